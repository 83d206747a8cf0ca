"""Stable positions and keyed randomness.

Positions drive most of the reference's semantics (slices, shards, ignore lists), so they
must not depend on how Spark happens to partition the data:

* :func:`read_with_row_id` numbers rows in sorted-file order from parquet metadata
  (``_metadata.file_path`` / ``_metadata.row_index``) plus a per-file prefix sum. One
  extra metadata-only pass, no shuffle of the data.
* :func:`positions` numbers rows in any order, optionally within groups. It range-partitions
  on the full ordering key (so a group holding a third of the rows is spread over many
  tasks), numbers rows locally, checkpoints that result to the shared checkpoint folder,
  and adds per-(task, group) offsets from a small count table. No window ever holds a
  whole group.
* :func:`keyed_hash` replaces ``random``: ``h(seed, key)`` is the first 8 hex digits of an
  md5, identical in DuckDB as ``('0x'||substr(md5(..),1,8))::BIGINT``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import ensure_checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id packs (partition << 33) + local index


def keyed_hash(seed: int | str, *keys: Column | str) -> Column:
    """Deterministic 32-bit hash of ``seed|key`` as a non-negative bigint."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    key = parts[0].cast("string") if len(parts) == 1 else F.concat_ws("|", *[p.cast("string") for p in parts])
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def keyed_hash_sql(seed: int | str, key_sql: str) -> str:
    """The DuckDB twin of :func:`keyed_hash` for oracle SQL."""
    return f"('0x' || substr(md5('{seed}|' || CAST({key_sql} AS VARCHAR)), 1, 8))::BIGINT"


def read_with_row_id(spark: SparkSession, path: str, name: str = "row_id") -> DataFrame:
    """Scan parquet and add globally consecutive row ids in sorted-file order.

    The per-file table has one row per file, the same size as the file listing the
    driver already holds, so broadcasting it is bounded.
    """
    scan = spark.read.parquet(path)
    meta = scan.select(
        F.col("_metadata.file_path").alias("_wf_file"), F.col("_metadata.row_index").alias("_wf_idx"), *scan.columns
    )
    counts = (
        scan.select(F.col("_metadata.file_path").alias("_wf_file"))
        .groupBy("_wf_file")
        .agg(F.count(F.lit(1)).alias("_wf_n"))
    )
    # the count table is one row per file: a window without partition is fine here
    w = Window.orderBy("_wf_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_wf_file", F.coalesce(F.sum("_wf_n").over(w), F.lit(0)).alias("_wf_off"))
    return (
        meta.join(F.broadcast(offsets), "_wf_file")
        .withColumn(name, (F.col("_wf_off") + F.col("_wf_idx")).cast("bigint"))
        .drop("_wf_file", "_wf_idx", "_wf_off")
    )


def _order_cols(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _per_task(offsets: DataFrame, part: Sequence[str]) -> DataFrame:
    """Offsets of tasks as a join side. Without groups it has one row per task of the range
    exchange, a number that the plan sets, and is broadcast; with groups it may have any
    size, so AQE chooses the join by its bytes."""
    return offsets if part else F.broadcast(offsets)


def positions(
    df: DataFrame,
    order: Sequence[Column | str],
    partition: Sequence[str] = (),
    name: str = "pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """0-based position of each row in ``order`` (within ``partition`` groups).

    ``order`` must end in a unique key, otherwise ties are numbered arbitrarily.
    Skew-safe: the range exchange samples the full key (groups + order), so one hot
    group spreads over many tasks; the only per-group state is one count per task.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    part = list(partition)
    keys = [F.col(p) for p in part] + _order_cols(order)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    mid = F.monotonically_increasing_id()
    local = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_wf_mid", mid)
        .withColumn("_wf_task", F.shiftright("_wf_mid", _LOCAL_BITS))
    )
    # pin task ids: a later recomputation could pick different range bounds
    local = local.checkpoint(eager=True)
    grp = part + ["_wf_task"]
    counts = local.groupBy(*grp).agg(
        F.count(F.lit(1)).alias("_wf_n"), F.min("_wf_mid").alias("_wf_first")
    )
    w = Window.partitionBy(*part).orderBy("_wf_task") if part else Window.orderBy("_wf_task")
    offsets = counts.select(
        *grp,
        "_wf_first",
        F.coalesce(F.sum("_wf_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_wf_off"),
    )
    offsets = _per_task(offsets, part)
    out = local.join(offsets, grp).withColumn(
        name, (F.col("_wf_off") + F.col("_wf_mid") - F.col("_wf_first")).cast("bigint")
    )
    return out.drop("_wf_mid", "_wf_task", "_wf_n", "_wf_first", "_wf_off")


def group_counts(df: DataFrame, partition: Sequence[str], name: str = "n") -> DataFrame:
    """Per-group row counts attached to every row (a pre-aggregated join, not a window)."""
    part = list(partition)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias(name))
    if part:
        return df.join(counts, part)
    # a single-row table: attach it through a constant key
    return df.withColumn("_wf_one", F.lit(1)).join(F.broadcast(counts.withColumn("_wf_one", F.lit(1))), "_wf_one").drop(
        "_wf_one"
    )


def positions_by_key(
    df: DataFrame, key: Sequence[str], order: Sequence[Column | str], partition: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """:func:`positions` over the key columns alone, joined back: payload columns (texts)
    are neither sorted nor checkpointed. ``key`` is unique and holds what ``order`` and
    ``partition`` read."""
    narrow = positions(df.select(*dict.fromkeys([*key, *partition])), order, partition, name)
    return df.join(narrow.select(*key, name), list(key))


def prefix_sum(
    df: DataFrame,
    order: Sequence[Column | str],
    value: Column | str,
    partition: Sequence[str] = (),
    name: str = "cum",
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Running sum of ``value`` in ``order`` (within ``partition`` groups), skew-safe."""
    return prefix_sums(df, order, {name: value}, partition, inclusive, num_partitions)


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    values: dict[str, Column | str],
    partition: Sequence[str] = (),
    inclusive: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Running sums of several values (name -> column) in one pass.

    Same plan as :func:`positions`: range exchange on the full key, local running
    sums inside each task (a window over the task id, which is already co-located), then
    the totals of earlier tasks added from a small per-(group, task) table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    part = list(partition)
    keys = [F.col(p) for p in part] + _order_cols(order)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = {f"_wf_v{i}": (F.col(v) if isinstance(v, str) else v) for i, v in enumerate(values.values())}
    local = (
        df.withColumns(own)
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_wf_mid", F.monotonically_increasing_id())
        .withColumn("_wf_task", F.shiftright("_wf_mid", _LOCAL_BITS))
    ).checkpoint(eager=True)
    grp = part + ["_wf_task"]
    # rows of one task are co-located, so this window's partition is local to the task
    wl = Window.partitionBy(*grp).orderBy("_wf_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("*", *[F.sum(v).over(wl).alias(f"{v}_l") for v in own])
    totals = local.groupBy(*grp).agg(*[F.sum(v).alias(f"{v}_t") for v in own])
    w = (Window.partitionBy(*part) if part else Window).orderBy("_wf_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*grp, *[F.coalesce(F.sum(f"{v}_t").over(w), F.lit(0)).alias(f"{v}_o") for v in own])
    out = local.join(_per_task(offsets, part), grp)
    sums = {
        name: F.col(f"{v}_o") + F.col(f"{v}_l") - (F.lit(0) if inclusive else F.col(v)) for name, v in zip(values, own)
    }
    return out.withColumns(sums).drop("_wf_mid", "_wf_task", *[f"{v}{x}" for v in own for x in ("", "_l", "_o")])
