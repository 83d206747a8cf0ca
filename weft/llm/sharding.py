"""K-d tree shards of near equal bytes (operator 4).

Rows are points in the space of their metadata: language and source, each by the rank of the
whole string among its different values, and the logarithm of the size. A node of the tree is to become so many shards of the target bytes. It is split
along the dimension in which its rows spread widest (as a part of the spread of all rows),
at the weighted median: the place in the order of that dimension where the running sum of
bytes passes the share of the shards on the left. Rows with equal values are ordered by
a hash, so one value may be cut anywhere. Nodes of one shard are leaves.

The running sums of all nodes of a level come from one range exchange over narrow rows
(:func:`weft.ids.prefix_sum`), so a node with most of the rows is spread over many tasks.
A row goes to the side that holds its middle byte, so a cut is off by at most half a row.

Defined results: a null text has no bytes; null metadata comes before all other values;
repeated rows are placed one by one; with fewer rows than shards some shards stay empty;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.ids import positions, prefix_sum
from weft.llm.batches import durable

SHARDS = 24
ROW_BYTES = 8  # a row's size beside its text
FEW_VALUES = 1000  # different strings whose ranks go to all tasks; more are joined by shuffling


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the rank of the whole string ``name`` among its different values; null is -1."""
    values = positions(rows.select(name).where(F.col(name).isNotNull()).distinct(), [name], name=f"{name}_place")
    if len(values.take(FEW_VALUES + 1)) <= FEW_VALUES:
        values = F.broadcast(values)
    return rows.join(values, name, "left").withColumn(f"{name}_place", F.coalesce(F.col(f"{name}_place").cast("double"), F.lit(-1.0)))


def points(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, the dimensions ``_d`` and a number ``_row`` of each row."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    metadata = [F.col(c).cast("string").alias(f"_{c}") for c in ("lang", "source")]
    rows = df.select(F.col(f"`{id_col}`"), size.alias("size"), crc.alias("text_crc32"), *metadata).withColumn("_row", F.monotonically_increasing_id())
    dims = F.array("_lang_place", "_source_place", F.log2(F.col("size").cast("double")))
    return _ranked(_ranked(durable(rows), "_lang"), "_source").select(f"`{id_col}`", "size", "text_crc32", dims.alias("_d"), "_row")


def _spreads(rows: DataFrame, dims: int, *group: str) -> DataFrame:
    """For each group its bytes and the array of its dimensions' spreads."""
    spread = [(F.max(F.col("_d")[k]) - F.min(F.col("_d")[k])) for k in range(dims)]
    return rows.groupBy(*group).agg(F.sum("size").alias("_bytes"), F.array(*spread).alias("_spread"))


def kd_shards(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``rows`` (see :func:`points`) with the number ``shard`` of each row's leaf.

    Either the number of shards is given, or the bytes that a shard is to have.
    """
    rows = durable(rows)
    dims = 3
    whole = _spreads(rows, dims).first()
    if not whole["_bytes"]:
        return rows.withColumn("shard", F.lit(0))
    leaves = shards or max(1, round(whole["_bytes"] / target_bytes))
    scale = F.array(*[F.lit(1.0 / s if s else 0.0) for s in whole["_spread"]])
    # _node is the number of the node's first leaf, _leaves how many it is to have
    todo = rows.withColumn("_node", F.lit(0)).withColumn("_leaves", F.lit(leaves))
    done = []
    for _ in range((leaves - 1).bit_length()):
        done.append(todo.where("_leaves = 1"))
        todo = todo.where("_leaves > 1")
        nodes = _spreads(todo, dims, "_node")
        relative = F.zip_with("_spread", scale, lambda s, k: s * k)
        nodes = nodes.select("_node", "_bytes", F.array_position(relative, F.array_max(relative)).cast("int").alias("_widest"))
        todo = todo.join(nodes, "_node").withColumn("_v", F.element_at("_d", F.col("_widest"))).drop("_widest")
        todo = prefix_sum(todo, ["_v", F.xxhash64("_row"), "_row"], "size", partition=["_node"], name="_before", inclusive=False)
        left = F.floor(F.col("_leaves") / 2).cast("int")
        goes_left = (F.col("_before") + F.col("size") / 2) * F.col("_leaves") <= F.col("_bytes") * left
        todo = todo.select(
            *rows.columns,
            F.when(goes_left, F.col("_node")).otherwise(F.col("_node") + left).alias("_node"),
            F.when(goes_left, left).otherwise(F.col("_leaves") - left).alias("_leaves"),
        )
    done.append(todo)
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out.select(*rows.columns, F.col("_node").alias("shard"))


def sharded_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    placed = kd_shards(points(documents), shards).drop("_d")
    placed = prefix_sum(placed, [F.xxhash64("_row"), "_row"], F.lit(1), partition=["shard"], name="slot", inclusive=False)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
