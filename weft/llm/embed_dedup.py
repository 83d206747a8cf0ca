"""Near-duplicate embeddings by cross-polytope hashing (operator 8).

A vector, padded to a power of two and brought to length one, is turned by three rounds of
random signs and a fast Hadamard transform; its hash is the axis, with sign, of its
greatest coordinate. ``FUNCTIONS`` such hashes make a bucket of one of ``TABLES`` tables.
Besides its own bucket a vector probes those in which one hash is replaced by the runner-up
axis. Vectors of one label (and dimension) that meet in a bucket are compared by cosine in
double precision.

Equal vectors are grouped first and stand in the index once, with their number. Buckets
are cut into blocks by a hash of the vector, and each pair of blocks is a task's work of
bounded size, however large the bucket. A pair that meets in several buckets counts in the
first one only, which both vectors' codes tell, so nothing but numbers of links and local
components leaves the tasks: no pairs.

Defined results: a vector that is null, empty or zero, or holds a null or a component that
isn't finite, and any vector without a label, has no links; so has one of another
dimension; copies link to each other; rows with a null id link but give no component its
name unless they are alone; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm.batches import durable
from weft.llm.graph import components

COSINE = 0.98
TABLES = 6
FUNCTIONS = 3
BLOCK = 512  # vectors of a bucket in one block


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width, h = len(x), x.shape[1], 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def codes(unit: np.ndarray, tables: int = TABLES, functions: int = FUNCTIONS, seed: int = 0) -> np.ndarray:
    """(vectors, tables, 1 + functions) bucket numbers: the own one, then those with one hash replaced."""
    width = 1 << max(1, unit.shape[1] - 1).bit_length()
    padded = np.zeros((len(unit), width))
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    rows = np.arange(len(unit))
    out = np.zeros((len(unit), tables, 1 + functions), dtype=np.int64)
    for t in range(tables):
        best, second = np.empty((2, functions, len(unit)), dtype=np.int64)
        for k in range(functions):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice([-1.0, 1.0], width))
            size = np.abs(x)
            best[k] = size.argmax(axis=1)
            sign = x[rows, best[k]] < 0
            size[rows, best[k]] = -1
            second[k] = size.argmax(axis=1)
            best[k], second[k] = 2 * best[k] + sign, 2 * second[k] + (x[rows, second[k]] < 0)
        place = (2 * width) ** np.arange(functions)[:, None]
        own = (best * place).sum(axis=0)
        out[:, t, 0] = own
        for k in range(functions):
            out[:, t, 1 + k] = own + (second[k] - best[k]) * place[k]
    return out


def _unit(batch: pa.Array) -> np.ndarray:
    v = np.asarray(batch.flatten(), dtype=np.float64).reshape(len(batch), -1)
    # by the greatest component first, so that the squares of very small or large ones stay in range
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _with_codes(classes: DataFrame) -> DataFrame:
    """``classes`` (_class, label, v, copies, _low) with the array of their bucket numbers, table by table."""

    def run(batches):
        for rb in batches:
            vectors = rb.column(rb.schema.get_field_index("v"))
            dims = np.asarray(pc.list_value_length(vectors))
            for d in np.unique(dims):
                some = rb.filter(pa.array(dims == d))
                found = codes(_unit(some.column(rb.schema.get_field_index("v"))))
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found[0].size), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, rows], names=[*rb.schema.names, "codes"])

    return classes.mapInArrow(run, T.StructType([*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))


def _groups(batches) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values in the first two columns, out of sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for rb in batches:
        if not rb.num_rows:
            continue
        key = np.stack([np.asarray(rb.column(0)), np.asarray(rb.column(1))])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), key.shape[1]]
        for a, b in zip(cuts, cuts[1:]):
            if held and [held[0].column(k)[0].as_py() for k in (0, 1)] != key[:, a].tolist():
                yield _joined(held)
                held = []
            held.append(rb.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """The least row that links reach, for each row of a symmetric matrix."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root, len(root)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _compare(group: pa.RecordBatch, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(class, linked vectors counted here, local root's class) of the classes with a link in a group."""
    ids = np.asarray(group.column("_class"))
    table = group.column("table")[0].as_py()
    own = np.asarray(group.column("own"))
    side = np.asarray(group.column("side"))
    unit = _unit(group.column("v"))
    linked = unit @ unit.T >= cosine
    # one vector of a pair must be in its own bucket; two different blocks meet across only
    linked &= own[:, None] | own[None, :]
    linked &= (side == 0)[:, None] | (side[:, None] != side[None, :])
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(linked)
    if not len(a):
        return None
    found = np.asarray(group.column("codes").flatten()).reshape(len(ids), -1, 1 + FUNCTIONS)
    # of two buckets of this table, that of the lower class comes first
    low, high = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    first = own[low] | ~(found[low, table, :1] == found[high, table]).any(axis=1)
    for t in range(table):
        met = (found[a, t, :1] == found[b, t]).any(axis=1) | (found[b, t, :1] == found[a, t]).any(axis=1)
        first &= ~met
    number = np.bincount(a, weights=np.asarray(group.column("copies"))[b] * first, minlength=len(ids)).astype(np.int64)
    some = np.flatnonzero(linked.any(axis=1))
    return ids[some], number[some], ids[_local_roots(linked)[some]]


def class_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(_class, n, root) rows: links found in one place, and a class that they reach."""
    probes = 1 + FUNCTIONS
    hashed = classes.select("_class", "label", "dims", F.posexplode("codes").alias("_at", "bucket"))
    hashed = hashed.select("_class", "label", "dims", "bucket", F.floor(F.col("_at") / probes).cast("int").alias("table"), (F.col("_at") % probes == 0).alias("own"))
    place = ["label", "dims", "table", "bucket"]
    sizes = hashed.groupBy(*place).agg(F.count("*").alias("_n"), F.max("own").alias("_any")).where("_n > 1 and _any")
    met = hashed.join(sizes, place).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    met = met.withColumn("_block", F.pmod(F.hash("_class"), F.col("_blocks")))
    # a block meets itself and every other one; side tells the two blocks of a pair apart
    met = met.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    i, j = F.least("_block", "_other"), F.greatest("_block", "_other")
    side = F.when(F.col("_block") == F.col("_other"), 0).when(F.col("_block") < F.col("_other"), 1).otherwise(2)
    # two hashes name a group, so that no two groups fall together
    keys = [F.xxhash64(F.lit(k), *place, i, j).alias(f"_key{k}") for k in (0, 1)]
    dealt = met.select(*keys, "_class", "table", "own", side.alias("side")).join(classes.select("_class", "v", "codes", "copies"), "_class")

    def run(batches):
        for group in _groups(batches):
            if group.num_rows > 1 and (found := _compare(group, cosine)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["_class", "n", "root"])

    ordered = dealt.select("_key0", "_key1", "_class", "table", "own", "side", "v", "codes", "copies")
    ordered = ordered.repartition("_key0", "_key1").sortWithinPartitions("_key0", "_key1")
    return ordered.mapInArrow(run, "_class long, n long, root long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component_id and kept of every vector."""
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    rows = durable(rows.withColumn("_ok", usable("v") & F.col("label").isNotNull()))
    good = rows.where("_ok")
    classes = good.groupBy("label", "v").agg(F.min("_id").alias("_low"), F.count("*").alias("copies"))
    # the number of a class is fixed before anything joins by it
    classes = durable(classes.withColumn("dims", F.size("v")).withColumn("_class", F.monotonically_increasing_id()))
    classes = durable(_with_codes(classes))
    found = durable(class_links(classes, cosine))
    numbers = found.groupBy("_class").agg(F.sum("n").alias("_n"))
    roots = components(found.select(F.col("_class").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "_class", "root": "_root"})
    named = classes.join(numbers, "_class", "left").join(roots, "_class", "left").withColumn("_root", F.coalesce("_root", "_class"))
    low = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = named.join(low, "_root").select("label", "v", (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "v"]).select("_id", "n_links", "component_id")
    alone = rows.where("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    out = linked.union(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))
