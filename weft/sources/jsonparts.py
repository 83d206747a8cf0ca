"""Large JSON arrays and objects, read by byte ranges.

A file that is one JSON array, or one object, has no line ends to split it at. Spark's text
source reads it by ranges all the same when its lines end in commas; what is not known in
a range is whether it begins inside a string, and at what depth. Both follow from the
ranges before it, and a range's part in them is three numbers:

1. the first pass gives for each range the parity of its quotes, and the change of depth
   for either state at its start; a running combination over the ranges of a file (as many
   rows as the driver lists splits) gives the state at each start;
2. the second pass cuts each range at the commas that are outside strings at depth one.
   Whole elements leave their task as they are. The pieces before the first cut and after
   the last one are put together with those of the neighbouring ranges: at most two rows a
   range are shuffled.

Strings, escapes and nesting are found by array operations on the bytes of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import ensure_checkpoint_dir

_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _COMMA = 34, 44
_OPEN, _CLOSE = (91, 123), (93, 125)


def _scan(spark: SparkSession, path) -> DataFrame:
    """(file, block, value): what stands between commas, in order within a block (a byte range of a file)."""
    lines = spark.read.option("lineSep", ",").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary"))


def _by_block(batches) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) of the runs of rows of one block; a run ends with a comma."""
    for rb in batches:
        files, blocks = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        start = 0
        for i in range(1, rb.num_rows + 1):
            if i == rb.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
                yield files[start], blocks[start], b",".join(rb.column(2).slice(start, i - start).to_pylist()) + b","
                start = i


def _structure(data: bytes, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, whether each is in a string, and the depth after each, from the state before the first."""
    if b"\\" in data:
        data = _ESCAPE.sub(b"  ", data)  # an escaped sign is a sign like others
    b = np.frombuffer(data, dtype=np.uint8)
    in_string = ((np.cumsum(b == _QUOTE) + inside) & 1).astype(bool)
    step = ((b == _OPEN[0]) | (b == _OPEN[1])).astype(np.int64) - ((b == _CLOSE[0]) | (b == _CLOSE[1]))
    step[in_string] = 0
    return b, in_string, depth + np.cumsum(step)


def _summaries(scan: DataFrame) -> DataFrame:
    """(file, block, quotes, outside, within, first): parity, change of depth by state, first sign of the block."""

    def run(batches):
        totals: dict[tuple, list] = {}
        for file, block, data in _by_block(batches):
            known = totals.setdefault((file, block), [0, 0, 0, ""])
            b, in_string, after = _structure(data, 0, 0)
            other = _structure(data, 1, 0)[2]
            changes = (int(after[-1]), int(other[-1]))
            known[1], known[2] = known[1] + changes[known[0]], known[2] + changes[1 - known[0]]
            known[0] ^= int(in_string[-1])
            known[3] = known[3] or data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode("latin-1")
        rows = [(f, b, *t) for (f, b), t in totals.items()]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "quotes", "outside", "within", "first"])

    return scan.mapInArrow(run, "file string, block long, quotes long, outside long, within long, first string")


def _starts(summaries: DataFrame) -> DataFrame:
    """(file, block, inside, depth): the state at the start of each block.

    The window is one file's list of splits, which the driver holds, too.
    """
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = summaries.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    change = F.when(F.col("inside") == 0, F.col("outside")).otherwise(F.col("within"))
    return states.withColumn("change", change).select("file", "block", "inside", F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth"))


def _cut(scan: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, block, part, text): whole elements (part 0), and the head (1), body (2) or tail (3) that a block shares."""

    def run(batches):
        key, state, held, cuts = None, (0, 0), b"", 0

        def finish():
            if key is not None and held:
                yield (*key, 3 if cuts else 2, held)

        for rb in batches:
            out: list[tuple] = []
            begin = dict(zip(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()), zip(rb.column(3).to_pylist(), rb.column(4).to_pylist())))
            for file, block, data in _by_block([rb]):
                if (file, block) != key:
                    out += finish()
                    key, state, held, cuts = (file, block), begin[file, block], b"", 0
                b, in_string, depth = _structure(data, *state)
                top_open = (depth == 1) & ~in_string & ((b == _OPEN[0]) | (b == _OPEN[1]))
                # an element begins behind the bracket that opens the whole, and ends before the one that closes it
                ends = ((b == _COMMA) & (depth == 1) & ~in_string) | top_open | ((depth == 0) & ~in_string & ((b == _CLOSE[0]) | (b == _CLOSE[1])))
                state, at = (int(in_string[-1]), int(depth[-1])), 0
                for e in np.flatnonzero(ends).tolist():
                    text, held = held + data[at:e], b""
                    out.append((file, block, 0 if cuts else 1, text))
                    cuts, at = cuts + 1, e + 1
                held += data[at:]
            yield _pieces(out)
        yield _pieces(list(finish()))

    # as many rows as splits, which the driver's own list has
    placed = scan.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "inside", "depth")
    return placed.mapInArrow(run, "file string, block long, part int, text binary")


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "part", "text"])


def ranges(spark: SparkSession, path) -> DataFrame:
    """What :func:`elements` must know of the byte ranges of the files; one row a range, durable."""
    ensure_checkpoint_dir(spark)
    return _summaries(_scan(spark, path)).checkpoint()


def first_signs(summaries: DataFrame) -> dict[str, str]:
    """The first sign of each file by its path: one entry a file, like the driver's own listing."""
    return {unquote(r["file"]): r["first"] for r in summaries.where("block = 0").select("file", "first").collect()}


def elements(spark: SparkSession, path, summaries: DataFrame | None = None) -> DataFrame:
    """(file, text): the elements of JSON arrays, or the ``"key": value`` members of JSON objects, one file one array or object."""
    scan = _scan(spark, path)
    pieces = _cut(scan, _starts(_summaries(scan) if summaries is None else summaries))
    whole = pieces.where("part = 0").select("file", "text")
    # a shared element is a tail, any bodies, and a head; heads end a group
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    shared = pieces.where("part > 0").withColumn("group", F.coalesce(F.sum((F.col("part") == 1).cast("int")).over(order), F.lit(0)))
    parts = shared.groupBy("file", "group").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("l"))
    joined = F.aggregate("l", F.lit(b""), lambda a, x: F.concat(a, x["text"]))
    texts = whole.union(parts.select("file", joined)).select("file", F.col("text").cast("string").alias("text"))
    return texts.where(~F.col("text").rlike(r"^[\s\x{FEFF},]*$"))
