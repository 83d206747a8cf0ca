"""Arrow batch helpers shared by the operators that run numpy inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weft.session import ensure_checkpoint_dir

#: Bytes of text handed to an operator at once.
CHUNK_CHARS = 2_000_000
#: Rows of an Arrow batch, at most: whole texts pass through, so batches are kept small.
BATCH_ROWS = 1_000

_TEXT = "__llm_text"


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless they are smaller already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def spare_memory() -> None:
    """Give what earlier tasks of this worker have freed, models and batches, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list], Sequence]],
    fields: str,
    keep: Sequence[str] = (),
    text: str = "text",
    binary: bool = False,
) -> DataFrame:
    """Columns computed from a text column, one Arrow chunk at a time.

    ``make()`` runs once per task and returns ``fn(texts)``, which gives one array per
    field of the DDL string ``fields``. Null texts arrive as empty ones. The result holds
    the ``keep`` columns and the fields; a kept column with the name of a field gives way
    to it. No other column of ``df`` is read.
    """
    out = T.StructType.fromDDL(fields)
    names = {f.name for f in out.fields}
    kept = [c for c in keep if c not in names]
    small_batches(df.sparkSession)
    if text in kept and not binary and df.schema[text].dataType == T.StringType():
        sel, place = df.select(*[F.col(f"`{c}`") for c in kept]), kept.index(text)  # the text goes once
    else:
        source = F.col(text).cast("binary" if binary else "string")
        sel, place = df.select(*[F.col(f"`{c}`") for c in kept], source.alias(_TEXT)), len(kept)
    schema = T.StructType([f for f in sel.schema.fields if f.name != _TEXT] + out.fields)
    arrow = to_arrow_schema(schema)
    empty = b"" if binary else ""

    def run(batches):
        spare_memory()
        fn = make()
        for rb in batches:
            for part in text_runs(rb, place):
                texts = [empty if t is None else t for t in part.column(place).to_pylist()]
                cols = fn(texts)
                arrays = [part.column(i) for i in range(len(kept))]
                arrays += [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(len(kept) + i).type) for i, c in enumerate(cols)]
                arrays = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(arrays)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return sel.mapInArrow(run, schema)


def text_runs(rb: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``CHUNK_CHARS`` bytes of text each.

    Only one slice at a time has to be held as Python strings; a longer text makes a
    slice of its own.
    """
    sizes = pc.fill_null(pc.binary_length(rb.column(column)), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > CHUNK_CHARS:
            yield rb.slice(start, i - start)
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield rb.slice(start)
