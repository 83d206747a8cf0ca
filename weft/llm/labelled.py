"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of each class that a classifier is fitted on, at most.
FIT_PER_CLASS = 2_500
#: Longer documents are scored like any other, but not fitted on.
FIT_CHARS = 40_000


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a row without an id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit_sample(documents: DataFrame, labels: DataFrame, target: str, extra=(), per_class: int = FIT_PER_CLASS, max_chars: int = FIT_CHARS) -> list:
    """Rows (text, y, *extra) of at most ``2 * per_class`` labelled documents that aren't held out.

    The documents of a class are taken in hash order, so the sample is the same in every
    run. Rows without an id, label or text, and ids with contradicting labels, are left
    out; an id that occurs more than once counts once, with its least text.
    """
    known = (
        labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(target).cast("int").alias("y"), F.max(target).cast("int").alias("_top"))
        .where("y = _top")
        .select("doc_id", "y")
    )
    usable = documents.where(F.col("text").isNotNull() & (F.char_length("text") <= max_chars)).select(F.col("doc_id").alias("_id"), "text", *extra)
    # which ids: narrow join, then a distributed top-n by hash for each class
    ids = usable.select("_id").join(known, F.col("_id") == F.col("doc_id")).select("doc_id", "y").distinct()
    picked = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    picked = {r["doc_id"]: r["y"] for r in picked.collect()}  # at most 2 * per_class ids
    if not picked:
        return []
    chosen = documents.sparkSession.createDataFrame(sorted(picked.items()), T.StructType([ids.schema["doc_id"], T.StructField("y", T.IntegerType())]))
    rows = (
        usable.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id"))
        .groupBy("doc_id", "y")
        .agg(F.min(F.struct("text", *extra)).alias("row"))
        .select("doc_id", "y", "row.*")
    )
    return sorted(rows.collect(), key=lambda r: r["doc_id"])


def class_counts(labels: DataFrame, target: str) -> tuple[int, int]:
    """Label rows of class 0 and 1 that aren't held out."""
    rows = labels.where(F.col(target).isin(0, 1) & ~held_out()).groupBy(target).count().collect()
    found = {r[0]: r[1] for r in rows}
    return found.get(0, 0), found.get(1, 0)
