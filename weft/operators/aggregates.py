"""Aggregations over samples and score tables (G01, G28–G35 and friends).

All of these are single ``groupBy``/``agg`` steps: Spark computes partial aggregates on
the map side, so a hot key costs one partial row per task, not a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.text import word_count

MEDIA_TOKENS = 128


def source_histogram(df: DataFrame, key: str = "source") -> DataFrame:
    """Rows per source."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def turns_words(turns: Column) -> Column:
    return F.aggregate(turns, F.lit(0), lambda acc, t: acc + word_count(t["value"]))


def sample_length(df: DataFrame, name: str = "length") -> DataFrame:
    """White-space words over all turns, +128 when the sample has an image."""
    has_image = F.coalesce(F.size("images"), F.lit(0)) > 0
    return df.withColumn(
        name, turns_words(F.col("turns")) + F.when(has_image, F.lit(MEDIA_TOKENS)).otherwise(F.lit(0))
    )


def modality_length(df: DataFrame, name: str = "modality_length") -> DataFrame:
    """Word count, negative for text-only samples (Q18: one definition)."""
    has_image = F.coalesce(F.size("images"), F.lit(0)) > 0
    n = turns_words(F.col("turns"))
    return df.withColumn(name, F.when(has_image, n).otherwise(-n))
