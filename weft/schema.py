"""Canonical schemas shared by adapters, shaping operators and metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
TURNS = T.ArrayType(TURN)

# Sample: one training example, every dataset adapter projects into this.
SAMPLE = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("images", T.ArrayType(T.StringType())),
        T.StructField("video", T.StringType()),
        T.StructField("turns", TURNS),
        T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    ]
)
SAMPLE_COLUMNS = [f.name for f in SAMPLE.fields]

IMAGE_TOKEN = "<image>"
VIDEO_TOKEN = "<video>"
IGNORE_INDEX = -100


def turn(role: str | Column, value: Column | str) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    v = F.col(value) if isinstance(value, str) else value
    return F.struct(r.alias("from"), v.cast("string").alias("value"))


def no_images() -> Column:
    return F.array().cast("array<string>")


def no_extras() -> Column:
    return F.create_map().cast("map<string,string>")


def to_sample(
    dataset: str,
    sample_id: Column,
    row_id: Column | str,
    turns: Column,
    images: Column | None = None,
    video: Column | None = None,
    extras: Column | None = None,
) -> list[Column]:
    """Projection list for the canonical Sample columns."""
    rid = F.col(row_id) if isinstance(row_id, str) else row_id
    return [
        sample_id.cast("string").alias("sample_id"),
        F.lit(dataset).alias("dataset"),
        rid.cast("bigint").alias("row_id"),
        (images if images is not None else no_images()).cast("array<string>").alias("images"),
        (video if video is not None else F.lit(None)).cast("string").alias("video"),
        turns.cast(TURNS).alias("turns"),
        (extras if extras is not None else no_extras()).cast("map<string,string>").alias("extras"),
    ]
