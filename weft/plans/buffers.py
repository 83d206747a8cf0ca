"""Restarting buffers over an ordered stream of texts.

A buffer takes texts until it holds ``size`` characters or more; the next buffer starts
with the text after. Where a buffer starts thus depends on where the one before started,
but for every text the start *after* a buffer that began there is a plain function of the
running sums: the first text at which the sum has grown by ``size``. The starts that the
stream really has are the path from the first text along that function. It is found in
three steps, none of which needs the order in one place:

1. each text's successor, from one range sort of the running sums together with the sums
   that are asked for;
2. in blocks of consecutive texts, the place at which a path that enters at a text leaves
   the block, and from these the places that paths can enter at all, a small share of the
   texts; the path over them by pointer doubling;
3. in each block, the walk from the place where the path enters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.ids import prefix_sum, prefix_sums
from weft.session import ensure_checkpoint_dir

#: Consecutive texts that one group of the block steps holds (integers only).
BLOCK = 1 << 16


def _durable(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _successors(points: DataFrame, size: int) -> DataFrame:
    """(i, next): the text at which the buffer after one that starts at ``i`` starts.

    It is one past the first text whose running sum reaches ``size`` more than the sum
    before ``i``. A sum that is asked for sorts before the texts of the same sum, so the
    texts counted before it are those that end below.
    """
    texts = points.select(F.col("sum").alias("v"), F.lit(1).alias("is_text"), "i")
    asked = points.select((F.col("sum") - F.col("chars") + size).alias("v"), F.lit(0).alias("is_text"), "i")
    below = prefix_sum(texts.union(asked), ["v", "is_text", "i"], F.col("is_text").cast("bigint"), name="below")
    return below.where("is_text = 0").select("i", (F.col("below") + 2).alias("next"))


def _leaving(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where a path that enters a block at ``i`` leaves it, for every ``i``; last text first."""
    pdf = pdf.sort_values("i")
    first, out = int(pdf["i"].iloc[0]), pdf["next"].tolist()
    for k in range(len(out) - 1, -1, -1):
        if out[k] - first < len(out):
            out[k] = out[out[k] - first]
    return pd.DataFrame({"i": pdf["i"].to_numpy(), "leaves": np.array(out, dtype=np.int64)})


def _walked(pdf: pd.DataFrame) -> pd.DataFrame:
    """Starts up to each text of a block, counted from the place where the path enters it."""
    pdf = pdf.sort_values("i")
    ids, following = pdf["i"].to_numpy(), pdf["next"].tolist()
    starts = np.zeros(len(ids), dtype=np.int64)
    at = pdf["enters"].iloc[0]
    at = len(ids) if pd.isna(at) else int(at) - int(ids[0])
    while at < len(ids):
        starts[at] = 1
        at = following[at] - int(ids[0])
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "i": ids, "local": starts.cumsum()})


def _path(hops: DataFrame) -> DataFrame:
    """Places reached from text 1 along (i, leaves), by pointer doubling.

    After ``k`` rounds the reached set holds all places within ``2**k`` hops, and a hop of
    the table spans as many, so rounds grow with the logarithm of the number of blocks.
    """
    reached, size = hops.where("i = 1").select("i"), 1
    # a hop past the last text ends the path; its place is no text, though its number may lie in the last block
    hops = hops.join(hops.select(F.col("i").alias("leaves")), "leaves", "left_semi").select("i", "leaves")
    while True:
        further = reached.join(hops, "i").select(F.col("leaves").alias("i"))
        reached = _durable(reached.union(further).distinct())
        if (now := reached.count()) == size:
            return reached
        size = now
        onward = hops.select(F.col("i").alias("leaves"), F.col("leaves").alias("_far"))
        hops = _durable(hops.join(onward, "leaves").select("i", F.col("_far").alias("leaves")))


def restarting_buffers(df: DataFrame, chars: str, order: Sequence[str], size: float, name: str = "buffer", block: int = BLOCK) -> DataFrame:
    """``df`` with the number of the buffer that each row belongs to, in ``order`` (a unique key).

    A null count of characters is zero. Work and shuffles are those of two range sorts of
    narrow rows; blocks hold ``block`` rows of integers.
    """
    if not size > 0:
        raise ValueError("size must be positive")
    narrow = df.select(*order, F.coalesce(F.col(chars).cast("bigint"), F.lit(0)).alias("_wf_chars"))
    sums = prefix_sums(narrow, list(order), {"_wf_sum": "_wf_chars", "_wf_i": F.lit(1).cast("bigint")})
    points = sums.select(F.col("_wf_i").alias("i"), F.col("_wf_sum").alias("sum"), F.col("_wf_chars").alias("chars"))
    steps = _durable(_successors(points, math.ceil(size)).withColumn("block", F.floor((F.col("i") - 1) / block)))
    exits = _durable(steps.groupBy("block").applyInPandas(_leaving, "i bigint, leaves bigint"))
    entered = exits.select(F.col("leaves").alias("i")).union(exits.where("i = 1").select("i")).distinct()
    entries = _path(_durable(exits.join(entered, "i", "left_semi"))).select(F.floor((F.col("i") - 1) / block).alias("block"), F.col("i").alias("enters"))
    # a path enters a block once, so there is a row a block at most
    walked = _durable(steps.join(entries, "block", "left").groupBy("block").applyInPandas(_walked, "block bigint, i bigint, local bigint"))
    before = prefix_sum(walked.groupBy("block").agg(F.max("local").alias("n")), ["block"], "n", name="before", inclusive=False)
    numbered = walked.join(before.select("block", "before"), "block").select(F.col("i").alias("_wf_i"), (F.col("before") + F.col("local") - 1).alias(name))
    return df.join(sums.select(*order, "_wf_i").join(numbered, "_wf_i").drop("_wf_i"), list(order))
