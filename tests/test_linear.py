"""Long inputs take time that grows with their length, and odd numbers don't end the job."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from weft.functions.answers import normalise_answer
from weft.functions.choices import extract_answer, normalise_extraction, parse_choice
from weft.operators import prefs as R
from weft.operators.messages import strip_ws
from weft.operators.windows import pack_padded

TOKENS = 1_048_576


@pytest.fixture(scope="module")
def long_ids(spark):
    """A million tokens, in turns of 1000 that begin with marker 3 or 5."""
    token = F.when(F.col("id") % 1000 == 0, F.when(F.col("id") % 2000 == 0, 3).otherwise(5)).otherwise(F.col("id") % 89 + 10)
    ids = spark.range(TOKENS).select("id", token.cast("int").alias("t")).groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("l"))
    return ids.select(F.transform("l", lambda x: x["t"]).alias("ids")).checkpoint()


def _counts(df, column):
    """Kept tokens, and their places' sum; nothing of the million tokens goes to the driver."""
    start = time.time()
    kept = df.select(F.transform(column, lambda t, i: F.when(t != -100, i.cast("long"))).alias("p"))
    kept = kept.select(F.size("p").alias("n"), F.filter("p", lambda x: x.isNotNull()).alias("p"))
    [row] = kept.select("n", F.size("p").alias("k"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x).alias("s")).collect()
    assert time.time() - start < 60
    return tuple(row)


def test_masks_of_a_million_tokens(spark, long_ids):
    places = [i for i in range(TOKENS) if i // 1000 % 2 == 1 and i % 1000]
    want = (TOKENS, len(places), sum(places))
    assert _counts(long_ids, R.mask_by_markers("ids", instruction=3, response=5)) == want
    assert _counts(long_ids, R.mask_by_marker_tokens("ids", [5], [3])) == want
    assert _counts(long_ids, R.mask_interleaved("ids", image=5, sep=3))[1] == want[1] + sum(1 for i in range(1000, TOKENS, 2000))
    template = long_ids.select("ids", F.filter("ids", lambda t, i: (i / 1000).cast("int") % 2 == 0).alias("tpl"))
    assert _counts(template, R.mask_by_template("ids", "tpl"))[0] == TOKENS


def test_padded_rows_of_many_texts(spark):
    df = spark.range(20_000).select(F.lit(1).alias("b"), F.col("id"), F.array(F.lit(1), F.lit(2)).alias("t"))
    start = time.time()
    rows = pack_padded(df, "t", "b", "id", 30_000).agg(F.count("*"), F.sum(F.size("input_ids"))).collect()
    assert tuple(rows[0]) == (2, 60_000) and time.time() - start < 30


def test_runs_of_blanks(spark):
    run = " " * 1_000_000
    df = spark.createDataFrame([(run + "a" + run + "b" + run,)], "t string")
    start = time.time()
    letters = F.array(F.lit("A"), F.lit("B"))
    row = df.select(
        normalise_answer("t").alias("n"), F.length(strip_ws(F.col("t"))).alias("s"), parse_choice(F.concat(F.col("t"), F.lit("(B)" + "." * 1000)), letters, key=F.lit("k")).alias("c")
    ).collect()[0]
    assert (row["n"], row["s"], row["c"]) == ("a b", 1_000_002, "B") and time.time() - start < 60


def test_numbers_of_any_length(spark):
    texts = ["0" * 30 + "1234567890123456789012345", "-0", " -007 ", "+12", "1.5", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in df.select(extract_answer("r", F.lit("free_form"), F.lit("integer"), none)).collect()]
    assert got == ["1234567890123456789012345", "0", "-7", "12", None, None, ""]
    numbers = ["1e30", "-1e30", "NaN", "inf", "9007199254740993", "1e19", "-7.9", "2.5e15", "x", "1e300", "18446744073709551616"]
    df = spark.createDataFrame([(t,) for t in numbers], "r string")
    got = [r[0] for r in df.select(normalise_extraction("r", none, F.lit("free_form"), F.lit("integer"), F.lit(1))).collect()]
    want = [str(int(float(t))) if t not in ("NaN", "inf", "x", "1e300") else None for t in numbers]
    assert got == want
