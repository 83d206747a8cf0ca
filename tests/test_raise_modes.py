"""Modes that end the job: they do so for a bad row, and leave good rows as they are."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from weft.operators import filters as P
from weft.sources import tarshards as TS


def test_on_failure(spark):
    df = spark.createDataFrame([(1, None), (2, "no such file")], "row_id long, error string")
    assert [r["row_id"] for r in P.on_failure(df.where("row_id = 1")).collect()] == [1]
    with pytest.raises(PySparkException, match="row failed: no such file"):
        P.on_failure(df).collect()


def test_media_counts(spark):
    schema = "id long, turns array<struct<from:string,value:string>>, images array<string>"
    df = spark.createDataFrame([(1, [("human", "<image> a")], ["x"]), (2, [("human", "a")], ["x"])], schema)
    assert [r["id"] for r in P.check_media_counts(df.where("id = 1"), "raise").collect()] == [1]
    with pytest.raises(PySparkException, match="number mismatch"):
        P.check_media_counts(df, "raise").collect()


def _desc(**more):
    import json

    return json.dumps({"wids_version": 1, **more})


@pytest.mark.parametrize(
    "json, message",
    [
        (_desc(shardlist=[]), "No shards found"),
        (_desc(datasets=[{"source_url": "http://h/a.json"}]), "refer to each other"),
        (_desc(datasets=[{"source_url": "http://h/none.json"}]), "not fetched"),
        ('{"wids_version": 2}', "Unknown wids_version"),
    ],
)
def test_indices(spark, json, message):
    known = spark.createDataFrame([("http://h/a.json", _desc(datasets=[{"source_url": "../a.json"}]))], "url string, json string")
    with pytest.raises(PySparkException, match=message):
        TS.resolve_index(spark.createDataFrame([(1, json)], "desc_id int, json string"), fetched=known).collect()


def test_urls(spark):
    from pyspark.sql import functions as F

    cases = [("a.tar", "http://h/x/y", "http://h/x/y/a.tar"), ("../a.tar", "http://h/x/y/", "http://h/x/a.tar"), ("../../../a.tar", "http://h/x", "http://h/a.tar"),
             ("./b/../a.tar?q=../1", "http://h/x", "http://h/x/a.tar?q=../1"), ("/r/a.tar", "http://h/x", "http://h/r/a.tar"), ("s3://k/a", "http://h/x", "s3://k/a"),
             ("a.tar", None, "a.tar"), ("../a.tar", "x/y", "x/a.tar"), ("../../../a.tar", "x/y", "../a.tar")]
    df = spark.createDataFrame(cases, "url string, base string, want string")
    assert [r[0] for r in df.select(TS.rebase(F.col("url"), F.col("base"))).collect()] == [c[2] for c in cases]


def test_spellings_of_a_url_are_folded(spark):
    cases = [
        ("http://host/top/../one/0.json", "http://host/one/0.json"),
        ("http://host/../a/./b.json?x=../y", "http://host/a/b.json?x=../y"),
        ("s3://bucket/a//b.json", "s3://bucket/a//b.json"),
        ("http://host", "http://host"),
        ("a/../b.json", "b.json"),
        ("..a/b..json", "..a/b..json"),
        (None, None),
    ]
    df = spark.createDataFrame(cases, "url string, folded string")
    assert [r[0] for r in df.select(TS.folded_url(df["url"])).collect()] == [c[1] for c in cases]
