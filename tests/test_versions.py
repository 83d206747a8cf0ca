from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from weft.sources.versions import KeyedTable
from weft.streaming.jobs import stream_incremental_eval, stream_pack_constant, stream_prompt_advantages, work_dir


def _table(spark):
    return KeyedTable(spark, work_dir(spark, "keyed"), "id long, label string, n int", ["id"])


def _rows(df):
    return {r["id"]: (r["label"], r["n"]) for r in df.collect()}


def test_upserts_replace_and_versions_stay(spark):
    t, want = _table(spark), {}
    assert _rows(t.load()) == {} and t.versions() == []
    history = []
    for k in range(6):
        new = {i: (f"v{k}", k if i % 2 else None) for i in range(k, 40, k + 1)} | ({None: (None, k)} if k == 4 else {})
        t.upsert(spark.createDataFrame([(i, *v) for i, v in new.items()], t.schema))
        want |= new
        history.append(dict(want))
        assert _rows(t.load()) == want
    assert [_rows(t.load(v)) for v in t.versions()] == history
    assert len(t.runs()) <= 5
    t.compact()
    assert len(t.runs()) == 1 and _rows(t.load()) == want
    t.vacuum(1)
    assert len(t.versions()) == 1 and _rows(t.load()) == want


def test_a_reader_during_a_save_sees_one_version(spark):
    t = _table(spark)
    t.upsert(spark.createDataFrame([(1, "old", 1), (2, "old", 2)], t.schema))
    reader = t.load()

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    commit, t._commit = t._commit, stop
    with pytest.raises(Stop):  # all rows are written, the version isn't there yet
        t.upsert(spark.createDataFrame([(2, "new", 0), (3, "new", 0)], t.schema))
    assert _rows(t.load()) == _rows(reader) == {1: ("old", 1), 2: ("old", 2)}
    t._commit = commit
    t.upsert(spark.createDataFrame([(2, "new", 0)], t.schema))
    assert _rows(reader) == {1: ("old", 1), 2: ("old", 2)}
    assert _rows(t.load()) == {1: ("old", 1), 2: ("new", 0)}


def test_two_writers_of_one_version(spark):
    t = _table(spark)
    t.upsert(spark.createDataFrame([(1, "a", 1)], t.schema), version=5)
    assert t.upsert(spark.createDataFrame([(1, "b", 1)], t.schema), version=5) == 5  # a repeated batch
    assert _rows(t.load()) == {1: ("a", 1)}
    with pytest.raises(ValueError):
        t._commit(5, [])
    with pytest.raises(ValueError):
        t.load(7)
    with pytest.raises(ValueError):
        KeyedTable(spark, t.root, "id long", ["other"])


def _bytes(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root.removeprefix("file:")) for f in names if f.endswith(".parquet"))


def test_bytes_written_follow_the_batch(spark):
    t = _table(spark)
    many = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("label"), F.lit(1).alias("n"))
    t.upsert(many.coalesce(2))
    first = _bytes(t.root)
    for k in range(4):
        t.upsert(spark.createDataFrame([(i, f"x{k}", k) for i in range(k, 1000, 100)], t.schema).coalesce(1))
    assert _bytes(t.root) - first < 0.02 * first
    assert t.load().count() == 200_000 and _rows(t.load().where("id = 3"))[3] == ("x3", 3)


def test_keep_drops_what_has_expired(spark):
    t = _table(spark)
    t.upsert(spark.createDataFrame([(i, "a", i) for i in range(10)], t.schema))
    t.upsert(spark.createDataFrame([(i, "b", i) for i in range(20, 32)], t.schema), keep=F.col("n") >= 5)
    assert set(_rows(t.load())) == {5, 6, 7, 8, 9, *range(20, 32)}


@pytest.mark.parametrize("waves", [1, 5])
def test_packed_stream_does_not_depend_on_its_batches(spark, waves):
    rows = [("ab"[i % 5 == 0], i, list(range(i % 13))) for i in range(160)] + [("c", 200, [1, 2, 3])]
    df = spark.createDataFrame(rows, "source string, doc_id long, tokens array<int>")
    parts = [df.where((F.col("doc_id") >= w * 201 // waves) & (F.col("doc_id") < (w + 1) * 201 // waves)).repartition(4) for w in range(waves)]
    got = {(r["source"], r["chunk"]): r["input_ids"] for r in stream_pack_constant(spark, parts, 8).collect()}
    want = {}
    for source in "abc":
        tokens = [t for s, _, ts in rows if s == source for t in [*ts, 0]]
        want |= {(source, k): tokens[8 * k : 8 * k + 8] for k in range(len(tokens) // 8)}
    assert got == want


def test_ids_expire(spark):
    def wave(day, ids):
        return spark.createDataFrame([(i, "g", 1.0) for i in ids], "id long, grp string, score double").withColumn("seen", F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp"))

    waves = [wave(1, [1, 2, 2]), wave(2, [1, 3]), wave(20, [4]), wave(21, [5]), wave(22, [1, 4])]
    out = stream_incremental_eval(spark, waves, "id", "score", "grp", "seen", "5 days").collect()
    # 1 counts again on day 22, three weeks after it was seen; 4 doesn't
    assert [(r["grp"], r["n"], r["mean_score"]) for r in out] == [("g", 6, 1.0)]


def test_prompts_of_earlier_batches_keep_their_buffers(spark):
    def batch(rows):
        return spark.createDataFrame(rows, "prompt string, step long, reward double")

    batches = [batch([("p", k, float(k)) for k in range(6)] + [("q", 0, 1.0)]), batch([("q", 1, 5.0)]), batch([("p", 6, 6.0)])]
    out = {(r["prompt"], r["step"]): r["buffered"] for r in stream_prompt_advantages(spark, batches, buffer=4, min_count=2).collect()}
    assert out["p", 0] == 4 and out["q", 0] == 1 and out["q", 1] == 2 and out["p", 6] == 4
