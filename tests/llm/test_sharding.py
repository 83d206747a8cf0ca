from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import MEDIUM
from weft.llm import sharding
from weft.llm.queries import op4_kd_shards, table


def check(rows, texts, shards=24):
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(d) for d, _ in texts)
    want = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_on_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, MEDIUM, "documents").collect()]
    rows = op4_kd_shards(spark, MEDIUM).collect()
    check(rows, docs)
    total = defaultdict(int)
    for r in rows:
        total[r["shard"]] += r["size"]
    mean, largest = sum(total.values()) / 24, max(r["size"] for r in rows)
    # each of the five cuts above a shard is off by at most half a row, and passes on a share of that
    assert len(total) == 24 and all(abs(b - mean) <= largest for b in total.values())


def plain_tree(rows, leaves, scale, first=0):
    """The same tree by sorting each node's rows; rows are (id, size, dims, tie)."""
    if leaves == 1 or not rows:
        return {r[0]: first for r in rows}
    spread = [(max(r[2][k] for r in rows) - min(r[2][k] for r in rows)) * scale[k] for k in range(3)]
    d, left, total, at = spread.index(max(spread)), leaves // 2, sum(r[1] for r in rows), 0
    a, b = [], []
    for r in sorted(rows, key=lambda r: (r[2][d], r[3])):
        (a if (at + r[1] / 2) * leaves <= total * left else b).append(r)
        at += r[1]
    return plain_tree(a, left, scale, first) | plain_tree(b, leaves - left, scale, first + left)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_leaves_equal_a_plain_tree(spark, shards):
    rows = sharding.points(table(spark, MEDIUM, "documents")).checkpoint()
    got = {r["doc_id"]: r["shard"] for r in sharding.kd_shards(rows, shards).collect()}
    plain = [(r["doc_id"], r["size"], list(r["_d"]), r["tie"]) for r in rows.withColumn("tie", F.xxhash64("_row")).collect()]
    spread = [max(r[2][k] for r in plain) - min(r[2][k] for r in plain) for k in range(3)]
    assert got == plain_tree(plain, shards, [1 / s if s else 0.0 for s in spread])


def test_target_bytes_set_the_number_of_leaves(spark):
    rows = sharding.points(table(spark, MEDIUM, "documents"))
    total = rows.agg(F.sum("size")).first()[0]
    assert sharding.kd_shards(rows, target_bytes=total // 7).select("shard").distinct().count() == 7


def test_edge_rows(spark):
    texts = [None, "", "é漢", "same", "same", "x" * 100000] + ["row"] * 40
    rows = [(i if i != 3 else None, t, None if i % 4 == 0 else "en", "s" if i % 3 else None, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int").repartition(3)
    check(sharding.sharded_documents(df).collect(), [(r[0], r[1]) for r in rows])
    assert sharding.sharded_documents(df.limit(0)).collect() == []
    few = sharding.sharded_documents(df.where("doc_id < 3")).collect()
    check(few, [(r[0], r[1]) for r in rows[:3]])
