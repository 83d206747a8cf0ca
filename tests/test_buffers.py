from __future__ import annotations

import random

import pytest

from weft.plans.buffers import restarting_buffers


def _replay(sizes, limit):
    out, buffer, held = [], 0, 0
    for n in sizes:
        if held >= limit:
            buffer, held = buffer + 1, 0
        out.append(buffer)
        held += n
    return out


def _case(kind):
    rng = random.Random(kind)
    if kind == "mixed":
        return [rng.choice([0, 0, 1, 3, 2000, 99, 100, 101]) for _ in range(700)]
    if kind == "huge":  # each text overfills several buffers
        return [rng.randint(100, 10**9) for _ in range(200)]
    return {"empty": [], "zeros": [0] * 50, "exact": [10] * 200}[kind]


@pytest.mark.parametrize("kind, partitions", [("mixed", 1), ("mixed", 16), ("huge", 16), ("zeros", 1), ("empty", 1), ("exact", 3)])
def test_equals_a_sequential_replay(spark, kind, partitions):
    sizes = _case(kind)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = [(i // 7, i % 7, n, "x") for i, n in enumerate(sizes)]
        df = spark.createDataFrame(rows, "a long, b int, n int, text string").repartition(partitions)
        got = {(r["a"], r["b"]): r["buffer"] for r in restarting_buffers(df, "n", ["a", "b"], 100, block=64).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[i // 7, i % 7] for i in range(len(sizes))] == _replay(sizes, 100)


def test_null_counts_and_fractional_sizes(spark):
    sizes = [3, None, 2, 5, None, 1, 9, 9]
    df = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
    got = {r["i"]: r["buffer"] for r in restarting_buffers(df, "n", ["i"], 4.5).collect()}
    assert [got[i] for i in range(len(sizes))] == _replay([n or 0 for n in sizes], 4.5)
    with pytest.raises(ValueError):
        restarting_buffers(df, "n", ["i"], 0)
