from __future__ import annotations

import math
import random

import pytest

from weft.operators import selection
from weft.operators.windows import top_fraction


def _order(row):
    part, key, score = row
    kind = 0 if score is None else 4 if math.isnan(score) else 2
    return (-kind, -(score if kind == 2 else 0.0), key)


def _scores(kind, rng, n):
    if kind == "normal":
        return [rng.gauss(0, 1) for _ in range(n)]
    if kind == "ties":
        return [float(rng.randrange(3)) for _ in range(n)]
    if kind == "wide":
        return [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308) for _ in range(n)]
    if kind == "near":
        return [1.0 + rng.randrange(50) * 2.0**-52 for _ in range(n)]
    return [rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 1.7e308, -1.7e308]) for _ in range(n)]


@pytest.mark.parametrize("kind, fraction", [("normal", 0.2), ("ties", 0.5), ("wide", 0.3), ("near", 0.1), ("odd", 0.4), ("odd", 0.0), ("normal", 1.0)])
def test_equals_a_full_ranking(spark, monkeypatch, kind, fraction):
    monkeypatch.setattr(selection, "FEW", 9)
    monkeypatch.setattr(selection, "BINS", 16)
    rng = random.Random(kind)
    rows = [(p, f"k{i:04}", s) for p, n in (("a", 400), ("b", 37), ("c", 1), (None, 20)) for i, s in enumerate(_scores(kind, rng, n))]
    df = spark.createDataFrame(rows, "part string, key string, score double").repartition(4)
    want = set()
    for p in ("a", "b", "c"):
        mine = sorted((r for r in rows if r[0] == p), key=_order)
        want |= {(p, r[1]) for r in mine[: int(len(mine) * fraction)]}
    assert {(r["part"], r["key"]) for r in top_fraction(df, "part", "score", "key", fraction).collect()} == want


def test_rows_that_a_filter_leaves_are_fewer_than_wanted(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(100)] + [("b", i, 1.0) for i in range(9)], "part string, key long, score double")
    kept = top_fraction(df, "part", "score", "key", 0.5, df["key"] < 7).collect()
    assert {(r["part"], r["key"]) for r in kept} == {("a", i) for i in range(7)} | {("b", i) for i in range(4)}
