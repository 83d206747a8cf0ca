"""Bucketed range and overlap joins equal a brute-force check on random intervals."""

from __future__ import annotations

import random

from weft.operators.joins import overlap_join, range_join


def test_range_join_matches_brute_force(spark):
    rnd = random.Random(7)
    points = [(k, rnd.randint(0, 3), rnd.uniform(0, 100)) for k in range(300)]
    ivs = []
    for k in range(200):
        s = rnd.choice([rnd.uniform(0, 100), float(rnd.randint(0, 10) * 10)])  # include bucket edges
        ivs.append((k, rnd.randint(0, 3), s, s + rnd.uniform(0, 35)))
    p = spark.createDataFrame(points, "pid int, g int, t double")
    i = spark.createDataFrame(ivs, "iid int, g int, s double, e double")
    got = {(r.pid, r.iid) for r in range_join(p, i, "t", "s", "e", keys=["g"], bucket=10.0).collect()}
    want = {(pid, iid) for pid, g, t in points for iid, g2, s, e in ivs if g == g2 and s <= t < e}
    assert got == want


def test_overlap_join_matches_brute_force(spark):
    rnd = random.Random(11)
    a = [(k, rnd.randint(0, 2), float(x), float(x + rnd.randint(0, 25))) for k in range(150) for x in [rnd.randint(0, 90)]]
    b = [(k, rnd.randint(0, 2), float(x), float(x + rnd.randint(0, 25))) for k in range(150) for x in [rnd.randint(0, 90)]]
    da = spark.createDataFrame(a, "ia int, g int, lo_a double, hi_a double")
    db = spark.createDataFrame(b, "ib int, g int, lo_b double, hi_b double")
    got = {(r.ia, r.ib) for r in overlap_join(da, db, "lo_a", "hi_a", "lo_b", "hi_b", keys=["g"]).collect()}
    want = {(ia, ib) for ia, g, la, ha in a for ib, g2, lb, hb in b if g == g2 and max(la, lb) < min(ha, hb)}
    assert got == want


def test_work_of_a_hot_key_follows_the_pairs(spark):
    """One key with long and short ranges of any kind; ranges that meet nothing make no row."""
    rnd = random.Random(5)
    spans = lambda n, base: [(base + k, x, x + rnd.choice([0.0, 0.5, 3.0, 400.0])) for k in range(n) for x in [float(rnd.randint(0, 500))]]
    a, b = spans(120, 0) + [(900, None, 3.0), (901, 5.0, 1.0)], spans(120, 1000) + [(1900, 0.0, 500.0)]
    da = spark.createDataFrame(a, "ia int, lo_a double, hi_a double")
    db = spark.createDataFrame(b, "ib int, lo_b double, hi_b double")
    rows = overlap_join(da, db, "lo_a", "hi_a", "lo_b", "hi_b").collect()
    want = sorted((ia, ib, max(la, lb), min(ha, hb)) for ia, la, ha in a for ib, lb, hb in b if la is not None and la < ha and lb < hb and max(la, lb) < min(ha, hb))
    assert sorted((r.ia, r.ib, r.lo, r.hi) for r in rows) == want
    assert overlap_join(da.limit(0), db, "lo_a", "hi_a", "lo_b", "hi_b").collect() == []
