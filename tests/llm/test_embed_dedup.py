from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import MEDIUM
from tests.llm.test_simhash import brute_components
from weft.llm import embed_dedup
from weft.llm.queries import op8_embedding_dedup, table



def brute(rows):
    """{id: (n_links, component_id)} by comparing all pairs of a label; rows are (id, label, vector)."""
    out = {i: [0, i] for i, _, _ in rows}
    by = defaultdict(list)
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append((i, np.array(v, dtype=np.float64)))
    for group in by.values():
        unit = np.array([v / np.linalg.norm(v) for _, v in group])
        linked = unit @ unit.T >= 0.98
        np.fill_diagonal(linked, False)
        place = {g[0]: k for k, g in enumerate(group)}
        roots = brute_components(sorted(place), lambda a, b: linked[place[a], place[b]]) if len(group) < 700 else None
        for i, k in place.items():
            out[i][0] = int(linked[k].sum())
            if roots:
                out[i][1] = roots[i]
    return out


def near_copies(rng, n, dims=64):
    """Clusters of near copies, chains and copies among random vectors."""
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            base = out[rng.integers(len(out))] if rng.random() < 0.5 else out[0]
            out.append(base if rng.random() < 0.3 else base + rng.normal(0, 0.015, dims) * np.linalg.norm(base))
        else:
            out.append(rng.normal(size=dims))
    return out


def test_query_on_whole_table(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table(spark, MEDIUM, "embeddings").collect()]
    want = brute(rows)
    got = op8_embedding_dedup(spark, MEDIUM).collect()
    assert {r["vec_id"]: [r["n_links"], r["component_id"]] for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_on_near_copies(spark):
    """Of all pairs with cosine >= 0.98, found by brute force, at least 0.99 are linked, and no other pair is."""
    rng = np.random.default_rng(12)
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(v for _ in range(6) for v in near_copies(rng, 400))]
    want = {i: n for i, (n, _) in brute(rows).items()}
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_duplicates(df).collect()}
    assert sum(want.values()) > 10000
    assert sum(got.values()) >= 0.99 * sum(want.values())
    assert all(got[i] <= want[i] for i in want)


@pytest.mark.parametrize("block", [7, 512])
def test_clusters_and_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup.class_links, "__defaults__", (embed_dedup.COSINE, block))
    rng = np.random.default_rng(block)
    vectors = near_copies(rng, 300) + near_copies(rng, 40, 5)
    rows = [(i, [3, 4, None][i % 3] if i % 7 else 3, v.tolist()) for i, v in enumerate(vectors)]
    n = len(rows)
    same = vectors[0].tolist()
    rows += [
        (n, 3, None),
        (n + 1, 3, []),
        (n + 2, 3, [0.0] * 64),
        (n + 3, 3, [float("nan"), *same[1:]]),
        (n + 4, 3, [float("inf"), *same[1:]]),
        (n + 5, 3, [None, *same[1:]]),
        (n + 6, None, same),
        (n + 7, 3, [x * 1e-200 for x in same]),
        (n + 8, 3, same[:63]),
        (n + 9, 3, [-x for x in same]),
    ]
    rows = [(i, label, v, "x") for i, label, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, n_links string").repartition(3)
    got = {r["vec_id"]: [r["n_links"], r["component_id"]] for r in embed_dedup.near_duplicates(df).collect()}
    want = brute([r[:3] for r in rows if r[0] != n + 7])
    tiny = got.pop(n + 7)
    assert tiny[0] == got[0][0] and tiny[1] == got[0][1]  # a scaled copy links like the vector itself
    linked = {i for i, v in enumerate(vectors) if rows[i][1] == 3 and len(v) == 64 and v @ vectors[0] / np.linalg.norm(v) / np.linalg.norm(vectors[0]) >= 0.98}
    want = {i: [x + (i in linked), c] for i, (x, c) in want.items()}
    assert got == want
    assert embed_dedup.near_duplicates(df.limit(0)).collect() == []


def test_hadamard_keeps_lengths_and_equals_its_matrix():
    x = np.random.default_rng(0).normal(size=(5, 8))
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embed_dedup.hadamard(x), x @ h / np.sqrt(8))
