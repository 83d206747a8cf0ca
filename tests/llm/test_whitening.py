from __future__ import annotations

import math

import numpy as np
import pytest

from tests.conftest import SMALL
from weft.llm import whitening as wh
from weft.llm.queries import op12_whitening, table
from weft.llm.whitening import bidiagonal, directions, dqds, twisted_vector, whitened_rows


def _check(rows, vectors, components=32):
    """Rows against numpy's own eigenvalues of the covariance, and exact integers."""
    good = {i: v for i, v in vectors.items() if v and all(c is not None and math.isfinite(c) for c in v)}
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in good.values()], dtype=np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    deviation = {i: sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for i, row in zip(good, x)}
    centred = x - np.array(sums) / n
    e = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    k = min(components, len(e))
    by_id = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by_id) == len(rows) == n * k and {i for i, _ in by_id} == set(good)
    z = np.array([[by_id[i, c]["whitened"] for c in range(1, k + 1)] for i in good])
    assert all(r["n"] == n and r["deviation"] == deviation[r["vec_id"]] for r in rows)
    assert np.allclose([by_id[next(iter(good)), c]["explained"] for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    error = np.abs((z - z.mean(axis=0)).T @ (z - z.mean(axis=0)) / n - np.eye(k)).max()
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]}
    assert rows[0]["identity_error"] < 1e-9 and error < 1e-9
    # the directions that z is made of are eigenvectors: z = centred V / sqrt(e)
    v, *_ = np.linalg.lstsq(centred, z * np.sqrt(e[:k]), rcond=None)
    assert np.allclose(v.T @ v, np.eye(k), atol=1e-9)
    assert np.allclose(centred.T @ (centred @ v) / n, v * e[:k], atol=1e-9 * e[0])


def test_query_on_whole_table(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in table(spark, SMALL, "embeddings").collect()}
    _check(op12_whitening(spark, SMALL).collect(), vectors)


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    vectors = {i: [float(c) for c in v] for i, v in enumerate(rng.normal(0, [5, 1, 1, 0.3], (60, 4)))}
    vectors |= {100: None, 101: [1.0, None, 0.0, 0.0], 102: [math.nan, 0.0, 0.0, 0.0], 103: [0.0, math.inf, 0.0, 0.0], 104: [], 105: vectors[3], 106: vectors[3]}
    schema = "vec_id long, embedding array<double>, n int, _x string, deviation int"
    df = spark.createDataFrame([(i, v, 0, "", 1) for i, v in vectors.items()], schema).repartition(40)
    rows = whitened_rows(df).collect()
    _check(rows, vectors)
    odd = spark.createDataFrame([(200, [1.0], 0, "", 1), (201, [1e300, 0.0, 0.0, 0.0], 0, "", 1), (None, [1.0, 2.0], 0, "", 1)], schema)
    more = whitened_rows(df.union(odd)).collect()
    assert {r["vec_id"] for r in more} == {r["vec_id"] for r in rows}
    assert whitened_rows(df.limit(0)).collect() == []
    assert whitened_rows(df.where("vec_id in (3, 105)")).collect() == []  # equal vectors have no direction
    assert {r["component"] for r in whitened_rows(df.where("vec_id < 3")).collect()} == {1, 2}


def test_great_entries_are_exact(spark):
    vectors = {0: [2.0**40, 1.0], 1: [-(2.0**40), 3.0], 2: [5.0, -(2.0**30)], 3: [0.0, 2.0**30]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    n, x = 4, [[math.floor(64 * c) + 1000000 for c in v] for v in vectors.values()]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    for r in whitened_rows(df).collect():
        want = exact[r["vec_id"]]
        assert r["deviation"] == (want if want < 1 << 63 else None)


def _matrices():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    yield from (np.triu(rng.standard_normal((n, n))) for n in (1, 2, 3, 17))
    yield np.eye(6)
    yield np.zeros((4, 4))
    yield np.linalg.qr(np.diag(np.repeat([9.0, 4.0, 4.0 + 1e-9, 1.0], 5)) @ q, mode="r")
    yield np.linalg.qr(rng.standard_normal((100, 12)) * np.logspace(0, -8, 12), mode="r")
    doubled = rng.standard_normal((50, 8))
    yield np.linalg.qr(np.hstack([doubled, doubled]), mode="r")


@pytest.mark.parametrize("r", list(_matrices()))
def test_solver_agrees_with_the_library(r):
    d, upper, v = bidiagonal(r)
    want = np.linalg.svd(r, compute_uv=False)
    top = max(want[0], 1e-300)
    b = np.diag(d) + np.diag(upper, 1)
    assert np.allclose(np.linalg.svd(b, compute_uv=False), want, atol=1e-14 * len(r) * top)
    assert np.abs(dqds(d, upper) - want).max() < 1e-13 * top
    sigma, z = directions(r)
    assert np.allclose(z.T @ z, np.eye(len(r)), atol=1e-13)
    image = r @ z
    gram = image.T @ image
    assert np.abs(gram - np.diag(sigma**2)).max() <= 1e-12 * top**2


def test_small_values_keep_their_digits():
    """dqds finds the values of a graded bidiagonal to high relative accuracy, the product being exact."""
    d, upper = 10.0 ** -np.arange(0, 24, 2), 0.5 * 10.0 ** -np.arange(1, 23, 2)
    assert math.isclose(float(np.prod(dqds(d, upper))), float(np.prod(d)), rel_tol=1e-12)


def test_twisted_vector_of_a_split_matrix():
    z = twisted_vector(np.array([3.0, 2.0, 1.0]), np.zeros(2), 2.0)
    assert np.allclose(np.abs(z), [0, 1, 0])


def test_factors_are_reduced_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    vectors = {i: [float(c) for c in v] for i, v in enumerate(rng.normal(0, [3, 2, 1], (50, 3)))}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(9)
    _check(whitened_rows(df).collect(), vectors)
