"""Operators 1 and 9: held-out accuracy, defined results for odd rows, and parts against plain versions."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from weft.llm import quality_model, toxicity
from weft.llm.labelled import fit_sample
from weft.llm.queries import op1_toxicity, op9_quality_model, table
from weft.llm.subwords import Subwords, factorise

LARGE = "/root/testdata/sf0.1"


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(
    ("query", "target", "limit", "accuracy", "area"),
    [(op1_toxicity, "toxic", 0.5, 0.97, 0.97), (op9_quality_model, "quality", 0.3, 0.96, 0.97)],
)
def test_held_out_accuracy(spark, query, target, limit, accuracy, area):
    got = {r["doc_id"]: r for r in query(spark, LARGE).collect()}
    docs = table(spark, LARGE, "documents").select("doc_id").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    rows = [r for r in table(spark, LARGE, "labels").collect() if got[r["doc_id"]]["held_out"]]
    y = np.array([r[target] for r in rows])
    scores = np.array([got[r["doc_id"]]["score"] for r in rows])
    assert ((scores >= limit) == y).mean() >= accuracy
    assert auc(scores, y) >= area


TOXIC = ["you are an idiot", "what a moron he is", "idiot and moron"] * 30
CLEAN = ["a fine day", "the sea is blue", "what a fine sea"] * 30


def _tables(spark):
    texts = [t for pair in zip(TOXIC, CLEAN) for t in pair]
    odd = [None, "", " \n\t", "word", "fine sea " * 30000, "fine sea", "fine sea", "😀 ﬁ\x00 ́"]
    rows = [(i, t, "en" if i % 3 else None, 0.5) for i, t in enumerate(texts + odd)] + [(None, "a fine day", "en", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = [(i, 1 - i % 2, 1 - i % 2) for i in range(len(texts))]
    labels += [(0, 1, 1), (1, None, None), (3, 1, 1), (None, 1, 1), (10**9, 0, 0), (len(texts), 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"), len(texts)


@pytest.mark.parametrize(("model", "limit"), [(toxicity, 0.5), (quality_model, 0.3)])
def test_edge_rows(spark, model, limit):
    docs, labels, n = _tables(spark)
    rows = model.scored_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    got = {r["doc_id"]: r["score"] for r in rows}
    assert all(0 <= s <= 1 for s in got.values())
    assert got[n] == got[n + 1] == got[n + 2]  # null, empty and blank
    assert got[n + 5] == got[n + 6]
    assert got[n + 4] == pytest.approx(got[n + 5], abs=0.2)
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    if model is toxicity:
        assert np.mean([got[i] for i in range(0, n, 2)]) > 0.8 and np.mean([got[i] for i in range(1, n, 2)]) < 0.2
    assert model.scored_documents(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in model.scored_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_sample_is_bounded_and_leaves_out_held_out_rows(spark):
    docs, labels, _ = _tables(spark)
    rows = fit_sample(docs.union(docs), labels, "toxic", per_class=7)
    assert len(rows) == len({r["doc_id"] for r in rows}) == 14
    assert sum(r["y"] for r in rows) == 7
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)
    assert 3 not in {r["doc_id"] for r in rows}  # contradicting labels


def test_subword_sums_equal_plain_sums():
    words, buckets = ["a", "the", "idiots", "x" * 90, "é漢😀"], 997
    table_ = np.vstack([np.random.default_rng(0).normal(size=(buckets, 4)), np.zeros((1, 4))]).astype(np.float32)
    s = Subwords(buckets, 3, 5)
    sums, count = s.sums(words, table_, step=2)
    for i, w in enumerate(words):
        whole, grams, _ = s.ids([w])
        ids = [g for g in grams.ravel() if g < buckets]
        marked = f"<{w}>"
        assert len(ids) == sum(max(0, len(marked) - n + 1) for n in (3, 4, 5)) == count[i] - 1
        assert np.allclose(sums[i], table_[ids].sum(axis=0) + table_[whole[0]], atol=1e-3)
    assert (s.whole(words) == s.ids(words)[0]).all()


def test_pooled_equals_plain_convolution():
    rng = np.random.default_rng(2)
    model = toxicity.train([], [], [], 0.5)
    model.filters = [rng.normal(size=f.shape).astype(np.float32) for f in model.filters]
    texts = [["a", "b", "a", "c"], [], ["c"], ["b", "c"]]
    codes, distinct, sizes = factorise(texts)
    embedded = rng.normal(size=(len(distinct), toxicity.DIMENSIONS)).astype(np.float32)
    got = model.pooled(embedded, codes, sizes)
    place = {w: i for i, w in enumerate(distinct)}
    for t, words in enumerate(texts):
        none = [np.zeros(toxicity.DIMENSIONS)] * 2
        rows = none + [embedded[place[w]] for w in words] + none
        want = []
        for f in model.filters:
            at = range(3 - len(f), 3 - len(f) + len(words) + 2)
            want.extend(np.max([sum(rows[i + k] @ f[k] for k in range(len(f))) for i in at], axis=0) if words else [0] * f.shape[2])
        assert np.allclose(got[t], want, atol=1e-4)


def test_threshold_of_a_language_follows_its_rows():
    scores = np.concatenate([np.linspace(0, 0.4, 400), np.linspace(0.45, 1, 400), np.linspace(0, 0.7, 400), np.linspace(0.75, 1, 400)])
    y = np.repeat([0, 1, 0, 1], 400)
    overall, by_lang = toxicity.calibrate(scores, y, ["a"] * 800 + ["b"] * 800)
    assert by_lang["a"] < 0.5 < 0.69 < by_lang["b"]


def test_string_ids(spark):
    docs = spark.createDataFrame([(f"d{i}", ("good text here " if i % 2 else "bad words there ") * 5, "en") for i in range(60)], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 1 - i % 2) for i in range(60)], "doc_id string, quality int, toxic int")
    kept = {r["doc_id"] for r in quality_model.keep_good(docs, labels).collect()}
    assert kept and all(int(i[1:]) % 2 for i in kept)
    assert toxicity.scored_documents(docs, labels).count() == 60
