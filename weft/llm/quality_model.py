"""Supervised subword embeddings for document quality (operator 9).

Every word, character n-gram and pair of neighbouring words of a text is hashed to a
learned vector; a repeated neighbour (a word after itself) has one vector whatever the
word is. The vectors of a document are averaged and a softmax layer gives the class
probabilities. Vectors and layer are trained together by stochastic gradient descent in
numpy, with a step size per row, on a bounded sample of labelled documents (see
:mod:`weft.llm.labelled`); the class shares of all labelled documents set the prior.

For scoring, vectors and layer are multiplied into one number per bucket, so that a
document's score is a mean of looked-up numbers. The model is a bounded table of
``buckets`` numbers and goes to the executors as a broadcast.

Defined results: null and empty texts have no features and score the prior; repeated rows
score alike; with no labelled documents of either class every score is 0.5; an empty table
gives an empty result; other columns are not read by the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import map_texts
from weft.llm.labelled import class_counts, fit_sample, held_out
from weft.llm.subwords import Subwords, by_row, factorise, segment_sums

BUCKETS = 1 << 16
DIMENSIONS = 8
EPOCHS = 6
BATCH = 32
RATE = 0.3
THRESHOLD = 0.3
SHORTEST, LONGEST = 3, 5  # characters of an n-gram


def split_words(texts: list[str]) -> list[list[str]]:
    return [t.lower().split() for t in texts]


def _pair_ids(whole: np.ndarray, sizes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each neighbouring pair of words, and the pairs of each text."""
    after = np.ones(len(whole), dtype=bool)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = False  # the last word of a text has no neighbour
    left = np.flatnonzero(after)
    a, b = whole[left].astype(np.int64), whole[left + 1].astype(np.int64)
    ids = (a * 1_000_003 + b * 7_919 + 17) % buckets
    ids[a == b] = 0  # a word after itself
    return ids, np.maximum(sizes - 1, 0)


@dataclass
class QualityModel:
    numbers: np.ndarray  # (buckets + 1, 1): logit share of each bucket, the last row zero
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        words = split_words(texts)
        codes, distinct, sizes = factorise(words)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        if len(codes):
            subwords = Subwords(len(self.numbers) - 1, SHORTEST, LONGEST)
            sums, n = subwords.sums(distinct, self.numbers)
            whole = subwords.whole(distinct)
            pairs, pair_sizes = _pair_ids(whole[codes], sizes, subwords.buckets)
            total = segment_sums(sums[codes, 0], sizes) + segment_sums(self.numbers[pairs, 0], pair_sizes)
            count = segment_sums(n[codes], sizes) + pair_sizes
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket ids, mean weights) of each text."""
    subwords, out = Subwords(buckets, SHORTEST, LONGEST), []
    for words in split_words(texts):
        codes, distinct, sizes = factorise([words])
        if not len(codes):
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        times = np.bincount(codes)
        whole, grams, starts = subwords.ids(distinct)
        per_character = np.repeat(times, np.diff(np.append(starts, len(grams))))
        counts = np.bincount(whole, weights=times, minlength=buckets + 1)
        for k in range(grams.shape[1]):
            counts += np.bincount(grams[:, k], weights=per_character, minlength=buckets + 1)
        counts += np.bincount(_pair_ids(whole[codes], sizes, buckets)[0], minlength=buckets + 1)
        counts[buckets] = 0
        ids = np.flatnonzero(counts).astype(np.int32)
        out.append((ids, (counts[ids] / counts.sum()).astype(np.float32)))
    return out


def train(texts: list[str], y: list[int], share: float, buckets: int = BUCKETS, seed: int = 1) -> QualityModel:
    """Fit vectors and softmax layer; ``share`` is the part of class 1 in all labelled documents."""
    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros((buckets + 1, 1), np.float32), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (buckets, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    squares, layer_squares, bias_squares = np.full(buckets, 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)
    bags = _bags(texts, buckets)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            sizes = np.array([len(bags[i][0]) for i in rows])
            ids = np.concatenate([bags[i][0] for i in rows])
            weights = np.concatenate([bags[i][1] for i in rows])
            hidden = segment_sums(vectors[ids] * weights[:, None], sizes)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1  # gradient of the loss by the logits
            p /= len(rows)
            back = np.repeat(p @ layer.T, sizes, axis=0) * weights[:, None]
            slope = by_row(ids, back, buckets)
            squares += (slope * slope).mean(axis=1)
            vectors -= (rate * slope / np.sqrt(squares)[:, None]).astype(np.float32)
            for value, grad, seen in ((layer, hidden.T @ p, layer_squares), (bias, p.sum(axis=0), bias_squares)):
                seen += grad * grad
                value -= rate * grad / np.sqrt(seen)
    numbers = np.zeros((buckets + 1, 1), np.float32)
    numbers[:buckets, 0] = vectors @ (layer[:, 1] - layer[:, 0])
    # from the sample's class shares to those of all labelled documents
    prior = np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return QualityModel(numbers, float(bias[1] - bias[0] + prior))


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality") -> QualityModel:
    zero, one = class_counts(labels, target)
    rows = fit_sample(documents, labels, target)
    return train([r["text"] for r in rows], [r["y"] for r in rows], one / max(1, zero + one))


def score(df: DataFrame, model: QualityModel, keep=("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the probability of class 1 of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, lambda: lambda texts: [sent.value.scores(texts)], f"`{name}` double", keep=keep, text=text)


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(documents, fit(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without those that the classifier rejects; all columns stay."""
    scored = score(documents, fit(documents, labels), keep=documents.columns, name="_llm_score")
    return scored.where(F.col("_llm_score") >= threshold).drop("_llm_score")
