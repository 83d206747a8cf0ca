"""Convolutional toxicity classifier (operator 1).

A word's embedding is the mean of learned vectors in hash buckets: one for the word and
one for each of its character n-grams. Filters of several widths run over the embeddings
of neighbouring words; the greatest value of each filter in the whole text goes through a
rectifier into a logistic output. Trained in numpy on a bounded sample of labelled
documents (see :mod:`weft.llm.labelled`), with a step size per weight.

Thresholds are calibrated by language on the part of the sample that training leaves out:
for each language the threshold with the best balance of the two error rates, drawn
towards the one of all languages where a language has few rows. Language is used there
only; a score depends on the text alone.

For scoring, embeddings of distinct words are multiplied with the filters once per chunk,
and each position adds up looked-up rows. The model is a table of bounded size and goes to
the executors as a broadcast.

Defined results: null and empty texts have no words, all filters give zero and the score
is that of the bias; a text shorter than a filter is padded with zeros; repeated rows
score alike; with no labelled documents of either class every score is 0.5; an empty table
gives an empty result; other columns are not read by the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import map_texts
from weft.llm.labelled import class_counts, fit_sample, held_out
from weft.llm.subwords import Subwords, by_row, factorise

BUCKETS = 1 << 15
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
EPOCHS = 8
BATCH = 32
RATE = 0.1
SMOOTH = 10  # texts of the mean class shares that count with a bucket's own
THRESHOLD = 0.5
SHORTEST, LONGEST = 3, 6  # characters of an n-gram
FIT_PER_CLASS = 1_500
#: Every so many sample rows one is kept from training, for the thresholds.
CALIBRATION_EVERY = 8
#: Rows of all languages that count with a language's own rows.
SHRINK_ROWS = 50


def split_words(texts: list[str]) -> list[list[str]]:
    return [t.lower().split() for t in texts]


def _windows(sizes: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Position of each word once every text is followed by ``pad`` empty places; first position of each text."""
    room = sizes + pad
    starts = np.cumsum(room) - room
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), starts


@dataclass
class ToxicityModel:
    vectors: np.ndarray  # (buckets + 1, dimensions), the last row zero
    filters: list[np.ndarray]  # for each width (width, dimensions, filters)
    shifts: list[np.ndarray]  # for each width (filters,)
    out: np.ndarray  # (all filters,)
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = THRESHOLD

    def pooled(self, embedded: np.ndarray, codes: np.ndarray, sizes: np.ndarray, where: bool = False):
        """(texts, filters) greatest values over each text, and where they are if asked for."""
        pad = max(WIDTHS) - 1
        place, starts = _windows(sizes, pad)
        total = int((sizes + pad).sum())
        row = np.full(pad + total, len(embedded), dtype=np.int64)
        row[pad + place] = codes
        best, at = [], []
        for filters, shift in zip(self.filters, self.shifts):
            first = pad + 1 - len(filters)  # a window ends at its position, so it never reaches the next text
            # one matrix per offset, looked up by word; the last row is the empty place
            values = np.zeros((total, filters.shape[2]), dtype=np.float32)
            for k in range(len(filters)):
                per_word = np.vstack([embedded @ filters[k], np.zeros((1, filters.shape[2]), np.float32)])
                values += per_word[row[first + k : first + k + total]]
            values += shift
            top = np.maximum.reduceat(values, starts, axis=0)
            best.append(top)
            if where:
                hit = values == np.repeat(top, sizes + pad, axis=0)
                place = np.where(hit, np.arange(total)[:, None], total)
                at.append(first + np.minimum.reduceat(place, starts, axis=0))
        top = np.hstack(best)
        top[sizes == 0] = 0
        return (top, at, row) if where else top

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        codes, distinct, sizes = factorise(split_words(texts))
        if len(codes):
            sums, count = Subwords(len(self.vectors) - 1, SHORTEST, LONGEST).sums(distinct, self.vectors)
            top = self.pooled(sums / count[:, None], codes, sizes)
        else:
            top = np.zeros((len(texts), len(self.out)))
        return 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ self.out + self.bias, -30, 30)))


class _Words:
    """Subword ids of the sample's distinct words, looked up by word."""

    def __init__(self, distinct: list[str], buckets: int):
        self.whole, grams, starts = Subwords(buckets, SHORTEST, LONGEST).ids(distinct)
        self.ids, self.firsts, at = [], np.zeros(len(distinct) + 1, dtype=np.int64), 0
        flat = grams.ravel()
        bounds = np.append(starts, len(grams)) * grams.shape[1]
        keep = flat != buckets
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.sizes = kept[bounds[1:]] - kept[bounds[:-1]] + 1  # n-grams and the word itself
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.insert(flat[keep], kept[bounds[:-1]], self.whole)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all given words in a row, ids of each word)."""
        sizes = self.sizes[words]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1]) + np.repeat(self.firsts[words] - ends + sizes, sizes)], sizes


def _log_odds(words: _Words, texts: list[np.ndarray], y: np.ndarray, buckets: int) -> np.ndarray:
    """Smoothed log odds of class 1 against class 0 for the texts in which a bucket occurs.

    Training starts from them: they are the first dimension of the embeddings.
    """
    seen = np.zeros((2, buckets))
    for codes, label in zip(texts, y):
        if len(codes):
            seen[label][np.unique(words.of(np.unique(codes))[0])] += 1
    share = np.bincount(y, minlength=2) / len(y)
    rates = (seen + SMOOTH * share[:, None]) / np.bincount(y, minlength=2)[:, None]
    return np.log(rates[1] / rates[0])


def train(texts: list[str], y: list[int], langs: list, share: float, buckets: int = BUCKETS, seed: int = 1) -> ToxicityModel:
    """Fit the network; ``share`` is the part of class 1 in all labelled documents."""
    rng = np.random.default_rng(seed)
    dims, n = DIMENSIONS, FILTERS
    model = ToxicityModel(
        vectors=np.vstack([rng.normal(0, 0.1, (buckets, dims)), np.zeros((1, dims))]).astype(np.float32),
        filters=[rng.normal(0, 0.5, (w, dims, n)).astype(np.float32) for w in WIDTHS],
        shifts=[np.zeros(n, np.float32) for _ in WIDTHS],
        out=rng.normal(0, 0.3, n * len(WIDTHS)),
        bias=0.0,
    )
    y = np.asarray(y)
    if not len(y) or y.min() == y.max():
        model.out[:] = 0
        return model
    codes, distinct, sizes = factorise(split_words(texts))
    words = _Words(distinct, buckets)
    firsts = np.cumsum(sizes) - sizes
    fit_rows = np.array([i for i in range(len(y)) if i % CALIBRATION_EVERY or len(y) < 20 * CALIBRATION_EVERY])
    model.vectors[:buckets, 0] = _log_odds(words, [codes[firsts[i] : firsts[i] + sizes[i]] for i in fit_rows], y[fit_rows], buckets)
    seen = {k: np.full(np.shape(v), 1e-6) for k, v in (("vectors", model.vectors), ("out", model.out), ("bias", 0.0))}
    seen_filters = [np.full(f.shape, 1e-6) for f in model.filters]
    seen_shifts = [np.full(s.shape, 1e-6) for s in model.shifts]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fit_rows)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            rows = rows[sizes[rows] > 0]
            if not len(rows):
                continue
            size = sizes[rows]
            used = codes[np.arange(size.sum()) + np.repeat(firsts[rows] - (np.cumsum(size) - size), size)]
            kinds, used = np.unique(used, return_inverse=True)
            ids, per_word = words.of(kinds)
            begin = np.cumsum(per_word) - per_word
            embedded = (np.add.reduceat(model.vectors[ids], begin, axis=0) / per_word[:, None]).astype(np.float32)
            top, at, row = model.pooled(embedded, used, size, where=True)
            hidden = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.bias, -30, 30)))
            error = (p - y[rows]) / len(rows)
            d_top = np.outer(error, model.out) * (top > 0)
            d_out, d_bias = hidden.T @ error, error.sum()
            padded = np.vstack([embedded, np.zeros((1, dims), np.float32)])
            d_embedded = np.zeros_like(padded, dtype=np.float64)
            for k, (filters, where) in enumerate(zip(model.filters, at)):
                d = d_top[:, k * n : (k + 1) * n]
                grad = np.empty(filters.shape)
                for j in range(len(filters)):
                    word = row[where + j]  # (texts, filters)
                    grad[j] = np.einsum("tf,tfd->df", d, padded[word])
                    d_embedded += by_row(word.ravel(), (d[:, :, None] * filters[j].T[None]).reshape(-1, dims), len(padded))
                for value, g, s in ((filters, grad, seen_filters[k]), (model.shifts[k], d.sum(axis=0), seen_shifts[k])):
                    s += g * g
                    value -= (rate * g / np.sqrt(s)).astype(np.float32)
            touched = np.flatnonzero(np.abs(d_embedded[:-1]).sum(axis=1))  # words that some filter chose
            if len(touched):
                ids, per_word = words.of(kinds[touched])
                g = by_row(ids, np.repeat(d_embedded[touched] / per_word[:, None], per_word, axis=0), buckets)
                seen["vectors"][:buckets] += g * g
                model.vectors[:buckets] -= (rate * g / np.sqrt(seen["vectors"][:buckets])).astype(np.float32)
            seen["out"] += d_out * d_out
            model.out -= rate * d_out / np.sqrt(seen["out"])
            seen["bias"] += d_bias * d_bias
            model.bias -= float(rate * d_bias / np.sqrt(seen["bias"]))
    left = np.setdiff1d(np.arange(len(y)), fit_rows)
    mean = y[fit_rows].mean()
    model.bias += float(np.log(share / (1 - share)) - np.log(mean / (1 - mean)))
    if len(left):
        s = model.scores([texts[i] for i in left])
        model.threshold, model.thresholds = calibrate(s, y[left], [langs[i] for i in left])
    return model


def _errors(scores: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the two error rates at each threshold of ``at``."""
    one, zero = np.sort(scores[y == 1]), np.sort(scores[y == 0])
    missed = np.searchsorted(one, at) / max(1, len(one))
    wrong = 1 - np.searchsorted(zero, at) / max(1, len(zero))
    return missed + wrong


def calibrate(scores: np.ndarray, y: np.ndarray, langs: list) -> tuple[float, dict[str, float]]:
    """(threshold of all languages, threshold of each language): the middle of the best ones of a fixed grid."""
    at = np.linspace(0.02, 0.98, 97)
    overall = _errors(scores, y, at)
    middle = lambda e: float(np.median(at[e <= e.min() + 1e-9]))
    out, names = {}, np.array([x if x is not None else "" for x in langs])
    for lang in sorted({x for x in langs if x is not None}):
        own = names == lang
        if (y[own] == 1).any() and (y[own] == 0).any():
            n = own.sum()
            out[lang] = middle((n * _errors(scores[own], y[own], at) + SHRINK_ROWS * overall) / (n + SHRINK_ROWS))
    return middle(overall), out


def fit(documents: DataFrame, labels: DataFrame, target: str = "toxic") -> ToxicityModel:
    zero, one = class_counts(labels, target)
    rows = fit_sample(documents, labels, target, extra=("lang",), per_class=FIT_PER_CLASS)
    share = one / max(1, zero + one)
    return train([r["text"] for r in rows], [r["y"] for r in rows], [r["lang"] for r in rows], share)


def score(df: DataFrame, model: ToxicityModel, keep=("doc_id",), text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns and the probability that each whole text is toxic."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(df, lambda: lambda texts: [sent.value.scores(texts)], f"`{name}` double", keep=keep, text=text)


def scored_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and the verdict by the language's threshold."""
    model = fit(documents, labels)
    scored = score(documents, model, keep=("doc_id", "lang"))
    limits = F.lit(model.threshold)
    for lang, limit in model.thresholds.items():
        limits = F.when(F.col("lang") == lang, F.lit(limit)).otherwise(limits)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        limits.alias("threshold"),
        (F.col("score") >= limits).alias("toxic"),
    )
