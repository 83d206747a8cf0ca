"""Hashed word and character n-gram ids of words, computed with numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def _mix(h: np.ndarray, buckets: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIER
    return ((h >> np.uint64(29)) % np.uint64(buckets)).astype(np.int32)


class Subwords:
    """Ids in ``buckets`` hash buckets; id ``buckets`` means none.

    A word's n-grams are those of ``<word>`` with ``low`` to ``high`` characters; the word
    itself has an id too.
    """

    def __init__(self, buckets: int, low: int = 3, high: int = 6):
        self.buckets, self.low, self.high = buckets, low, high

    def _characters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of the marked words, characters of each word, first character of each word)."""
        text = "<" + "><".join(words) + ">"
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
        return codes, sizes, np.cumsum(sizes) - sizes

    def _whole(self, codes: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = np.arange(len(codes)) - np.repeat(starts, sizes)
        h = np.add.reduceat(codes * _POWERS[at % 64] * (at // 64 + 1).astype(np.uint64), starts)
        return _mix(h + sizes.astype(np.uint64), self.buckets)

    def whole(self, words: list[str]) -> np.ndarray:
        """The id of each word itself."""
        return self._whole(*self._characters(words))

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word id of each word, n-gram ids of each character and length, first character of each word)."""
        codes, sizes, starts = self._characters(words)
        room = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the word's end
        grams = np.full((len(codes), self.high - self.low + 1), self.buckets, dtype=np.int32)
        h = codes.copy()
        for n in range(2, self.high + 1):
            if n > len(codes):
                break
            h = h[:-1] * _MULTIPLIER + codes[n - 1 :]
            h ^= h >> np.uint64(29)
            if n >= self.low:
                found = _mix(h + np.uint64(n), self.buckets)
                found[room[: len(h)] < n] = self.buckets
                grams[: len(h), n - self.low] = found
        return self._whole(codes, sizes, starts), grams, starts

    def sums(self, words: list[str], table: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the rows of ``table`` over a word's ids, number of ids). ``table`` ends in a row of zeros."""
        out = np.empty((len(words), table.shape[1]), dtype=np.float32)
        count = np.empty(len(words), dtype=np.float32)
        for a in range(0, len(words), step):
            whole, grams, starts = self.ids(words[a : a + step])
            rows = table[grams[:, 0]]
            for k in range(1, grams.shape[1]):
                rows += table[grams[:, k]]
            out[a : a + step] = np.add.reduceat(rows, starts, axis=0) + table[whole]
            count[a : a + step] = np.add.reduceat((grams < self.buckets).sum(axis=1), starts) + 1
        return out, count


def factorise(texts_words: list[list[str]]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each word of all texts, distinct words, number of words of each text)."""
    place: dict[str, int] = {}
    codes = [place.setdefault(w, len(place)) for words in texts_words for w in words]
    return np.array(codes, dtype=np.int64), list(place), np.fromiter(map(len, texts_words), dtype=np.int64, count=len(texts_words))


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs of ``sizes`` rows; empty runs give zero."""
    out = np.zeros((len(sizes), *values.shape[1:]), dtype=np.float64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(values, starts, axis=0, dtype=np.float64)
    return out


def by_row(ids: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the weight rows of each id: a dense (rows, columns) table."""
    return np.stack([np.bincount(ids, weights=weights[:, d], minlength=rows) for d in range(weights.shape[1])], axis=1)
