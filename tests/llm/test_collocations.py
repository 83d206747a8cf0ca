from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.conftest import MEDIUM, SMALL
from weft.llm import collocations as co
from weft.llm.queries import op11_collocations, table


def _lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def _plain(rows, top=2000, least=100):
    """The contract by plain counting of all phrases."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", _lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                counts[lang if lang is not None else "und"].update(zip(*[words[i:] for i in range(m)]))
    out = []
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        f = {p: v for p, v in c.items() if v >= least}
        inside = set()
        for p, v in f.items():
            for m in range(2, len(p)):
                inside |= {p[i : i + m] for i in range(len(p) - m + 1) if f[p[i : i + m]] <= v}
        rows_ = []
        for p, a in f.items():
            if len(p) > 1 and p not in inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows_.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        rows_.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows_[:top])]
    return sorted(out)


def _found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query_on_whole_table(spark, folder):
    rows = [(r["lang"], r["text"]) for r in table(spark, folder, "documents").select("lang", "text").collect()]
    want = _plain(rows)
    assert want and _found(op11_collocations(spark, folder)) == want


@pytest.mark.parametrize("top", [3, 15, 10**6])
def test_rounds_settle_the_first_scores(spark, top):
    """Words of all frequencies, with repeated passages, so that rounds open and close the frontier."""
    rng = random.Random(top)
    words = ["w%d" % i for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    passages = [rng.choices(words, k=rng.randint(2, 7)) for _ in range(12)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randint(0, 12)):
            text += rng.choice(passages) if rng.random() < 0.4 else rng.choices(words, weights, k=3)
            text.append(rng.choice(["", ".", ",", "\n", "A"]))
        rows.append((rng.choice(["x", "x", "x", "y", None]), " ".join(text)))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert _found(co.collocations(df, top=top, least=4)) == _plain(rows, top, 4)


@pytest.mark.parametrize("bits", [64])
def test_false_members_of_filters_change_nothing(spark, monkeypatch, bits):
    """A word let through before its own round is scored once."""
    rng = random.Random(bits)
    rows = [(rng.choice("xy"), " ".join(rng.choices(["w%d" % i for i in range(40)], [1 / (i + 1) for i in range(40)], k=30))) for _ in range(120)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(co, "MAX_BITS", bits)
    assert _found(co.collocations(df, top=30, least=3)) == _plain(rows, 30, 3)


def test_edge_rows(spark):
    rows = [(None, None), ("x", ""), ("x", " \t "), ("x", "..!"), ("und", "A b\tc d"), (None, "a b c\x0bd"), ("x", "É\xa0é É\xa0é. \x1cq \x1cq z"), ("y", "lone")]
    rows += [("long", "p q " * 60_000), ("long", "p q."), ("x", "q z"), ("x", "q z"), (None, "a b c d e f g"), ("und", "a b c d e f g")]
    df = spark.createDataFrame([(a, b, 1, "p") for a, b in rows], "lang string, text string, f int, phrase string")
    assert _found(co.collocations(df, least=2)) == _plain(rows, least=2)
    assert co.collocations(df.limit(0)).collect() == []
    assert co.collocations(df.where("lang = 'y'"), least=1).collect() == []


def test_chunks_are_cut_at_marks(monkeypatch):
    monkeypatch.setattr(co, "CHUNK", 50)
    texts = [b"Aa bb cc; dd ee " * 9, b"x" * 200 + b" y! z", b""]
    whole = [w for data, codes, _ in co.numbered(texts) for w in _words(data, codes)]
    assert [w for w in whole if w != b"."] == b" ".join(texts).lower().replace(b";", b"").replace(b"!", b"").split()


def _words(data, codes):
    import numpy as np

    words = data.split(b" ")
    return [words[c] for c in np.frombuffer(codes, co._kind(len(words)))]


def test_counts_hold_when_two_phrases_share_a_hash(monkeypatch):
    import numpy as np

    [(words, codes, _)] = list(co.numbered([b"a b. a c. a b. b a"]))
    chunk = co.Chunk("x", words, codes)
    monkeypatch.setattr(chunk, "hash_at", lambda at, m: np.zeros(len(at), dtype=np.uint64))
    everything = np.ones(len(chunk.words), dtype=bool)
    everything[0] = False
    rb = chunk.counts(chunk.places(2, everything, everything), 2)
    assert dict(zip(rb.column(1).to_pylist(), rb.column(2).to_pylist())) == {b"a b": 2, b"a c": 1, b"b a": 1}
