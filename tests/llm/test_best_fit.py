from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from weft.llm import best_fit as bf
from weft.llm.best_fit import best_fit, byte_level_ids, pack_whole
from weft.llm.queries import op13_best_fit, table, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")

ODD = ["", " ", "a\x1c!b  c\tz", "it's  THE\n\n dog's\r\n x ", "<|endoftext|> x<|endoftext|>", "😀😀 a😀 漢字かな　b", "\xa0\xa0a\x85 \x85b", "x" * 9000, " " * 9000]


def _check(rows, texts, window=1024, longest=1024, max_docs=10**9, max_cost=10**12):
    tokenizer = Tokenizer.from_file(PATH)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert sorted(docs) == sorted(texts)
    for d, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        got = sorted(docs[d], key=lambda r: r["piece"])
        assert [r["length"] for r in got][1:] == [longest] * (-(-len(ids) // longest) - 1)
        at = 0
        for k, r in enumerate(got):
            assert (r["piece"], r["start"], r["doc_tokens"]) == (k, at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and len(pieces) <= max_docs and sum(r["length"] ** 2 for r in pieces) <= max_cost
    return len(seqs)


def test_query_on_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    rows = op13_best_fit(spark, SMALL).collect()
    n = _check(rows, {r["doc_id"]: r["text"] for r in docs})
    assert n <= 1.03 * sum(r["length"] for r in rows) / 1024 + 1


def test_edge_rows(spark):
    texts = dict(enumerate([*ODD, None, "same text", "same text", "word " * 7000]))
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in texts.items()], "doc_id long, text string, length int, _row int").repartition(3)
    _check(pack_whole(df, PATH).collect(), texts)
    assert pack_whole(df.limit(0), PATH).collect() == []
    nameless = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id string, text string")
    assert [r["length"] for r in pack_whole(nameless, PATH).collect()] == [3, 3]


@pytest.mark.parametrize("rule", bf.RULES)
def test_every_capacity_binds(spark, rule):
    rng = random.Random(3)
    texts = {i: "ab " * rng.choice([0, 1, 3, 9, 30, 90]) for i in range(200)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = pack_whole(df, PATH, window=64, max_docs=3, max_cost=2000, rule=rule).collect()
    _check(rows, texts, window=64, longest=44, max_docs=3, max_cost=2000)


@pytest.mark.parametrize("rule", bf.RULES)
def test_takes_the_best_sequence(rule):
    """Every step against a plain search over all open sequences."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 60, 300)
    weights, caps = (1.0, 0.3, 0.2), (60, 5, 2500)
    sizes = np.minimum(sizes, 50)
    bins, offsets = best_fit(sizes, *caps, weights=weights, rule=rule)
    open_: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        need = (int(sizes[i]), 1, int(sizes[i]) ** 2)
        best, score = None, None
        for b, room in enumerate(open_):
            if all(r >= n for r, n in zip(room, need)):
                if rule == "norm":
                    s = sum(w * ((r - n) / c) ** 2 for w, r, n, c in zip(weights, room, need, caps))
                else:
                    s = -sum(w * r * n / c**2 for w, r, n, c in zip(weights, room, need, caps))
                if score is None or s < score - 1e-12:
                    best, score = b, s
        if best is None:
            best = len(open_)
            open_.append(list(caps))
        assert bins[i] == best and offsets[i] == caps[0] - open_[best][0]
        open_[best] = [r - n for r, n in zip(open_[best], need)]


def test_a_group_is_packed_nearly_full():
    sizes = np.random.default_rng(7).integers(1, 1024, 5000)
    bins, _ = best_fit(sizes, 1024, 1024, 1024**2)
    assert bins.max() + 1 <= 1.01 * sizes.sum() / 1024 + 1


def test_random_strings_have_the_library_ids():
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(2)
    parts = [*"abXY'’é.,!#|019 \n\t\r\x0b\x1c\x1f\x85\xa0 　​﻿̸ßİ²Ⅷ漢😀…_-", "  ", "   ", "'s", " 'll", "<|endoftext|>", "the", " THE", "ed,"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20000)]
    for text, got in zip(texts, byte_level_ids(PATH)(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
