from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.conftest import SMALL
from weft.llm import packing
from weft.llm.packing import LevelPacker, pack, pour, word_id_bytes
from weft.llm.queries import op10_packing, table, tokenizer_file

PATH = tokenizer_file("word_bpe_49k.json")

ODD = [
    "",
    " ",
    "a\x1c!b  c\tz",
    "It's THE dog's  ’d 42 ٣٤",
    "é ́x İstanbul ΣΑΣ ﬁ",
    "<|endoftext|> x<|startoftext|>y",
    " a b c\r\nd",
    "😀😀 a😀 漢字かな",
    "x" * 5000,
]


def test_word_ids_equal_whole_text_ids():
    tokenizer = Tokenizer.from_file(PATH)
    for text, got in zip(ODD, word_id_bytes(PATH)(ODD)):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text


def _check(rows, texts, window=2048):
    """Pieces cover each document's ids once; sequences are gapless and full or powers of two."""
    tokenizer = Tokenizer.from_file(PATH)
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert sorted(docs) == sorted(texts)
    for d, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(docs[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(seqs) == list(range(len(seqs)))
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0


def test_query_on_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    _check(op10_packing(spark, SMALL).collect(), {r["doc_id"]: r["text"] for r in docs})


def test_edge_rows(spark):
    texts = dict(enumerate([*ODD, None, "same text", "same text", "word " * 7000]))
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, length int").repartition(2)
    _check(pack(df, PATH).collect(), texts)
    assert pack(df.limit(0), PATH).collect() == []


def test_places_by_least_sum_of_squares():
    rng = np.random.default_rng(1)
    packer, levels = LevelPacker(16), {}
    for i, size in enumerate(rng.integers(1, 16, 400).tolist()):
        def after(h):
            n = dict(levels)
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] = n.get(h + size, 0) + 1
            return sum(v * v for v in n.values())

        best = min(after(h) for h in range(0, 17 - size) if h == 0 or levels.get(h))
        packer.place((i, 0, size), size)
        levels = {h: int(c) for h, c in enumerate(packer.counts) if c}
        assert sum(v * v for v in levels.values()) == best


@pytest.mark.parametrize("total", [1, 15, 16, 37, 160])
def test_pour(total):
    pieces = [(i, 3, n) for i, n in enumerate([7] * (total // 7) + ([total % 7] if total % 7 else []))]
    sizes = [sum(p[2] for p in w) for w in pour(pieces, 16)]
    assert sum(sizes) == total and sizes[: total // 16] == [16] * (total // 16)
    assert all(s & (s - 1) == 0 for s in sizes)


def test_random_strings_have_the_library_ids():
    import random

    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(2)
    parts = [*"abXYZ'’é.,!#|=<>019 \n\t\x1c\x85̸́ßİΣ²Ⅷ漢😀¿…_-ǄǅſŸµªƻ", "s'", "<|endoftext|>", "the", "THE", "ed,", "Å", "ﬁ", "≠", "ées"]
    parts += [chr(c) for c in range(0xC0, 0x250)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(20000)]
    for text, got in zip(texts, word_id_bytes(PATH)(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_plain_texts_are_encoded_by_rank(monkeypatch):
    """New words of plain texts cost no pass through tables of words."""
    import random

    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    parts = [*"abcxyzABCZ'.,!%|=019 \n\t\rßéÉ–…×»", "'s", "'LL", "the", "tion", "ing ", "...", "''re"]
    parts += [c for c in map(chr, range(0xC0, 0x250)) if packing._PLAIN.fullmatch(c)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(5000)] + ["x" * 1000, "x" * 1000 + " " + "." * 1000]
    assert all(packing._PLAIN.fullmatch(t) for t in texts) and not packing._PLAIN.fullmatch("x" * 1001)
    got = word_id_bytes(PATH)(texts)
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    by_rank, memo = packing._ENCODERS[PATH]
    assert by_rank is not None
    held = len(memo.young) + len(memo.old)
    word_id_bytes(PATH)([f"qxz{i}{'abc'[i % 3] * 9} of" for i in range(1000)])
    assert len(memo.young) + len(memo.old) == held
    monkeypatch.setattr(packing, "CHUNK_CHARS", 7)  # long texts are cut at spaces
    assert word_id_bytes(PATH)(texts) == got


def test_every_token_is_its_own_encoding():
    """Encoding by rank is the rule of the merges as each token comes out of the merges of its own parts."""
    import json

    model = json.loads(Tokenizer.from_file(PATH).to_str())["model"]
    rank = {tuple(m): k for k, m in enumerate(model["merges"])}
    end, wrong = model["end_of_word_suffix"], []
    for a, b in model["merges"]:
        core = (a + b).removesuffix(end)
        parts = list(core)
        if core != a + b:
            parts[-1] += end
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda k: (rank.get((parts[k], parts[k + 1]), len(rank)), k))
            if (parts[k], parts[k + 1]) not in rank:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if parts != [a + b]:
            wrong.append((a, b))
    assert not wrong
