from __future__ import annotations

import hashlib
import random

import numpy as np
import sentencepiece

from tests.conftest import SMALL
from weft.llm.pieces import digest_texts, encode_texts, piece_table
from weft.llm.queries import op5_sentencepiece, table, tokenizer_file

PATH = tokenizer_file("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)

ODD = ["", " ", "   ", "a  b", " lead", "trail ", "▁▁x▁ y", "line\none\t\x00two", "<s> </s> <0x0A> <unk>", "漢字😀é ́", "a" * 30000, "the " * 3000, " " * 4000 + "x"]


def _lib(text):
    return LIB.encode(text, add_bos=True, add_eos=True)


def test_random_strings_equal_the_library():
    rng = random.Random(7)
    parts = [*"abcdefghijklmnop   \n\t.,the▁é漢字😀0123456789-<>\x00ﬁΣ", "the", "ing", "<s>", "<0x0A>", "    ", "▁▁"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(5000)]
    t = piece_table(PATH)
    for text, got in zip(texts, t.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == _lib(text), text


def test_prefix_table_holds_each_prefix_last_token():
    t = piece_table(PATH)
    text = "▁internationalisationés"
    for i, token in enumerate(t.last_tokens(text)):
        ids = [x for x in LIB.encode(text[1 : i + 1])] if i else [t.ids["▁"]]
        assert token == ids[-1]


def test_pair_test_equals_merging_the_joined_text():
    t, rng = piece_table(PATH), random.Random(3)
    tokens = sorted(p for p in t.tokens if len(p) <= 6 and "▁▁" not in p)
    ends = {}
    for p in tokens:
        ends.setdefault(p[-1], []).append(p)
    for _ in range(20000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if "▁" not in b:
            assert t.compatible(t.ids[a], t.ids[b]) == (t.merge(a + b) == [a, b]), (a, b)


def test_query_on_whole_table(spark):
    got = {r["doc_id"]: r for r in op5_sentencepiece(spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = _lib(d["text"] or "")
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


def test_edge_rows(spark):
    texts = [*ODD, None, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = sorted(encode_texts(df, PATH).collect())
    assert [list(r["ids"]) for r in rows] == [_lib(t or "") for t in texts]
    assert [r["decoded"] for r in rows] == [LIB.decode(_lib(t or "")) for t in texts]
    assert digest_texts(df.limit(0), PATH).collect() == []
    assert dict(digest_texts(df, PATH, keep=("doc_id", "n_tokens")).dtypes)["n_tokens"] == "bigint"
