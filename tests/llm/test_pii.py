from __future__ import annotations

import hashlib
import random
import re

from tests.conftest import SMALL
from weft.llm import pii
from weft.llm.queries import op6_pii, table

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub(r"\D", "", s)) <= 19 and plain_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
}


def plain_luhn(d):
    odd, even = d[-1::-2], d[-2::-2]
    return (sum(map(int, odd)) + sum(sum(map(int, str(2 * int(c)))) for c in even)) % 10 == 0


def plain_spans(text):
    out = []
    for k, (rule, good) in enumerate(RULES.values()):
        out += [(m.start(), k, m.end()) for m in re.finditer(rule, text) if good(m[0])]
    return sorted(out)


def as_text(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def parse(s):
    return [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(as_text(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(s[1] == i for s in want) for i in range(4)]
        got = parse(r["spans"])
        assert [s for s in got if s[1] < 4] == want and got == sorted(got)
        assert want or not got  # nothing is added where nothing is protected


def test_random_strings_equal_the_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "..", "x@y.z", "_", "-", "1", "12", "255", "256", "001", "1.2.3.4", " ", "+", "+1 (", ")", "4111 1111 1111 1111", "378282246310005", "é", "\n"]
    for _ in range(30000):
        t = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_query_on_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    check(op6_pii(spark, SMALL).collect(), {r["doc_id"]: r["text"] for r in docs})


def test_long_texts_take_linear_time():
    for t in ["a" * 10**6, "1" * 10**6, "+" * 10**5, "a@" * 10**5, "1." * 10**5, "9 " * 10**5, "+1" + "(" * 10**5]:
        pii.base_spans(t)


TEXTS = [
    "call zorblax about bob@site.org please today",
    "yes zorblax wrote to bob@site.org again now",
    "yes zorblax wrote to bob@site.org again now",
    "that zorblax sent bob@site.org a line now",
    "see amy@site.org about the line",
    None,
    "",
    "+1 (017) 555-7713 " + "word " * 50000 + "10.0.0.1",
] + [f"the line {i} is here now again and please call about today" for i in range(60)]


def test_edge_rows_and_redaction(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string").repartition(3)
    rows = pii.digest_documents(df).collect()
    check(rows, dict(enumerate(TEXTS)))
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert "term:5:12" in spans[0] and spans[1] == spans[2] and spans[4].count(":") == 2
    clean = pii.sanitise(df)
    assert clean.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(text) == len(TEXTS) and text[5] is None and text[6] == ""
    assert text[3] == "that [removed] sent [email] a line now"
    assert text[7].startswith("[phone] word") and text[7].endswith("word [ip]")
    assert text[10] == TEXTS[10]
    assert pii.digest_documents(df.limit(0)).collect() == [] and pii.sanitise(df.limit(0)).collect() == []


def test_columns_with_clashing_names(spark):
    names = ["_source", "_hash", "_spans", "_entities", "_terms", "doc_id", "text", "n_chars", "_0", "_text"]
    rows = [("s", 1, "sp", 2.0, True, i, t, len(t), "z", None) for i, t in enumerate(["a bob@site.org b", "plain", "zorblax bob@site.org", "its zorblax bob@site.org"])]
    df = spark.createDataFrame(rows, "_source string, _hash long, _spans string, _entities double, _terms boolean, doc_id long, text string, n_chars int, _0 string, _text string")
    out = pii.sanitise(df)
    assert out.columns == names and out.schema == df.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in range(2)] == ["a [email] b", "plain"] and got[0]["n_chars"] == 11
    assert all(tuple(r)[:5] == rows[0][:5] and r["_0"] == "z" and r["_text"] is None for r in got.values())
