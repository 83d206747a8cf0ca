from __future__ import annotations

import re

import numpy as np
import pytest

from tests.conftest import MEDIUM
from weft.llm import quality_rules as rules
from weft.llm.queries import op7_quality_rules, table


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
    }


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed
        assert not (failed and r["kept"])


def test_query_on_whole_table(spark):
    docs = {r["doc_id"]: r for r in table(spark, MEDIUM, "documents").collect()}
    rows = op7_quality_rules(spark, MEDIUM).collect()
    check(rows, {d: r["text"] for d, r in docs.items()})
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"]}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, MEDIUM, "labels").collect()}
    assert np.mean([kept[d] for d in kept if labels.get(d) == 1]) >= 0.98
    junk = [d for d in kept if sum(c in "#*$%&|<>" for c in docs[d]["text"]) > 0.5 * len(docs[d]["text"].split())]
    assert junk and np.mean([kept[d] for d in junk]) <= 0.1


W = [f"w{i}" for i in range(400)]
ODD = [
    None,
    "",
    " \n\t\x0b\x0c\r ",
    "one",
    " ".join(W[:8]),
    " ".join(W[:8] * 2),
    " ".join(W[:9] + ["x"] + W[:9]),
    " ".join(["a"] * 30),
    " ".join(["a"] * 9),
    "\n".join(["same line here", " same line here", "same line here", "", "", "other"]),
    " ".join(W + W[100:200] + W[50:300]),
    "é\x1cx ñ y 漢字 <|> #a\nb",
    "\nlead and trail \n",
    " ".join(f"v{i % 5000}" for i in range(40000)),
    "#*$%&|<> " * 25,
]


def test_edge_rows(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s"][i % 2], True) for i, t in enumerate(ODD + ODD[-3:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept boolean").repartition(3)
    check(rules.judged(df).collect(), {r[0]: r[1] for r in rows})
    assert rules.judged(df.limit(0)).collect() == []


def test_fences_follow_each_source(spark):
    rng = np.random.default_rng(0)
    rows = []
    for source, mean in (("a", 0.0), ("b", 2.0)):
        for i in range(3000):
            rows.append(("en", source, 1000, 5000, int(1000 * mean + rng.normal(0, 20)), 0, 0, 10))
    rows += [("en", "few", 1000, 5000, 0, 0, 0, 10), ("xx", None, 1000, 5000, 0, 0, 0, 10)]
    cols = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    got = {(r["lang"], r["source"]): r for r in rules.fences(spark.createDataFrame(rows, cols)).collect()}
    for source in "ab":
        x = np.array([r[4] / 1000 for r in rows if r[1] == source])
        low, high = np.quantile(x, [0.25, 0.75])
        room = rules.FENCE * max(high - low, rules.RATIOS["symbols"])
        assert got["en", source]["symbols_low"] == pytest.approx(low - room, abs=0.02)
        assert got["en", source]["symbols_high"] == pytest.approx(high + room, abs=0.02)
    # too few rows: the language's fences, then those of all rows, which reach over both sources
    assert got["en", "few"]["symbols_high"] == pytest.approx(got["xx", None]["symbols_high"], abs=0.1)
    assert got["en", "few"]["symbols_high"] > 2 + 3 * 2


def test_plan_has_no_python(spark):
    plan = rules.judged(table(spark, MEDIUM, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_runs_of_blanks_take_linear_time(spark):
    """A million blanks before, between and behind words; by pattern a run of 80,000 took over a minute."""
    import time

    text = " " * 1_000_000 + "a" + "\t" * 1_000_000 + "b c" + "\n" * 1_000_000
    start = time.time()
    [row] = rules.judged(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).collect()
    assert row["n_words"] == 3 and time.time() - start < 60
