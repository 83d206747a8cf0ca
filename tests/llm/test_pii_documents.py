from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from weft.llm import pii

PLAIN = [f"the line {i} is here now again and please call about today" for i in range(60)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def clean(spark, texts):
    return [r["text"] for r in pii.sanitise(frame(spark, texts)).orderBy("doc_id").collect()]


def test_terms_are_marked_wherever_they_stand_in_the_entitys_documents(spark):
    far = "bob@site.org " + "the line is here now again and please call about today " * 3
    texts = [far + "zorblax", "the zorblax " + far, far + "now zorblax again zorblax", *PLAIN]
    got = clean(spark, texts)
    assert not any("zorblax" in t for t in got) and got[2].endswith("now [removed] again [removed]") and got[3:] == PLAIN
    spans = {r["doc_id"]: r["spans"] for r in pii.digest_documents(frame(spark, texts)).collect()}
    assert spans[0].endswith(f"term:{len(far)}:{len(far) + 7}") and spans[3] == ""


def test_copies_of_the_disclosing_documents_change_nothing(spark):
    own = ["zorblax the line bob@site.org now", "here bob@site.org again zorblax and now"]
    few, many = own + PLAIN, own * 50 + PLAIN
    assert clean(spark, few)[:2] == ["[removed] the line [email] now", "here [email] again [removed] and now"]
    assert clean(spark, many) == clean(spark, few)[:2] * 50 + PLAIN


def test_counts_of_different_texts(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.randint(0, 4))) for _ in range(400)] + [None, None]
    df = frame(spark, texts)
    terms = spark.createDataFrame([(c,) for c in "abcdz"], "term string")
    counts, total = pii.distinct_document_counts(df, terms)
    different = {t or "" for t in texts}
    assert total == len(different)
    assert {r["term"]: r["n"] for r in counts.collect()} == {c: sum(c in t.split() for t in different) for c in "abcd"}


def test_words_of_a_single_text_stay(spark):
    """Unrelated once-only words beside an address, in corpora of two sizes; terms that two texts share with one go."""
    for plain in (PLAIN, [f"{t} {i}" for i in range(40) for t in PLAIN]):
        chance = [f"the line p{k}@site.org is rare{k}a now rare{k}b" for k in range(100)]
        planted = [f"call {x} about q{k}@site.org and {w}" for k in range(20) for x, w in ((f"name{k}", f"town{k}"), (f"name{k}", "today"))]
        got = clean(spark, [*chance, *planted, *plain])
        assert got[:100] == [f"the line [email] is rare{k}a now rare{k}b" for k in range(100)]
        assert [t for t in got[100:140]] == [f"call [removed] about [email] and {w}" for k in range(20) for w in (f"town{k}", "today")]
        assert got[140:] == plain


def test_disclosure_equals_plain_counts_over_different_texts(spark):
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(4000)]
    texts = []
    for _ in range(700):
        t = rng.choices(words, k=rng.randint(1, 12))
        if rng.random() < 0.1:
            for k in rng.choices(range(25), k=rng.randint(1, 3)):
                t += [f"p{k}@site.org", f"w{5000 + k}"]
        if rng.random() < 0.03:
            t.append(f"w{5000 + rng.randrange(25)}")
        rng.shuffle(t)
        texts += [" ".join(t)] * rng.choice([1, 1, 1, 4])
    different = sorted(set(texts))
    mails = {t: set(re.findall(r"p\d+@site.org", t)) for t in different}
    n_e, n_t, n_pair = defaultdict(int), defaultdict(int), defaultdict(int)
    for t in different:
        for e in mails[t]:
            n_e[e] += 1
        for w in set(re.findall(r"\w+", t)):
            n_t[w] += 1
            for e in mails[t]:
                n_pair[e, w] += 1
    n = len(different)

    def bound(hits, tries):
        share, z2 = hits / tries, pii.Z**2
        return (share + z2 / (2 * tries) - pii.Z * math.sqrt(share * (1 - share) / tries + z2 / (4 * tries * tries))) / (1 + z2 / tries)

    def kind(t, w):
        bounds = {e: bound(n_pair[e, w], n_t[w]) for e in mails[t]}
        best = max((p for e, p in bounds.items() if math.log(p * n / n_e[e]) >= pii.SHARE * math.log(n / n_e[e])), default=0)
        return "term" if best >= pii.REMOVE_FROM else "general" if best >= pii.GENERALISE_FROM else None

    rows = pii.digest_documents(frame(spark, texts)).collect()
    kinds = set()
    for r in rows:
        t = texts[r["doc_id"]]
        want = [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(r"(?<!\S)w\d+", t) if (k := kind(t, m[0]))]
        assert [s for s in r["spans"].split(",") if s[:4] in ("term", "gene")] == want
        kinds |= {s.split(":")[0] for s in want}
    assert kinds == {"term", "general"}
