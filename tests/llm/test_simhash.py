from __future__ import annotations

import random
import re

import pytest
import xxhash

from tests.conftest import SMALL
from weft.llm.graph import components
from weft.llm.queries import op3_simhash, table
from weft.llm.simhash import fingerprints, near_duplicates, near_links


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def check(rows, texts):
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    want = brute_components(sorted(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert len(rows) == len(texts)
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in texts}


def test_query_on_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    check(op3_simhash(spark, SMALL).collect(), {r["doc_id"]: r["text"] for r in docs})


def test_edge_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = ["", None, "   \n", "One", "one", "one two", "ONE two", "É é\x1cx", "a b c", base, base + " end", base.upper(), "x " * 20000, "a b c"]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in enumerate(texts)], "doc_id long, text string, component_id int, fingerprint string").repartition(3)
    check(near_duplicates(df).collect(), dict(enumerate(texts)))
    assert near_duplicates(df.limit(0)).collect() == []


def test_rows_without_id_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "zz")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["component_id"]) for r in near_duplicates(df).collect() if r["component_id"])
    assert got == [(False, 4), (False, 4), (True, 4)]


@pytest.mark.parametrize("bucket", [0, 3, 64])
@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_of_a_close_family(spark, bucket, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps)[:4]:
        for _ in range(25):
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    want = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= distance)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = near_links(spark.createDataFrame([(signed(f),) for f in fps], "_fp long"), distance, bucket=bucket).collect()
    mask = (1 << 64) - 1
    assert all(((a & mask) ^ (b & mask)).bit_count() <= distance for a, b in links)
    pairs = {(a & mask, b & mask) for a, b in links} | {(b & mask, a & mask) for a, b in links}
    assert brute_components(sorted(fps), lambda a, b: (a, b) in pairs) == want


def test_fingerprints_without_shingles():
    assert fingerprints([b"", b" \n"]).tolist() == [0, 0]
    assert fingerprints([]).tolist() == []


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for e in links for n in e if None not in e and e[0] != e[1]}
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    want = brute_components(sorted(nodes), lambda a, b: (a, b) in both)
    assert {n: got.get(n, n) for n in nodes} == want
