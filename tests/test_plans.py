"""Invariants and hand-worked cases of the order and packing plans and of T03."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from weft.functions.lcs import lcs_length
from weft.plans.order import deal_evenly, interleave_sizes, modality_grouped, pack_greedy
from weft.streaming.jobs import stream_prompt_advantages

Q = entry.queries()


def test_interleave_slots_are_a_permutation_per_rank(spark):
    rows = Q["w11_interleave_plan"](spark, SMALL).collect()
    by_rank: dict[int, list[int]] = {}
    for r in rows:
        by_rank.setdefault(r.rank, []).append(r.slot)
    assert set(by_rank) == {0, 1}
    sizes = Counter(r.dataset for r in rows if r.rank == 0)
    for slots in by_rank.values():
        assert sorted(slots) == list(range(len(slots)))
    # every dataset contributes whole batches to each rank
    assert all(n % 4 == 0 for n in sizes.values())


def test_interleave_size_rule():
    assert interleave_sizes({"a": 103, "b": 7}, world=2, batch=4, accum=1, sp=1) == {"a": 48, "b": 0}


def test_length_grouped_covers_every_row_once(spark):
    rows = Q["w13_length_grouped"](spark, SMALL).collect()
    ids = [r.conv_id for r in rows]
    assert len(ids) == len(set(ids))
    per_mb = Counter(r.megabatch for r in rows)
    for mb, n in per_mb.items():
        chunks = Counter(r.chunk for r in rows if r.megabatch == mb)
        if n % 2 == 0:
            assert set(chunks.values()) == {n // 2}


@pytest.mark.parametrize(("media", "text", "extra", "full"), [(8, 8, 16, 0), (12, 9, 5, 16), (8, 0, 0, 8), (3, 2, 5, 0)])
def test_last_megabatches_of_both_modalities_make_one(spark, media, text, extra, full):
    rows = [(i, 10 + i) for i in range(media)] + [(100 + i, -5 - i) for i in range(text)]
    out = modality_grouped(spark.createDataFrame(rows, "k long, n long"), "k", "n", batch=4, world=2).collect()
    merged = sorted((r.pos, r.k) for r in out if r.extra)
    assert len(merged) == extra and len(out) - extra == full
    assert [k for _, k in merged] == sorted(k for _, k in merged)
    assert len({r.megabatch_order for r in out}) == full // 8 + (extra > 0)


def test_zero_length_fails(spark):
    df = spark.createDataFrame([(1, 0), (2, 3)], "k long, n long")
    with pytest.raises(Exception, match="zero length"):
        modality_grouped(df, "k", "n", 4, 2).collect()


@pytest.mark.parametrize(("lengths", "k", "want"), [
    ([9, 5, 4, 1], 2, [0, 1, 1, 0]),
    ([9, 8, 7, 1, 1, 1], 2, [0, 1, 1, 0, 0, 1]),
    ([5, 4, 3], 2, [0, 1, 0]),
    ([], 3, []),
    ([3, 3, 3], 3, [0, 1, 2]),
])
def test_items_are_dealt_evenly(lengths, k, want):
    assert deal_evenly(lengths, k) == want


def test_packs_by_hand(spark):
    # (id, tokens, images); sorted: 9, 8, 5, 4, 3, 2 and one that is too long
    rows = [(1, 9, 1), (2, 8, 0), (3, 5, 0), (4, 4, 2), (5, 3, 0), (6, 2, 0), (7, 40, 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k long, t long, i long, g long")
    got = {r.k: (r.pack, r.offset) for r in pack_greedy(df, "k", "g", "t", "i", max_len=12, max_images=2).collect()}
    # 9 opens pack 0; 8 does not fit; without images a pack takes what fits in 12 tokens
    assert got == {1: (0, 0), 2: (1, 0), 3: (2, 0), 4: (2, 5), 5: (3, 0), 6: (3, 3), 7: (-1, 0)}


def test_bit_row_lcs_equals_the_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


def test_prompt_advantages_by_hand(spark):
    schema = "prompt string, step long, reward double"
    batches = [[("a", 1, 0.0), ("a", 2, 10.0), ("b", 1, 5.0)], [("a", 3, 2.0), ("a", 4, 4.0)], [("b", 2, 7.0), ("a", 5, 6.0)]]
    rows = stream_prompt_advantages(spark, [spark.createDataFrame(b, schema) for b in batches], buffer=3, min_count=3).collect()
    got = {(r.prompt, r.step): r.advantage for r in rows}
    first = np.array([0.0, 10.0, 5.0])  # too few of either prompt: the whole batch
    assert got["a", 1] == pytest.approx((0 - first.mean()) / (first.std() + 1e-6))
    assert got["b", 1] == pytest.approx(0)
    kept = np.array([10.0, 2.0, 4.0])  # the last three of a
    assert got["a", 3] == pytest.approx((2 - kept.mean()) / (kept.std() + 1e-6))
    assert got["b", 2] == pytest.approx((7 - 6.5) / (0.5 + 1e-6))  # two of b: the batch of 7 and 6
    kept = np.array([2.0, 4.0, 6.0])
    assert got["a", 5] == pytest.approx((6 - kept.mean()) / (kept.std() + 1e-6))


def test_greedy_packs_respect_max_len(spark):
    rows = Q["w17_pack_greedy"](spark, SMALL).collect()
    packs: dict[tuple[int, int], int] = {}
    for r in rows:
        if r.pack >= 0:
            packs[(r.batch, r.pack)] = max(packs.get((r.batch, r.pack), 0), r.offset + r.seqlen)
        else:
            assert r.seqlen > 512
    assert max(packs.values()) <= 512


def test_streaming_state_is_bounded(spark):
    rows = Q["t03_stream_prompt_advantages"](spark, SMALL).collect()
    assert rows and max(r.buffered for r in rows) <= 16
