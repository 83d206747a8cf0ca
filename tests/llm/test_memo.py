from __future__ import annotations

import random

from weft.llm.memo import ENTRY, LONG, Memo


def test_values_are_right_and_bytes_bounded():
    rng, asked = random.Random(1), []

    def compute(keys):
        asked.extend(keys)
        return [k.encode() * 2 for k in keys]

    memo = Memo(compute, budget=20_000)
    for _ in range(200):
        lists = [[rng.choice("abcdefgh") * rng.choice([1, 2, 3, 50, LONG + 5, 4000]) + str(rng.randrange(300)) for _ in range(20)] for _ in range(3)]
        get = memo.getter(lists)
        assert all(get(k) == k.encode() * 2 for ks in lists for k in ks)
        for table in (memo.young, memo.old):
            assert not any(len(k) > LONG for k in table)
            assert sum(len(k) + len(v) + ENTRY for k, v in table.items()) <= 20_000 + 60 * (ENTRY + 3 * LONG)
    assert len(asked) < 200 * 60  # it remembers


def test_a_key_in_use_outlives_a_turn():
    asked = []
    memo = Memo(lambda ks: [asked.append(k) or b"x" for k in ks], budget=10 * ENTRY)
    for i in range(50):
        memo.getter([["kept", f"k{i}"]])
    assert asked.count("kept") == 1
