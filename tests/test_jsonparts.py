from __future__ import annotations

import json
import random

import pytest

from weft.sources import files as S
from weft.sources import jsonparts as J
from weft.sources.files import shared_path


def _value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choices('ab,{}[]":\\ \n\té漢😀', k=rng.randrange(9)))
    if kind < 4:
        return rng.choice([None, True, 1.5, -3, 10**12])
    if kind < 6:
        return {f'k{i}"\\,'[: rng.randint(2, 5)]: _value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(4))]


def _write(spark, name, texts):
    root = shared_path(spark, name)
    import os

    local = root.removeprefix("file:")
    os.makedirs(local)
    for k, t in enumerate(texts):
        with open(f"{local}/f{k}.json", "w", encoding="utf-8") as f:
            f.write(t)
    return root


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_elements_equal_the_whole_read(spark, small_splits, seed):
    rng = random.Random(seed)
    arrays = [[_value(rng) for _ in range(rng.choice([0, 1, 60, 200]))] for _ in range(4)]
    arrays.append(["," * 3000, {"x": "y" * 2500}, [], "z" * 1500, 7])  # elements longer than several ranges
    dump = lambda x: json.dumps(x, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
    root = _write(spark, f"elements{seed}", [rng.choice(["", " \n", "﻿"]) + dump(x) + rng.choice(["", "\n"]) for x in arrays])
    assert J.ranges(spark, root).count() > 8
    got: dict[str, list] = {}
    for r in J.elements(spark, root).collect():
        got.setdefault(r["file"][-7:-5], []).append(json.dumps(json.loads(r["text"])))
    for k, x in enumerate(arrays):
        assert sorted(got.get(f"f{k}", [])) == sorted(json.dumps(v) for v in x)


def test_members_of_objects(spark, small_splits):
    rng = random.Random(9)
    objects = [{f'id"{k}-{i}': {"k": i, "t": _value(rng)} for i in range(n)} for k, n in enumerate((0, 1, 150))]
    root = _write(spark, "members", [json.dumps(o) for o in objects])
    got = {r["key"]: r["k"] for r in S.read_keyed_json(spark, root, "struct<k:bigint>").select("key", "value.k").collect()}
    assert got == {k: v["k"] for o in objects for k, v in o.items()}
    numbers = _write(spark, "numbers", [json.dumps({f"n{i}": i for i in range(400)}, indent=1)])
    assert {r["key"]: r["value"] for r in S.read_keyed_json(spark, numbers, "bigint").collect()} == {f"n{i}": i for i in range(400)}


def test_arrays_and_lines_by_file(spark, small_splits):
    rows = [{"id": i, "t": 'a,"]}[{' * (i % 5)} for i in range(300)]
    lines = "\n".join(json.dumps(r) for r in rows[200:]) + "\n\n"
    root = _write(spark, "records", [json.dumps(rows[:200])[:-1] + ', 5, null, ["x"]]', lines, "", "  \n"])
    got = {r["id"]: r["t"] for r in S.read_records(spark, root, "id bigint, t string").collect()}
    assert got == {r["id"]: r["t"] for r in rows}
    big = spark.read.option("lineSep", ",").text(f"{root}/f0.json")
    assert big.rdd.getNumPartitions() > 3  # several tasks read the one array
    assert S.read_records(spark, _write(spark, "none", [""]), "id bigint").collect() == []
