"""Invariants of the shared primitives: positions, keyed hash, mixture grammar."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from weft.ids import keyed_hash, positions, read_with_row_id
from weft.plans.mixture import expand_names, parse_item


def test_row_id_is_dense_and_file_ordered(spark):
    df = read_with_row_id(spark, f"{SMALL}/documents.parquet")
    ids = [r.row_id for r in df.select("row_id").collect()]
    assert sorted(ids) == list(range(len(ids)))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_positions_do_not_depend_on_partitioning(spark, parts):
    base = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    base = base.withColumn("k", F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).dropDuplicates(["k"])
    got = positions(base.repartition(parts), ["k"], partition=["l_linenumber"], name="pos", num_partitions=parts)
    rows = got.select("l_linenumber", "k", "pos").collect()
    by_group: dict[int, list[tuple[int, int]]] = {}
    for r in rows:
        by_group.setdefault(r.l_linenumber, []).append((r.k, r.pos))
    for pairs in by_group.values():
        pairs.sort()
        assert [p for _, p in pairs] == list(range(len(pairs)))


def test_positions_hot_group_spreads(spark):
    # one group holds every row: the range exchange must still use several tasks
    df = spark.range(0, 5000).withColumn("g", F.lit("hot"))
    got = positions(df, ["id"], partition=["g"], num_partitions=8)
    assert [r.pos for r in got.orderBy("id").select("pos").collect()] == list(range(5000))


def test_keyed_hash_matches_duckdb(spark, duck_small):
    row = spark.range(1).select(keyed_hash(42, F.lit(7)).alias("h")).first()
    assert row.h == duck_small.execute("SELECT ('0x' || substr(md5('42|7'), 1, 8))::BIGINT").fetchone()[0]


def test_mixture_grammar():
    mix = {"m": ["b", "a*2"], "n": ["m", "c@x"]}
    assert expand_names("n+d", mix) == sorted(["b", "a*2", "c@x", "d"])
    assert parse_item("a*3@noisy").times == 3 and parse_item("a*3@noisy").subset == "noisy"
    with pytest.raises(ValueError):
        parse_item("a@noisy*3")
    with pytest.raises(ValueError):
        expand_names("x", {"x": ["y"], "y": ["x"]})
