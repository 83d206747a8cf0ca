"""Results must not depend on partitioning: run with 1 and 16 shuffle partitions."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from weft.oracle import normalise

Q = entry.queries()
NAMES = ["s16_equal_shards", "k01_top_fraction", "w20_retention", "p17_slice_fraction", "m11_with_system", "w10_pad_to_batch", "r11_prompt_advantages"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_for_1_and_16_partitions(spark, name):
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = Q[name](spark, SMALL)
            results.append(normalise(df.columns, [tuple(r) for r in df.collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]
