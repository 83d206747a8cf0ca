from __future__ import annotations

from collections import defaultdict

import pytest

from weft.llm import sharding


@pytest.mark.parametrize("few", [sharding.FEW_VALUES, 0])
def test_names_that_share_their_first_bytes_are_told_apart(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FEW_VALUES", few)
    names = ["wikipedia_de", "wikipedia_en", "wikipedia_fr", "wikipedia_it"]
    rows = [(i, "x" * 50, "en", names[i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    shards = defaultdict(set)
    for r in sharding.sharded_documents(df, 4).collect():
        shards[r["shard"]].add(names[r["doc_id"] % 4])
    assert sorted(map(sorted, shards.values())) == [[n] for n in names]
