from __future__ import annotations

from weft.llm import simhash


def test_a_distinct_text_is_not_dropped_for_its_id(spark):
    a, b, c = "one two three four five six seven", "nine plain apples lie under the old tree", "rain falls on stone all day long here"
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "z"), (7, c, "u"), (7, b, "v"), (3, c, "w"), (9, None, "n"), (None, a, "k"), (3, a, "b")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        got = {tuple(r) for r in simhash.keep_one(df).collect()}
        assert {(d, t) for d, t, _ in got} == {(3, a), (5, b), (3, c), (9, None), (None, a)} and len(got) == 5
        seen = got if parts == 1 else seen
        assert got == seen
