from __future__ import annotations

from weft.sources.labels import LabelStore
from weft.streaming.jobs import work_dir


def test_store_is_saved_as_map_and_list_and_loaded(spark):
    store = LabelStore(spark, work_dir(spark, "labels"), "score int, note string")
    first = store.upsert(spark.createDataFrame([("a", 1, 'q "x"'), ("b", None, None)], "id string, score int, note string"), "id")
    store.upsert(spark.createDataFrame([("b", 2, "é"), ("c", 3, "")], "id string, score int, note string"), "id")
    folder = work_dir(spark, "saved")
    store.save(folder)
    lines = {r[0] for r in spark.read.text(f"{folder}/data").collect()}
    assert lines == {'{"a":{"score":1,"note":"q \\"x\\""}}', '{"b":{"score":2,"note":"é"}}', '{"c":{"score":3,"note":""}}'}
    assert spark.read.text(f"{folder}/instances").count() == 3
    other = LabelStore(spark, work_dir(spark, "labels"), "score int, note string")
    assert other.load(folder + "-none") is None and other.rows().count() == 0
    other.load(folder)
    as_dict = lambda df: {r["key"]: tuple(r["instance"]) for r in df.collect()}
    assert as_dict(other.rows()) == as_dict(store.rows()) == {"a": (1, 'q "x"'), "b": (2, "é"), "c": (3, "")}
    assert as_dict(store.rows(first)) == {"a": (1, 'q "x"'), "b": (None, None)}
