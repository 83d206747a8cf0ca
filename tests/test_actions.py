"""F24–F26 against hand-worked cases (no SQL twin)."""

from __future__ import annotations


from weft.functions.actions import compare_action, indel_ratio, parse_action


def test_indel_ratio(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("abc", "abc")], "a string, b string")
    got = [round(r.x, 6) for r in df.select(indel_ratio("a", "b").alias("x")).collect()]
    # LCS(kitten, sitting) = 4 -> 8 / 13
    assert got == [round(8 / 13, 6), 1.0, 1.0]


def test_parse_and_compare(spark):
    gt = '{"ACTION": "scroll", "ARGS": {"direction": "down"}}'
    rows = [
        (gt, gt),
        (gt, "let me SCROLL now, scroll down please"),
        ('{"ACTION": "click_element", "ARGS": {"bbox": [0, 0, 10, 10]}}', "CLICK_ELEMENT at [1, 1, 10, 10]"),
        ('{"ACTION": "input", "ARGS": {"text": "hello"}}', "input text hello world"),
        ('{"ACTION": "press_home", "ARGS": {}}', "press_back"),
    ]
    df = spark.createDataFrame(rows, "gt string, pred string")
    out = df.select(compare_action(parse_action("gt"), parse_action("pred")).alias("m")).select("m.*").collect()
    assert [(r.type_match, r.exact_match) for r in out] == [(True, True), (True, True), (True, True), (True, True), (False, False)]
