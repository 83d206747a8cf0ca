"""Registered queries for answer parsing (F17, F19, F20) and the facet breakdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import fx_answers
from weft.functions import choices as C
from weft.operators.metrics import facet_breakdown

RESP_SQL = """CASE question_id % 5 WHEN 0 THEN 'The answer is (B).' WHEN 1 THEN 'I think B is right'
  WHEN 2 THEN '(A) or maybe (C) final' WHEN 3 THEN 'this is clearly the ' || gt || ' part you asked for' ELSE 'no idea!' END"""


def _resp():
    k = F.col("question_id") % 5
    return (
        F.when(k == 0, F.lit("The answer is (B).")).when(k == 1, F.lit("I think B is right")).when(k == 2, F.lit("(A) or maybe (C) final"))
        .when(k == 3, F.concat(F.lit("this is clearly the "), "gt", F.lit(" part you asked for"))).otherwise(F.lit("no idea!"))
    )


def _strip_sql(x: str) -> str:
    for ch in C.STRIP_CHARS:
        esc = "\\" + ch if ch in ".?" else ch
        lit = esc.replace("'", "''")
        x = f"regexp_replace({x}, '^{lit}+|{lit}+$', '', 'g')"
    return x


def _rfind_sql(s: str, sub: str) -> str:
    return f"(CASE WHEN strpos(reverse({s}), reverse({sub})) > 0 THEN length({s}) - length({sub}) - strpos(reverse({s}), reverse({sub})) + 1 ELSE -1 END)"


PARSE_SQL = f"""WITH a AS (SELECT question_id, {_strip_sql(RESP_SQL)} AS r, ['A', 'B', 'C', 'D'] AS letters, [pred, gt, category, 'red bolt'] AS answers FROM fx_answers),
b AS (SELECT question_id, r, ' ' || r || ' ' AS resp, letters, answers FROM a),
c AS (SELECT *,
  list_filter(range(4), lambda i: strpos(resp, '(' || letters[i + 1] || ')') > 0) AS brack,
  list_filter(range(4), lambda i: strpos(resp, ' ' || letters[i + 1] || ' ') > 0) AS spaced,
  CASE WHEN len(list_filter(regexp_split_to_array(trim(resp), '\\s+'), lambda w: w <> '')) > 5
    THEN list_filter(range(4), lambda i: strpos(lower(resp), lower(answers[i + 1])) > 0) ELSE [] END AS content FROM b)
SELECT question_id, letters[1 + CASE
  WHEN len(brack) > 0 THEN (list_sort(list_transform(brack, lambda i: {{'p': {_rfind_sql("resp", "'(' || letters[i + 1] || ')'")}, 'ni': -i}}), 'DESC'))[1].ni * -1
  WHEN len(spaced) > 0 THEN (list_sort(list_transform(spaced, lambda i: {{'p': {_rfind_sql("resp", "' ' || letters[i + 1] || ' '")}, 'ni': -i}}), 'DESC'))[1].ni * -1
  WHEN len(content) > 0 THEN (list_sort(list_transform(content, lambda i: {{'p': {_rfind_sql("lower(resp)", "lower(answers[i + 1])")}, 'ni': -i}}), 'DESC'))[1].ni * -1
  ELSE ('0x' || substr(md5('42|' || r), 1, 8))::BIGINT % 4 END] AS letter FROM c"""


@query("f17_parse_choice", PARSE_SQL)
def f17(spark, sf):
    a = fx_answers(spark, sf)
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    answers = F.array("pred", "gt", "category", F.lit("red bolt"))
    return a.select("question_id", C.parse_choice(_resp(), letters, answers).alias("letter"))


QT = "CASE WHEN question_id % 3 = 0 THEN 'free_form' ELSE 'multi_choice' END"
AT = "CASE WHEN question_id % 3 <> 0 THEN 'text' WHEN question_id % 2 = 0 THEN 'integer' ELSE 'float' END"
F_RESP = """CASE WHEN question_id % 3 <> 0 THEN (CASE question_id % 4 WHEN 0 THEN gt WHEN 1 THEN '(c) guess' WHEN 2 THEN 'B' ELSE 'zz ' || pred END)
  WHEN question_id % 2 = 0 THEN CASE WHEN question_id % 9 = 0 THEN 'x' || CAST(n AS STRING) ELSE CAST(n AS STRING) END
  ELSE CASE WHEN question_id % 7 = 0 THEN 'The answer is "' || CAST(n AS STRING) || '.25".' ELSE CAST(n AS STRING) || '.5' END END"""


def _frame(spark, sf):
    a = fx_answers(spark, sf)
    q = F.col("question_id")
    qt = F.when(q % 3 == 0, F.lit("free_form")).otherwise(F.lit("multi_choice"))
    at = F.when(q % 3 != 0, F.lit("text")).when(q % 2 == 0, F.lit("integer")).otherwise(F.lit("float"))
    k4 = q % 4
    mc = F.when(k4 == 0, F.col("gt")).when(k4 == 1, F.lit("(c) guess")).when(k4 == 2, F.lit("B")).otherwise(F.concat(F.lit("zz "), "pred"))
    ns = F.col("n").cast("string")
    integer = F.when(q % 9 == 0, F.concat(F.lit("x"), ns)).otherwise(ns)
    flt = F.when(q % 7 == 0, F.concat(F.lit('The answer is "'), ns, F.lit('.25".'))).otherwise(F.concat(ns, F.lit(".5")))
    resp = F.when(q % 3 != 0, mc).when(q % 2 == 0, integer).otherwise(flt)
    return a.select("question_id", "gt", "category", qt.alias("qt"), at.alias("at"), resp.alias("resp"),
                    F.array("pred", "gt", "category", F.lit("red bolt")).alias("choices"))


@query(
    "f19_f20_extract_normalise",
    f"""WITH a AS (SELECT question_id, {QT} AS qt, {AT} AS atype, {F_RESP} AS resp, [pred, gt, category, 'red bolt'] AS choices FROM fx_answers),
e AS (SELECT *, CASE WHEN resp = '' THEN ''
    WHEN qt = 'multi_choice' AND list_contains(choices, resp) THEN resp
    WHEN atype = 'integer' AND regexp_matches(resp, '^\\s*[-+]?\\d+\\s*$') THEN trim(resp)::BIGINT::VARCHAR
    WHEN atype = 'float' AND TRY_CAST(trim(resp) AS DOUBLE) IS NOT NULL THEN TRY_CAST(trim(resp) AS DOUBLE)::VARCHAR
    WHEN regexp_extract(resp, 'The answer is "(.*)"\\.', 1) <> '' THEN regexp_extract(resp, 'The answer is "(.*)"\\.', 1) END AS ex FROM a),
l AS (SELECT *, CASE WHEN upper(regexp_extract(trim(ex), '\\(([a-zA-Z])\\)', 1)) <> '' THEN upper(regexp_extract(trim(ex), '\\(([a-zA-Z])\\)', 1)) ELSE trim(ex) END AS e2 FROM e)
SELECT question_id, ex AS extraction, CASE WHEN qt = 'multi_choice' THEN
    CASE WHEN e2 IN ('A', 'B', 'C', 'D') THEN choices[ascii(e2) - 64]
    ELSE (list_sort(list_transform(choices, lambda c, i: {{'d': levenshtein(e2, c), 'i': i, 'c': c}})))[1].c END
  WHEN atype = 'integer' THEN CAST(TRY_CAST(ex AS DOUBLE) AS BIGINT)::VARCHAR
  WHEN atype = 'float' THEN round_even(TRY_CAST(ex AS DOUBLE), 1)::VARCHAR ELSE ex END AS normalised FROM l""",
)
def f19(spark, sf):
    d = _frame(spark, sf)
    ex = C.extract_answer("resp", "qt", "at", "choices")
    d = d.withColumn("extraction", ex)
    return d.select("question_id", "extraction", C.normalise_extraction("extraction", "choices", "qt", "at", F.lit(1)).alias("normalised"))


@query(
    "g23_facet_breakdown",
    f"""WITH a AS (SELECT (pred = gt)::DOUBLE AS ok, {QT} AS qt, category, string_split(gt, ' ') AS skills FROM fx_answers),
f AS (SELECT 'qt' AS facet, qt AS value, ok FROM a UNION ALL SELECT 'category', category, ok FROM a
  UNION ALL SELECT 'skills', s, ok FROM (SELECT unnest(list_distinct(skills)) AS s, ok FROM a))
SELECT facet, value, avg(ok) AS acc, count(*) AS total, printf('%.2f', avg(ok) * 100) AS accuracy FROM f GROUP BY facet, value""",
)
def g23(spark, sf):
    d = _frame(spark, sf).join(fx_answers(spark, sf).select("question_id", "pred"), "question_id")
    d = d.withColumn("skills", F.split("gt", " ")).withColumnRenamed("qt", "qt")
    return facet_breakdown(d, F.col("pred") == F.col("gt"), ["qt", "category"], ["skills"])


F21_TEXT = """CASE question_id % 10 WHEN 0 THEN 'the largest ' || pred WHEN 1 THEN 'Twenty ' || pred WHEN 2 THEN CAST(n AS STRING) WHEN 3 THEN ' ' || CAST(n AS STRING) || '.00'
  WHEN 4 THEN '-' || CAST(n AS STRING) || '.5' WHEN 5 THEN 'yes' WHEN 6 THEN 'Yes, ' || pred WHEN 7 THEN pred WHEN 8 THEN 'rates of ' || pred ELSE '.' END"""


@query(
    "f21_text_predicates",
    """SELECT question_id, question_id % 10 IN (2, 3, 4) AS digit, question_id % 10 IN (1, 2, 3, 4) AS number_word, question_id % 10 = 0 AS quantity,
  question_id % 10 = 5 AS bool_word, question_id % 10 IN (2, 3) AS int_string, question_id % 10 IN (3, 4) AS float_string FROM fx_answers""",
)
def f21(spark, sf):
    # each form of text has known answers
    a = fx_answers(spark, sf).withColumn("t", F.expr(F21_TEXT))
    return a.select(
        "question_id",
        C.has_digit("t").alias("digit"),
        C.has_number_word("t").alias("number_word"),
        C.has_quantity_word("t").alias("quantity"),
        C.is_bool_word("t").alias("bool_word"),
        C.is_int_string("t").alias("int_string"),
        C.is_float_string("t").alias("float_string"),
    )
