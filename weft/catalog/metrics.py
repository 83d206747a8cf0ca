"""Registered queries for aggregations and metrics (G*) and answer expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, fx_answers, fx_boxes, fx_lines, fx_pairs, fx_spans, fx_steps, table
from weft.functions import answers as A
from weft.functions.text import word_count
from weft.operators import aggregates as G
from weft.operators import metrics as MT

WORDS = r"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def words_sql(x: str) -> str:
    return WORDS.format(x=x)


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normalise_sql(x: str) -> str:
    """DuckDB twin of F16 built from the same fixed tables."""
    t = f"lower({x})"
    t = f"replace(replace({t}, ',', ''), '?', '')"
    t = f"replace({t}, '''s', ' ''s')"
    t = strip_sql(t)
    t = strip_sql(f"replace(replace({t}, chr(10), ' '), chr(9), ' ')")
    return t


def normalise_words_sql(t: str) -> str:
    out = "t0"
    for p in A.PUNCTUATIONS:
        ps = sql_str(p)
        drop = f"(contains(t0, {ps} || ' ') OR contains(t0, ' ' || {ps}) OR regexp_matches(t0, '\\d,+\\d'))"
        out = f"replace({out}, {ps}, CASE WHEN {drop} THEN '' ELSE ' ' END)"
    per = r"regexp_replace(regexp_replace({o}, '\.([^0-9]|$)', '\1', 'g'), '\.([^0-9]|$)', '\1', 'g')".format(o=out)
    nums = "MAP {" + ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in A.NUMBER_MAP.items()) + "}"
    cons = "MAP {" + ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in A.CONTRACTIONS.items()) + "}"
    arts = ", ".join(sql_str(a) for a in A.ARTICLES)
    words = rf"list_filter(regexp_split_to_array(lower({strip_sql(per)}), '\s+'), lambda w: w <> '')"
    words = f"list_transform({words}, lambda w: coalesce({nums}[w], w))"
    words = f"list_filter({words}, lambda w: w NOT IN ({arts}))"
    words = f"list_transform({words}, lambda w: coalesce({cons}[w], w))"
    return f"array_to_string({words}, ' ')"


NORM_INPUT_SQL = """p_name || ' ' || p_type || CASE p_partkey % 6 WHEN 0 THEN ' the one-two!' WHEN 1 THEN ' (a) cant'
  WHEN 2 THEN '; dont x/y' WHEN 3 THEN ' 3.5 and 2. ok.' WHEN 4 THEN ' Its ten, an apple''s' ELSE ' none' END"""


def _norm_input(part):
    k = F.col("p_partkey") % 6
    tail = (
        F.when(k == 0, " the one-two!").when(k == 1, " (a) cant").when(k == 2, "; dont x/y").when(k == 3, " 3.5 and 2. ok.")
        .when(k == 4, " Its ten, an apple's").otherwise(" none")
    )
    return F.concat("p_name", F.lit(" "), "p_type", tail)


@query(
    "f16_normalise_answer",
    f"""WITH a AS (SELECT p_partkey, {normalise_sql(NORM_INPUT_SQL)} AS t0 FROM part)
SELECT p_partkey, {normalise_words_sql('t0')} AS norm FROM a""",
)
def f16(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", A.normalise_answer(_norm_input(p)).alias("norm"))


COUNT_WORDS_SQL = "[" + ", ".join(sql_str(k) for k in A.COUNT_WORDS) + "]"
COUNT_MAP_SQL = "MAP {" + ", ".join(f"{sql_str(k)}: {sql_str(v)}" for k, v in A.COUNT_WORDS.items()) + "}"
TALLY_PRED_SQL = f"""CASE l_linenumber % 4 WHEN 0 THEN {COUNT_WORDS_SQL}[(CAST(l_quantity AS BIGINT) % 21) + 1]
  WHEN 1 THEN 'about ' || (CAST(l_quantity AS BIGINT) % 19)::VARCHAR || ' things'
  WHEN 2 THEN 'i see ' || {COUNT_WORDS_SQL}[(l_partkey % 21) + 1] || ' cars' ELSE 'many' END"""


def _tally_pred():
    words = F.array(*[F.lit(w) for w in A.COUNT_WORDS])
    q = F.col("l_quantity").cast("bigint")
    k = F.col("l_linenumber") % 4
    return (
        F.when(k == 0, F.get(words, (q % 21).cast("int")))
        .when(k == 1, F.concat(F.lit("about "), (q % 19).cast("string"), F.lit(" things")))
        .when(k == 2, F.concat(F.lit("i see "), F.get(words, (F.col("l_partkey") % 21).cast("int")), F.lit(" cars")))
        .otherwise(F.lit("many"))
    )


def _count_sql(t: str) -> str:
    ws = rf"list_filter(regexp_split_to_array(lower({t}), '\s+'), lambda w: w <> '')"
    hits = f"list_filter(list_transform({ws}, lambda w: {COUNT_MAP_SQL}[w]), lambda v: v IS NOT NULL)"
    return f"""CASE WHEN {COUNT_MAP_SQL}[lower({t})] IS NOT NULL THEN {COUNT_MAP_SQL}[lower({t})]
  WHEN regexp_matches({t}, '^\\d+$') THEN {t}
  WHEN regexp_extract({t}, '\\d+', 0) <> '' THEN regexp_extract({t}, '\\d+', 0)
  WHEN len({hits}) > 0 THEN {hits}[1] ELSE {t} END"""


@query("f18_count_to_numeral", f"SELECT l_orderkey, l_linenumber, {_count_sql(TALLY_PRED_SQL)} AS numeral FROM fx_lines")
def f18(spark, sf):
    x = fx_lines(spark, sf)
    return x.select("l_orderkey", "l_linenumber", A.count_to_numeral(_tally_pred()).alias("numeral"))


@query("g01_source_histogram", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def g01(spark, sf):
    return G.source_histogram(table(spark, sf, "documents"))


BRANDS = ["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#99"]


@query(
    "g03_accuracy_rollup",
    """WITH a AS (SELECT CASE WHEN question_id % 13 <> 0 THEN category END AS category, pred, gt FROM fx_answers),
per AS (SELECT category, sum((pred = gt)::INT) AS m, count(*) AS t FROM a WHERE category IS NOT NULL GROUP BY category
  UNION ALL SELECT 'Other', sum((pred = gt)::INT), count(*) FROM a WHERE category IS NULL
  UNION ALL SELECT 'overall', sum((pred = gt)::INT), count(*) FROM a),
cats AS (SELECT * FROM (VALUES ('overall'), ('Other'), ('Brand#1'), ('Brand#2'), ('Brand#3'), ('Brand#4'), ('Brand#5'), ('Brand#99')) v(category))
SELECT c.category, coalesce(m, 0) / greatest(coalesce(t, 0), 1) AS accuracy FROM cats c LEFT JOIN per USING (category)""",
)
def g03(spark, sf):
    a = fx_answers(spark, sf).withColumn("category", F.when(F.col("question_id") % 13 != 0, F.col("category")))
    return MT.accuracy_rollup(a, "category", F.col("pred") == F.col("gt"), ["Other", *BRANDS])


@query(
    "g04_accuracy_by",
    """WITH a AS (SELECT CASE WHEN question_id % 17 = 0 THEN 'Other' ELSE category END AS c, (pred = gt)::DOUBLE AS ok FROM fx_answers)
SELECT c AS category, avg(ok) AS accuracy, count(*) AS count FROM a GROUP BY c
UNION ALL SELECT 'Overall', avg(ok), count(*) FROM a""",
)
def g04(spark, sf):
    a = fx_answers(spark, sf).withColumn("category", F.when(F.col("question_id") % 17 != 0, F.col("category")))
    return MT.accuracy_by(a, "category", F.col("pred") == F.col("gt"))


@query(
    "g05_accuracy",
    """SELECT avg((pred = gt)::DOUBLE) AS accuracy,
  (SELECT avg(((CASE WHEN length(p) = 1 THEN p ELSE 'FAILED' END) = g)::DOUBLE) FROM
    (SELECT CASE WHEN n % 3 = 0 THEN 'AB' ELSE chr((65 + n % 4)::INTEGER) END AS p, chr((65 + question_id % 4)::INTEGER) AS g FROM fx_answers))
   AS letter_accuracy FROM fx_answers""",
)
def g05(spark, sf):
    a = fx_answers(spark, sf)
    p = F.when(F.col("n") % 3 == 0, F.lit("AB")).otherwise(F.char(65 + F.col("n") % 4))
    letters = a.select(p.alias("p"), F.char(65 + F.col("question_id") % 4).alias("g"))
    acc = MT.accuracy(a, "pred", "gt")
    la = MT.single_letter_accuracy(letters, "p", "g").withColumnRenamed("accuracy", "letter_accuracy")
    return acc.withColumn("_k", F.lit(1)).join(la.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "g06_group_references",
    """SELECT question_id // 3 AS id, string_agg(gt, '|' ORDER BY question_id) AS refs, arg_max(pred, question_id) AS pred
FROM fx_answers GROUP BY 1""",
)
def g06(spark, sf):
    a = fx_answers(spark, sf).withColumn("id", F.floor(F.col("question_id") / 3))
    g = MT.group_references(a, "id", "pred", "gt", "question_id")
    return g.select("id", F.array_join("refs", "|").alias("refs"), "pred")


@query(
    "g10_bleu_from_parts",
    """SELECT question_id, least(1.0, n / 25.0) * exp(
   CASE WHEN n / 50.0 <> 0 THEN 0.25 * ln(n / 50.0) ELSE 0 END + CASE WHEN (n % 7) / 7.0 <> 0 THEN 0.25 * ln((n % 7) / 7.0) ELSE 0 END
 + CASE WHEN (n % 3) / 3.0 <> 0 THEN 0.25 * ln((n % 3) / 3.0) ELSE 0 END) AS bleu FROM fx_answers""",
)
def g10(spark, sf):
    a = fx_answers(spark, sf)
    n = F.col("n").cast("double")
    prec = F.array(n / 50.0, (F.col("n") % 7) / 7.0, F.lit(0.0), (F.col("n") % 3) / 3.0)
    return a.select("question_id", MT.bleu_from_parts(prec, [0.25] * 4, F.least(F.lit(1.0), n / 25.0)).alias("bleu"))


def _answers10():
    # normalise the two distinct answers once, then lay out the ten slots
    return F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.when((F.col("question_id") + i) % 3 == 0, F.col("np")).otherwise(F.col("ng")),
    )


def norm_full(x: str) -> str:
    return normalise_words_sql("t0").replace("t0", f"({normalise_sql(x)})")


@query(
    "g12_soft_vqa_accuracy",
    f"""WITH a AS (SELECT category, {norm_full('pred')} AS np, {norm_full('gt')} AS ng,
   CASE WHEN question_id % 3 = 0 THEN 4 ELSE 3 END AS k FROM fx_answers),
b AS (SELECT category, CASE WHEN np = ng THEN 10 ELSE k END AS c FROM a)
SELECT category, avg((c * least(1.0, (c - 1) / 3.0) + (10 - c) * least(1.0, c / 3.0)) / 10) AS accuracy FROM b GROUP BY category""",
)
def g12(spark, sf):
    a = fx_answers(spark, sf).select("question_id", "category", A.normalise_answer("pred").alias("np"), A.normalise_answer("gt").alias("ng"))
    a = a.withColumn("answers", _answers10())
    s = a.select("category", MT.soft_vqa_score(F.col("np"), F.col("answers")).alias("s"))
    return s.groupBy("category").agg(F.avg("s").alias("accuracy"))


@query(
    "g13_any_match",
    f"""SELECT category, avg(CASE WHEN {norm_full('pred')} IN ({norm_full('gt')}, {norm_full('category')}) THEN 1.0 ELSE 0.0 END) AS accuracy
FROM fx_answers GROUP BY category""",
)
def g13(spark, sf):
    a = fx_answers(spark, sf)
    ans = F.array(A.normalise_answer("gt"), A.normalise_answer("category"))
    return a.groupBy("category").agg(F.avg(MT.any_match(A.normalise_answer("pred"), ans)).alias("accuracy"))


def _anls_sql(a: str) -> str:
    p = "lower(trim(pred))"
    b = f"lower(trim({a}))"
    s = f"(1 - levenshtein({p}, {b}) / greatest(length({p}), length({b})))"
    return f"CASE WHEN {s} >= 0.5 THEN {s} ELSE 0.0 END"


@query("g14_anls", f"SELECT avg(greatest({_anls_sql('gt')}, {_anls_sql('category')})) AS anls FROM fx_answers")
def g14(spark, sf):
    a = fx_answers(spark, sf)
    return a.agg(F.avg(MT.anls(F.col("pred"), F.array("gt", "category"))).alias("anls"))


@query(
    "g15_tally_accuracy",
    f"""WITH t AS (SELECT {_count_sql(TALLY_PRED_SQL)} AS p, (CAST(l_quantity AS BIGINT) % 18)::VARCHAR AS g, l_linenumber % 2 AS simple FROM fx_lines),
h AS (SELECT (p = g)::DOUBLE AS hit, g, simple FROM t)
SELECT 'all' AS bucket, avg(hit) AS acc, count(*) AS num FROM h
UNION ALL SELECT CASE simple WHEN 1 THEN 'simple' ELSE 'complex' END, avg(hit), count(*) FROM h GROUP BY simple
UNION ALL SELECT 'count_' || g, avg(hit), count(*) FROM h WHERE g::INT <= 15 GROUP BY g""",
)
def g15(spark, sf):
    x = fx_lines(spark, sf)
    d = x.select(
        A.count_to_numeral(_tally_pred()).alias("p"),
        (F.col("l_quantity").cast("bigint") % 18).cast("string").alias("g"),
        (F.col("l_linenumber") % 2).alias("simple"),
    )
    return MT.tally_accuracy(d, "p", "g", "simple")


@query(
    "g16_detection_accuracy",
    """SELECT ignored, avg(CASE WHEN greatest(0, least(x2, px2) - greatest(x1, px1) + 1) * greatest(0, least(y2, py2) - greatest(y1, py1) + 1) /
   ((x2 - x1 + 1) * (y2 - y1 + 1) + (px2 - px1 + 1) * (py2 - py1 + 1)
    - greatest(0, least(x2, px2) - greatest(x1, px1) + 1) * greatest(0, least(y2, py2) - greatest(y1, py1) + 1)) >= 0.5 THEN 1.0 ELSE 0.0 END) * 100 AS accuracy,
  count(*) AS total FROM fx_boxes GROUP BY ignored""",
)
def g16(spark, sf):
    b = fx_boxes(spark, sf)
    return MT.detection_accuracy(b, F.array("px1", "py1", "px2", "py2"), F.array("x1", "y1", "x2", "y2"), ["ignored"])


TIOU_SQL = """CASE WHEN greatest(pe - ps, 0) + greatest(e - s, 0) - greatest(least(pe, e) - greatest(ps, s), 0) > 0
  THEN greatest(least(pe, e) - greatest(ps, s), 0) / (greatest(pe - ps, 0) + greatest(e - s, 0) - greatest(least(pe, e) - greatest(ps, s), 0))
  ELSE 0.0 END"""


@query(
    "g17_rtl_macro",
    f"""WITH v AS (SELECT vid, avg({TIOU_SQL}) AS i, avg(({TIOU_SQL} >= 0.5)::DOUBLE) AS p FROM fx_spans GROUP BY vid)
SELECT avg(i) AS mean_iou, avg(p) AS precision_at_05 FROM v""",
)
def g17(spark, sf):
    return MT.rtl_macro(fx_spans(spark, sf), "vid", "s", "e", "ps", "pe")


@query(
    "g18_rtl_micro",
    f"""WITH x AS (SELECT CASE WHEN qid % 7 = 0 THEN 'Other' ELSE category END AS category, {TIOU_SQL} AS i FROM fx_spans)
SELECT category, avg(i) AS mean_iou, count(*) FILTER (WHERE i >= 0.5) / count(*) AS precision_at_05, count(*) AS count FROM x GROUP BY category
UNION ALL SELECT 'overall', avg(i), count(*) FILTER (WHERE i >= 0.5) / count(*), count(*) FROM x""",
)
def g18(spark, sf):
    spans = fx_spans(spark, sf).withColumn("category", F.when(F.col("qid") % 7 != 0, F.col("category")))
    return MT.rtl_micro(spans, "category", "s", "e", "ps", "pe")


@query(
    "g19_action_step_metrics",
    """WITH s AS (SELECT CASE WHEN action = 'purchase' THEN 'INPUT' ELSE upper(action) END AS a, type_match::DOUBLE AS tm, exact_match::DOUBLE AS em,
   (step % 10 <> 0)::DOUBLE AS hit, CASE WHEN step % 3 <> 0 THEN (step % 7) / 7.0 END AS td FROM fx_steps)
SELECT a AS action, count(*) AS count, round(avg(tm), 4) AS type_acc, round(avg(em), 4) AS exact_acc, NULL::DOUBLE AS hit_rate,
  CASE WHEN a = 'INPUT' THEN round(avg(td), 4) END AS text_dist FROM s GROUP BY a
UNION ALL SELECT 'total', count(*), round(avg(tm), 4), round(avg(em), 4), round(avg(hit), 4), NULL FROM s""",
)
def g19(spark, sf):
    s = fx_steps(spark, sf).withColumn("hit", F.col("step") % 10 != 0).withColumn(
        "td", F.when(F.col("step") % 3 != 0, (F.col("step") % 7) / 7.0)
    ).withColumn("action", F.when(F.col("action") == "purchase", F.lit("input")).otherwise(F.col("action")))
    return MT.action_step_metrics(s, "action", "type_match", "exact_match", "hit", "td")


@query(
    "g20_episode_metrics",
    """WITH f AS (SELECT episode, min(CASE WHEN NOT exact_match THEN step END) AS miss, count(*) AS n FROM fx_steps GROUP BY episode),
p AS (SELECT s.episode, sum((f.miss IS NULL OR s.step < f.miss)::INT) / max(f.n) AS prog, max((f.miss IS NULL)::INT)::DOUBLE AS succ
  FROM fx_steps s JOIN f USING (episode) GROUP BY s.episode)
SELECT round(avg(succ), 4) AS success_rate, round(avg(prog), 4) AS goal_progress FROM p""",
)
def g20(spark, sf):
    return MT.episode_metrics(fx_steps(spark, sf), "episode", "step", "exact_match")


@query(
    "w16_prefix_success",
    """SELECT episode, step, bool_and(exact_match) OVER (PARTITION BY episode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix_ok
FROM fx_steps""",
)
def w16(spark, sf):
    return MT.prefix_success(fx_steps(spark, sf), "episode", "step", "exact_match").select("episode", "step", "prefix_ok")


@query(
    "g21_tolerance_accuracy",
    """WITH t AS (SELECT category AS task, CASE WHEN qid % 13 = 0 THEN NULL ELSE ps % 12 END AS p, s % 12 AS g FROM fx_spans)
SELECT task, avg((abs(p - g) = 0)::DOUBLE) * 100 AS exact_accuracy, avg((abs(p - g) <= 1)::DOUBLE) * 100 AS tolerance_1_accuracy,
  avg((abs(p - g) <= 2)::DOUBLE) * 100 AS tolerance_2_accuracy, count(*) AS total FROM t WHERE p IS NOT NULL GROUP BY task""",
)
def g21(spark, sf):
    sp = fx_spans(spark, sf)
    ptxt = F.when(F.col("qid") % 13 == 0, F.lit("none")).otherwise(F.concat(F.lit("I see "), (F.col("ps") % 12).cast("string"), F.lit(" cars")))
    gtxt = F.concat((F.col("s") % 12).cast("string"), F.lit(" cars"))
    return MT.tolerance_accuracy(sp, "category", A.first_int(ptxt), A.first_int(gtxt))


@query(
    "g22_set_prf",
    """WITH s AS (SELECT list_distinct(list(l_suppkey % 50)) AS p, list_distinct(list(l_partkey % 50)) AS g FROM fx_lines GROUP BY l_orderkey),
m AS (SELECT len(list_intersect(p, g))::DOUBLE AS tp, len(p) AS np, len(g) AS ng, len(list_distinct(list_concat(p, g))) AS nu FROM s)
SELECT avg(tp / np) * 100 AS precision, avg(tp / ng) * 100 AS recall,
  avg(CASE WHEN tp / np + tp / ng > 0 THEN 2 * (tp / np) * (tp / ng) / (tp / np + tp / ng) ELSE 0 END) * 100 AS f1_score,
  avg(tp / nu) * 100 AS accuracy, count(*) AS total FROM m""",
)
def g22(spark, sf):
    x = fx_lines(spark, sf)
    g = x.groupBy("l_orderkey").agg(
        F.collect_set(F.col("l_suppkey") % 50).alias("p"), F.collect_set(F.col("l_partkey") % 50).alias("g")
    )
    return MT.set_prf(g, F.col("p"), F.col("g"))


@query(
    "g24_judge_summary",
    """SELECT avg(contains(lower(CASE WHEN step % 3 = 0 THEN 'Yes' ELSE 'no' END), 'yes')::DOUBLE) AS accuracy,
  avg(CASE WHEN step % 11 = 0 THEN 0 ELSE step % 6 END)::DOUBLE AS average_score, count(*) AS count FROM fx_steps""",
)
def g24(spark, sf):
    s = fx_steps(spark, sf).select(
        F.when(F.col("step") % 3 == 0, F.lit("Yes")).otherwise(F.lit("no")).alias("pred"),
        F.when(F.col("step") % 11 == 0, F.lit("bad")).otherwise((F.col("step") % 6).cast("string")).alias("score"),
    )
    return MT.judge_summary(s, "pred", "score")


@query("g25_aspect_score", "SELECT action AS task, avg(trunc((step % 50) / 10.0))::DOUBLE AS score FROM fx_steps GROUP BY action")
def g25(spark, sf):
    s = fx_steps(spark, sf).select(F.col("action").alias("task"), ((F.col("step") % 50) / 10.0).cast("string").alias("score"))
    return MT.aspect_score(s, "task", "score")


@query(
    "g26_needle_matrix",
    """WITH s AS (SELECT (step % 5) * 25 AS depth, (step % 3 + 1) * 32 AS frames, type_match::DOUBLE AS score FROM fx_steps)
SELECT depth, avg(score) FILTER (WHERE frames = 32) AS "32", avg(score) FILTER (WHERE frames = 64) AS "64",
  avg(score) FILTER (WHERE frames = 96) AS "96",
  (SELECT avg(m) FROM (SELECT avg(score) AS m FROM s GROUP BY depth, frames)) AS overall FROM s GROUP BY depth""",
)
def g26(spark, sf):
    s = fx_steps(spark, sf).select(
        ((F.col("step") % 5) * 25).alias("depth"), ((F.col("step") % 3 + 1) * 32).alias("frames"), F.col("type_match").cast("double").alias("score")
    )
    return MT.needle_matrix(s, "depth", "frames", "score", [32, 64, 96])


@query(
    "g27_summarise",
    """WITH r AS (SELECT 'task' || (item_id % 5)::VARCHAR AS task, item_id, length(text) AS len FROM benchmark),
reg AS (SELECT * FROM (VALUES ('task0', 'acc', 'a/b'), ('task1', 'acc', 'a/b'), ('task1', 'len', 'c'), ('task2', 'len', 'c')) v(task, name, path))
SELECT task, name, CASE WHEN path = 'a/b' THEN item_id ELSE len END::DOUBLE AS value FROM r JOIN reg USING (task)""",
)
def g27(spark, sf):
    b = table(spark, sf, "benchmark")
    res = b.select(
        F.concat(F.lit("task"), (F.col("item_id") % 5).cast("string")).alias("task"),
        F.to_json(F.struct(F.struct(F.col("item_id").alias("b")).alias("a"), F.length("text").alias("c"))).alias("json"),
    )
    reg = spark.createDataFrame(
        [("task0", "acc", "a/b"), ("task1", "acc", "a/b"), ("task1", "len", "c"), ("task2", "len", "c")], "task string, name string, path string"
    )
    return MT.summarise(res, reg)


@query(
    "g28_sample_lengths",
    f"""WITH t AS (SELECT conv_id, sum({words_sql('value')}) AS w FROM fx_turns GROUP BY conv_id)
SELECT t.conv_id, t.w + CASE WHEN i.n_img > 0 THEN 128 ELSE 0 END AS length,
  CASE WHEN i.n_img > 0 THEN t.w ELSE -t.w END AS modality_length FROM t JOIN fx_convimg i USING (conv_id)""",
)
def g28(spark, sf):
    s = G.modality_length(G.sample_length(conv_samples(spark, sf)))
    return s.select("conv_id", F.col("length").cast("bigint").alias("length"), F.col("modality_length").cast("bigint").alias("modality_length"))


def _labels(turns):
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.transform(
                F.filter(F.split(t["value"], r"\s+"), lambda w: w != ""),
                lambda w: F.when(t["from"] == "gpt", F.length(w)).otherwise(F.lit(-100)),
            ),
        )
    )


@query(
    "g29_loss_weights",
    f"""WITH c AS (SELECT conv_id % 4 AS rank, sum(CASE WHEN role = 'gpt' THEN {words_sql('value')} ELSE 0 END)
   - max(CASE WHEN turn = 0 AND role = 'gpt' AND {words_sql('value')} > 0 THEN 1 ELSE 0 END) AS a FROM fx_turns GROUP BY conv_id),
r AS (SELECT rank, sum(a)::BIGINT AS active FROM c GROUP BY rank)
SELECT rank, active, active / (SELECT sum(active) FROM r) * 4 AS loss_weight FROM r""",
)
def g29(spark, sf):
    s = conv_samples(spark, sf).select((F.col("conv_id") % 4).alias("rank"), _labels(F.col("turns")).alias("labels"))
    return MT.loss_weights(s, "rank", "labels", world=4).withColumn("active", F.col("active").cast("bigint"))


@query(
    "g30_masked_stats",
    """WITH s AS (SELECT sum(l_quantity * m) AS sx, sum(l_quantity * l_quantity * m) AS sxx, sum(m) AS sm
  FROM (SELECT l_quantity, (l_returnflag <> 'R')::DOUBLE AS m FROM fx_lines))
SELECT sx / sm AS mean, (sxx / sm - (sx / sm) * (sx / sm)) * sm / (sm - 1) AS var FROM s""",
)
def g30(spark, sf):
    x = fx_lines(spark, sf).withColumn("m", F.col("l_returnflag") != "R")
    return MT.masked_stats(x, "l_quantity", "m")


@query(
    "g31_moments",
    "SELECT avg(l_extendedprice) AS mean, var_pop(l_extendedprice) AS var_pop, var_samp(l_extendedprice) AS var_samp, count(l_extendedprice) AS count FROM lineitem",
)
def g31(spark, sf):
    return MT.moments(table(spark, sf, "lineitem"), "l_extendedprice")


@query(
    "g32_pair_accuracy",
    """SELECT avg(((pc - rc) >= (pr - rr))::DOUBLE) AS accuracy, count(*) FILTER (WHERE (pc - rc) = (pr - rr)) AS ties,
  avg(1.0 / (1.0 + exp((pr - rr) - (pc - rc)))) AS p_chosen FROM fx_pairs""",
)
def g32(spark, sf):
    p = fx_pairs(spark, sf).select((F.col("pc") - F.col("rc")).alias("c"), (F.col("pr") - F.col("rr")).alias("r"))
    return MT.pair_accuracy(p, "c", "r")


@query(
    "g33_preference_stats",
    """SELECT avg(0.1 * (pc - rc)) AS rewards_chosen, avg(0.1 * (pr - rr)) AS rewards_rejected,
  avg((0.1 * (pc - rc) > 0.1 * (pr - rr))::DOUBLE) AS rewards_accuracies, avg(0.1 * (pc - rc) - 0.1 * (pr - rr)) AS rewards_margins,
  avg(pc) AS logps_chosen, avg(pr) AS logps_rejected, avg(rc) AS ref_logps_chosen, avg(rr) AS ref_logps_rejected FROM fx_pairs""",
)
def g33(spark, sf):
    return MT.preference_stats(fx_pairs(spark, sf), "pc", "pr", "rc", "rr", beta=0.1)


@query(
    "g34_rollout_stats",
    f"""WITH c AS (SELECT conv_id, sum(CASE WHEN turn = 0 THEN {words_sql('value')} ELSE 0 END) AS q,
   sum(CASE WHEN turn = 1 THEN {words_sql('value')} ELSE 0 END) AS r, count(*) AS n FROM fx_turns GROUP BY conv_id)
SELECT avg(q) AS tokens_queries_len_mean, stddev_samp(q) AS tokens_queries_len_std, avg(r) AS tokens_responses_len_mean,
  stddev_samp(r) AS tokens_responses_len_std, avg((conv_id % 7) / 10.0) AS objective_kl, avg(n) AS objective_entropy,
  avg(q - r) AS env_reward_mean, stddev_samp(q - r) AS env_reward_std FROM c""",
)
def g34(spark, sf):
    s = conv_samples(spark, sf)
    q = F.coalesce(word_count(F.get(F.col("turns"), 0)["value"]), F.lit(0))
    r = F.coalesce(word_count(F.get(F.col("turns"), 1)["value"]), F.lit(0))
    return MT.rollout_stats(s, q, r, (F.col("conv_id") % 7) / 10.0, F.size("turns"), q - r)


@query(
    "g35_mean_stats",
    """SELECT 'loss/a' AS key, avg(value) AS mean FROM events UNION ALL SELECT 'loss/b', avg(value * 2) FROM events
UNION ALL SELECT 'kl/x', avg(user_id) FROM events""",
)
def g35(spark, sf):
    e = table(spark, sf, "events")
    m = F.create_map(
        F.lit("loss"), F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") * 2),
        F.lit("kl"), F.create_map(F.lit("x"), F.col("user_id").cast("double")),
    )
    return MT.mean_stats(e.select(m.alias("stats")), "stats")
