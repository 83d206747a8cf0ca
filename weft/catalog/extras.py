"""Registered queries for U02, U04, F02, F34 and F36."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.functions.lcs import lcs_sql
from weft.fixtures import fx_lines, table
from weft.functions import text as TX
from weft.plans.mixture import merge_datasets
from weft.sources.files import shared_path


@query("u02_merge_datasets", "SELECT source AS dataset, count(*) AS n FROM documents WHERE source IN ('src1', 'src3', 'src5') GROUP BY source")
def u02(spark, sf):
    root = shared_path(spark, "u02")
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("dataset"))
    d.write.mode("overwrite").partitionBy("dataset").parquet(root)
    return merge_datasets(spark, root, ["src1", "src3", "src5"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u04_array_set_ops",
    """WITH s AS (SELECT l_orderkey, list_distinct(list(l_suppkey % 50)) AS p, list_distinct(list(l_partkey % 50)) AS g FROM fx_lines GROUP BY l_orderkey)
SELECT l_orderkey, len(list_intersect(p, g)) AS n_inter, len(list_filter(p, lambda x: NOT list_contains(g, x))) AS n_except,
  len(list_distinct(list_concat(p, g))) AS n_union, len(list_intersect(p, g)) > 0 AS overlap FROM s""",
)
def u04(spark, sf):
    g = fx_lines(spark, sf).groupBy("l_orderkey").agg(
        F.collect_set(F.col("l_suppkey") % 50).alias("p"), F.collect_set(F.col("l_partkey") % 50).alias("g")
    )
    return g.select(
        "l_orderkey",
        F.size(F.array_intersect("p", "g")).alias("n_inter"),
        F.size(F.array_except("p", "g")).alias("n_except"),
        F.size(F.array_union("p", "g")).alias("n_union"),
        F.arrays_overlap("p", "g").alias("overlap"),
    )


@query(
    "f02_url_parts",
    r"""WITH u AS (SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS f FROM pages)
SELECT page_id, regexp_extract(url, '^(.*/)', 1) AS dir, f AS file,
  array_to_string(list_distinct(list_filter(regexp_split_to_array(regexp_replace(f, '\.[^.]*$', ''), '[^A-Za-z0-9]+'),
    lambda w: w <> '' AND NOT regexp_matches(w, '^\d+$'))), '-') AS short FROM u""",
)
def f02(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", TX.url_dir("url").alias("dir"), TX.url_file("url").alias("file"), TX.short_name("url").alias("short"))


@query(
    "f34_first_letter_case",
    "SELECT doc_id, upper(substr(source, 1, 1)) || substr(source, 2) AS up, lower(substr(lang, 1, 1)) || substr(lang, 2) AS low FROM documents",
)
def f34(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", TX.upper_first("source").alias("up"), TX.lower_first("lang").alias("low"))


@query(
    "f36_entropy_logprob",
    """WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE * 10) AS l FROM embeddings),
m AS (SELECT *, list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) AS lse FROM x)
SELECT vec_id, lse - list_sum(list_transform(l, lambda v: exp(v - lse) * v)) AS entropy, l[label + 1] - lse AS label_logprob FROM m""",
)
def f36(spark, sf):
    e = table(spark, sf, "embeddings")
    logits = F.transform("embedding", lambda v: v.cast("double") * 10)
    s = e.select("vec_id", TX.log_softmax_stats(logits, "label").alias("s"))
    return s.select("vec_id", "s.entropy", "s.label_logprob")


def _actions(spark, sf):
    from weft.fixtures import fx_steps

    s = fx_steps(spark, sf)
    st = F.col("step")
    dirs = F.array(*[F.lit(d) for d in ("up", "down", "left", "right")])
    args = F.struct(
        F.when(s.action == "click", F.array((st % 500).cast("double"), ((st * 3) % 700).cast("double"), (st % 500 + 50).cast("double"), ((st * 3) % 700 + 40).cast("double"))).alias("bbox"),
        F.when(s.action == "view", F.get(dirs, (st % 4).cast("int"))).alias("direction"),
        F.when(s.action == "purchase", F.concat(F.lit("item "), st.cast("string"))).alias("text"),
        F.when(s.action == "error", F.lit("success")).alias("status"),
    )
    kind = (F.when(s.action == "click", "click_element").when(s.action == "view", "scroll").when(s.action == "purchase", "input")
            .when(s.action == "signup", "press_home").otherwise("stop"))
    gt = F.to_json(F.struct(kind.alias("ACTION"), args.alias("ARGS")))
    k = st % 6
    pred = (
        F.when(k == 0, gt)
        .when(k == 1, F.concat(F.lit("I will "), F.upper(kind), F.lit(" [12, 30, 60, 70] scroll down text item "), st.cast("string")))
        .when(k == 2, F.concat(F.lit("{\"action\": \""), kind, F.lit("\"}")))
        .when(k == 3, F.lit("nothing to do"))
        .when(k == 4, F.concat(F.lit("type input text item "), (st + 1).cast("string")))
        .otherwise(F.lit("press_back now"))
    )
    return s.select("episode", "step", gt.alias("gt"), pred.alias("pred"))


# What each of the six forms of prediction comes to, worked out by hand from the rules:
# 0 repeats the answer; 1 names a click with a fixed box, or else reads as ``scroll down``;
# 2 has the right action without arguments; 3 has no action; 4 is an input; 5 presses back.
@query(
    "f24_f25_action_match",
    "WITH RECURSIVE "
    + lcs_sql("""SELECT step AS id, string_split(' item ' || (step + 1)::VARCHAR, '') AS x, string_split('item ' || step::VARCHAR, '') AS y
  FROM (SELECT DISTINCT step FROM fx_steps WHERE step % 6 = 4 AND action = 'purchase') s""")
    + """, s AS (SELECT episode, step, action, step % 6 AS k, (step % 500)::DOUBLE AS x1, (step * 3 % 700)::DOUBLE AS y1 FROM fx_steps),
b AS (SELECT *, greatest(least(60, x1 + 50) - greatest(12, x1), 0) * greatest(least(70, y1 + 40) - greatest(30, y1), 0) AS common FROM s),
t AS (SELECT b.*, 2.0 * n / (nx + ny) AS ratio, CASE k WHEN 0 THEN true WHEN 1 THEN action IN ('click', 'view') WHEN 2 THEN true WHEN 4 THEN action = 'purchase' ELSE false END AS type_match
  FROM b LEFT JOIN lcs ON id = step AND k = 4 AND action = 'purchase')
SELECT step, k <> 3 AS hit, type_match, type_match AND CASE k WHEN 0 THEN true
    WHEN 1 THEN CASE action WHEN 'click' THEN common / (48 * 40 + 50 * 40 - common) > 0.5 ELSE step % 4 = 1 END
    WHEN 2 THEN action IN ('signup', 'error') ELSE ratio > 0.8 END AS exact_match,
  round(CASE WHEN action = 'purchase' AND k = 0 THEN 1.0 ELSE ratio END, 6) AS text_dist FROM t""",
)
def f24(spark, sf):
    from weft.functions.actions import compare_action, parse_action

    a = _actions(spark, sf)
    m = a.select("step", compare_action(parse_action("gt"), parse_action("pred")).alias("m"))
    return m.select("step", "m.hit", "m.type_match", "m.exact_match", F.round("m.text_dist", 6).alias("text_dist"))


@query(
    "f26_indel_ratio",
    "WITH RECURSIVE "
    + lcs_sql("SELECT p_partkey AS id, string_split(p_name, '') AS x, string_split(p_type, '') AS y FROM part")
    + " SELECT id AS p_partkey, 2.0 * n / (nx + ny) AS ratio FROM lcs",
)
def f26(spark, sf):
    from weft.functions.actions import indel_ratio

    p = table(spark, sf, "part")
    return p.select("p_partkey", indel_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query(
    "x04_metric_table",
    """WITH a AS (SELECT category, trim(pred) AS p, trim(gt) AS g FROM fx_answers)
SELECT category, avg((p = g)::DOUBLE) AS exact, avg(contains(lower(p), lower(g))::DOUBLE) AS contained,
  avg(CASE WHEN greatest(length(p), length(g)) = 0 THEN 1.0 ELSE 1 - levenshtein(p, g) / greatest(length(p), length(g)) END) AS similarity FROM a GROUP BY category""",
)
def x04(spark, sf):
    from weft import registry as X
    from weft.fixtures import fx_answers

    trimmed = lambda d: d.withColumn("pred", F.trim("pred")).withColumn("gt", F.trim("gt"))
    return X.metric_table(X.apply_chain(fx_answers(spark, sf), [trimmed]), "pred", "gt", ["exact", "contained", "similarity"], by=["category"])
