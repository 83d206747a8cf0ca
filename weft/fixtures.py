"""Deterministic inputs derived from the driver's tables (FIXTURES.md part 3).

Each ``fx_*`` function returns a DataFrame built from the base parquet tables, so the
work of every registered query grows with the tables. ``FX_SQL`` holds the same
definitions in DuckDB SQL; :func:`with_fx` prepends the ones an oracle query uses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fx_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    role = (
        F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    )
    value = (
        F.when(F.col("turn") == 0, F.concat(F.lit("<image>\n"), "text"))
        .when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.concat(F.lit("<image><image>"), "text"))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", role.alias("role"), value.alias("value"))


def fx_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines are nearly unique: dealt by their key first, they are sorted once, in parts of an input split
    li = table(spark, sf_dir, "lineitem")
    n = max(spark.sparkContext.defaultParallelism, 4 * li.rdd.getNumPartitions())
    return li.repartition(n, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"),
        F.min("l_suppkey").alias("l_suppkey"),
        F.max("l_quantity").alias("l_quantity"),
        F.max("l_discount").alias("l_discount"),
        F.max("l_tax").alias("l_tax"),
        F.min("l_returnflag").alias("l_returnflag"),
    )


def fx_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_lines(spark, sf_dir)
    q, t, ln, pk, sk = (F.col(c) for c in ("l_quantity", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"))
    return x.select(
        F.col("l_orderkey").alias("img_id"),
        ln.alias("idx"),
        pk.alias("k"),
        (q * 10).alias("x1"),
        (t * 5000).alias("y1"),
        (q * 10 + 20 + ln * 10).alias("x2"),
        (t * 5000 + 15 + pk % 40).alias("y2"),
        (q * 10 + sk % 30).alias("px1"),
        (t * 5000 + sk % 12).alias("py1"),
        (q * 10 + 25 + ln * 10).alias("px2"),
        (t * 5000 + 18 + pk % 40).alias("py2"),
        F.lit(1000).alias("w"),
        F.lit(800).alias("h"),
        (F.col("l_returnflag") == "R").alias("ignored"),
    )


def fx_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_lines(spark, sf_dir)
    return x.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_returnflag").alias("shard"),
        F.col("l_discount").alias("s1"),
        F.col("l_tax").alias("s2"),
    )


def fx_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx_lines(spark, sf_dir)
    return x.select(
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_linenumber").alias("item"),
        (F.col("l_returnflag") != "R").alias("ok"),
    )


def fx_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    dur = 60 + uid % 120
    s = (eid * 7) % dur
    ps = (eid * 7 + eid % 5) % dur
    return e.select(
        uid.alias("vid"),
        eid.alias("qid"),
        F.col("event_type").alias("category"),
        dur.alias("duration"),
        s.alias("s"),
        F.least(dur, s + 1 + eid % 9).alias("e"),
        ps.alias("ps"),
        F.least(dur, ps + 2 + eid % 6).alias("pe"),
    )


def fx_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("episode"),
        F.col("event_id").alias("step"),
        F.col("event_type").alias("action"),
        (F.col("event_type") != "error").alias("type_match"),
        F.col("event_type").isin("click", "view").alias("exact_match"),
    )


def fx_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("media_id"),
        (200 + F.col("o_custkey") % 1800).alias("width"),
        (200 + F.col("o_orderkey") % 1500).alias("height"),
        (10 + F.col("o_orderkey") % 50).alias("fps"),
        (F.col("o_custkey") % 900).alias("frame_count"),
    )


def fx_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("question_id"),
        F.col("p_name").alias("pred"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.col("p_type")).alias("gt"),
        F.col("p_brand").alias("category"),
        F.col("p_size").alias("n"),
    )


def fx_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("shard"), F.col("doc_id").alias("k"), F.col("n_chars").alias("nbytes"), "text"
    )


def fx_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("caption"))


def fx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        (-(F.col("o_totalprice") / 100000)).alias("pc"),
        (-((F.col("o_custkey") % 97) / 20.0)).alias("pr"),
        (-((F.col("o_orderkey") % 89) / 25.0)).alias("rc"),
        (-((F.col("o_custkey") % 61) / 15.0)).alias("rr"),
    )


def fx_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    hex8 = F.substring(F.md5(F.concat(F.lit("42|"), F.col("doc_id").cast("string"))), 1, 8)
    return d.select("doc_id", hex8.alias("hex8"))


# DuckDB definitions of the same views, in dependency order.
FX_SQL: dict[str, str] = {
    "fx_turns": """SELECT conv_id, turn,
  CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS role,
  CASE WHEN turn = 0 THEN '<image>' || chr(10) || text
       WHEN (conv_id + turn) % 7 = 0 THEN '<image><image>' || text
       ELSE text END AS value FROM conversations""",
    "fx_lines": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey,
  min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount,
  max(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "fx_boxes": """SELECT l_orderkey AS img_id, l_linenumber AS idx, l_partkey AS k,
  l_quantity * 10 AS x1, l_tax * 5000 AS y1,
  l_quantity * 10 + 20 + l_linenumber * 10 AS x2, l_tax * 5000 + 15 + (l_partkey % 40) AS y2,
  l_quantity * 10 + (l_suppkey % 30) AS px1, l_tax * 5000 + (l_suppkey % 12) AS py1,
  l_quantity * 10 + 25 + l_linenumber * 10 AS px2, l_tax * 5000 + 18 + (l_partkey % 40) AS py2,
  1000 AS w, 800 AS h, l_returnflag = 'R' AS ignored FROM fx_lines""",
    "fx_scored": """SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS shard,
  l_discount AS s1, l_tax AS s2 FROM fx_lines""",
    "fx_fetch": """SELECT l_orderkey AS sample_id, l_linenumber AS item,
  l_returnflag <> 'R' AS ok FROM fx_lines""",
    "fx_spans": """SELECT user_id AS vid, event_id AS qid, event_type AS category,
  60 + user_id % 120 AS duration,
  (event_id * 7) % (60 + user_id % 120) AS s,
  least(60 + user_id % 120, (event_id * 7) % (60 + user_id % 120) + 1 + event_id % 9) AS e,
  (event_id * 7 + event_id % 5) % (60 + user_id % 120) AS ps,
  least(60 + user_id % 120, (event_id * 7 + event_id % 5) % (60 + user_id % 120) + 2 + event_id % 6) AS pe
  FROM events""",
    "fx_steps": """SELECT user_id AS episode, event_id AS step, event_type AS action,
  event_type <> 'error' AS type_match, event_type IN ('click', 'view') AS exact_match FROM events""",
    "fx_media": """SELECT o_orderkey AS media_id, 200 + o_custkey % 1800 AS width,
  200 + o_orderkey % 1500 AS height, 10 + o_orderkey % 50 AS fps, o_custkey % 900 AS frame_count FROM orders""",
    "fx_answers": """SELECT p_partkey AS question_id, p_name AS pred,
  CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type END AS gt, p_brand AS category, p_size AS n FROM part""",
    "fx_members": """SELECT source AS shard, doc_id AS k, n_chars AS nbytes, text FROM documents""",
    "fx_recap": """SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE '' END AS caption FROM labels""",
    "fx_pairs": """SELECT o_orderkey AS id, -(o_totalprice / 100000) AS pc,
  -((o_custkey % 97) / 20.0) AS pr, -((o_orderkey % 89) / 25.0) AS rc, -((o_custkey % 61) / 15.0) AS rr FROM orders""",
    "fx_convimg": """SELECT conv_id, sum(len(string_split(value, '<image>')) - 1) AS n_tags,
  CASE WHEN conv_id % 5 = 0 THEN sum(len(string_split(value, '<image>')) - 1) - 1
       ELSE sum(len(string_split(value, '<image>')) - 1) END AS n_img
  FROM fx_turns GROUP BY conv_id""",
    "fx_hash": """SELECT doc_id, substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8) AS hex8 FROM documents""",
}


def with_fx(sql: str) -> str:
    """Prefix ``sql`` with the CTEs of every ``fx_*`` view it (transitively) uses."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name in FX_SQL:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit(FX_SQL[name])
                need.append(name)

    visit(sql)
    if not need:
        return sql
    ctes = ",\n".join(f"{n} AS ({FX_SQL[n]})" for n in need)
    body = sql.lstrip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"


def conv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_turns regrouped into canonical samples (one row per conversation).

    Images: one path per tag (``<conv>_<i>.jpg``), one short for every fifth
    conversation so count checks have failures to find. A conversation is a bounded
    group (its turns), so ``collect_list`` here never gathers an unbounded group.
    """
    t = fx_turns(spark, sf_dir)
    tags = F.size(F.split(F.col("value"), "<image>", -1)) - 1
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), "value"))).alias("_t"),
        F.sum(tags).alias("_n"),
    )
    n_img = F.when(F.col("conv_id") % 5 == 0, F.col("_n") - 1).otherwise(F.col("_n"))
    images = F.transform(
        F.sequence(F.lit(1), F.greatest(n_img, F.lit(1))),
        lambda i: F.concat(F.col("conv_id").cast("string"), F.lit("_"), i.cast("string"), F.lit(".jpg")),
    )
    return g.select(
        F.col("conv_id").cast("string").alias("sample_id"),
        "conv_id",
        F.lit("conv").alias("dataset"),
        F.col("conv_id").alias("row_id"),
        F.when(n_img > 0, images).otherwise(F.array().cast("array<string>")).alias("images"),
        F.lit(None).cast("string").alias("video"),
        F.transform("_t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("turns"),
        F.create_map().cast("map<string,string>").alias("extras"),
    )


def explode_turns(df: DataFrame, turns: str = "turns", key: str = "conv_id") -> DataFrame:
    """One row per turn: (key, turn, role, value)."""
    return df.select(key, F.posexplode(turns).alias("turn", "_t")).select(
        key, F.col("turn").cast("bigint").alias("turn"), F.col("_t.from").alias("role"), F.col("_t.value").alias("value")
    )
