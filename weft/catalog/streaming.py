"""Registered streaming queries (T01–T04); each runs its stream to completion and
returns the sink. T01, T02 and T04 equal their batch twins, whatever the batches; T03's
oracle replays its micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import fx_spans, fx_steps, table
from weft.ids import positions
from weft.operators.windows import token_ids, with_count
from weft.streaming import jobs as S

TOK = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), lambda w: length(w))"


@query(
    "t01_stream_pack_constant",
    f"""WITH t AS (SELECT source, flatten(list({TOK} || [0] ORDER BY doc_id)) AS toks FROM documents GROUP BY source)
SELECT source, c AS chunk, array_to_string(list_transform(toks[c * 64 + 1 : c * 64 + 64], lambda y: y::VARCHAR), ',') AS ids
FROM t, range(0, len(toks) // 64) r(c)""",
)
def t01(spark, sf):
    """Documents arrive in four waves, each in several files that hold all sources."""
    d = table(spark, sf, "documents").select("doc_id", "source", token_ids(F.col("text")).alias("tokens"))
    ids = with_count(positions(d.select("doc_id"), ["doc_id"], name="place"))
    ids = ids.select("doc_id", F.floor(F.col("place") * 4 / F.col("_wf_n")).alias("wave"))
    waves = (d.join(ids.where(F.col("wave") == w), "doc_id").repartition(3, "doc_id") for w in range(4))
    out = S.stream_pack_constant(spark, waves, 64)
    return out.select(F.col("source"), "chunk", F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(
    "t02_stream_moments",
    "SELECT avg(value) AS mean, stddev_samp(value) AS std, count(value) AS count FROM events",
)
def t02(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    root = S.land(e, S.work_dir(spark, "t02-in"), by="event_type", whole=False)
    return S.stream_moments(spark, root, e.schema, "value")


@query(
    "t03_stream_prompt_advantages",
    """WITH s AS (SELECT episode AS prompt, step, ((step * 37) % 11)::DOUBLE AS reward, step % 4 AS wave FROM fx_steps),
k AS (SELECT DISTINCT prompt, wave FROM s),
b AS (SELECT k.prompt, k.wave, list(s.reward ORDER BY s.wave, s.step, s.reward) AS l FROM k JOIN s ON s.prompt = k.prompt AND s.wave <= k.wave GROUP BY ALL),
u AS (SELECT prompt, wave, list_slice(l, greatest(len(l) - 15, 1), len(l)) AS l FROM b),
w AS (SELECT wave, avg(reward) AS m, stddev_pop(reward) AS d FROM s GROUP BY wave)
SELECT s.prompt::VARCHAR AS prompt, s.step, s.reward, len(l) AS buffered,
  (s.reward - CASE WHEN len(l) >= 4 THEN list_avg(l) ELSE m END) / (CASE WHEN len(l) >= 4 THEN list_stddev_pop(l) ELSE d END + 1e-6) AS advantage
FROM s JOIN u USING (prompt, wave) JOIN w USING (wave)""",
)
def t03(spark, sf):
    s = fx_steps(spark, sf).select(
        F.col("episode").alias("prompt"), "step", ((F.col("step") * 37) % 11).cast("double").alias("reward"), (F.col("step") % 4).alias("wave")
    )
    return S.stream_prompt_advantages(spark, [s.where(F.col("wave") == w) for w in range(4)], buffer=16, min_count=4)


@query(
    "t04_stream_incremental_eval",
    """SELECT category, avg(score) AS mean_score, count(*) AS n FROM (SELECT DISTINCT qid, category, (qid % 7)::DOUBLE AS score FROM fx_spans)
GROUP BY category""",
)
def t04(spark, sf):
    s = fx_spans(spark, sf).select("qid", "category", (F.col("qid") % 7).cast("double").alias("score"))
    hour = lambda n: F.lit(f"2024-01-01 0{n}:00:00").cast("timestamp")
    again = s.filter(F.col("qid") % 3 == 0).withColumn("seen", hour(1))
    return S.stream_incremental_eval(spark, [s.withColumn("seen", hour(0)), again], "qid", "score", "category", "seen", "1 day")
