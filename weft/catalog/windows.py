"""Registered queries for position plans (W*) and top-k (K*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, fx_answers, fx_members, fx_scored, fx_steps, fx_turns, table
from weft.ids import positions
from weft.operators import windows as W
from weft.plans.buffers import restarting_buffers

H = "('0x' || substr(md5('{seed}|' || {k}), 1, 8))::BIGINT"
SCORED_ROWS = "(SELECT *, row_number() OVER (ORDER BY id) - 1 AS row_id, count(*) OVER () AS n FROM fx_scored)"


def scored_rows(spark, sf):
    return positions(fx_scored(spark, sf), ["id"], name="row_id")


@query("w01_reassign_ids", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS id FROM documents")
def w01(spark, sf):
    return W.reassign_ids(table(spark, sf, "documents"), "source", ["doc_id"]).select("doc_id", "id")


@query("w02_shard_position", "SELECT k, row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS shard_idx FROM fx_members")
def w02(spark, sf):
    return W.shard_position(fx_members(spark, sf), "shard", ["k"]).select("k", "shard_idx")


@query(
    "w03_group_n",
    f"""SELECT row_id // 4 AS "group", string_agg(id::VARCHAR, ',' ORDER BY row_id) AS items FROM {SCORED_ROWS}
GROUP BY row_id // 4 HAVING count(*) = 4""",
)
def w03(spark, sf):
    d = scored_rows(spark, sf).withColumn("value", F.col("id").cast("string"))
    g = W.group_n(d, 4)
    return g.select(F.col("group").cast("bigint").alias("group"), F.array_join("items", ",").alias("items"))


@query(
    "w04_linspace_sample",
    """WITH n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT r.i AS sample_idx, CASE WHEN r.i = 36 THEN n.n - 1 ELSE floor(r.i * ((n.n - 1) / 36.0)) END AS row_id FROM range(37) r(i), n)
SELECT sample_idx, doc_id FROM i JOIN documents d ON d.doc_id = i.row_id""",
)
def w04(spark, sf):
    d = table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))
    return W.linspace_sample(d, 37).select("sample_idx", "doc_id")


@query(
    "w05_chunk_last_rest",
    f"SELECT id, least(row_id // greatest(n // 7, 1), 6) AS chunk FROM {SCORED_ROWS}",
)
def w05(spark, sf):
    return W.chunk_last_rest(scored_rows(spark, sf), 7).select("id", F.col("chunk").cast("bigint").alias("chunk"))


@query("w06_chunk_ceil", f"SELECT id, row_id // CAST(ceil(n / 7) AS BIGINT) AS chunk FROM {SCORED_ROWS}")
def w06(spark, sf):
    return W.chunk_ceil(scored_rows(spark, sf), 7).select("id", F.col("chunk").cast("bigint").alias("chunk"))


@query("w07_stride_split", f"SELECT id, row_id % 7 AS rank FROM {SCORED_ROWS}")
def w07(spark, sf):
    return W.stride_split(scored_rows(spark, sf), 7).select("id", "rank")


BAL = """CASE WHEN row_id < (n % {p}) * (n // {p} + 1) THEN row_id // (n // {p} + 1)
  ELSE (n % {p}) + (row_id - (n % {p}) * (n // {p} + 1)) // greatest(n // {p}, 1) END"""


@query(
    "w08_balanced_split",
    f"""SELECT id, {BAL.format(p=7)} AS rank,
  CASE WHEN {BAL.format(p=14)} < 7 THEN {BAL.format(p=14)} ELSE 13 - {BAL.format(p=14)} END AS zigzag FROM {SCORED_ROWS}""",
)
def w08(spark, sf):
    d = W.balanced_split(scored_rows(spark, sf), 7)
    d = W.balanced_split(d, 7, zigzag=True, name="zigzag")
    return d.select("id", "rank", "zigzag")


@query(
    "w10_pad_to_batch",
    f"""WITH n AS (SELECT count(*) AS n FROM labels),
p AS (SELECT n, CASE WHEN n % 1000 = 0 THEN 1 WHEN 1000 // n >= 2 THEN 1000 // n ELSE 1 END AS times FROM n),
rep AS (SELECT doc_id, unnest(range(times)) AS copy FROM labels, p),
res AS (SELECT CASE WHEN n % 1000 = 0 THEN 0 ELSE 1000 - (n * times) % 1000 END AS r FROM p)
SELECT doc_id, copy FROM rep
UNION ALL (SELECT doc_id, -1 FROM rep ORDER BY {H.format(seed=42, k="doc_id::VARCHAR || '|' || copy::VARCHAR")}, doc_id, copy
  LIMIT (SELECT r FROM res))""",
)
def w10(spark, sf):
    lab = table(spark, sf, "labels").withColumn("row_id", F.col("doc_id"))
    return W.pad_to_batch(lab, 1000).select("doc_id", F.col("copy").cast("bigint").alias("copy"))


@query(
    "w15_shard_shuffle_order",
    f"""SELECT shard, k, {H.format(seed=3, k='shard')} AS s, {H.format(seed=3, k='k::VARCHAR')} AS r FROM fx_members""",
)
def w15(spark, sf):
    d = W.shard_shuffle_order(fx_members(spark, sf), "shard", "k", epoch=3)
    return d.select("shard", "k", "order_key.s", "order_key.r")


@query(
    "w15_chunk_shuffle",
    f"""SELECT id, row_number() OVER (ORDER BY {H.format(seed=5, k='(row_id // 16)::BIGINT::VARCHAR')}, {H.format(seed=6, k='row_id::VARCHAR')}, row_id) - 1 AS place
FROM {SCORED_ROWS}""",
)
def w15_chunk(spark, sf):
    d = W.chunk_shuffle(scored_rows(spark, sf), "row_id", 16, epoch=5)
    return positions(d.select("id", "order_key"), ["order_key"], name="place").select("id", "place")


@query(
    "w15_rank_chunk",
    f"""WITH r AS {SCORED_ROWS}
SELECT id, row_id // CAST(ceil(n / 6) AS BIGINT) AS rank FROM r
UNION ALL SELECT id, (n + row_id) // CAST(ceil(n / 6) AS BIGINT) FROM r WHERE row_id < CAST(ceil(n / 6) AS BIGINT) * 6 - n""",
)
def w15_rank(spark, sf):
    return W.rank_chunk(scored_rows(spark, sf), 6).select("id", "rank")


TOKENS_SQL = r"list_transform(list_filter(regexp_split_to_array(value, '\s+'), lambda w: w <> ''), lambda w: length(w))"


#: The buffers, replayed text by text: a buffer takes texts until it holds 3000 characters.
BUFFERS_SQL = """o AS (SELECT *, length(value) AS chars, row_number() OVER (ORDER BY conv_id, turn) AS i FROM fx_turns),
r AS (SELECT i, 0::BIGINT AS buffer, chars AS held FROM o WHERE i = 1
  UNION ALL SELECT o.i, r.buffer + (r.held >= 3000)::BIGINT, CASE WHEN r.held >= 3000 THEN 0 ELSE r.held END + o.chars FROM r JOIN o ON o.i = r.i + 1)"""


def _buffered_turns(spark, sf):
    t = fx_turns(spark, sf).withColumn("chars", F.length("value"))
    return restarting_buffers(t, "chars", ["conv_id", "turn"], 3000)


@query("w18_buffers", f"WITH RECURSIVE {BUFFERS_SQL} SELECT conv_id, turn, buffer FROM r JOIN o USING (i)")
def w18_buffers(spark, sf):
    return _buffered_turns(spark, sf).select("conv_id", "turn", "buffer")


@query(
    "w18_pack_constant",
    f"""WITH RECURSIVE {BUFFERS_SQL},
t AS (SELECT buffer, flatten(list({TOKENS_SQL} || [0] ORDER BY conv_id, turn)) AS toks FROM r JOIN o USING (i) GROUP BY buffer)
SELECT buffer, c AS chunk, array_to_string(toks[c * 16 + 1 : c * 16 + 16], ',') AS ids
FROM t, range(0, len(toks) // 16) r(c)""",
)
def w18(spark, sf):
    t = _buffered_turns(spark, sf).withColumn("tokens", W.token_ids(F.col("value")))
    out = W.pack_constant(t.withColumn("place", F.struct("conv_id", "turn")), "tokens", "buffer", "place", 16)
    return out.select("buffer", "chunk", F.array_join("input_ids", ",").alias("ids"))


@query(
    "w19_pack_padded",
    f"""WITH t AS (SELECT conv_id, list({TOKENS_SQL} ORDER BY turn) AS l FROM fx_turns GROUP BY conv_id),
j AS (SELECT conv_id, flatten(list_transform(l, lambda x, i: CASE WHEN i = 1 THEN x ELSE [0] || x END)) AS toks FROM t)
SELECT conv_id, c AS chunk, array_to_string(toks[c * 32 + 1 : c * 32 + 32] || list_transform(range(32 - len(toks[c * 32 + 1 : c * 32 + 32])), lambda x: 0), ',') AS ids
FROM j, range(0, CAST(ceil(len(toks) / 32) AS BIGINT)) r(c)""",
)
def w19(spark, sf):
    t = fx_turns(spark, sf).withColumn("tokens", W.token_ids(F.col("value")))
    out = W.pack_padded(t, "tokens", "conv_id", "turn", 32)
    return out.select("conv_id", "chunk", F.array_join("input_ids", ",").alias("ids"))


@query(
    "w20_retention",
    """SELECT k, sum(nbytes) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING) <= 500000
  AND row_number() OVER (ORDER BY k DESC) - 1 < 300 AS keep FROM fx_members""",
)
def w20(spark, sf):
    m = fx_members(spark, sf).withColumn("mtime", F.col("k"))
    return W.retention(m, "nbytes", "mtime", "k", 500000, 300).select("k", "keep")


@query(
    "k01_top_fraction",
    """WITH t AS (SELECT shard, count(*) AS total FROM fx_scored GROUP BY shard),
r AS (SELECT id, shard, row_number() OVER (PARTITION BY shard ORDER BY s1 + s2 DESC, id) - 1 AS rk FROM fx_scored WHERE s1 + s2 > 0.05)
SELECT id, shard FROM r JOIN t USING (shard) WHERE rk < floor(total * 0.2)""",
)
def k01(spark, sf):
    s = fx_scored(spark, sf).withColumn("score", F.col("s1") + F.col("s2"))
    return W.top_fraction(s, "shard", "score", "id", 0.2, keep=F.col("score") > 0.05).select("id", "shard")


@query(
    "k02_cap_media",
    "SELECT conv_id, least(CASE WHEN n_img > 0 THEN n_img ELSE 0 END, 2)::BIGINT AS n_images FROM fx_convimg",
)
def k02(spark, sf):
    s = W.cap_media(conv_samples(spark, sf), 2)
    return s.select("conv_id", F.size("images").cast("bigint").alias("n_images"))


@query(
    "k04_best_of_n",
    """SELECT episode, step, rank FROM (SELECT episode, step, row_number() OVER (PARTITION BY episode ORDER BY (step * 7919) % 1000 DESC, step) - 1 AS rank
FROM fx_steps) WHERE rank < 3""",
)
def k04(spark, sf):
    s = fx_steps(spark, sf).withColumn("score", (F.col("step") * 7919) % 1000)
    return W.best_of_n(s, "episode", "score", "step", 3).select("episode", "step", "rank")


@query(
    "k05_most_similar",
    """SELECT question_id, list_sort(list_transform([gt, category, 'red bolt'], lambda c, i: {'d': levenshtein(pred, c), 'i': i, 'c': c}))[1].c AS choice
FROM fx_answers""",
)
def k05(spark, sf):
    a = fx_answers(spark, sf)
    return a.select("question_id", W.most_similar(F.col("pred"), F.array("gt", "category", F.lit("red bolt"))).alias("choice"))
