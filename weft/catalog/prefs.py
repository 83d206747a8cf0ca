"""Registered queries for preference/rollout operators (R*) and time expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, fx_pairs, fx_spans, fx_steps, fx_turns, table
from weft.functions import timeparse as T
from weft.operators import prefs as R
from weft.operators.windows import token_ids

TOK = r"list_transform(list_filter(regexp_split_to_array({v}, '\s+'), lambda w: w <> ''), lambda w: length(w))"


def tok_sql(v: str = "value") -> str:
    return TOK.format(v=v)


def arr(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def arr_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda y: y::VARCHAR), ',')"


@query(
    "r01_split_prompt_answer",
    f"""WITH t AS (SELECT conv_id, turn, {tok_sql()} AS p FROM fx_turns),
f AS (SELECT conv_id, turn, p, CASE WHEN turn % 3 = 0 AND len(p) > 0 THEN p[1:len(p) - 1] || [p[len(p)] + 100] || [7, 8] ELSE p || [7, 8] END AS fl FROM t),
s AS (SELECT *, len(p) - CASE WHEN fl[1:len(p)] <> p THEN 1 ELSE 0 END AS st FROM f)
SELECT conv_id, turn, {arr_sql('fl[1:st]')} AS prompt_ids, {arr_sql('fl[st + 1:len(fl)]')} AS answer_ids FROM s""",
)
def r01(spark, sf):
    t = fx_turns(spark, sf).withColumn("p", token_ids(F.col("value")))
    n = F.size("p")
    merged = F.concat(F.slice("p", 1, F.greatest(n - 1, F.lit(0))), F.array(F.element_at("p", F.greatest(n, F.lit(1))) + 100), F.array(F.lit(7), F.lit(8)))
    full = F.when((F.col("turn") % 3 == 0) & (n > 0), merged).otherwise(F.concat("p", F.array(F.lit(7), F.lit(8))))
    s = t.withColumn("full", full).withColumn("x", R.split_prompt_answer("full", "p"))
    return s.select("conv_id", "turn", arr(F.col("x.prompt_ids")).alias("prompt_ids"), arr(F.col("x.answer_ids")).alias("answer_ids"))


@query(
    "r02_truncate_pair",
    f"""WITH t AS (SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN {tok_sql()} END), []) AS p,
   coalesce(max(CASE WHEN turn = 1 THEN {tok_sql()} END), []) AS c, coalesce(max(CASE WHEN turn = 2 THEN {tok_sql()} END), []) AS r
   FROM fx_turns GROUP BY conv_id),
a AS (SELECT conv_id, c, r, CASE WHEN len(p) + greatest(len(c), len(r)) > 64 AND len(p) > 24 THEN p[len(p) - 23:len(p)] ELSE p END AS pp FROM t),
b AS (SELECT conv_id, pp, CASE WHEN len(pp) + greatest(len(c), len(r)) > 64 THEN c[1:40] ELSE c END AS cc,
   CASE WHEN len(pp) + greatest(len(c), len(r)) > 64 THEN r[1:40] ELSE r END AS rr FROM a)
SELECT conv_id, {arr_sql('pp || cc')} AS chosen_ids, {arr_sql('pp || rr')} AS rejected_ids,
  {arr_sql("list_transform(pp, lambda x: -100) || cc")} AS chosen_labels FROM b""",
)
def r02(spark, sf):
    s = conv_samples(spark, sf)
    tk = lambda i: F.coalesce(token_ids(F.get(F.col("turns"), i)["value"]), F.array().cast("array<int>"))
    x = s.select("conv_id", R.truncate_pair(tk(0), tk(1), tk(2), 64, 24, "keep_end").alias("x"))
    return x.select("conv_id", arr(F.col("x.chosen_ids")).alias("chosen_ids"), arr(F.col("x.rejected_ids")).alias("rejected_ids"),
                    arr(F.col("x.chosen_labels")).alias("chosen_labels"))


@query(
    "r03_pad_in_batch",
    f"""WITH t AS (SELECT conv_id, turn, conv_id % 5 AS b, {tok_sql()} AS ids FROM fx_turns),
m AS (SELECT b, max(len(ids)) AS mx FROM t GROUP BY b)
SELECT conv_id, turn, {arr_sql("list_transform(range(mx - len(ids)), lambda x: 0) || ids")} AS padded FROM t JOIN m USING (b)""",
)
def r03(spark, sf):
    t = fx_turns(spark, sf).withColumn("ids", token_ids(F.col("value"))).withColumn("b", F.col("conv_id") % 5)
    out = R.pad_in_batch(t, "b", "ids", 0, left=True, name="padded")
    return out.select("conv_id", "turn", arr(F.col("padded")).alias("padded"))


def _state_mask_sql(on_tok: int, off_tok: int) -> str:
    # label kept when the most recent marker before this token is the "on" marker
    return f"""list_transform(ids, lambda x, i: CASE WHEN x <> {on_tok} AND x <> {off_tok}
   AND coalesce(list_last(list_filter(ids[1:i - 1], lambda y: y = {on_tok} OR y = {off_tok})), -1) = {on_tok} THEN x ELSE -100 END)"""


@query(
    "r02_preference_row",
    f"""WITH t AS (SELECT conv_id, coalesce(max(CASE WHEN turn = 0 THEN {tok_sql()} END), []) AS p,
   coalesce(max(CASE WHEN turn = 1 THEN {tok_sql()} END), []) AS c, coalesce(max(CASE WHEN turn = 2 THEN {tok_sql()} END), []) AS r
   FROM fx_turns GROUP BY conv_id),
q AS (SELECT conv_id, [1] || p AS cp, [1] || CASE conv_id % 3 WHEN 0 THEN p[1:len(p) - 1] WHEN 1 THEN p[1:len(p) - 1] || [99] ELSE p END AS rp, c || [2] AS c, r || [2] AS r FROM t),
l AS (SELECT *, greatest(len(c), len(r)) AS n FROM q),
a AS (SELECT conv_id, c, r, n, CASE WHEN len(cp) + n > 64 AND len(cp) > 24 THEN cp[len(cp) - 23:len(cp)] ELSE cp END AS cp,
  CASE WHEN len(rp) + n > 64 AND len(rp) > 24 THEN rp[len(rp) - 23:len(rp)] ELSE rp END AS rp FROM l)
SELECT conv_id, {arr_sql("cp || CASE WHEN len(cp) + n > 64 THEN c[1:40] ELSE c END")} AS chosen_ids,
  {arr_sql("rp || CASE WHEN len(rp) + n > 64 THEN r[1:40] ELSE r END")} AS rejected_ids,
  {arr_sql("list_transform(rp, lambda x: -100) || CASE WHEN len(rp) + n > 64 THEN r[1:40] ELSE r END")} AS rejected_labels FROM a""",
)
def r02_row(spark, sf):
    s = conv_samples(spark, sf)
    tk = lambda i: F.coalesce(token_ids(F.get(F.col("turns"), i)["value"]), F.array().cast("array<int>"))
    s = s.select("conv_id", tk(0).alias("p"), tk(1).alias("c"), tk(2).alias("r"))
    short = F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0)))
    other = F.when(F.col("conv_id") % 3 == 0, short).when(F.col("conv_id") % 3 == 1, F.concat(short, F.array(F.lit(99)))).otherwise(F.col("p"))
    x = s.select("conv_id", R.preference_row(F.col("p"), F.col("c"), other, F.col("r"), 1, 2, 64, 24).alias("x"))
    return x.select("conv_id", *[arr(F.col(f"x.{n}")).alias(n) for n in ("chosen_ids", "rejected_ids", "rejected_labels")])


@query(
    "r04_mask_by_markers",
    f"SELECT conv_id, turn, {arr_sql(_state_mask_sql(5, 3))} AS labels FROM (SELECT conv_id, turn, {tok_sql()} AS ids FROM fx_turns)",
)
def r04(spark, sf):
    t = fx_turns(spark, sf).withColumn("ids", token_ids(F.col("value")))
    return t.select("conv_id", "turn", arr(R.mask_by_markers("ids", instruction=3, response=5)).alias("labels"))


@query(
    "r04_marker_tokens",
    f"""WITH t AS (SELECT conv_id, flatten(list({tok_sql()} ORDER BY turn)) AS ids FROM fx_turns GROUP BY conv_id),
p AS (SELECT conv_id, i, ids[i] AS x, ids[i] = 2 AND ids[i + 1] = 3 AS res, ids[i] = 3 AND ids[i + 1] = 2 AS ins, len(ids) AS n FROM t, range(1, len(ids) + 1) r(i)),
r AS (SELECT conv_id, i + 1 AS stop, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS k, count(*) OVER (PARTITION BY conv_id) AS nr FROM p WHERE res),
h0 AS (SELECT conv_id, i AS go FROM p WHERE ins),
h1 AS (SELECT conv_id, go FROM h0 UNION ALL
  SELECT conv_id, 1 FROM (SELECT conv_id, min(go) AS go FROM h0 GROUP BY conv_id) f JOIN (SELECT conv_id, min(stop) AS stop FROM r GROUP BY conv_id) q USING (conv_id) WHERE f.go > q.stop + 1),
h AS (SELECT conv_id, go, row_number() OVER (PARTITION BY conv_id ORDER BY go) AS k, count(*) OVER (PARTITION BY conv_id) AS nh FROM h1),
m AS (SELECT p.conv_id, p.i, p.x,
   NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = p.conv_id) OR NOT EXISTS (SELECT 1 FROM h0 WHERE h0.conv_id = p.conv_id)
   OR EXISTS (SELECT 1 FROM r JOIN h USING (conv_id, k) WHERE r.conv_id = p.conv_id AND p.i <= r.stop AND (k = 1 OR p.i >= h.go))
   OR p.i >= (SELECT max(go) FROM h WHERE h.conv_id = p.conv_id AND nh > coalesce((SELECT max(nr) FROM r WHERE r.conv_id = p.conv_id), 0)) AS hidden,
   p.i <= coalesce((SELECT max(stop) FROM r WHERE r.conv_id = p.conv_id), p.n) AS before FROM p)
SELECT conv_id, string_agg((CASE WHEN coalesce(hidden, false) THEN -100 ELSE x END)::VARCHAR, ',' ORDER BY i) AS labels,
  string_agg((CASE WHEN before THEN -100 ELSE x END)::VARCHAR, ',' ORDER BY i) AS last FROM m GROUP BY conv_id""",
)
def r04_tokens(spark, sf):
    t = fx_turns(spark, sf).select("conv_id", F.struct("turn", token_ids(F.col("value")).alias("w")).alias("t"))
    g = t.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["w"])).alias("ids"))
    both, last = R.mask_by_marker_tokens("ids", [2, 3], [3, 2]), R.mask_by_marker_tokens("ids", [2, 3])
    return g.select("conv_id", arr(both).alias("labels"), arr(last).alias("last"))


@query(
    "r06_mask_interleaved",
    f"""WITH t AS (SELECT conv_id, turn, {tok_sql()} AS ids FROM fx_turns),
p AS (SELECT conv_id, turn, i, ids[i] AS x FROM t, range(1, len(ids) + 1) r(i)),
m AS (SELECT *, max(CASE WHEN x = 7 THEN i END) OVER w AS last_image, max(CASE WHEN x = 2 THEN i END) OVER w AS last_sep
  FROM p WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
l AS (SELECT conv_id, turn, string_agg((CASE WHEN last_image > coalesce(last_sep, 0) THEN x ELSE -100 END)::VARCHAR, ',' ORDER BY i) AS labels FROM m GROUP BY ALL)
SELECT t.conv_id, t.turn, coalesce(labels, '') AS labels FROM t LEFT JOIN l USING (conv_id, turn)""",
)
def r06(spark, sf):
    t = fx_turns(spark, sf).withColumn("ids", token_ids(F.col("value")))
    return t.select("conv_id", "turn", arr(R.mask_interleaved("ids", image=7, sep=2)).alias("labels"))


def _template_tokens(spark, sf):
    """Tokens of conversations: role, word lengths from 10, end; answers without words and
    end make the template, and for every seventh conversation it has one token too many."""
    t = fx_turns(spark, sf).select("conv_id", "turn", "role", F.transform(token_ids(F.col("value")), lambda x: x + 10).alias("w"))
    human = F.col("role") == "human"
    own = F.concat(F.array(F.when(human, 1).otherwise(3)), "w", F.array(F.lit(2)))
    tpl = F.when(human, own).otherwise(F.array(F.lit(3)))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", own.alias("own"), tpl.alias("tpl")))).alias("l"))
    g = g.select("conv_id", F.flatten(F.transform("l", lambda x: x["own"])).alias("ids"), F.flatten(F.transform("l", lambda x: x["tpl"])).alias("tpl"))
    return g.withColumn("long", F.when(F.col("conv_id") % 7 == 0, F.concat("tpl", F.array(F.lit(-5)))).otherwise(F.col("tpl")))


@query(
    "r05_mask_by_template",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, role = 'human' AS human, list_transform({tok_sql()}, lambda x: x + 10) AS w FROM fx_turns),
c AS (SELECT conv_id, flatten(list([CASE WHEN human THEN 1 ELSE 3 END] || w || [2] ORDER BY turn)) AS ids,
  flatten(list(CASE WHEN human THEN [1] || w || [2] ELSE [3] END ORDER BY turn)) AS tpl FROM t GROUP BY conv_id),
r AS (SELECT conv_id, ids, tpl, 1::BIGINT AS i, 1::BIGINT AS p, ''::VARCHAR AS labels FROM c
  UNION ALL SELECT conv_id, ids, tpl, i + 1, CASE WHEN ids[i] = tpl[p] THEN p + 1 ELSE p END,
    labels || ',' || CASE WHEN ids[i] = tpl[p] THEN '-100' ELSE ids[i]::VARCHAR END FROM r WHERE i <= len(ids)),
e AS (SELECT conv_id, len(ids) AS n, p > len(tpl) AS used, substr(labels, 2) AS labels FROM r WHERE i = len(ids) + 1)
SELECT conv_id, CASE WHEN used THEN labels ELSE substr(repeat(',-100', n), 2) END AS labels,
  CASE WHEN used AND conv_id % 7 <> 0 THEN labels ELSE substr(repeat(',-100', n), 2) END AS strict FROM e""",
)
def r05(spark, sf):
    t = _template_tokens(spark, sf)
    return t.select("conv_id", arr(R.mask_by_template("ids", "long", "tpl")).alias("labels"), arr(R.mask_by_template("ids", "long")).alias("strict"))


LS = "(-(greatest(-({x}), 0) + ln(1 + exp(-abs({x})))))"
LOGITS = "((pc - pr) - (rc - rr))"


@query(
    "r07_pair_losses",
    f"""SELECT id, -{LS.format(x='0.1 * ' + LOGITS)} * 0.9 - {LS.format(x='-0.1 * ' + LOGITS)} * 0.1 AS sigmoid,
  greatest(0, 1 - 0.1 * {LOGITS}) AS hinge, pow({LOGITS} - 1 / (2 * 0.1), 2) AS ipo,
  1 - 1 / (1 + exp(-(0.1 * ((pc - rc) - (SELECT greatest(avg(pr - rr), 0) FROM fx_pairs))))) AS kto_chosen,
  0.1 * (pc - rc) AS chosen_reward FROM fx_pairs""",
)
def r07(spark, sf):
    p = fx_pairs(spark, sf)
    s = R.pair_losses(p, "pc", "pr", "rc", "rr", "sigmoid", 0.1, 0.1).select("id", F.col("loss").alias("sigmoid"), "chosen_reward")
    h = R.pair_losses(p, "pc", "pr", "rc", "rr", "hinge", 0.1).select("id", F.col("loss").alias("hinge"))
    i = R.pair_losses(p, "pc", "pr", "rc", "rr", "ipo", 0.1).select("id", F.col("loss").alias("ipo"))
    k = R.pair_losses(p, "pc", "pr", "rc", "rr", "kto_pair", 0.1).select("id", F.col("loss")[0].alias("kto_chosen"))
    return s.join(h, "id").join(i, "id").join(k, "id")


EMB_LP = "list_transform(embedding, lambda x: -abs(x))"


@query(
    "r08_sequence_logp",
    f"""SELECT vec_id, list_sum(list_transform({EMB_LP}, lambda x, i: CASE WHEN (i - 1) % 5 <> 0 THEN x ELSE 0.0 END)) AS logp_sum,
  list_sum(list_transform({EMB_LP}, lambda x, i: CASE WHEN (i - 1) % 5 <> 0 THEN x ELSE 0.0 END)) / len(list_filter(range(len(embedding)), lambda i: i % 5 <> 0)) AS logp_mean
FROM embeddings""",
)
def r08(spark, sf):
    e = table(spark, sf, "embeddings")
    lp = F.transform("embedding", lambda x: -F.abs(x).cast("double"))
    m = F.transform("embedding", lambda x, i: i % 5 != 0)
    return e.select("vec_id", R.sequence_logp(lp, m).alias("logp_sum"), R.sequence_logp(lp, m, average=True).alias("logp_mean"))


@query(
    "r09_token_rewards",
    f"""WITH t AS (SELECT vec_id, label, list_transform(embedding, lambda x: -abs(x::DOUBLE) - (-abs(x::DOUBLE) * 0.9)) AS kl, least(50 + vec_id % 10, len(embedding)) - 1 AS last FROM embeddings)
SELECT vec_id, list_sum(list_transform(kl, lambda k: -0.2 * k)) + label AS total, -0.2 * kl[last + 1] + label AS last_reward FROM t""",
)
def r09(spark, sf):
    e = table(spark, sf, "embeddings")
    lp = F.transform("embedding", lambda x: -F.abs(x).cast("double"))
    rp = F.transform("embedding", lambda x: -F.abs(x).cast("double") * 0.9)
    m = F.transform("embedding", lambda x, i: i < 50 + F.col("vec_id") % 10)
    r = e.select("vec_id", R.token_rewards(lp, rp, m, "label", 0.2).alias("r"), (F.least(50 + F.col("vec_id") % 10, F.size("embedding")) - 1).alias("last"))
    return r.select("vec_id", F.aggregate("r", F.lit(0.0), lambda a, b: a + b).alias("total"), F.get(F.col("r"), F.col("last").cast("int")).alias("last_reward"))


@query(
    "r10_gae",
    """WITH t AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 60 THEN x::DOUBLE ELSE 0.0 END) AS v,
   list_transform(embedding, lambda x, i: CASE WHEN i <= 60 THEN -abs(x)::DOUBLE ELSE 0.0 END) AS r FROM embeddings),
d AS (SELECT vec_id, v, list_transform(r, lambda x, i: x + 0.99 * coalesce(v[i + 1], 0.0) - v[i]) AS delta FROM t)
SELECT vec_id, list_sum(list_transform(delta, lambda x, i: pow(0.99 * 0.95, i - 1) * x)) AS adv0,
  list_sum(list_transform(delta, lambda x, i: pow(0.99 * 0.95, i - 1) * x)) + v[1] AS ret0 FROM d""",
)
def r10(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    r = F.transform("embedding", lambda x: -F.abs(x).cast("double"))
    m = F.transform("embedding", lambda x, i: i < 60)
    g = e.select("vec_id", R.gae(v, r, m, 0.99, 0.95).alias("g"))
    return g.select("vec_id", F.col("g.advantages")[0].alias("adv0"), F.col("g.returns")[0].alias("ret0"))


@query(
    "r10_whitened_advantages",
    """WITH RECURSIVE t AS (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i <= 60 THEN x::DOUBLE ELSE 0.0 END) AS v,
   list_transform(embedding, lambda x, i: CASE WHEN i <= 60 THEN -abs(x)::DOUBLE ELSE 0.0 END) AS r FROM embeddings),
d AS (SELECT vec_id, UNNEST(list_transform(r, lambda x, i: x + 0.99 * coalesce(v[i + 1], 0.0) - v[i])) AS delta, UNNEST(range(1, len(r) + 1)) AS i FROM t),
n AS (SELECT max(i) AS n FROM d),
a AS (SELECT vec_id, i, delta AS adv FROM d, n WHERE i = n
  UNION ALL SELECT d.vec_id, d.i, d.delta + 0.99 * 0.95 * a.adv FROM a JOIN d ON d.vec_id = a.vec_id AND d.i = a.i - 1),
m AS (SELECT avg(adv) AS mean, var_samp(adv) AS var FROM a WHERE i <= 60)
SELECT vec_id, (adv - mean) / sqrt(var + 1e-8) AS white0 FROM a, m WHERE i = 1""",
)
def r10_white(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    r = F.transform("embedding", lambda x: -F.abs(x).cast("double"))
    m = F.transform("embedding", lambda x, i: i < 60)
    g = e.select("vec_id", R.gae(v, r, m, 0.99, 0.95).alias("g"), m.alias("mask")).select("vec_id", F.col("g.advantages").alias("adv"), "mask")
    return R.masked_whiten(g, "adv", "mask", "white").select("vec_id", F.col("white")[0].alias("white0"))


@query(
    "r11_prompt_advantages",
    """WITH s AS (SELECT episode, step, ((step * 37) % 11)::DOUBLE AS reward FROM fx_steps),
n AS (SELECT episode, count(*) AS n FROM s GROUP BY episode),
b AS (SELECT episode, avg(reward) AS bm, stddev_pop(reward) AS bs FROM
  (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY step DESC) - 1 AS pos FROM s) WHERE pos < 16 GROUP BY episode),
g AS (SELECT avg(reward) AS gm, stddev_pop(reward) AS gs FROM s)
SELECT s.episode, step, (reward - CASE WHEN least(n, 16) >= 8 THEN bm ELSE gm END) / (CASE WHEN least(n, 16) >= 8 THEN bs ELSE gs END + 1e-6) AS advantage
FROM s JOIN n USING (episode) JOIN b USING (episode), g""",
)
def r11(spark, sf):
    s = fx_steps(spark, sf).withColumn("reward", ((F.col("step") * 37) % 11).cast("double"))
    return R.prompt_advantages(s, "episode", "reward", "step", 16, 8).select("episode", "step", "advantage")


@query(
    "r12_pad_to",
    f"SELECT conv_id, turn, {arr_sql(f'({tok_sql()})[1:10] || list_transform(range(greatest(10 - len({tok_sql()}), 0)), lambda x: -1)')} AS ids FROM fx_turns",
)
def r12(spark, sf):
    t = fx_turns(spark, sf)
    return t.select("conv_id", "turn", arr(R.pad_to(token_ids(F.col("value")), 10, -1)).alias("ids"))


@query(
    "f12_hms_to_seconds",
    """SELECT event_id, (event_id % 3) * 3600 + ((event_id * 7) % 60) * 60 + ((event_id * 13) % 60) + (event_id % 1000) / 1000.0 AS seconds FROM events""",
)
def f12(spark, sf):
    e = table(spark, sf, "events")
    s = F.format_string("%d:%02d:%02d.%03d", F.col("event_id") % 3, (F.col("event_id") * 7) % 60, (F.col("event_id") * 13) % 60, F.col("event_id") % 1000)
    return e.select("event_id", T.hms_to_seconds(s).alias("seconds"))


SPAN_TEXT_SQL = "'from <' || s::VARCHAR || '> to <' || e::VARCHAR || '.5> and <.25> end '"


def _span_text():
    return F.concat(F.lit("from <"), F.col("s").cast("string"), F.lit("> to <"), F.col("e").cast("string"), F.lit(".5> and <.25> end "))


@query(
    "f13_encode_time_tokens",
    rf"""WITH t AS (SELECT qid, duration, {SPAN_TEXT_SQL} AS text FROM fx_spans),
p AS (SELECT qid, regexp_split_to_array(text, '<(?:(?:\d*\.\d+)|(?:\d+\.?))>') AS pieces,
  regexp_extract_all(text, '<(?:(?:\d*\.\d+)|(?:\d+\.?))>', 0) AS ms, duration FROM t)
SELECT qid, regexp_replace(array_to_string(list_transform(pieces, lambda x, i: x || CASE WHEN i <= len(ms)
  THEN '<t' || round_even(replace(replace(ms[i], '<', ''), '>', '')::DOUBLE / duration * 99, 0)::BIGINT::VARCHAR || '>' ELSE '' END), ''),
  '^\s+|\s+$', '', 'g') AS text FROM p""",
)
def f13(spark, sf):
    s = fx_spans(spark, sf)
    return s.select("qid", T.encode_time_tokens(_span_text(), "duration", 100).alias("text"))


@query(
    "f14_decode_time_tokens",
    r"""WITH t AS (SELECT qid, duration, 'at <t' || (qid % 120)::VARCHAR || '> until <t' || (s % 99)::VARCHAR || '>.' AS text FROM fx_spans),
p AS (SELECT qid, duration, regexp_split_to_array(text, '<t\d+>') AS pieces, regexp_extract_all(text, '<t(\d+)>', 1) AS ks FROM t)
SELECT qid, array_to_string(list_transform(pieces, lambda x, i: x || CASE WHEN i <= len(ks) THEN '<' ||
  (CASE WHEN ks[i]::BIGINT < 100 THEN round_even(ks[i]::BIGINT * duration / 99, 2) ELSE round_even(duration::DOUBLE, 2) END)::VARCHAR || '>' ELSE '' END), '') AS text FROM p""",
)
def f14(spark, sf):
    s = fx_spans(spark, sf)
    text = F.concat(F.lit("at <t"), (F.col("qid") % 120).cast("string"), F.lit("> until <t"), (F.col("s") % 99).cast("string"), F.lit(">."))
    return s.select("qid", T.decode_time_tokens(text, "duration", 100).alias("text"))


@query(
    "f15_parse_timestamps",
    r"""WITH t AS (SELECT qid, duration, CASE WHEN qid % 4 = 0 THEN 'only <' || s::VARCHAR || '>' ELSE '<' || (e + 300)::VARCHAR || '> back to <' || s::VARCHAR || '.5>' END AS text FROM fx_spans),
m AS (SELECT qid, duration, list_transform(regexp_extract_all(text, '<(?:(?:\d*\.?\d+)|(?:\d+\.?))>', 0), lambda x: replace(replace(x, '<', ''), '>', '')::DOUBLE) AS ms FROM t)
SELECT qid, CASE WHEN len(ms) >= 2 THEN least(least(greatest(ms[1], 0), duration), least(greatest(ms[2], 0), duration)) ELSE 0.0 END AS lo,
  CASE WHEN len(ms) >= 2 THEN greatest(least(greatest(ms[1], 0), duration), least(greatest(ms[2], 0), duration)) ELSE duration END AS hi FROM m""",
)
def f15(spark, sf):
    s = fx_spans(spark, sf)
    text = F.when(F.col("qid") % 4 == 0, F.concat(F.lit("only <"), F.col("s").cast("string"), F.lit(">"))).otherwise(
        F.concat(F.lit("<"), (F.col("e") + 300).cast("string"), F.lit("> back to <"), F.col("s").cast("string"), F.lit(".5>"))
    )
    p = s.select("qid", T.parse_timestamps(text, "duration").alias("p"))
    return p.select("qid", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


@query(
    "w09_split_at_media",
    f"""WITH t AS (SELECT conv_id, flatten(list({tok_sql()} ORDER BY turn)) AS ids FROM fx_turns GROUP BY conv_id),
p AS (SELECT conv_id, ids, list_filter(range(len(ids)), lambda i: ids[i + 1] = 7) AS pos FROM t),
r AS (SELECT conv_id, ids, pos, rk, len(pos) // 2 AS q, len(pos) % 2 AS rm FROM p, range(2) x(rk) WHERE len(pos) >= 2),
s AS (SELECT conv_id, rk, ids, CASE WHEN rk = 0 THEN 0 ELSE pos[rk * q + least(rk, rm) + 1] END AS st,
  CASE WHEN rk = 1 THEN len(ids) ELSE pos[(rk + 1) * q + least(rk + 1, rm) + 1] END AS en FROM r)
SELECT conv_id, rk AS rank, {arr_sql('ids[st + 1:en]')} AS local_ids,
  CASE WHEN rk = 0 THEN 0 ELSE st + 5 * len(list_filter(ids[1:st], lambda y: y = 7)) END AS pos_start,
  en + 5 * len(list_filter(ids[1:en], lambda y: y = 7)) AS pos_end FROM s""",
)
def w09(spark, sf):
    t = fx_turns(spark, sf).withColumn("tok", token_ids(F.col("value")))
    g = t.groupBy("conv_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "tok"))), lambda x: x["tok"])).alias("ids"))
    out = R.split_at_media(g, "ids", image_token=7, sp=2, image_len=5).filter(F.col("error").isNull())
    return out.select("conv_id", F.col("rank").cast("bigint").alias("rank"), arr(F.col("local_ids")).alias("local_ids"), "pos_start", "pos_end")
