"""Registered queries for n-gram metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import fx_answers, table
from weft.functions.lcs import lcs_sql
from weft.operators import ngram as NG

WS = r"list_filter(regexp_split_to_array({t}, '\s+'), lambda w: w <> '')"

DOC_REFS_SQL = """docs AS (SELECT doc_id AS id, text FROM documents),
refs AS (SELECT d.doc_id AS id, 0 AS ref_idx, b.text FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
  UNION ALL SELECT d.doc_id, 1, e.text FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1),
cw AS (SELECT id, {cws} AS ws FROM docs),
rw AS (SELECT id, ref_idx, {rws} AS ws FROM refs),
cg AS (SELECT id, n, g, count(*) AS cnt FROM (SELECT id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
   FROM cw, range(1, 5) r(n)) GROUP BY id, n, g),
rg AS (SELECT id, ref_idx, n, g, count(*) AS cnt FROM (SELECT id, ref_idx, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS g
   FROM rw, range(1, 5) r(n)) GROUP BY id, ref_idx, n, g)""".format(cws=WS.format(t="text"), rws=WS.format(t="text"))


def doc_pairs(spark, sf):
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark")
    nb = b.agg(F.count(F.lit(1)).alias("_nb"))
    cands = d.select(F.col("doc_id").alias("id"), "text")
    r0 = (
        d.select("doc_id").withColumn("_k", F.lit(1)).join(F.broadcast(nb.withColumn("_k", F.lit(1))), "_k")
        .join(b, F.col("item_id") == F.col("doc_id") % F.col("_nb"))
        .select(F.col("doc_id").alias("id"), F.lit(0).alias("ref_idx"), "text")
    )
    return cands, r0.unionByName(next_texts(d))


FEW = 100_000  # rows of two numbers that are sent to all tasks, at most


def next_texts(d):
    """(id, ref_idx, text): each text for every row of the id before its own. Ids are matched first;
    texts are dealt by id only if many of them are not matched exactly once."""
    nxt = d.where(F.col("doc_id").isNotNull()).select((F.col("doc_id") - 1).alias("id"), F.lit(1).alias("ref_idx"), "text")
    rows = d.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    times = F.coalesce(F.col("_n"), F.lit(0))
    odd = nxt.select("id").distinct().join(rows, "id", "left").select("id", times.alias("_n")).where("_n <> 1").checkpoint()
    few = odd.limit(FEW + 1).count() <= FEW
    matched = nxt.join(F.broadcast(odd) if few else odd, "id", "left").withColumn("_n", F.coalesce(F.col("_n"), F.lit(1)).cast("int"))
    once = matched.where("_n = 1").select("id", "ref_idx", "text")
    more = matched.where("_n > 1").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("id", "ref_idx", "text")
    return once.unionByName(more)


@query(
    "g07_bleu",
    "WITH " + DOC_REFS_SQL + """,
rmax AS (SELECT id, n, g, max(cnt) AS rmax FROM rg GROUP BY id, n, g),
corr AS (SELECT n, sum(least(cnt, coalesce(rmax, 0))) AS c FROM cg LEFT JOIN rmax USING (id, n, g) GROUP BY n),
gs AS (SELECT n, sum(greatest(len(ws) - n + 1, 0)) AS gu FROM cw, range(1, 5) r(n) GROUP BY n),
tl AS (SELECT sum(len(ws)) AS testlen FROM cw),
cl AS (SELECT sum(rl) AS reflen FROM (SELECT c.id, arg_min(len(r.ws), abs(len(r.ws) - len(c.ws)) * 10000000 + len(r.ws)) AS rl
   FROM cw c JOIN rw r USING (id) GROUP BY c.id)),
p AS (SELECT n, sum(ln((coalesce(c, 0) + 1e-15) / (gu + 1e-9))) OVER (ORDER BY n) AS lp FROM gs LEFT JOIN corr USING (n)),
bp AS (SELECT CASE WHEN (testlen + 1e-15) / (reflen + 1e-9) < 1 THEN exp(1 - 1 / ((testlen + 1e-15) / (reflen + 1e-9))) ELSE 1.0 END AS bp FROM tl, cl)
SELECT max(CASE WHEN n = 1 THEN exp(lp / 1) END) * max(bp) AS bleu_1, max(CASE WHEN n = 2 THEN exp(lp / 2) END) * max(bp) AS bleu_2,
  max(CASE WHEN n = 3 THEN exp(lp / 3) END) * max(bp) AS bleu_3, max(CASE WHEN n = 4 THEN exp(lp / 4) END) * max(bp) AS bleu_4 FROM p, bp""",
)
def g07(spark, sf):
    c, r = doc_pairs(spark, sf)
    return NG.bleu(c, r)


@query(
    "g08_cider",
    "WITH " + DOC_REFS_SQL + """,
dfreq AS (SELECT n, g, count(DISTINCT id) AS df FROM rg GROUP BY n, g),
nd AS (SELECT ln(count(DISTINCT id)) AS ref_len FROM refs),
cv AS (SELECT id, n, g, cnt * (ref_len - ln(greatest(1.0, coalesce(df, 0)))) AS wh FROM cg LEFT JOIN dfreq USING (n, g), nd),
rv AS (SELECT id, ref_idx, n, g, cnt * (ref_len - ln(greatest(1.0, coalesce(df, 0)))) AS wr FROM rg LEFT JOIN dfreq USING (n, g), nd),
nh AS (SELECT id, n, sqrt(sum(wh * wh)) AS nh FROM cv GROUP BY id, n),
nr AS (SELECT id, ref_idx, n, sqrt(sum(wr * wr)) AS nr FROM rv GROUP BY id, ref_idx, n),
dt AS (SELECT id, ref_idx, n, sum(wh * wr) AS dot FROM cv JOIN rv USING (id, n, g) GROUP BY id, ref_idx, n),
grid AS (SELECT DISTINCT id, ref_idx, r.n FROM refs, range(1, 5) r(n)),
v AS (SELECT id, ref_idx, CASE WHEN coalesce(nh, 0) <> 0 AND coalesce(nr, 0) <> 0 THEN coalesce(dot, 0) / (nh * nr) ELSE coalesce(dot, 0) END AS val
  FROM grid LEFT JOIN dt USING (id, ref_idx, n) LEFT JOIN nh USING (id, n) LEFT JOIN nr USING (id, ref_idx, n)),
per AS (SELECT id, avg(s) * 10 AS cider FROM (SELECT id, ref_idx, sum(val) / 4 AS s FROM v GROUP BY id, ref_idx) GROUP BY id)
SELECT avg(cider) AS cider FROM per""",
)
def g08(spark, sf):
    c, r = doc_pairs(spark, sf)
    return NG.cider(c, r)


def _rouge_sql(p: str, r: str, n: int) -> str:
    def grams(t: str) -> str:
        ws = f"flatten(list_transform(list_filter(string_split({t}, '.'), lambda s: length(s) > 0), lambda s: {WS.format(t='s')}))"
        return f"list_distinct(list_transform(range(1, len({ws}) - {n} + 2), lambda i: array_to_string(({ws})[i:i + {n} - 1], ' ')))"

    e, rr = grams(p), grams(r)
    ov = f"len(list_intersect({e}, {rr}))::DOUBLE"
    pp = f"CASE WHEN len({e}) > 0 THEN {ov} / len({e}) ELSE 0.0 END"
    rc = f"CASE WHEN len({rr}) > 0 THEN {ov} / len({rr}) ELSE 0.0 END"
    return f"2 * (({pp}) * ({rc}) / (({pp}) + ({rc}) + 1e-8))"


ROUGE_IN = "(SELECT CASE WHEN question_id % 11 = 0 THEN 'dummy text' ELSE pred || '. ' || category END AS p, gt || ' ' || category AS r FROM fx_answers)"


ROUGE_WORDS = "flatten(list_transform(list_filter(string_split({t}, '.'), lambda s: length(s) > 0), lambda s: " + WS.format(t="s") + "))"


@query("g09_rouge", f"SELECT avg({_rouge_sql('p', 'r', 1)}) AS rouge_1, avg({_rouge_sql('p', 'r', 2)}) AS rouge_2 FROM {ROUGE_IN}")
def g09(spark, sf):
    a = fx_answers(spark, sf)
    pred = F.when(F.col("question_id") % 11 == 0, F.lit("")).otherwise(F.concat("pred", F.lit(". "), "category"))
    d = a.select(pred.alias("pred"), F.array("gt", "category").alias("refs"))
    return NG.rouge(d, "pred", "refs", with_l=False)


@query(
    "g09_rouge_l",
    f"WITH RECURSIVE i AS (SELECT row_number() OVER () AS id, p, r FROM {ROUGE_IN}), "
    + lcs_sql(f"SELECT id, {ROUGE_WORDS.format(t='p')} AS x, {ROUGE_WORDS.format(t='r')} AS y FROM i")
    + f""", l AS (SELECT avg(CASE WHEN n = 0 THEN 0.0 ELSE 2 * (n / nx) * (n / ny) / (n / nx + n / ny + 1e-8) END) AS rouge_l FROM lcs)
SELECT avg({_rouge_sql('p', 'r', 1)}) AS rouge_1, avg({_rouge_sql('p', 'r', 2)}) AS rouge_2, any_value(rouge_l) AS rouge_l FROM i, l""",
)
def g09l(spark, sf):
    a = fx_answers(spark, sf)
    pred = F.when(F.col("question_id") % 11 == 0, F.lit("")).otherwise(F.concat("pred", F.lit(". "), "category"))
    return NG.rouge(a.select(pred.alias("pred"), F.array("gt", "category").alias("refs")), "pred", "refs", with_l=True)


def _spell_sql(n: str) -> str:
    """English words of an integer below a million, by arithmetic."""
    ones = "['" + "','".join(NG.ONES) + "']"
    tens = "['" + "','".join(NG.TENS) + "']"

    def below_hundred(x: str) -> str:
        return f"(CASE WHEN {x} < 20 THEN {ones}[{x} + 1] WHEN {x} % 10 = 0 THEN {tens}[{x} // 10 - 1] ELSE {tens}[{x} // 10 - 1] || {ones}[{x} % 10 + 1] END)"

    def below_thousand(x: str) -> str:
        hundred = f"{ones}[{x} // 100 + 1] || ' hundred'"
        return f"(CASE WHEN {x} < 100 THEN {below_hundred(x)} WHEN {x} % 100 = 0 THEN {hundred} ELSE {hundred} || ' and ' || {below_hundred(f'({x} % 100)')} END)"

    rest = f"(CASE WHEN {n} % 1000 < 100 THEN ' and ' ELSE ' ' END) || {below_thousand(f'({n} % 1000)')}"
    return f"""(CASE WHEN {n} < 1000 THEN {below_thousand(n)} WHEN {n} % 1000 = 0 THEN {below_thousand(f'({n} // 1000)')} || ' thousand'
  ELSE {below_thousand(f'({n} // 1000)')} || ' thousand' || {rest} END)"""


def _letters_sql(t: str) -> str:
    return WS.format(t=f"lower(regexp_replace({t}, '[^a-zA-Z ]', '', 'g'))")


@query(
    "g11_vqa_f1_em",
    f"""WITH a AS (SELECT question_id % 5 = 0 AS yes, gt, pred, n::BIGINT AS n, (question_id * 7919 % 300000)::BIGINT AS big FROM fx_answers),
t AS (SELECT CASE WHEN yes THEN 'yes' ELSE gt || ' ' || {_spell_sql('(n % 10)')} || ' ' || {_spell_sql('big')} || ' cars xd' END AS g,
   pred || ' ' || {_spell_sql('n')} || ' ' || {_spell_sql('(big + n % 3)')} || ' cars x' AS p FROM a),
w AS (SELECT g, {_letters_sql('p')} AS c, {_letters_sql('g')} AS r FROM t),
s AS (SELECT g, c, r, list_distinct(c) AS cs, list_distinct(r) AS rs FROM w),
m AS (SELECT g, c, r, cs, rs,
  len(list_filter(c, lambda x: list_contains(rs, x))) AS tp, len(list_filter(c, lambda x: NOT list_contains(rs, x))) AS fp,
  len(list_filter(r, lambda x: NOT list_contains(cs, x))) AS fn FROM s)
SELECT CASE WHEN lower(g) IN ('yes', 'no') THEN 'closed' ELSE 'open' END AS kind,
  avg(CASE WHEN len(c) = 0 OR len(r) = 0 OR tp = 0 THEN 0.0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) END) AS f1,
  avg(CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_filter(rs, lambda x: list_contains(cs, x))) / len(c) END) AS exact_match, count(*) AS n
FROM m GROUP BY 1""",
)
def g11(spark, sf):
    a = fx_answers(spark, sf).withColumn("big", F.col("question_id") * 7919 % 300000)
    s = lambda c: c.cast("string")
    # numbers of any size, next to marks, and digits inside a word, which stay digits and fall out
    g = F.concat("gt", F.lit(" "), s(F.col("n") % 10), F.lit(", ("), s(F.col("big")), F.lit(" cars) x4d"))
    g = F.when(F.col("question_id") % 5 == 0, F.lit("yes")).otherwise(g)
    p = F.concat("pred", F.lit(" "), s(F.col("n")), F.lit(", "), s(F.col("big") + F.col("n") % 3), F.lit(" cars, x_9"))
    return NG.vqa_f1_em(a.select(p.alias("p"), g.alias("g")), "p", "g")
