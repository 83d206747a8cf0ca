"""Registered queries for message shaping (M01–M19) over conversation samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, explode_turns, fx_answers, fx_media, fx_turns
from weft.operators import messages as M

NL = "chr(10)"
IMG = "'<image>'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def m01_sql(x: str) -> str:
    for tag in ("'<image>'", "'<video>'"):
        x = f"replace(replace(replace({x}, {tag} || {NL}, ''), {NL} || {tag}, ''), {tag}, '')"
    return strip_sql(x)


@query("m01_strip_media_tags", f"SELECT conv_id, turn, role, {m01_sql('value')} AS value FROM fx_turns")
def m01(spark, sf):
    return fx_turns(spark, sf).select("conv_id", "turn", "role", M.strip_media_tags("value").alias("value"))


M02_FIX = f"""CASE WHEN contains(v, {IMG}) THEN
  replace(replace({strip_sql(f"array_to_string(list_transform(string_split(v, {IMG}), lambda ch, i: CASE WHEN i < len(string_split(v, {IMG})) THEN {strip_sql('ch')} || ' ' ELSE {strip_sql('ch')} END), {IMG} || {NL})")},
    {IMG}, {IMG} || {NL}), {IMG} || {NL} || {NL}, {IMG} || {NL})
  ELSE v END"""


@query(
    "m02_normalise_image_tags",
    f"""WITH t AS (
  SELECT conv_id, turn, role,
    CASE WHEN turn = 0 AND NOT bool_or(contains(value, {IMG})) OVER (PARTITION BY conv_id)
         THEN {IMG} || {NL} || value ELSE value END AS v
  FROM fx_turns)
SELECT conv_id, turn, role, {M02_FIX} AS value FROM t""",
)
def m02(spark, sf):
    s = conv_samples(spark, sf).withColumn("turns", M.normalise_image_tags("turns"))
    return explode_turns(s)


M03_K = 3


@query(
    "m03_cap_image_tags",
    f"""WITH t AS (
  SELECT conv_id, turn, role, value, len(string_split(value, {IMG})) - 1 AS c,
    coalesce(sum(len(string_split(value, {IMG})) - 1) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM fx_turns)
SELECT conv_id, turn, role,
  array_to_string(list_transform(string_split(value, {IMG}), lambda p, j:
    CASE WHEN j = 1 THEN p WHEN j - 2 < greatest(0, least(c, {M03_K} - prior)) THEN {IMG} || p ELSE p END), '') AS value
FROM t""",
)
def m03(spark, sf):
    s = conv_samples(spark, sf).withColumn("turns", M.cap_image_tags("turns", M03_K))
    return explode_turns(s)


@query(
    "m04_media_first",
    f"""SELECT t.conv_id, t.turn, t.role,
  CASE WHEN t.turn = 0 THEN repeat({IMG}, CAST(greatest(i.n_img, 1) AS BIGINT) * (i.n_img > 0)::INT) ELSE '' END
    || {m01_sql('t.value')} AS value,
  CASE WHEN t.turn = 0 THEN greatest(i.n_img, 1) * (i.n_img > 0)::INT + 1 ELSE 1 END::BIGINT AS n_parts
FROM fx_turns t JOIN fx_convimg i USING (conv_id)""",
)
def m04(spark, sf):
    s = M.media_first(conv_samples(spark, sf))
    s = s.select("conv_id", F.posexplode("messages").alias("turn", "m"), M.flatten_parts("messages", 8).alias("flat"))
    return s.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.col("m.from").alias("role"),
        F.get(F.col("flat"), F.col("turn"))["value"].alias("value"),
        F.size("m.parts").cast("bigint").alias("n_parts"),
    )


@query(
    "m05_inline_media",
    f"""WITH t AS (
  SELECT conv_id, turn, role, value, string_split(value, {IMG}) AS pieces,
    coalesce(sum(len(string_split(value, {IMG})) - 1) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM fx_turns)
SELECT t.conv_id, t.turn, t.role,
  array_to_string(list_transform(pieces, lambda p, j:
    CASE WHEN j > 1 THEN '[' || coalesce(CASE WHEN prior + j - 1 <= greatest(i.n_img, 1) * (i.n_img > 0)::INT
      THEN t.conv_id::VARCHAR || '_' || (prior + j - 1)::VARCHAR || '.jpg' END, '?') || ']' ELSE '' END || p), '') AS value,
  (len(pieces) - 1 + len(list_filter(list_transform(pieces, lambda p, j: p <> '' OR j = len(pieces)), lambda b: b)))::BIGINT AS n_parts,
  i.n_tags <> greatest(i.n_img, 1) * (i.n_img > 0)::INT AS bad
FROM t JOIN fx_convimg i USING (conv_id)""",
)
def m05(spark, sf):
    s = M.inline_media(conv_samples(spark, sf))
    s = s.select("conv_id", "error", F.posexplode("messages").alias("turn", "m"))
    render = F.array_join(
        F.transform("m.parts", lambda p: F.coalesce(p["text"], F.concat(F.lit("["), F.coalesce(p["path"], F.lit("?")), F.lit("]")))),
        "",
    )
    return s.select(
        "conv_id",
        F.col("turn").cast("bigint").alias("turn"),
        F.col("m.from").alias("role"),
        render.alias("value"),
        F.size("m.parts").cast("bigint").alias("n_parts"),
        F.col("error").isNotNull().alias("bad"),
    )


@query(
    "m07_inline_numbered_media",
    r"""WITH t AS (
  SELECT conv_id, turn, role, regexp_replace(value, '<image>', '<image-' || ((conv_id % 3) + 1)::VARCHAR || '>', 'g') AS v
  FROM fx_turns),
r AS (SELECT conv_id, list_distinct(flatten(list(regexp_extract_all(v, '<image-(\d+)>', 1)))) AS refs FROM t GROUP BY conv_id)
SELECT t.conv_id, t.turn, regexp_replace(t.v, '<image-\d+>', '<image>', 'g') AS value,
  NOT list_contains(r.refs, '1') OR NOT list_contains(r.refs, '2') AS bad
FROM t JOIN r USING (conv_id)""",
)
def m07(spark, sf):
    s = conv_samples(spark, sf)
    numbered = F.concat(F.lit("<image-"), ((F.col("conv_id") % 3) + 1).cast("string"), F.lit(">"))
    s = s.withColumn(
        "turns",
        F.transform("turns", lambda t: F.struct(t["from"].alias("from"), F.replace(t["value"], F.lit("<image>"), numbered).alias("value"))),
    ).withColumn("n_images", F.lit(2))
    s = M.inline_numbered_media(s)
    out = s.select("conv_id", "error", F.posexplode("turns").alias("turn", "t"))
    return out.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("t.value").alias("value"), F.col("error").isNotNull().alias("bad")
    )


@query(
    "m10_expand_tile_tags",
    f"""WITH m AS (SELECT media_id, [1 + width % 4, 1 + height % 3] AS tiles,
  CASE WHEN media_id % 4 = 0 THEN 'no images here <image> at all'
       ELSE 'look <image> and <image> then <image> end' END AS prompt FROM fx_media)
SELECT media_id,
  CASE WHEN media_id % 4 = 0 THEN replace(prompt, {IMG}, '')
  ELSE array_to_string(list_transform(string_split(prompt, {IMG}), lambda p, j:
     p || CASE WHEN j <= 2 THEN repeat({IMG} || {NL}, tiles[j]) ELSE '' END), '') END AS text
FROM m""",
)
def m10(spark, sf):
    m = fx_media(spark, sf)
    tiles = F.when(F.col("media_id") % 4 == 0, F.array().cast("array<int>")).otherwise(
        F.array((1 + F.col("width") % 4).cast("int"), (1 + F.col("height") % 3).cast("int"))
    )
    prompt = F.when(F.col("media_id") % 4 == 0, F.lit("no images here <image> at all")).otherwise(
        F.lit("look <image> and <image> then <image> end")
    )
    return m.select("media_id", M.expand_tile_tags(prompt, tiles).alias("text"))


SYSTEMS = ["You are a careful assistant.", "Answer briefly.", "Describe the image."]


@query(
    "m11_with_system",
    f"""SELECT conv_id, 0::BIGINT AS turn, 'system' AS role,
  (['You are a careful assistant.', 'Answer briefly.', 'Describe the image.'])[
     (('0x' || substr(md5('42|' || CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT % 3) + 1] AS value
FROM (SELECT DISTINCT conv_id FROM fx_turns)
UNION ALL SELECT conv_id, turn + 1, role, value FROM fx_turns""",
)
def m11(spark, sf):
    return explode_turns(M.with_system(conv_samples(spark, sf), SYSTEMS, seed=42, key="sample_id"))


def _render_sql(style: str) -> str:
    tpl = M.TEMPLATES[style]
    r0, r1 = (repr_sql(x) for x in tpl["roles"])
    sep, sep2 = repr_sql(tpl["sep"]), repr_sql(tpl["sep2"] or "")
    role = f"CASE WHEN role = 'human' THEN {r0} ELSE {r1} END"
    if tpl["style"] == "TWO":
        piece = f"{role} || ': ' || value || CASE WHEN turn % 2 = 0 THEN {sep} ELSE {sep2} END"
    elif tpl["style"] == "LLAMA_3":
        piece = f"{role} || value || CASE WHEN turn < n - 1 THEN {sep} ELSE {sep2} END"
    else:
        piece = f"{role} || value || {sep}"
    head = repr_sql(tpl["system"] + tpl["sep"])
    return f"""WITH t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM fx_turns)
SELECT conv_id, {head} || string_agg({piece}, '' ORDER BY turn) AS text FROM t GROUP BY conv_id"""


def repr_sql(s: str) -> str:
    """A DuckDB string expression for a Python string (newlines via chr(10))."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


for _style in ("vicuna_v1", "llama_3", "hermes-2"):

    def _mk(style):
        def run(spark, sf):
            return conv_samples(spark, sf).select("conv_id", M.render_chat("turns", style).alias("text"))

        return run

    query(f"m12_render_chat_{_style.replace('-', '_')}", _render_sql(_style))(_mk(_style))


@query(
    "m12_render_chat_plain",
    rf"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '<image>' || chr(10) || regexp_replace(replace(value, '<image>', ''), '^\s+|\s+$', '', 'g')
  ELSE value END || CASE WHEN turn % 2 = 0 THEN chr(10) ELSE '' END AS piece FROM fx_turns)
SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM t GROUP BY conv_id""",
)
def m12_plain(spark, sf):
    return conv_samples(spark, sf).select("conv_id", M.render_chat("turns", "plain", media_first=True).alias("text"))


@query(
    "m14_to_chatml",
    f"""WITH ok AS (SELECT conv_id FROM fx_turns GROUP BY conv_id HAVING bool_and(role IN ('human', 'gpt')))
SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN role = 'gpt' AND turn % 4 = 1 THEN value ELSE value END AS content
FROM fx_turns WHERE conv_id IN (SELECT conv_id FROM ok)""",
)
def m14(spark, sf):
    s = conv_samples(spark, sf)
    s = s.filter(F.forall("turns", lambda t: t["from"].isin("human", "gpt")))
    s = s.select("conv_id", F.posexplode(M.to_chatml("turns")).alias("turn", "m"))
    return s.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@query(
    "m15_format_by_schema",
    f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END AS role, text AS value
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, {repr_sql(M.TEMPLATES['hermes-2']['system'] + M.TEMPLATES['hermes-2']['sep'])} ||
  string_agg(CASE WHEN role = 'human' THEN {repr_sql('<|im_start|>user' + chr(10))} ELSE {repr_sql('<|im_start|>assistant' + chr(10))} END
  || value || '<|im_end|>', '' ORDER BY turn) AS text FROM t GROUP BY conv_id""",
)
def m15(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").filter(F.col("role").isin("user", "assistant"))
    msgs = c.groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")),
        ).alias("messages")
    )
    return M.format_by_schema(msgs, "hermes-2").select("conv_id", "text")


@query(
    "m16_plain_pair",
    f"""WITH s AS (SELECT conv_id, count(*) AS n, max(CASE WHEN turn = 1 THEN value END) AS v1,
    bool_or(turn = 0 AND contains(value, {IMG})) AS tag0 FROM fx_turns WHERE turn < 2 OR conv_id % 2 = 0 GROUP BY conv_id)
SELECT conv_id, CASE WHEN n = 2 AND tag0 THEN {IMG} || v1 || {NL} END AS text, NOT (n = 2 AND tag0) AS bad FROM s""",
)
def m16(spark, sf):
    s = conv_samples(spark, sf)
    s = s.withColumn("turns", F.when(F.col("conv_id") % 2 == 0, F.col("turns")).otherwise(F.slice("turns", 1, 2)))
    return M.plain_pair(s).select("conv_id", "text", F.col("error").isNotNull().alias("bad"))


@query(
    "m17_mc_prompt",
    r"""WITH q AS (SELECT question_id, 'Which part is ' || category || '?' AS question,
   [pred, gt, category] AS options FROM fx_answers)
SELECT question_id,
  question || array_to_string(list_transform(options, lambda o, i: chr(10) || '- ' || chr((64 + i)::INTEGER) || ') ' || o), '') AS dash,
  question || chr(10) || array_to_string(list_transform(options, lambda o, i: chr((64 + i)::INTEGER) || '. ' || o || chr(10)), '')
    || 'Answer with the option''s letter from the given choices directly.' AS lettered
FROM q""",
)
def m17(spark, sf):
    a = fx_answers(spark, sf)
    q = F.concat(F.lit("Which part is "), F.col("category"), F.lit("?"))
    opts = F.array("pred", "gt", "category")
    return a.select("question_id", M.mc_prompt(q, opts, "dash").alias("dash"), M.mc_prompt(q, opts, "lettered").alias("lettered"))


@query(
    "m18_split_prompt",
    rf"""WITH p AS (SELECT conv_id, turn, string_split(value, '<image>' || chr(10)) AS pieces FROM fx_turns)
SELECT conv_id, turn, array_to_string(flatten(list_transform(pieces, lambda x, i:
  CASE WHEN {strip_sql('x')} <> '' THEN [{strip_sql('x')}] ELSE [] END ||
  CASE WHEN i <= 1 THEN ['[img]'] ELSE [] END)), '|') AS parts FROM p""",
)
def m18(spark, sf):
    t = fx_turns(spark, sf)
    parts = M.split_prompt("value", F.array(F.lit("[img]")))
    return t.select(
        "conv_id", "turn", F.array_join(F.transform(parts, lambda p: p["value"]), "|").alias("parts")
    )


@query(
    "m19_route_turns",
    f"""WITH tasks AS (SELECT * FROM (VALUES ('t_et', 'et'), ('t_en', 'en'), ('t_de', 'de')) v(task, prefix)),
t AS (SELECT conv_id, turn, role, value, lead(role) OVER w AS nrole, lead(value) OVER w AS nvalue
  FROM fx_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT CAST(conv_id AS VARCHAR) AS sample_id, task, turn, value AS question,
  CASE WHEN nrole = 'gpt' THEN nvalue END AS ground_truth
FROM t JOIN tasks ON starts_with(lower(replace(value, {IMG} || {NL}, '')), prefix) WHERE role = 'human'""",
)
def m19(spark, sf):
    tasks = spark.createDataFrame([("t_et", "et"), ("t_en", "en"), ("t_de", "de")], "task string, prefix string")
    out = M.route_turns(conv_samples(spark, sf), tasks)
    return out.withColumn("turn", F.col("turn").cast("bigint"))


@query(
    "m06_frames_first",
    rf"""WITH f AS (SELECT conv_id, conv_id % 5 AS n FROM (SELECT DISTINCT conv_id FROM fx_turns))
SELECT t.conv_id, CASE WHEN t.turn = 0 THEN f.n + 1 ELSE 1 END::BIGINT AS n_parts,
  CASE WHEN t.turn = 0 THEN regexp_replace(replace(t.value, '<image>', ''), '^\s+|\s+$', '', 'g') ELSE t.value END AS text, t.turn,
  f.n = 0 AS bad FROM fx_turns t JOIN f USING (conv_id)""",
)
def m06(spark, sf):
    s = conv_samples(spark, sf).withColumn("video", F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    n = F.col("conv_id") % 5
    idx = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<bigint>"))
    frames = s.select("video", F.explode(idx).alias("i")).select(
        "video", F.format_string("frames/%s/%03d.jpeg", F.col("video"), F.col("i")).alias("path")
    )
    out = M.frames_first(s, frames)
    ex = out.select("conv_id", "error", F.posexplode("messages").alias("turn", "m"))
    return ex.select(
        "conv_id",
        F.size("m.parts").cast("bigint").alias("n_parts"),
        F.element_at("m.parts", -1)["text"].alias("text"),
        F.col("turn").cast("bigint").alias("turn"),
        F.col("error").isNotNull().alias("bad"),
    )
