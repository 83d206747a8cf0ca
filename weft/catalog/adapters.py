"""Registered queries for dataset adapters (A*), compared as flat ``from:value`` text."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import fx_boxes, fx_recap, fx_turns, table
from weft.operators import adapters as AD
from weft.operators.windows import linspace_sample

NL = "chr(10)"


def _sq(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


@query(
    "a01_messages_samples",
    f"""SELECT CAST(conv_id AS VARCHAR) AS sample_id,
  string_agg(CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END || ':' ||
    replace(CASE WHEN turn = 0 THEN '<|image|>' || text ELSE text END, '<|image|>', '<image>' || {NL}), {NL} ORDER BY turn) AS text,
  1::BIGINT AS n_images FROM conversations GROUP BY conv_id""",
)
def a01(spark, sf):
    c = table(spark, sf, "conversations")
    content = F.when(F.col("turn") == 0, F.concat(F.lit("<|image|>"), "text")).otherwise(F.col("text"))
    g = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    ).withColumn("image", F.array(F.concat(F.col("conv_id").cast("string"), F.lit("_a.jpg")), F.concat(F.col("conv_id").cast("string"), F.lit("_b.jpg"))))
    s = AD.messages_samples(g, "docreason", "conv_id")
    return s.select("sample_id", AD.turns_text().alias("text"), F.size("images").cast("bigint").alias("n_images"))


@query(
    "a02_query_response",
    f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'human:' || source || ' question' || {NL} || 'gpt:' || text AS text, lang AS question_type FROM documents",
)
def a02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit(" question")).alias("query"), F.col("text").alias("response"), F.col("lang").alias("type"))
    s = AD.query_response_samples(d, "metamathqa", "doc_id")
    return s.select("sample_id", AD.turns_text().alias("text"), F.col("extras")["question_type"].alias("question_type"))


@query(
    "a03_parallel_qa",
    f"""SELECT CAST(user_id AS VARCHAR) AS sample_id, string_agg(CASE WHEN rn = 1 THEN 'human:<image>' || {NL} ELSE 'human:' END
  || event_type || {NL} || 'gpt:' || event_id::VARCHAR, {NL} ORDER BY event_id) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) GROUP BY user_id""",
)
def a03(spark, sf):
    e = table(spark, sf, "events")
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("_l"))
    g = g.select("user_id", F.transform("_l", lambda x: x["event_type"]).alias("Questions"), F.transform("_l", lambda x: x["event_id"]).alias("Answers"))
    s = AD.parallel_qa_samples(g, "kvqa", "user_id")
    return s.select("sample_id", AD.turns_text().alias("text"))


@query(
    "a04_instruction",
    f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'human:Summarise: ' || source || {NL} || 'gpt:' || lang AS text FROM documents",
)
def a04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.lit("Summarise: ").alias("instruction"), F.col("source").alias("inputs"), F.col("lang").alias("outputs"))
    return AD.instruction_samples(d, "m3it", "doc_id").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a06_chart_query",
    f"""SELECT replace(p_name, ' ', '_') || p_partkey::VARCHAR AS sample_id,
  'human:<image>' || {NL} || ' ' || trim(replace('<opencqa> ' || p_type || ' ', '<opencqa>', '')) || {NL} || 'gpt:' || p_brand AS text FROM part""",
)
def a06(spark, sf):
    p = table(spark, sf, "part").select(
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"), F.lit(".png")).alias("imgname"),
        F.concat(F.lit("<opencqa> "), "p_type", F.lit(" ")).alias("query"),
        F.col("p_brand").alias("label"),
    )
    return AD.chart_query_samples(p, "unichart").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a08_multi_image_texts",
    f"""WITH p AS (SELECT conv_id, turn // 2 AS k, max(CASE WHEN turn % 2 = 0 THEN text END) AS u,
   max(CASE WHEN turn % 2 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'Answer: ' || text ELSE text END END) AS a FROM conversations GROUP BY conv_id, turn // 2)
SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg('human:' || CASE WHEN k = 0 THEN repeat('<image>' || {NL}, (conv_id % 3)::BIGINT) ELSE '' END || u
  || CASE WHEN a IS NULL THEN '' ELSE {NL} || 'gpt:' || CASE WHEN starts_with(a, 'Answer: ') THEN replace(a, 'Answer: ', '') ELSE a END END, {NL} ORDER BY k) AS text,
  (conv_id % 3)::BIGINT AS n_images FROM p GROUP BY conv_id""",
)
def a08(spark, sf):
    c = table(spark, sf, "conversations")
    a_text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Answer: "), "text")).otherwise(F.col("text"))
    pairs = c.groupBy("conv_id", (F.col("turn") / 2).cast("bigint").alias("k")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("user"), F.max(F.when(F.col("turn") % 2 == 1, a_text)).alias("assistant")
    )
    g = pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "user", "assistant"))), lambda x: F.struct(x["user"].alias("user"), x["assistant"].alias("assistant"))).alias("texts"))
    g = g.withColumn("n_images", (F.col("conv_id") % 3).cast("int"))
    s = AD.multi_image_texts_samples(g, "idefics2", "conv_id")
    return s.select("sample_id", AD.turns_text().alias("text"), F.size("images").cast("bigint").alias("n_images"))


ART_SQL = f"""SELECT CAST(p_partkey AS VARCHAR) AS sample_id, {_sq('human:' + AD.ART_FIRST)} || {NL} || 'gpt:' || p_name || '.'
  || {NL} || 'human:Who is the author of the painting?' || {NL} || 'gpt:' || p_brand || '.'
  || CASE WHEN p_size % 2 = 0 THEN {NL} || 'human:What is the genre of the painting?' || {NL} || 'gpt:' || p_type || '.' ELSE '' END
  || CASE WHEN p_size % 3 = 0 THEN {NL} || 'human:What is the style of the painting?' || {NL} || 'gpt:modern.' ELSE '' END AS text
FROM part WHERE p_partkey % 13 <> 0"""


@query("a10_artwork", ART_SQL)
def a10(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 13 == 0, F.lit("")).otherwise(F.col("p_name")).alias("painting_name"),
        F.col("p_brand").alias("author"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("")).alias("genre"),
        F.when(F.col("p_size") % 3 == 0, F.lit("modern")).otherwise(F.lit("")).alias("style"),
        F.concat(F.lit("art/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("path"),
    )
    return AD.artwork_samples(p, "art", "p_partkey").select("sample_id", AD.turns_text().alias("text"))


def _entity_q(code: str) -> str:
    return f"'human:' || CASE WHEN {{first}} THEN '<image>' || {NL} ELSE '' END || 'what is the value for {AD.ENTITY_NAMES[code]}? Answer this question using the text in the image directly.'"


@query(
    "a12_entity_samples",
    f"""SELECT CAST(event_id AS VARCHAR) AS sample_id,
  {_entity_q('SS').format(first='true')} || {NL} || 'gpt:' || user_id::VARCHAR || {NL} ||
  {_entity_q('SO-D').format(first='false')} || {NL} || 'gpt:' || event_id::VARCHAR AS text
FROM events WHERE event_id % 10 <> 0""",
)
def a12(spark, sf):
    e = table(spark, sf, "events")
    ent = F.when(F.col("event_id") % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("SS"), F.col("user_id").cast("string"), F.lit("SO-D"), F.col("event_id").cast("string"))
    )
    d = e.select(ent.alias("entity_dict"), F.concat(F.lit("poie/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("file_name"))
    return AD.entity_samples(d, "poie").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a13_receipt_samples",
    f"""SELECT 'r' || event_id::VARCHAR || '.company' AS sample_id, 'human:<image>' || {NL} || {_sq(AD.RECEIPT_QUESTIONS['company'])} || {NL} || 'gpt:' || event_type AS text FROM events
UNION ALL SELECT 'r' || event_id::VARCHAR || '.total', 'human:<image>' || {NL} || {_sq(AD.RECEIPT_QUESTIONS['total'])} || {NL} || 'gpt:' || user_id::VARCHAR FROM events""",
)
def a13(spark, sf):
    e = table(spark, sf, "events")
    d = e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.create_map(F.lit("company"), F.col("event_type"), F.lit("total"), F.col("user_id").cast("string")).alias("fields"),
    )
    return AD.receipt_samples(d, "sroie").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a16_flan_samples",
    f"""WITH n AS (SELECT count(*) AS n FROM documents),
i AS (SELECT r.i AS sample_idx, CASE WHEN r.i = 36 THEN n.n - 1 ELSE floor(r.i * ((n.n - 1) / 36.0)) END AS row_id FROM range(37) r(i), n)
SELECT printf('text_flan_%08d', sample_idx) AS sample_id, 'human:' || source || {NL} || 'gpt:' || lang AS text FROM i JOIN documents d ON d.doc_id = i.row_id""",
)
def a16(spark, sf):
    d = table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))
    s = linspace_sample(d, 37)
    return AD.flan_samples(s, "flan", "source", "lang").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a17_generic_samples",
    f"""SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'human:' || source || {NL} || 'gpt:' || lang AS text,
  CASE WHEN doc_id % 2 = 0 THEN 'm' || doc_id::VARCHAR || '.mp4' ELSE 'i' || doc_id::VARCHAR || '.jpg' END AS media FROM documents""",
)
def a17(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("http://x/y/m"), F.col("doc_id").cast("string"), F.lit(".mp4"))).alias("media"),
        F.concat(F.lit("/data/i"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"),
        F.col("source").alias("question"),
        F.col("lang").alias("answer"),
    )
    s = AD.generic_samples(d, "hf", "doc_id")
    return s.select("sample_id", AD.turns_text().alias("text"), F.col("images")[0].alias("media"))


@query(
    "a27_ocr_reading",
    f"""SELECT CAST(img_id AS VARCHAR) AS sample_id, {_sq('human:' + AD.OCR_READ_PROMPT)} || {NL} || 'gpt:' || string_agg('w' || k::VARCHAR, ' ' ORDER BY idx) AS text
FROM fx_boxes GROUP BY img_id""",
)
def a27(spark, sf):
    b = fx_boxes(spark, sf)
    g = b.groupBy("img_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat(F.lit("w"), F.col("k").cast("string")).alias("w")))), lambda x: x["w"]).alias("words"))
    return AD.ocr_reading_samples(g, "textocr", "img_id").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a28_preference_prompt",
    rf"""SELECT conv_id, turn, repeat('<image>' || {NL}, turn % 4) || regexp_replace(replace(CASE WHEN turn % 2 = 1 THEN '<video> ' || value ELSE value END, '<video>', ''), '^\s+|\s+$', '', 'g') AS prompt
FROM fx_turns""",
)
def a28(spark, sf):
    t = fx_turns(spark, sf)
    p = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("<video> "), "value")).otherwise(F.col("value"))
    return t.select("conv_id", "turn", AD.preference_prompt(p, (F.col("turn") % 4).cast("int")).alias("prompt"))


@query(
    "a29_clip_caption",
    f"""SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, 'human:<image>' || {NL} || {NL} || 'gpt:' || coalesce(r.caption, 'Describe the video.') AS text
FROM documents d LEFT JOIN fx_recap r USING (doc_id)""",
)
def a29(spark, sf):
    clips = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("v"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video"))
    return AD.clip_caption_samples(clips, fx_recap(spark, sf), "doc_id", "panda70m").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a25_caption_samples",
    f"SELECT CAST(doc_id AS VARCHAR) AS sample_id, 'human:<image>' || {NL} || {NL} || 'gpt:' || replace(text, '<image>', '<IMAGE>') AS text FROM documents",
)
def a25(spark, sf):
    d = table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))
    return AD.caption_samples(d, "captions").select("sample_id", AD.turns_text().alias("text"))


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tpl_sql(templates, idx_sql: str, value_sql: str) -> str:
    pre = "[" + ", ".join(_q(t.split("{}")[0]) for t in templates) + "]"
    post = "[" + ", ".join(_q(t.split("{}")[1]) for t in templates) + "]"
    return f"({pre})[{idx_sql} + 1] || {value_sql} || ({post})[{idx_sql} + 1]"


HK = "('0x' || substr(md5('42|' || {k}), 1, 8))::BIGINT"
BOX_SQL = ("printf('[%03d,%03d,%03d,%03d]', least(greatest(trunc(x1 / 1000 * 1000), 0), 999)::BIGINT, least(greatest(trunc(y1 / 800 * 1000), 0), 999)::BIGINT, "
           "least(greatest(trunc(x2 / 1000 * 1000), 0), 999)::BIGINT, least(greatest(trunc(y2 / 800 * 1000), 0), 999)::BIGINT)")


@query(
    "a14_ocr_grounding",
    f"""WITH a AS (SELECT img_id, idx, {BOX_SQL} AS box, 'w' || k::VARCHAR AS tr, img_id::VARCHAR || '|' || idx::VARCHAR AS kk FROM fx_boxes WHERE NOT ignored),
b AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY idx) AS rn, {HK.format(k="kk || '|dir'")} % 2 = 0 AS box_first,
   {HK.format(k="kk || '|tpl'")} % 5 AS t FROM a)
SELECT CAST(img_id AS VARCHAR) AS sample_id, string_agg('human:' || CASE WHEN rn = 1 THEN '<image>' || {NL} ELSE '' END ||
  CASE WHEN box_first THEN {_tpl_sql(AD.OCR_BOX_PROMPTS, 't', 'box')} || {NL} || 'gpt:' || tr
       ELSE {_tpl_sql(AD.OCR_TEXT_PROMPTS, 't', 'tr')} || {NL} || 'gpt:' || box END, {NL} ORDER BY idx) AS text
FROM b GROUP BY img_id""",
)
def a14(spark, sf):
    from weft.functions.boxes import polygon_box_text

    b = fx_boxes(spark, sf)
    pts = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    ann = F.struct("idx", polygon_box_text(pts, "w", "h").alias("box"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("transcription"),
                   F.col("ignored").alias("illegible"))
    g = b.groupBy("img_id").agg(F.array_sort(F.collect_list(ann)).alias("anns"))
    return AD.ocr_grounding_samples(g, "art", "img_id").select("sample_id", AD.turns_text().alias("text"))


def _events(spark, sf):
    from weft.fixtures import fx_spans

    s = fx_spans(spark, sf)
    ev = F.struct("qid", F.col("s").alias("start"), F.col("e").alias("end"),
                  F.concat("category", F.lit(" event "), F.col("qid").cast("string"), F.lit(".")).alias("sentence"))
    return s.groupBy("vid", "duration").agg(F.array_sort(F.collect_list(ev)).alias("events")).withColumn(
        "video", F.concat(F.lit("v"), F.col("vid").cast("string"), F.lit(".mp4"))
    )


def _tok_sql(x: str) -> str:
    return f"'<t' || round_even({x} / duration * 99, 0)::BIGINT::VARCHAR || '>'"


@query(
    "a20_dense_captions",
    f"""SELECT CAST(vid AS VARCHAR) AS sample_id, 'human:' || ([{', '.join(_q(p) for p in AD.DVC_TASK_PROMPTS)}])[{HK.format(k="vid::VARCHAR || '|task'")} % 4 + 1]
  || ' ' || ([{', '.join(_q(p) for p in AD.DVC_TIME_PROMPTS)}])[{HK.format(k="vid::VARCHAR || '|time'")} % 3 + 1] || {NL} || 'gpt:' ||
  string_agg({_tok_sql('s')} || ' ' || {_tok_sql('e')} || ' ' || category || ' event ' || qid::VARCHAR || '.', ' ' ORDER BY qid) AS text
FROM fx_spans GROUP BY vid, duration""",
)
def a20(spark, sf):
    return AD.dense_caption_samples(_events(spark, sf), "dvc", "vid").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a21_event_localisation",
    f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY vid) AS n FROM fx_spans)
SELECT CAST(vid AS VARCHAR) AS sample_id, 'human:' ||
  ([{', '.join(_q(p.split('{event}')[0]) for p in AD.EL_TASK_PROMPTS)}])[{HK.format(k="vid::VARCHAR || '|task'")} % 4 + 1] ||
  lower(substr(category, 1, 1)) || substr(category, 2) || ' event ' || qid::VARCHAR ||
  ([{', '.join(_q(p.split('{event}')[1]) for p in AD.EL_TASK_PROMPTS)}])[{HK.format(k="vid::VARCHAR || '|task'")} % 4 + 1] || ' ' ||
  ([{', '.join(_q(p) for p in AD.EL_TIME_PROMPTS)}])[{HK.format(k="vid::VARCHAR || '|time'")} % 3 + 1] || {NL} || 'gpt:' ||
  {_tok_sql('s')} || ' ' || {_tok_sql('e')} AS text
FROM e WHERE i = {HK.format(k="vid::VARCHAR")} % n""",
)
def a21(spark, sf):
    return AD.event_localisation_samples(_events(spark, sf), "el", "vid").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a09_conversation_samples",
    f"""SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg(role || ':' || value, {NL} ORDER BY turn) AS text,
  CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS n_images FROM fx_turns GROUP BY conv_id""",
)
def a09(spark, sf):
    from weft.fixtures import conv_samples

    s = conv_samples(spark, sf).withColumn("image", F.when(F.col("conv_id") % 2 == 0, F.lit("img.jpg")))
    out = AD.conversation_samples(s, "onevision", "conv_id")
    return out.select("sample_id", AD.turns_text().alias("text"), F.size("images").cast("bigint").alias("n_images"))


PAIRS_SQL = """(SELECT conv_id, turn // 2 AS k, max(CASE WHEN turn % 2 = 0 THEN text END) AS q, max(CASE WHEN turn % 2 = 1 THEN text END) AS a
  FROM conversations GROUP BY conv_id, turn // 2)"""


def _pairs(spark, sf, q="question", a="answer"):
    c = table(spark, sf, "conversations")
    p = c.groupBy("conv_id", (F.col("turn") / 2).cast("bigint").alias("k")).agg(
        F.max(F.when(F.col("turn") % 2 == 0, F.col("text"))).alias(q), F.coalesce(F.max(F.when(F.col("turn") % 2 == 1, F.col("text"))), F.lit("")).alias(a)
    )
    return p.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", q, a))), lambda x: F.struct(x[q].alias(q), x[a].alias(a))).alias("_l"))


@query(
    "a11_annotation_list",
    f"""SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg('human:' || CASE WHEN k = 0 THEN '<image>' || {NL} ELSE '' END || q || {NL} || 'gpt:' || coalesce(a, ''), {NL} ORDER BY k) AS text
FROM {PAIRS_SQL} GROUP BY conv_id""",
)
def a11(spark, sf):
    g = _pairs(spark, sf).withColumnRenamed("_l", "annotation")
    return AD.annotation_list_samples(g, "estvqa", "conv_id").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a18_texts_samples",
    f"""SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg('human:' || q || {NL} || 'gpt:' || coalesce(a, ''), {NL} ORDER BY k) AS text
FROM {PAIRS_SQL} GROUP BY conv_id""",
)
def a18(spark, sf):
    g = _pairs(spark, sf, "user", "assistant").withColumnRenamed("_l", "texts")
    return AD.texts_samples(g, "hf_parquet", "conv_id").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a19_role_mapped_video",
    f"""SELECT CAST(conv_id AS VARCHAR) AS sample_id, string_agg(CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END || ':' || text, {NL} ORDER BY turn) AS text,
  'v' || conv_id::VARCHAR || '.mp4' AS video, ((conv_id % 4 + 1) * 8)::VARCHAR AS num_frames FROM conversations GROUP BY conv_id""",
)
def a19(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))), lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations")
    ).withColumn("video", F.concat(F.lit("v"), F.col("conv_id").cast("string"), F.lit(".mp4"))).withColumn("num_frames", (F.col("conv_id") % 4 + 1) * 8)
    s = AD.role_mapped_video_samples(g, "my_video", "conv_id")
    return s.select("sample_id", AD.turns_text().alias("text"), "video", F.col("extras")["num_frames"].alias("num_frames"))


def _qa_videos(spark, sf):
    from weft.fixtures import fx_spans

    s = fx_spans(spark, sf)
    qa = F.struct(
        F.concat(F.lit(" When does the "), F.col("category"), F.lit(" happen? ")).alias("q"),
        F.concat(F.lit(" From <"), F.col("s").cast("string"), F.lit("> to <"), F.col("e").cast("string"), F.lit(">. ")).alias("a"),
        F.col("qid").alias("qid"),
    )
    g = s.groupBy("vid", "duration").agg(F.array_sort(F.collect_list(F.struct(F.col("qid").alias("o"), qa.alias("x")))).alias("_l"))
    return g.select("vid", "duration", F.transform("_l", lambda x: F.struct(x["x"]["q"].alias("q"), x["x"]["a"].alias("a"))).alias("QA"),
                    F.concat(F.lit("v"), F.col("vid").cast("string"), F.lit(".mp4")).alias("video"))


@query(
    "a22_temporal_qa",
    f"""SELECT CAST(vid AS VARCHAR) || '_' || (row_number() OVER (PARTITION BY vid ORDER BY qid) - 1)::VARCHAR AS sample_id,
  'human:When does the ' || category || ' happen?' || {NL} || 'gpt:From ' || {_tok_sql('s')} || ' to ' || {_tok_sql('e')} || '.' AS text FROM fx_spans""",
)
def a22(spark, sf):
    return AD.temporal_qa_samples(_qa_videos(spark, sf), "rtl", "vid").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a23_video_qa",
    f"""SELECT CAST(vid AS VARCHAR) AS sample_id, string_agg('human:When does the ' || category || ' happen?' || {NL} || 'Answer briefly.' || {NL} ||
  'gpt:From <' || s::VARCHAR || '> to <' || e::VARCHAR || '>.', {NL} ORDER BY qid) AS text FROM fx_spans GROUP BY vid""",
)
def a23(spark, sf):
    return AD.video_qa_samples(_qa_videos(spark, sf), "videoqa", "vid", task_prompt=" Answer briefly. ").select("sample_id", AD.turns_text().alias("text"))


@query(
    "a26_interleaved_text",
    r"""WITH c AS (SELECT conv_id, list(replace(text, '<image>', '<IMAGE>') ORDER BY turn) AS s, count(*) AS n,
   list((turn * 7 + conv_id) ORDER BY turn) FILTER (WHERE turn % 3 = 0) AS raw FROM conversations GROUP BY conv_id),
i AS (SELECT conv_id, s, list_transform(raw[1:6], lambda v: v % n) AS ixs FROM c)
SELECT conv_id, replace(replace(array_to_string(list_transform(s, lambda x, j: repeat('<image>' || chr(10), len(list_filter(ixs, lambda v: v = j - 1))) || x), ' '),
  '<image> ', '<image>'), ' <image>', '<image>') || '</s>' AS text, len(ixs)::BIGINT AS n_images FROM i""",
)
def a26(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("sentences"),
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 3 == 0, F.struct("turn", (F.col("turn") * 7 + F.col("conv_id")).alias("m"))))), lambda x: x["m"]).alias("raw"),
    )
    g = g.withColumn("matched", F.transform("raw", lambda v: v % F.col("n")))
    return g.select("conv_id", AD.interleaved_text("sentences", "matched").alias("text"), F.size(F.slice("matched", 1, 6)).cast("bigint").alias("n_images"))


@query(
    "a05_vqa_pair",
    f"""SELECT CAST(question_id AS VARCHAR) AS sample_id, 'human:<image>' || {NL} || 'What is ' || pred || '?' || {NL} || 'gpt:' || gt AS text,
  'vqa/' || question_id::VARCHAR || '.jpg' AS media FROM fx_answers""",
)
def a05(spark, sf):
    from weft.fixtures import fx_answers

    a = fx_answers(spark, sf).select(
        "question_id", F.concat(F.lit("What is "), "pred", F.lit("?")).alias("question"), F.col("gt").alias("answer"),
        F.concat(F.lit("vqa/"), F.col("question_id").cast("string"), F.lit(".jpg")).alias("image_path"),
    )
    s = AD.vqa_pair_samples(a, "viquae", "question_id")
    return s.select("sample_id", AD.turns_text().alias("text"), F.col("images")[0].alias("media"))


@query(
    "a07_chart_qa",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS sample_id, 'human:<image>' || {NL} || p_type || {NL} || 'gpt:' || p_brand AS text,
  octet_length(encode(p_name)) AS nbytes FROM part""",
)
def a07(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("query"), F.col("p_brand").alias("label"), F.encode("p_name", "UTF-8").alias("image"))
    s = AD.chart_qa_samples(p, "unichart_sft", "p_partkey")
    return s.select("sample_id", AD.turns_text().alias("text"), F.octet_length("media_bytes").cast("bigint").alias("nbytes"))


def _qlist(xs) -> str:
    return "[" + ", ".join(_q(x) for x in xs) + "]"


@query(
    "a15_ocr_full_image",
    f"""WITH l AS (SELECT img_id, idx, CASE WHEN k % 11 = 0 THEN 'x###' ELSE 'w' || k::VARCHAR END AS tr,
   printf('%03d,%03d,%03d,%03d', least(greatest(trunc(least(x1, x2) * 1000 / 1000), 0), 999)::BIGINT, least(greatest(trunc(least(y1, y2) * 1000 / 800), 0), 999)::BIGINT,
     least(greatest(trunc(greatest(x1, x2) * 1000 / 1000), 0), 999)::BIGINT, least(greatest(trunc(greatest(y1, y2) * 1000 / 800), 0), 999)::BIGINT) AS box FROM fx_boxes),
k AS (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY idx) - 1 AS i FROM l WHERE NOT contains(tr, '###')),
img AS (SELECT DISTINCT img_id, img_id::VARCHAR AS kk FROM fx_boxes),
m AS (SELECT img_id, kk, {HK.format(k="kk || '|mode'")} % 3 AS mode FROM img),
agg AS (SELECT img_id, string_agg('Inside bounding box: [' || box || '], The text is: ' || tr || chr(10), '' ORDER BY idx) AS answer,
   string_agg(tr, ' ' ORDER BY idx) AS texts,
   string_agg('human:' || CASE WHEN i = 0 THEN '<image>' || {NL} ELSE '' END ||
     ({_qlist([p.split('{}')[0] for p in AD.OCR_BOX4_PROMPTS])})[{HK.format(k="img_id::VARCHAR || '|b' || i::VARCHAR")} % 5 + 1] || box ||
     ({_qlist([p.split('{}')[1] for p in AD.OCR_BOX4_PROMPTS])})[{HK.format(k="img_id::VARCHAR || '|b' || i::VARCHAR")} % 5 + 1] || {NL} || 'gpt:' || tr, {NL} ORDER BY idx) AS per_box
  FROM k GROUP BY img_id)
SELECT CAST(m.img_id AS VARCHAR) AS sample_id, CASE m.mode
  WHEN 0 THEN 'human:' || ({_qlist(AD.OCR_FULL_PROMPTS)})[{HK.format(k="kk || '|p0'")} % 5 + 1] || {NL} || 'gpt:' || coalesce(agg.answer, '')
  WHEN 1 THEN agg.per_box
  ELSE 'human:' || ({_qlist(AD.OCR_TEXTS_PROMPTS)})[{HK.format(k="kk || '|p2'")} % 6 + 1] || {NL} || 'gpt:' || coalesce(agg.texts, '') END AS text,
  m.mode::INT AS mode
FROM m LEFT JOIN agg USING (img_id) WHERE m.mode <> 1 OR agg.per_box IS NOT NULL""",
)
def a15(spark, sf):
    b = fx_boxes(spark, sf)
    text = F.when(F.col("k") % 11 == 0, F.lit("x###")).otherwise(F.concat(F.lit("w"), F.col("k").cast("string")))
    line = F.struct("idx", F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2").alias("coords"), text.alias("text"))
    g = b.groupBy("img_id", "w", "h").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    s = AD.ocr_full_image_samples(g, "mtwi", "img_id")
    return s.select("sample_id", AD.turns_text().alias("text"), "mode")


@query(
    "a24_supervised_video",
    f"""WITH m AS (SELECT media_id, frame_count, fps, least(8, frame_count) AS fl FROM fx_media)
SELECT CAST(media_id AS VARCHAR) AS sample_id,
  CASE media_id % 3 WHEN 0 THEN 'p/' || media_id::VARCHAR || '.mkv' WHEN 1 THEN 'v/' || media_id::VARCHAR || '.mp4' ELSE 'id' || media_id::VARCHAR || '.mp4' END AS video,
  'human:' || repeat('<image>' || {NL}, fl) || CASE WHEN media_id % 4 = 0 THEN {_q(AD.CAPTION_QUESTION)}
    WHEN media_id % 3 = 1 THEN 'Describe ' || media_id::VARCHAR ELSE 'what happens in ' || media_id::VARCHAR END || {NL} || 'gpt:' ||
  CASE WHEN fl = 0 THEN 'Empty video.' WHEN media_id % 4 = 0 THEN 'cap ' || media_id::VARCHAR
    WHEN media_id % 3 = 1 THEN 'answer ' || fps::VARCHAR ELSE 'nothing' END AS text FROM m""",
)
def a24(spark, sf):
    from weft.fixtures import fx_media

    m = fx_media(spark, sf)
    mid = F.col("media_id")
    sid = mid.cast("string")
    caps = F.when(mid % 4 == 0, F.array(F.struct(F.lit("0").alias("idx"), F.lit("first").alias("content")),
                                        F.struct(F.lit("-1").alias("idx"), F.concat(F.lit("cap "), sid).alias("content"))))
    turns = F.array(
        F.struct(F.lit("human").alias("from"), F.concat(F.lit("<video>\nDescribe "), sid, F.lit("  ")).alias("value")),
        F.struct(F.lit("gpt").alias("from"), F.concat(F.lit("answer "), F.col("fps").cast("string"), F.lit(" ")).alias("value")),
    )
    d = m.select(
        "media_id",
        F.when(mid % 3 == 0, F.concat(F.lit("p/"), sid, F.lit(".mkv"))).alias("video_path"),
        F.when(mid % 3 == 1, F.concat(F.lit("v/"), sid, F.lit(".mp4"))).alias("video"),
        F.concat(F.lit("id"), sid).alias("video_id"),
        caps.alias("captions"),
        turns.alias("turns"),
        F.concat(F.lit("what happens in "), sid).alias("q"),
        F.lit("nothing").alias("a"),
        F.least(F.lit(8), F.col("frame_count")).cast("int").alias("frames_loaded"),
    )
    s = AD.supervised_video_samples(d, "video_sft", "media_id")
    return s.select("sample_id", "video", AD.turns_text().alias("text"))
