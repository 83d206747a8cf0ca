"""Registered queries for joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, fx_boxes, fx_fetch, fx_lines, fx_members, fx_recap, fx_spans, fx_steps, table
from weft.functions.boxes import iou_plus1
from weft.functions.text import question_from_prompt
from weft.ids import positions
from weft.operators import joins as J
from weft.plans.mixture import drop_positions, repeat_rows
from weft.sources import files as S

H = "('0x' || substr(md5('{seed}|' || {k}), 1, 8))::BIGINT"


@query(
    "j01_semi_with_count_check",
    """WITH ann AS (SELECT l_orderkey AS sample_id, count(*) AS n_ann FROM fx_lines GROUP BY l_orderkey),
img AS (SELECT sample_id, count(*) AS n_img FROM fx_fetch WHERE sample_id % 4 <> 0 GROUP BY sample_id)
SELECT sample_id, n_ann FROM ann JOIN img USING (sample_id)""",
)
def j01(spark, sf):
    lines = fx_lines(spark, sf)
    ann = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_ann"))
    img = fx_fetch(spark, sf).filter(F.col("sample_id") % 4 != 0).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_img"))
    return J.semi_with_count_check(ann, img, ["sample_id"], "n_ann", "n_img").select("sample_id", "n_ann")


@query(
    "j01_org_idx",
    """WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS org_idx, doc_id % 3 AS n FROM documents)
SELECT source, org_idx, doc_id FROM a WHERE org_idx % 5 <> 0""",
)
def j01_org_idx(spark, sf):
    """Annotations in one file a source, and images by file and line: a line without images goes, the others keep its number."""
    d = table(spark, sf, "documents").select("source", "doc_id", (F.col("doc_id") % 3).alias("n_ann"))
    root = S.shared_path(spark, "j01")
    lines = d.select("source", "doc_id", F.to_json(F.struct("doc_id", "n_ann")).alias("value"))
    lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(root)
    read = S.read_numbered_lines(spark, root).withColumn("source", F.regexp_extract("file", "source=([^/]*)", 1))
    ann = read.select("source", F.col("line").alias("org_idx"), F.from_json("value", "doc_id bigint, n_ann bigint").alias("a")).select("source", "org_idx", "a.*")
    per_source = positions(d, ["doc_id"], partition=["source"], name="org_idx")
    img = per_source.where("org_idx % 5 <> 0").select("source", "org_idx", F.col("n_ann").alias("n_img"))
    return J.semi_with_count_check(ann, img, ["source", "org_idx"], "n_ann", "n_img").select("source", "org_idx", "doc_id")


@query(
    "j02_attach_payloads",
    """SELECT l_orderkey AS sample_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS i,
  l_linenumber AS linenumber, 'p' || l_partkey::VARCHAR AS payload FROM fx_lines""",
)
def j02(spark, sf):
    lines = fx_lines(spark, sf)
    docs = lines.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: F.struct(x.alias("linenumber"))).alias("info")
    )
    pl = lines.select(
        F.col("l_orderkey").alias("sample_id"),
        F.format_string("img_%03d", "l_linenumber").alias("name"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("payload"),
    )
    out = J.attach_payloads(docs, pl, "sample_id", "info", "name", "payload")
    out = out.select("sample_id", F.posexplode("info").alias("i", "x"))
    return out.select("sample_id", F.col("i").cast("bigint").alias("i"), "x.linenumber", "x.payload")


@query(
    "j03_recaption_override",
    """SELECT d.doc_id, coalesce(r.caption, d.text) AS caption, r.doc_id IS NOT NULL AS overridden
FROM documents d LEFT JOIN fx_recap r USING (doc_id)""",
)
def j03(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("caption"))
    return J.override(d, fx_recap(spark, sf), ["doc_id"], "caption", "caption").select("doc_id", "caption", "overridden")


@query("j04_missing_recaptions", "SELECT count(*) AS n_missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM fx_recap)")
def j04(spark, sf):
    d = table(spark, sf, "documents")
    return J.missing_keys(d, fx_recap(spark, sf), ["doc_id"]).agg(F.count(F.lit(1)).alias("n_missing"))


@query(
    "j05_first_caption",
    """SELECT d.doc_id, coalesce(v.caption, t.caption, '') AS caption FROM documents d
LEFT JOIN (SELECT doc_id, caption FROM fx_recap WHERE caption = 'good') v USING (doc_id)
LEFT JOIN (SELECT doc_id, text AS caption FROM documents WHERE doc_id % 3 <> 0) t USING (doc_id)""",
)
def j05(spark, sf):
    d = table(spark, sf, "documents")
    vfc = fx_recap(spark, sf).filter(F.col("caption") == "good")
    txt = d.filter(F.col("doc_id") % 3 != 0).select("doc_id", F.col("text").alias("caption"))
    return J.first_caption(d.select("doc_id"), [vfc, txt], ["doc_id"]).select("doc_id", "caption")


@query(
    "j06_short_long_caption",
    """WITH j AS (SELECT d.doc_id, s.caption AS sc, l.caption AS lc FROM documents d
  LEFT JOIN (SELECT doc_id, caption || ' <image> x' AS caption FROM fx_recap WHERE doc_id % 2 = 0) s USING (doc_id)
  LEFT JOIN (SELECT doc_id, text AS caption FROM documents WHERE doc_id % 3 = 0) l USING (doc_id))
SELECT doc_id, '<image>' || replace(CASE WHEN lc IS NOT NULL THEN '### Short description: ' || chr(10) || coalesce(sc, '') || ' ' || chr(10) || chr(10)
  || '### Long description: ' || chr(10) || lc ELSE coalesce(sc, '') END, '<image>', '<IMAGE>') AS text FROM j""",
)
def j06(spark, sf):
    d = table(spark, sf, "documents")
    short = fx_recap(spark, sf).filter(F.col("doc_id") % 2 == 0).select("doc_id", F.concat("caption", F.lit(" <image> x")).alias("caption"))
    long = d.filter(F.col("doc_id") % 3 == 0).select("doc_id", F.col("text").alias("caption"))
    return J.short_long_caption(d.select("doc_id"), short, long, ["doc_id"]).select("doc_id", "text")


# Question lists per caption family (fixed values; Q16 fix: two run-together strings split).
FAMILY_QUESTIONS = {
    "spatial": [
        "Elaborate on the visual and narrative elements of the image in detail, with a focus on spatial relations.",
        "Describe the image in details, with a focus on spatial relations.",
        "Give a detailed description of the image, focusing on both visual and narrative elements, and the spatial information.",
    ],
    "ocr": [
        "Describe the textual content in the image.",
        "Identify the text visible in this image.",
        "What words or phrases can you identify in the image?",
    ],
    "bbox_interleaved": [
        "Generate a thorough caption for the image and specify where the main elements are positioned.",
        "Write a detialed caption for the image and specify the location of the main objects in [xmin,ymin,xmax,ymax].",
        "Provide a caption for the image, including the coordinates of the main visual elements.",
    ],
}


def _families(spark, sf):
    d = table(spark, sf, "documents")
    return (
        d.filter(F.col("doc_id") % 2 == 0).select("doc_id", F.lit("spatial").alias("family"), F.col("text").alias("caption"))
        .unionByName(d.filter(F.col("doc_id") % 3 == 0).select("doc_id", F.lit("ocr").alias("family"), F.col("lang").alias("caption")))
        .unionByName(
            d.filter(F.col("doc_id") % 5 == 0).select("doc_id", F.lit("bbox_interleaved").alias("family"), F.col("source").alias("caption"))
        )
    )


def _fq_sql() -> str:
    rows = []
    for fam, qs in FAMILY_QUESTIONS.items():
        arr = ", ".join("'" + q.replace("'", "''") + "'" for q in qs)
        rows.append(f"('{fam}', [{arr}])")
    return "(VALUES " + ", ".join(rows) + ") q(family, questions)"


@query(
    "j07_caption_family_turns",
    f"""WITH f AS (
  SELECT doc_id, 'spatial' AS family, text AS caption FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'ocr', lang FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'bbox_interleaved', source FROM documents WHERE doc_id % 5 = 0),
g AS (SELECT doc_id, string_agg(questions[({H.format(seed=43, k="doc_id::VARCHAR || '|' || family")} % 3) + 1] || '|' || caption, '|'
   ORDER BY {H.format(seed=42, k="doc_id::VARCHAR || '|' || family")}, family) AS qa, count(*) * 2 AS n_turns
  FROM f JOIN {_fq_sql()} USING (family) GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n_turns, 0)::BIGINT AS n_turns, coalesce(g.qa, '') AS qa FROM documents d LEFT JOIN g USING (doc_id)""",
)
def j07(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    q = spark.createDataFrame(list(FAMILY_QUESTIONS.items()), "family string, questions array<string>")
    out = J.caption_family_turns(d, _families(spark, sf), q, "doc_id", seed=42)
    return out.select(
        "doc_id", F.size("qa_turns").cast("bigint").alias("n_turns"), F.array_join(F.transform("qa_turns", lambda t: t["value"]), "|").alias("qa")
    )


@query(
    "j08_cot_override",
    """WITH r AS (SELECT 'conv/' || conv_id::VARCHAR || '-0' AS uid, count(*) FILTER (WHERE conv_id % 8 <> 0) AS n
   FROM fx_turns WHERE conv_id % 4 = 0 AND turn < 2 GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS n FROM fx_turns GROUP BY conv_id)
SELECT s.conv_id, coalesce(r.n > 0, false) AS overridden, CASE WHEN r.n > 0 THEN r.n ELSE s.n END::BIGINT AS n_turns
FROM s LEFT JOIN r ON r.uid = 'conv/' || s.conv_id::VARCHAR || '-0'""",
)
def j08(spark, sf):
    s = conv_samples(spark, sf)
    s = s.withColumn("uid", F.concat(F.lit("conv/"), F.col("row_id").cast("string"), F.lit("-0")))
    rel = s.filter(F.col("conv_id") % 4 == 0).select(
        "uid", F.when(F.col("conv_id") % 8 == 0, F.array().cast("array<struct<from:string,value:string>>")).otherwise(F.slice("turns", 1, 2)).alias("new")
    )
    out = s.join(rel, "uid", "left")
    hit = F.coalesce(F.size("new") > 0, F.lit(False))
    out = out.withColumn("turns", F.when(hit, F.col("new")).otherwise(F.col("turns"))).withColumn("overridden", hit)
    return out.select("conv_id", "overridden", F.size("turns").cast("bigint").alias("n_turns"))


@query("j09_drop_positions", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j09(spark, sf):
    d = table(spark, sf, "documents").withColumn("row_id", F.col("doc_id"))
    bad = table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("row_id"))
    return drop_positions(d, bad).select("doc_id")


@query(
    "j10_resolve_media",
    """WITH m AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'media/' || page_id::VARCHAR END AS path FROM pages
  UNION ALL SELECT 'media/' || page_id::VARCHAR || '.mp4' FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT 'media/' || page_id::VARCHAR || '.mkv' FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT 'media/' || page_id::VARCHAR || '.webm' FROM pages WHERE page_id % 3 = 0)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'media/' || page_id::VARCHAR ELSE 'media/' || page_id::VARCHAR || '.mkv' END AS media_path
FROM pages WHERE page_id % 3 <> 2""",
)
def j10(spark, sf):
    p = table(spark, sf, "pages")
    base = F.concat(F.lit("media/"), F.col("page_id").cast("string"))
    man = (
        p.filter(F.col("page_id") % 3 == 0).select(base.alias("path"))
        .unionByName(p.filter(F.col("page_id") % 3 == 1).select(F.concat(base, F.lit(".mp4")).alias("path")))
        .unionByName(p.filter(F.col("page_id") % 3 == 1).select(F.concat(base, F.lit(".mkv")).alias("path")))
        .unionByName(p.filter(F.col("page_id") % 3 == 0).select(F.concat(base, F.lit(".webm")).alias("path")))
    )
    return J.resolve_media(p.select("page_id"), man, base).select("page_id", "media_path")


@query(
    "j10_extension_order",
    """SELECT page_id, 'v' || page_id::VARCHAR || CASE page_id % 4 WHEN 0 THEN '.mp4' WHEN 1 THEN '.MP4' ELSE '.mkv' END AS media_path
FROM pages WHERE page_id % 4 <> 3""",
)
def j10_order(spark, sf):
    p = table(spark, sf, "pages").select("page_id")
    base, k = F.concat(F.lit("v"), F.col("page_id").cast("string")), F.col("page_id") % 4
    # 0 has all three, 1 the last two, 2 the last one, 3 another kind
    have = [(k == 0, ".mp4"), (k <= 1, ".MP4"), (k <= 2, ".mkv"), (k == 3, ".avi")]
    man = None
    for cond, ext in have:
        part = p.where(cond).select(F.concat(base, F.lit(ext)).alias("path"))
        man = part if man is None else man.unionByName(part)
    return J.resolve_by_extension(p, man, base, [".mp4", ".MP4", ".mkv"]).select("page_id", "media_path")


@query(
    "j10_folder_extension",
    """SELECT 'd' || (page_id % 50)::VARCHAR AS folder, CASE WHEN page_id % 50 % 5 <> 0 THEN '.png' END AS ext,
  page_id % 50 % 5 = 0 AS bad FROM pages GROUP BY page_id % 50 HAVING count(*) > 1""",
)
def j10_folder(spark, sf):
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 50).alias("d"))
    p = p.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("d"))).where("n > 1")
    odd = (F.col("d") % 5 == 0) & (F.floor(F.col("page_id") / 50) % 2 == 0)
    ext = F.when(odd, ".jpg").otherwise(".png")
    man = p.select(F.concat(F.lit("d"), F.col("d").cast("string"), F.lit("/f"), F.col("page_id").cast("string"), ext).alias("path"))
    return J.folder_extension(man).select("folder", "ext", F.col("error").isNotNull().alias("bad"))


PROMPT_SQL = """CASE p_partkey % 4
  WHEN 0 THEN 'OCR tokens: a b Question: ' || p_name || ' Short answer:'
  WHEN 1 THEN 'Reference OCR token: x' || chr(10) || p_name || chr(10) || 'Answer:'
  WHEN 2 THEN p_name || chr(10) || 'Reference OCR token: y' || chr(10) || 'ok'
  ELSE p_name || chr(10) || 'Answer the question.' END"""


@query(
    "j11_prediction_annotation",
    """SELECT p.p_partkey AS question_id, p.p_type AS text, a.p_brand AS gt
FROM part p JOIN part a ON a.p_partkey = p.p_partkey AND lower(a.p_name) = lower(p.p_name)""",
)
def j11(spark, sf):
    part = table(spark, sf, "part")
    k = F.col("p_partkey") % 4
    prompt = (
        F.when(k == 0, F.concat(F.lit("OCR tokens: a b Question: "), "p_name", F.lit(" Short answer:")))
        .when(k == 1, F.concat(F.lit("Reference OCR token: x\n"), "p_name", F.lit("\nAnswer:")))
        .when(k == 2, F.concat("p_name", F.lit("\nReference OCR token: y\nok")))
        .otherwise(F.concat("p_name", F.lit("\nAnswer the question.")))
    )
    preds = part.select(F.col("p_partkey").alias("question_id"), question_from_prompt(prompt).alias("q"), F.col("p_type").alias("text"))
    ann = part.select(F.col("p_partkey").alias("image_id"), F.lower("p_name").alias("question"), F.col("p_brand").alias("gt"))
    j = preds.join(ann, (preds.question_id == ann.image_id) & (preds.q == ann.question))
    return j.select("question_id", "text", "gt")


@query(
    "j12_dedupe_then_join",
    """WITH a AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS answer FROM orders GROUP BY o_custkey)
SELECT c_custkey, answer FROM customer JOIN a ON a.o_custkey = c_custkey""",
)
def j12(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("answer"))
    a = J.dedupe_last(o, "o_custkey", "o_orderkey")
    c = table(spark, sf, "customer")
    return c.join(a, c.c_custkey == a.o_custkey).select("c_custkey", "answer")


@query(
    "j13_annotations_all_predictions",
    """WITH hits AS (SELECT g.img_id, g.idx, bool_or(
  greatest(0, least(g.x2, p.px2) - greatest(g.x1, p.px1) + 1) * greatest(0, least(g.y2, p.py2) - greatest(g.y1, p.py1) + 1) /
   ((g.x2 - g.x1 + 1) * (g.y2 - g.y1 + 1) + (p.px2 - p.px1 + 1) * (p.py2 - p.py1 + 1)
    - greatest(0, least(g.x2, p.px2) - greatest(g.x1, p.px1) + 1) * greatest(0, least(g.y2, p.py2) - greatest(g.y1, p.py1) + 1)) >= 0.5) AS hit
  FROM fx_boxes g JOIN fx_boxes p ON p.img_id = g.img_id AND p.idx % 2 = 1 GROUP BY g.img_id, g.idx)
SELECT count(*) FILTER (WHERE hit) AS correct, (SELECT count(*) FROM fx_boxes) AS total FROM hits""",
)
def j13(spark, sf):
    b = fx_boxes(spark, sf)
    ann = b.select("img_id", "idx", F.array("x1", "y1", "x2", "y2").alias("g"))
    pred = b.filter(F.col("idx") % 2 == 1).select("img_id", F.array("px1", "py1", "px2", "py2").alias("p"))
    hits = ann.join(pred, "img_id").groupBy("img_id", "idx").agg(F.bool_or(iou_plus1(F.col("g"), F.col("p")) >= 0.5).alias("hit"))
    total = b.agg(F.count(F.lit(1)).alias("total"))
    correct = hits.agg(F.count(F.when(F.col("hit"), F.lit(1))).alias("correct"))
    return correct.withColumn("_k", F.lit(1)).join(total.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("j14_keep_answered", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j14(spark, sf):
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab.select("doc_id"), "doc_id", "left_semi").join(lab, "doc_id").select("doc_id", "quality")


MAPPING_SQL = """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS k1, p_name FROM part),
m AS (SELECT key || '.mp4' AS key, 'cat_' || key AS category FROM (SELECT DISTINCT k1 AS key FROM w UNION SELECT DISTINCT p_name FROM w
  UNION SELECT DISTINCT repeat(p_name, 20) FROM part WHERE p_partkey % 50 = 1)),
r AS (SELECT key, category, row_number() OVER (ORDER BY key DESC) AS rank FROM m)"""


@query(
    "j15_prefix_category",
    MAPPING_SQL
    + """,
ids AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'zz' WHEN p_partkey % 50 = 1 THEN repeat(p_name, 20) ELSE p_name END || '_' || p_partkey::VARCHAR AS vid FROM part)
SELECT p_partkey, coalesce((SELECT arg_min(category, rank) FROM r WHERE starts_with(vid, regexp_replace(key, '\\.[^./]*$', ''))), 'Other') AS category
FROM ids""",
)
def j15(spark, sf):
    part = table(spark, sf, "part")
    k1 = F.split("p_name", " ").getItem(0)
    long_key = F.repeat("p_name", 20)  # some hundred characters
    keys = part.select(k1.alias("key")).union(part.select(F.col("p_name").alias("key"))).union(part.where("p_partkey % 50 = 1").select(long_key.alias("key"))).distinct()
    m = keys.select(F.concat("key", F.lit(".mp4")).alias("key"), F.concat(F.lit("cat_"), "key").alias("category"))
    m = positions(m, [F.col("key").desc()], name="rank")
    ids = part.select(
        "p_partkey",
        F.concat(F.when(F.col("p_partkey") % 10 == 0, F.lit("zz")).when(F.col("p_partkey") % 50 == 1, long_key).otherwise(F.col("p_name")), F.lit("_"), F.col("p_partkey").cast("string")).alias("vid"),
    )
    return J.prefix_category(ids, m, "vid").select("p_partkey", "category")


@query(
    "j16_frames_to_subtitles",
    """WITH v AS (SELECT DISTINCT vid, duration FROM fx_spans),
fr AS (SELECT vid, round(i * (duration - 1) / 7.0) AS t FROM v, range(8) r(i))
SELECT vid, string_agg(DISTINCT qid::VARCHAR, ',' ORDER BY qid::VARCHAR) AS lines
FROM fr JOIN fx_spans s USING (vid) WHERE fr.t >= s.s AND fr.t < s.e GROUP BY vid""",
)
def j16(spark, sf):
    sp = fx_spans(spark, sf)
    v = sp.select("vid", "duration").distinct()
    frames = v.select(
        "vid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.bround(i * (F.col("duration") - 1) / 7.0, 0))).alias("t")
    )
    j = J.range_join(frames, sp.select("vid", "qid", "s", "e"), "t", "s", "e", keys=["vid"], bucket=10.0)
    return j.groupBy("vid").agg(F.array_join(F.array_sort(F.collect_set(F.col("qid").cast("string"))), ",").alias("lines"))


@query("j17_resume_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17(spark, sf):
    d = table(spark, sf, "documents")
    return J.resume(d, table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


@query(
    "j17_resume_by_columns",
    """SELECT episode, step FROM fx_steps s WHERE NOT EXISTS (SELECT 1 FROM fx_steps d WHERE d.step % 3 = 0 AND d.episode = s.episode AND d.step = s.step)""",
)
def j17_columns(spark, sf):
    s = fx_steps(spark, sf).select("episode", "step")
    return J.resume(s, s.where("step % 3 = 0"), ["episode", "step"])


@query(
    "j18_regroup_annotations",
    """SELECT img_id AS image_id, 1000 AS w, string_agg('a' || img_id::VARCHAR || '_' || idx::VARCHAR || '=' || x1::DOUBLE::VARCHAR, ','
  ORDER BY 'a' || img_id::VARCHAR || '_' || idx::VARCHAR) AS anns, count(*) AS n_anns FROM fx_boxes GROUP BY img_id""",
)
def j18(spark, sf):
    # three tables of maps, as the annotation file has them
    b = fx_boxes(spark, sf)
    aid = F.concat(F.lit("a"), F.col("img_id").cast("string"), F.lit("_"), F.col("idx").cast("string"))
    imgs = b.select("img_id").distinct().select(F.create_map(F.col("img_id"), F.struct(F.lit(1000).alias("w"), F.lit(800).alias("h"))).alias("imgs"))
    i2a = b.groupBy("img_id").agg(F.collect_list(aid).alias("l")).select(F.create_map("img_id", "l").alias("imgToAnns"))
    anns = b.select(F.create_map(aid, F.struct(F.col("x1").cast("double").alias("x1"), "y1")).alias("anns"))
    out = J.regroup_annotations(imgs, i2a, anns)
    text = F.transform("annotations", lambda a: F.concat(a["ann_id"], F.lit("="), a["ann"]["x1"].cast("string")))
    return out.select("image_id", "img.w", F.array_join(text, ",").alias("anns"), F.size("annotations").cast("bigint").alias("n_anns"))


@query(
    "j20_index_to_shard",
    """WITH s AS (SELECT shard AS url, count(*) AS nsamples FROM fx_members GROUP BY shard),
c AS (SELECT url, coalesce(sum(nsamples) OVER (ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, nsamples FROM s)
SELECT d.doc_id AS "index", c.url, d.doc_id - c.lo AS inner_index FROM documents d JOIN c ON d.doc_id >= c.lo AND d.doc_id < c.lo + c.nsamples""",
)
def j20(spark, sf):
    shards = fx_members(spark, sf).groupBy(F.col("shard").alias("url")).agg(F.count(F.lit(1)).alias("nsamples"))
    idx = table(spark, sf, "documents").select(F.col("doc_id").alias("index"))
    return J.index_to_shard(idx, shards).select("index", "url", "inner_index")


@query(
    "j21_range_intersections",
    """SELECT a.vid, a.qid, b.qid AS other, greatest(a.s, b.ps) AS lo, least(a.e, b.pe) AS hi
FROM fx_spans a JOIN fx_spans b ON a.vid = b.vid AND greatest(a.s, b.ps) < least(a.e, b.pe)""",
)
def j21(spark, sf):
    sp = fx_spans(spark, sf)
    a = sp.select("vid", "qid", "s", "e")
    b = sp.select("vid", F.col("qid").alias("other"), "ps", "pe")
    return J.overlap_join(a, b, "s", "e", "ps", "pe", keys=["vid"]).select("vid", "qid", "other", "lo", "hi")


@query(
    "j22_judge_join",
    "SELECT s.step AS id, s.step % 6 AS score, p.category FROM fx_steps s JOIN fx_spans p ON p.qid = s.step WHERE s.step % 3 <> 0",
)
def j22(spark, sf):
    judge = fx_steps(spark, sf).filter(F.col("step") % 3 != 0).select(F.col("step").alias("id"), (F.col("step") % 6).alias("score"))
    preds = fx_spans(spark, sf).select(F.col("qid").alias("id"), "category")
    return judge.join(preds, "id").select("id", "score", "category")


@query("j19_repeat_rows", "SELECT doc_id, c AS copy FROM labels, range(3) r(c)")
def j19(spark, sf):
    return repeat_rows(table(spark, sf, "labels"), 3).select("doc_id", F.col("copy").cast("bigint").alias("copy"))
