"""Registered queries for filters (P01–P22) and box expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import conv_samples, fx_boxes, fx_fetch, fx_scored, table
from weft.functions import boxes as B
from weft.ids import positions
from weft.operators import filters as P

H42 = "('0x' || substr(md5('42|' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


@query("p01_select_cols", "SELECT id, s1 FROM fx_scored")
def p01(spark, sf):
    return P.select_cols(fx_scored(spark, sf), ["id", "s1"])


@query(
    "p02_score_filter",
    """WITH s AS (SELECT id, shard, s1 + s2 AS score FROM fx_scored)
SELECT id, shard, score FROM s WHERE score > 0.1
  AND (SELECT count(*) FILTER (WHERE score > 0.1) / count(*) FROM s) > 0.2""",
)
def p02(spark, sf):
    return P.score_filter(fx_scored(spark, sf), ["s1", "s2"], 0.1, 0.2).select("id", "shard", "score")


ROUTES = {"alpha": ["src0", "src1", "src2", "src3", "src4"], "beta": ["src3", "src4", "src5", "src6"]}


@query(
    "p03_route_by_source",
    """SELECT doc_id, subset FROM documents JOIN (VALUES ('alpha','src0'),('alpha','src1'),('alpha','src2'),('alpha','src3'),
  ('alpha','src4'),('beta','src3'),('beta','src4'),('beta','src5'),('beta','src6')) r(subset, source) USING (source)""",
)
def p03(spark, sf):
    return P.route_by_source(table(spark, sf, "documents"), ROUTES).select("doc_id", "subset")


@query(
    "p04_keep_source_or_prefix",
    "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR starts_with('img/' || lang || '/' || doc_id::VARCHAR, 'img/de/')",
)
def p04(spark, sf):
    d = table(spark, sf, "documents").withColumn(
        "image", F.concat(F.lit("img/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    )
    return P.keep_source_or_prefix(d, ["src1", "src2"], ["img/de/"]).select("doc_id")


@query(
    "p05_max_tags_per_turn",
    "SELECT conv_id FROM fx_turns GROUP BY conv_id HAVING bool_and(len(string_split(value, '<image>')) - 1 <= 1)",
)
def p05(spark, sf):
    return P.max_tags_per_turn(conv_samples(spark, sf), 1).select("conv_id")


@query("p06_valid_roles", "SELECT conv_id FROM fx_turns GROUP BY conv_id HAVING bool_and(role IN ('human', 'gpt'))")
def p06(spark, sf):
    return P.valid_roles(conv_samples(spark, sf)).select("conv_id")


def _stop_sql(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in P.STOP_WORDS[lang])
    return f"len(list_filter(ws, lambda x: x IN ({words}))) AS {lang}"


@query(
    "p07_lang_filter",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, {_stop_sql('en')}, {_stop_sql('de')}, {_stop_sql('fr')}, {_stop_sql('es')} FROM w)
SELECT doc_id FROM s WHERE en > 0 AND en >= de AND en >= fr AND en >= es""",
)
def p07(spark, sf):
    return P.lang_filter(table(spark, sf, "documents"), ["text"], "en").select("doc_id")


@query(
    "p07_detect_lang",
    rf"""WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, lang, {_stop_sql('en')}, {_stop_sql('de')}, {_stop_sql('fr')}, {_stop_sql('es')} FROM w),
d AS (SELECT lang, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' WHEN en = greatest(en, de, fr, es) THEN 'en'
  WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS detected FROM s)
SELECT lang, detected, count(*) AS n FROM d GROUP BY lang, detected""",
)
def p07_detect(spark, sf):
    d = P.with_detected_lang(table(spark, sf, "documents").select("lang", "text"), "text").select("lang", "detected")
    return d.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p08_min_media_size",
    """WITH m AS (SELECT CASE WHEN page_id % 2 = 0 THEN 'v' || page_id::VARCHAR || '.mp4' ELSE page_id::VARCHAR || '.mp4' END AS path,
   octet_length(encode(html)) AS length FROM pages WHERE page_id % 5 <> 0)
SELECT page_id FROM pages WHERE coalesce(CASE WHEN page_id % 2 = 0 THEN 'v' || page_id::VARCHAR || '.mp4' END,
  page_id::VARCHAR || '.mp4') IN (SELECT path FROM m WHERE length > 2000)""",
)
def p08(spark, sf):
    pages = table(spark, sf, "pages")
    vpath = F.concat(F.lit("v"), F.col("page_id").cast("string"), F.lit(".mp4"))
    samples = pages.select(
        F.col("page_id").alias("sample_id"), F.when(F.col("page_id") % 2 == 0, vpath).alias("video")
    )
    manifest = pages.filter(F.col("page_id") % 5 != 0).select(
        F.when(F.col("page_id") % 2 == 0, vpath)
        .otherwise(F.concat(F.col("page_id").cast("string"), F.lit(".mp4")))
        .alias("path"),
        F.octet_length("html").alias("length"),
    )
    return P.min_media_size(samples, manifest, 2000).select(F.col("sample_id").alias("page_id"))


@query(
    "p09_drop_broken_media",
    """SELECT page_id FROM pages WHERE NOT (octet_length(encode(html)) < 1000 OR NOT starts_with(html, '<!'))""",
)
def p09(spark, sf):
    pages = table(spark, sf, "pages")
    manifest = pages.select(
        F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"), F.octet_length("html").alias("length")
    )
    reasons = P.probe_media(manifest, {"html": "3C21"}, min_bytes=1000)
    return P.drop_broken_media(pages, reasons, F.col("url")).select("page_id")


def _ocr_anns(spark, sf):
    b = fx_boxes(spark, sf)
    text = (
        F.when(F.col("k") % 11 == 0, F.lit("x###"))
        .when(F.col("k") % 13 == 0, F.lit("."))
        .otherwise(F.concat(F.lit("w"), F.col("k").cast("string")))
    )
    return b.withColumn("transcription", text)


OCR_TEXT_SQL = "CASE WHEN k % 11 = 0 THEN 'x###' WHEN k % 13 = 0 THEN '.' ELSE 'w' || k::VARCHAR END"


@query(
    "p10_legible",
    f"""SELECT img_id, count(*) FILTER (WHERE NOT ignored AND NOT contains({OCR_TEXT_SQL}, '###') AND {OCR_TEXT_SQL} <> '.') AS n_kept,
  coalesce(string_agg({OCR_TEXT_SQL}, ',' ORDER BY idx) FILTER (WHERE NOT ignored AND NOT contains({OCR_TEXT_SQL}, '###')
    AND {OCR_TEXT_SQL} <> '.'), '') AS texts
FROM fx_boxes GROUP BY img_id""",
)
def p10(spark, sf):
    a = _ocr_anns(spark, sf)
    g = a.groupBy("img_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "transcription", F.col("ignored").alias("illegible")))).alias("anns")
    )
    kept = P.legible("anns")
    return g.select(
        "img_id",
        F.size(kept).cast("bigint").alias("n_kept"),
        F.array_join(F.transform(kept, lambda x: x["transcription"]), ",").alias("texts"),
    )


@query(
    "p11_min_area",
    "SELECT img_id, count(*) FILTER (WHERE (x2 - x1) * (y2 - y1) / (1000 * 800) >= 0.0005) AS n_kept FROM fx_boxes GROUP BY img_id",
)
def p11(spark, sf):
    b = fx_boxes(spark, sf)
    g = b.groupBy("img_id").agg(
        F.collect_list(F.struct("idx", "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))).alias(
            "anns"
        )
    )
    return g.select("img_id", F.size(P.min_area("anns", F.lit(1000), F.lit(800), 0.0005)).cast("bigint").alias("n_kept"))


def _hier(spark, sf):
    b = fx_boxes(spark, sf)
    verts = F.array(
        F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2")
    )
    xm = (F.col("x1") + F.col("x2")) / 2
    words = F.array(
        F.struct(
            F.array(F.array("x1", "y1"), F.array(xm, F.col("y2"))).alias("vertices"),
            F.concat(F.lit("a"), F.col("k").cast("string")).alias("text"),
            (F.col("idx") % 3 == 0).alias("vertical"),
        ),
        F.struct(
            F.array(F.array(xm, F.col("y1")), F.array("x2", "y2")).alias("vertices"),
            F.concat(F.lit("b"), F.col("k").cast("string")).alias("text"),
            F.lit(False).alias("vertical"),
        ),
    )
    line = F.struct(
        "idx",
        verts.alias("vertices"),
        F.concat(F.lit("line"), F.col("k").cast("string")).alias("text"),
        (~F.col("ignored")).alias("legible"),
        (F.col("k") % 5 == 0).alias("handwritten"),
        (F.col("k") % 7 == 0).alias("vertical"),
        words.alias("words"),
    )
    g = b.groupBy("img_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return g.select(F.col("img_id").alias("image_id"), F.array(F.struct(F.col("lines").alias("lines"))).alias("paragraphs"))


HIER_KEEP = "NOT (x2 * y2 < 225) AND NOT (x2 - x1 < y2 - y1) AND NOT ignored AND NOT (k % 7 = 0)"


@query(
    "p12_hier_text_lines",
    f"SELECT img_id AS image_id, x1, y1, x2, y2, 'line' || k::VARCHAR AS transcription FROM fx_boxes WHERE {HIER_KEEP}",
)
def p12_lines(spark, sf):
    out = P.hier_text(_hier(spark, sf), "lines")
    return out.select("image_id", *[F.col("bbx")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])], "transcription")


@query(
    "p12_hier_text_words",
    f"""SELECT img_id AS image_id, x1, y1, (x1 + x2) / 2 AS x2, y2, 'a' || k::VARCHAR AS transcription FROM fx_boxes
  WHERE {HIER_KEEP} AND idx % 3 <> 0
UNION ALL SELECT img_id, (x1 + x2) / 2, y1, x2, y2, 'b' || k::VARCHAR FROM fx_boxes WHERE {HIER_KEEP}""",
)
def p12_words(spark, sf):
    out = P.hier_text(_hier(spark, sf), "words")
    return out.select("image_id", *[F.col("bbx")[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])], "transcription")


@query("p13_all_ok", "SELECT sample_id FROM fx_fetch GROUP BY sample_id HAVING bool_and(ok)")
def p13(spark, sf):
    return P.all_ok(fx_fetch(spark, sf))


@query("p14_ok_only", "SELECT sample_id, item FROM fx_fetch WHERE ok")
def p14(spark, sf):
    return P.ok_only(fx_fetch(spark, sf)).select("sample_id", "item")


TITLE_SQL = """CASE WHEN p_partkey % 9 = 0 THEN 'NoName' WHEN p_partkey % 10 = 0 THEN '##' || p_brand
  WHEN p_partkey % 4 = 0 THEN p_name || '##' || p_brand ELSE p_name END"""


@query(
    "p15_non_empty_title",
    f"""WITH t AS (SELECT p_partkey, split_part({TITLE_SQL}, '##', 1) AS h FROM part)
SELECT p_partkey, h AS title FROM t WHERE h <> 'NoName' AND length(h) > 0""",
)
def p15(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    title = (
        F.when(k % 9 == 0, F.lit("NoName"))
        .when(k % 10 == 0, F.concat(F.lit("##"), "p_brand"))
        .when(k % 4 == 0, F.concat("p_name", F.lit("##"), "p_brand"))
        .otherwise(F.col("p_name"))
    )
    return P.non_empty_title(p.select("p_partkey", title.alias("title")))


@query("p16_non_empty_turns", "SELECT DISTINCT conv_id FROM fx_turns WHERE role = 'system'")
def p16(spark, sf):
    s = conv_samples(spark, sf).withColumn("turns", F.filter("turns", lambda t: t["from"] == "system"))
    return P.non_empty_turns(s).select("conv_id")


@query(
    "p17_slice_fraction",
    """WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_id, count(*) OVER () AS n FROM fx_scored)
SELECT id, row_id FROM r WHERE row_id >= floor(n * 0.25) AND row_id < floor(n * 0.6)""",
)
def p17(spark, sf):
    s = positions(fx_scored(spark, sf), ["id"], name="row_id")
    return P.slice_fraction(s, 0.25, 0.6).select("id", "row_id")


@query(
    "p19_on_failure_resample",
    f"""WITH good AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS gpos FROM fx_scored WHERE shard <> 'R'),
ng AS (SELECT count(*) AS n FROM good),
bad AS (SELECT id AS replaced_from, {H42.format(k='id')} % (SELECT n FROM ng) AS gpos FROM fx_scored WHERE shard = 'R')
SELECT id, NULL::BIGINT AS replaced_from FROM good
UNION ALL SELECT g.id, b.replaced_from FROM bad b JOIN good g USING (gpos)""",
)
def p19(spark, sf):
    s = fx_scored(spark, sf).withColumn("row_id", F.col("id")).withColumn(
        "error", F.when(F.col("shard") == "R", F.lit("failed"))
    )
    return P.on_failure(s, mode="resample").select("id", "replaced_from")


@query(
    "p20_letters_only",
    "SELECT item_id, substr(text, 1, 1) AS letter FROM benchmark WHERE length(text) > 0 AND contains('ABCDEFGHIJ', substr(text, 1, 1))",
)
def p20(spark, sf):
    b = table(spark, sf, "benchmark")
    return P.letters_only(b, "text", "ABCDEFGHIJ").select("item_id", "letter")


@query(
    "p21_first_human",
    """SELECT conv_id, (CASE WHEN conv_id % 3 = 0 THEN max(CASE WHEN turn = 1 THEN role END) ELSE max(CASE WHEN turn = 0 THEN role END) END)
  IS DISTINCT FROM 'human' AS bad FROM fx_turns GROUP BY conv_id""",
)
def p21(spark, sf):
    s = conv_samples(spark, sf)
    s = s.withColumn("turns", F.when(F.col("conv_id") % 3 == 0, F.slice("turns", F.lit(2), F.size("turns"))).otherwise(F.col("turns")))
    return P.first_human(s).select("conv_id", F.col("error").isNotNull().alias("bad"))


@query(
    "p22_check_media_counts",
    """WITH c AS (SELECT conv_id, n_tags, CASE WHEN n_img > 0 THEN n_img ELSE 0 END + CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 0 END AS n FROM fx_convimg)
SELECT conv_id, least(n, n_tags)::BIGINT AS n_images, n < n_tags AS bad FROM c""",
)
def p22(spark, sf):
    s = conv_samples(spark, sf)
    s = s.withColumn(
        "images", F.when(F.col("conv_id") % 7 == 0, F.concat("images", F.array(F.lit("extra.jpg")))).otherwise(F.col("images"))
    )
    out = P.check_media_counts(s, "truncate")
    return out.select("conv_id", F.size("images").cast("bigint").alias("n_images"), F.col("error").isNotNull().alias("bad"))


# ---- box expressions -------------------------------------------------------------

GRID = "least(greatest(trunc({v} / {s} * 1000), 0), 999)::BIGINT"


def _grid(v, s):
    return GRID.format(v=v, s=s)


@query(
    "f05_polygon_box_text",
    f"""SELECT img_id, idx,
  printf('[%03d,%03d,%03d,%03d]', {_grid('least(x1, px1)', 1000)}, {_grid('least(y1, py1)', 800)},
    {_grid('greatest(x2, px2)', 1000)}, {_grid('greatest(y2, py2)', 800)}) AS box,
  printf('[%03d,%03d,%03d,%03d]', {_grid('least(x1, px1)', 1000)}, {_grid('least(y1, py1)', 800)},
    {_grid('greatest(x2, px2)', 1000)}, {_grid('greatest(y2, py2)', 800)}) AS flat_box
FROM fx_boxes""",
)
def f05(spark, sf):
    b = fx_boxes(spark, sf)
    pts = F.array(F.array("x1", "y1"), F.array("px2", "py1"), F.array("x2", "y2"), F.array("px1", "py2"))
    flat = F.array("x1", "y1", "px2", "py1", "x2", "y2", "px1", "py2")
    return b.select(
        "img_id", "idx", B.polygon_box_text(pts, "w", "h").alias("box"), B.flat_polygon_box_text(flat, "w", "h").alias("flat_box")
    )


@query(
    "f06_corner_box_text",
    f"""SELECT img_id, idx, printf('[%03d,%03d,%03d,%03d]', {_grid('least(x1, x2)', 1000)}, {_grid('least(y1, py1)', 800)},
    {_grid('greatest(px2, px1)', 1000)}, {_grid('greatest(y2, py2)', 800)}) AS box FROM fx_boxes""",
)
def f06(spark, sf):
    b = fx_boxes(spark, sf)
    pts = F.array(F.array("x1", "y1"), F.array("px2", "py1"), F.array("x2", "y2"), F.array("px1", "py2"))
    return b.select("img_id", "idx", B.corner_box_text(pts, "w", "h").alias("box"))


@query(
    "f08_boxes_in_text",
    """WITH t AS (SELECT img_id, idx, k, 'box [' || (idx * 7 % 100)::VARCHAR || ', ' || (k % 1000)::VARCHAR || ',' || (k % 97)::VARCHAR
   || ', 5] and [1, 2, 3]' AS text FROM fx_boxes)
SELECT img_id, idx, ('0.' || (idx * 7 % 100)::VARCHAR)::DOUBLE * 1000 AS a, ('0.' || (k % 1000)::VARCHAR)::DOUBLE * 800 AS b,
  ('0.' || (k % 97)::VARCHAR)::DOUBLE * 1000 AS c, 0.5 * 800 AS d FROM t""",
)
def f08(spark, sf):
    b = fx_boxes(spark, sf)
    text = F.concat(
        F.lit("box ["), (F.col("idx") * 7 % 100).cast("string"), F.lit(", "), (F.col("k") % 1000).cast("string"), F.lit(","),
        (F.col("k") % 97).cast("string"), F.lit(", 5] and [1, 2, 3]"),
    )
    bx = B.boxes_in_text(text, F.col("w"), F.col("h"))
    return b.select("img_id", "idx", *[bx[0][i].alias(n) for i, n in enumerate("abcd")])


@query(
    "f09_grounding_box",
    """WITH t AS (SELECT img_id, idx, k, w, h, '[' || (idx * 7 % 100)::VARCHAR || ', ' || (k % 1000)::VARCHAR || ', 5, 9].' AS text FROM fx_boxes)
SELECT img_id, idx,
  ('0.' || (idx * 7 % 100)::VARCHAR)::DOUBLE * 1000 - 0 AS x1, ('0.' || (k % 1000)::VARCHAR)::DOUBLE * 1000 - 100 AS y1,
  0.5 * 1000 AS x2, 0.9 * 1000 - 100 AS y2 FROM t""",
)
def f09(spark, sf):
    b = fx_boxes(spark, sf)
    text = F.concat(F.lit("["), (F.col("idx") * 7 % 100).cast("string"), F.lit(", "), (F.col("k") % 1000).cast("string"), F.lit(", 5, 9]."))
    g = B.grounding_box(text, "w", "h", "square_padded")
    return b.select("img_id", "idx", *[g[i].alias(n) for i, n in enumerate(["x1", "y1", "x2", "y2"])])


@query(
    "f10_iou_variants",
    """SELECT img_id, idx,
  greatest(0, least(x2, px2) - greatest(x1, px1) + 1) * greatest(0, least(y2, py2) - greatest(y1, py1) + 1) /
   ((x2 - x1 + 1) * (y2 - y1 + 1) + (px2 - px1 + 1) * (py2 - py1 + 1)
    - greatest(0, least(x2, px2) - greatest(x1, px1) + 1) * greatest(0, least(y2, py2) - greatest(y1, py1) + 1)) AS iou_plus1,
  greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) /
   (greatest((x2 - x1) * (y2 - y1), 1) + greatest((px2 - px1) * (py2 - py1), 1)
    - greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1))) AS iou_floor1,
  CASE WHEN greatest(x2 - x1, 0) + greatest(px2 - px1, 0) - greatest(least(x2, px2) - greatest(x1, px1), 0) > 0
    THEN greatest(least(x2, px2) - greatest(x1, px1), 0) /
      (greatest(x2 - x1, 0) + greatest(px2 - px1, 0) - greatest(least(x2, px2) - greatest(x1, px1), 0)) ELSE 0 END AS tiou,
  floor(x1) AS cx1, ceil(y2) AS cy2
FROM fx_boxes""",
)
def f10(spark, sf):
    b = fx_boxes(spark, sf)
    g = F.array("x1", "y1", "x2", "y2")
    p = F.array("px1", "py1", "px2", "py2")
    cb = B.cell_box(g)
    return b.select(
        "img_id",
        "idx",
        B.iou_plus1(g, p).alias("iou_plus1"),
        B.iou_floor1(g, p).alias("iou_floor1"),
        B.temporal_iou(F.col("x1"), F.col("x2"), F.col("px1"), F.col("px2")).alias("tiou"),
        cb[0].cast("double").alias("cx1"),
        cb[3].cast("double").alias("cy2"),
    )
