"""Registered queries for sources and sinks (S*). Each writes its input files (derived
from the driver's tables) into a fresh folder under the shared checkpoint folder and
reads them back through the operator."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import fx_answers, fx_members, fx_scored, fx_turns, table
from weft.ids import positions
from weft.sources import files as S
from weft.sources import tarshards as TS
from weft.sources.labels import LabelStore

H1 = "('0x' || substr(md5('1|' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT"


@query("s01_read_records", "SELECT doc_id, source, lang FROM documents")
def s01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang")
    root = S.shared_path(spark, "s01")
    arrays = d.filter(F.col("doc_id") % 2 == 0).groupBy(F.floor(F.col("doc_id") / 50).alias("g")).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "source", "lang"))).alias("value")
    )
    arrays.select("value").write.mode("overwrite").text(f"{root}/arrays")
    d.filter(F.col("doc_id") % 2 == 1).write.mode("overwrite").json(f"{root}/lines")
    schema = "doc_id bigint, source string, lang string"
    return S.read_records(spark, f"{root}/arrays", schema).unionByName(S.read_records(spark, f"{root}/lines", schema))


@query(
    "s02_read_write_any",
    "SELECT ext, doc_id::VARCHAR AS doc_id, quality::VARCHAR AS quality FROM labels, (VALUES ('csv'), ('jsonl'), ('parquet'), ('txt')) v(ext)",
)
def s02(spark, sf):
    root = S.shared_path(spark, "s02")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    out = None
    for ext in ("csv", "jsonl", "parquet", "txt"):
        path = f"{root}/labels.{ext}"
        S.write_any(lab.select(F.concat_ws(" ", "doc_id", "quality").alias("value")) if ext == "txt" else lab, path)
        back = S.read_any(spark, path)
        if ext == "txt":
            back = back.select(F.split("value", " ")[0].alias("doc_id"), F.split("value", " ")[1].alias("quality"))
        back = back.select(F.lit(ext).alias("ext"), F.col("doc_id").cast("string"), F.col("quality").cast("string"))
        out = back if out is None else out.unionByName(back)
    return out


@query(
    "s05_read_delimited",
    """SELECT doc_id::VARCHAR AS doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'img/' || doc_id::VARCHAR || '.jpg' ELSE source END AS source,
  'img/' || doc_id::VARCHAR || '.jpg' AS path FROM documents""",
)
def s05(spark, sf):
    d = table(spark, sf, "documents")
    p = F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    line = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("|", F.col("doc_id").cast("string"), "lang", p)).otherwise(
        F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "source", p)
    )
    root = S.shared_path(spark, "s05")
    d.select(line.alias("value")).write.mode("overwrite").text(root)
    return S.read_delimited(spark, root, r"\|", ["doc_id", "lang", "source"])


@query("s07_read_keyed_json", "SELECT event_id::VARCHAR AS key, json_extract(props, '$.k')::BIGINT AS k FROM events")
def s07(spark, sf):
    e = table(spark, sf, "events")
    obj = e.groupBy(F.floor(F.col("event_id") / 100).alias("g")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), F.from_json("props", "struct<k:bigint>"))))).alias("value")
    )
    root = S.shared_path(spark, "s07")
    obj.select("value").write.mode("overwrite").text(root)
    return S.read_keyed_json(spark, root, "struct<k:bigint>").select("key", F.col("value.k").alias("k"))


def _tars(spark, sf):
    root = S.shared_path(spark, "tars")
    m = fx_members(spark, sf).select("shard", F.format_string("%08d", "k").alias("key"), "text", F.col("nbytes").cast("string").alias("n"))
    TS.write_tar_shards(m, "shard", "key", {"txt": "text", "cls": "n"}, root)
    TS.register(spark)
    return root


@query(
    "s08_tar_shard_source",
    "SELECT shard, printf('%08d', k) AS key, length(text) AS txt_len, nbytes::VARCHAR AS cls FROM fx_members",
)
def s08(spark, sf):
    root = _tars(spark, sf)
    r = spark.read.format("tarshards").load(f"{root}/*.tar")
    return r.select(
        F.regexp_extract("__shard__", r"([^/]+)\.tar$", 1).alias("shard"), F.col("__key__").alias("key"), F.length("txt").alias("txt_len"), "cls"
    )


@query("s10_build_shard_index", "SELECT shard AS url, count(DISTINCT k) AS nsamples FROM fx_members GROUP BY shard")
def s10(spark, sf):
    root = _tars(spark, sf)
    idx = TS.build_shard_index(spark, f"{root}/*.tar")
    return idx.select(F.regexp_extract("url", r"([^/]+)\.tar$", 1).alias("url"), "nsamples")


@query(
    "s13_index_info",
    """SELECT count(*) AS shards, sum(n)::BIGINT AS samples, avg(n) AS avg_samples, min(shard) AS first, max(shard) AS last
FROM (SELECT shard, count(*) AS n FROM fx_members GROUP BY shard)""",
)
def s13(spark, sf):
    root = _tars(spark, sf)
    idx = TS.build_shard_index(spark, f"{root}/*.tar").withColumn("url", F.regexp_extract("url", r"([^/]+)\.tar$", 1))
    info = TS.index_info(idx)
    return info.select("shards", F.col("samples").cast("bigint").alias("samples"), "avg_samples", "first", "last")


@query(
    "s14_submission",
    "SELECT question_id::VARCHAR AS question_id, CASE WHEN substr(pred, 1, 1) IN ('a', 'b', 'c', 'r', 's') THEN substr(pred, 1, 1) ELSE '0' END AS answer FROM fx_answers",
)
def s14(spark, sf):
    a = fx_answers(spark, sf).select("question_id", F.substring("pred", 1, 1).alias("answer"))
    sub = S.submission(a, "question_id", "answer", ["a", "b", "c", "r", "s"])
    root = S.shared_path(spark, "s14")
    S.write_csv(sub, root)
    return spark.read.option("header", "true").csv(root)


@query(
    "s15_fixed_shards",
    """WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS row_id, count(*) OVER () AS n FROM fx_scored)
SELECT row_id // 1000 AS part, count(*) AS count FROM r WHERE row_id < (n // 1000) * 1000 GROUP BY 1""",
)
def s15(spark, sf):
    s = positions(fx_scored(spark, sf), ["id"], name="row_id")
    root = S.shared_path(spark, "s15")
    S.write_fixed_shards(s, 1000, root)
    return spark.read.parquet(f"{root}/counts")


@query(
    "s16_equal_shards",
    f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {H1.format(k='doc_id')}, doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, pos // (n // 16) AS shard FROM r WHERE pos < (n // 16) * 16""",
)
def s16(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return S.equal_shards(d, 16, "doc_id", seed=1).select("doc_id", "shard")


@query("s17_filtered_with_counts", "SELECT source, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY source")
def s17(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("lang") == "en").select("doc_id", "source")
    return S.write_filtered_with_counts(d, "source", S.shared_path(spark, "s17"))


@query(
    "s18_assign_shards_to_ranks",
    """WITH i AS (SELECT shard AS name, count(*) AS count FROM fx_members GROUP BY shard),
r AS (SELECT *, (row_number() OVER (ORDER BY name) - 1) // ((SELECT count(*) FROM i) // 3) AS rank FROM i),
k AS (SELECT * FROM r WHERE rank < 3), m AS (SELECT min(s) AS mn FROM (SELECT rank, sum(count) AS s FROM k GROUP BY rank))
SELECT name, count, rank, mn * 3 AS usable, rank * mn AS "offset" FROM k, m""",
)
def s18(spark, sf):
    idx = fx_members(spark, sf).groupBy(F.col("shard").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    return S.assign_shards_to_ranks(idx, 3)


@query(
    "s19_upsert_labels",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels",
)
def s19(spark, sf):
    lab = table(spark, sf, "labels")
    new = lab.filter(F.col("doc_id") % 3 == 0).withColumn("quality", 1 - F.col("quality"))
    return S.upsert_labels(lab, new, "doc_id").select("doc_id", "quality", "toxic")


@query(
    "s19_label_store",
    """WITH s AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 9 WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END AS quality, toxic FROM labels)
SELECT 'map' AS form, * FROM s UNION ALL SELECT 'list', NULL, quality, toxic FROM s UNION ALL SELECT 'first', * FROM labels""",
)
def s19_store(spark, sf):
    """Three saves over one another; the last version comes back from its map and its list, the first by number."""
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    store, copy = (LabelStore(spark, S.shared_path(spark, f"s19-{k}"), "quality bigint, toxic bigint") for k in ("store", "copy"))
    first = store.upsert(lab, "doc_id")
    store.upsert(lab.where("doc_id % 3 = 0").withColumn("quality", 1 - F.col("quality")), "doc_id")
    store.upsert(lab.where("doc_id % 6 = 0").withColumn("quality", F.lit(9)), "doc_id")
    saved = S.shared_path(spark, "s19-saved")
    store.save(saved)
    copy.load(saved)
    rows = lambda form, df: df.select(F.lit(form).alias("form"), F.col("key").cast("bigint").alias("doc_id"), "instance.*")
    instances = spark.read.schema("quality bigint, toxic bigint").json(f"{saved}/instances")
    as_list = instances.select(F.lit("list").alias("form"), F.lit(None).cast("bigint").alias("doc_id"), "quality", "toxic")
    return rows("map", copy.rows()).union(as_list).union(rows("first", store.rows(first)))


@query(
    "s21_read_json_folder",
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels",
)
def s21(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    root = S.shared_path(spark, "s21")
    lab.write.mode("overwrite").json(f"{root}/a")
    lab.filter(F.col("doc_id") % 4 == 0).withColumn("quality", 1 - F.col("quality")).write.mode("overwrite").json(f"{root}/b")
    return S.read_json_folder(spark, f"{root}/*", "doc_id", "doc_id bigint, quality int").select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("s21_append_json_folder", "SELECT doc_id, quality FROM labels")
def s21_append(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    root = S.shared_path(spark, "s21l")
    lists = lab.filter("doc_id % 8 <> 0").groupBy(F.floor(F.col("doc_id") / 50).alias("g")).agg(F.collect_list(F.struct("doc_id", "quality")).alias("l"))
    name = lambda x: F.concat(F.lit(x), F.col("g").cast("string"), F.lit(".json"))
    S.write_files(lists.select(name("list").alias("name"), F.to_json("l").alias("content")), root, "name", "content")
    ones = lab.filter("doc_id % 8 = 0").withColumn("g", F.col("doc_id"))
    S.write_files(ones.select(name("one").alias("name"), F.to_json(F.struct("doc_id", "quality")).alias("content")), root, "name", "content")
    bad = lab.filter("doc_id % 40 = 0").withColumn("g", F.col("doc_id"))
    S.write_files(bad.select(name("bad").alias("name"), F.lit("[{").alias("content")), root, "name", "content")
    return S.append_json_folder(spark, root, "doc_id bigint, quality int")


@query("s22_read_results", "SELECT count(*) AS n FROM labels")
def s22(spark, sf):
    root = S.shared_path(spark, "s22")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    lab.filter("doc_id % 2 = 0").write.mode("overwrite").json(f"{root}/x/y")
    lab.filter("doc_id % 2 = 1").write.mode("overwrite").json(f"{root}/z")
    return S.read_results(spark, root, "doc_id bigint, quality int").agg(F.count(F.lit(1)).alias("n"))


@query("s23_media_bytes", "SELECT doc_id, octet_length(encode(text)) AS nbytes FROM documents")
def s23(spark, sf):
    d = table(spark, sf, "documents")
    b64 = F.when(F.col("doc_id") % 2 == 0, F.base64(F.encode("text", "UTF-8")))
    raw = F.when(F.col("doc_id") % 2 == 1, F.encode("text", "UTF-8"))
    return d.select("doc_id", F.octet_length(S.media_bytes(b64, raw)).cast("bigint").alias("nbytes"))


@query("s25_collate", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM fx_turns GROUP BY conv_id")
def s25(spark, sf):
    t = fx_turns(spark, sf).select("conv_id", F.col("turn").alias("_wf_order"), "role")
    c = S.collate(t, "conv_id", strict=True)
    return c.select("conv_id", F.array_join("role", ",").alias("roles"), F.size("role").cast("bigint").alias("n"))


@query(
    "s11_resolve_index",
    """WITH s AS (SELECT shard, count(*) AS n, CAST(substr(shard, 4) AS INT) AS num FROM fx_members GROUP BY shard)
SELECT num % 4 AS desc_id, CASE WHEN num % 3 = 0 THEN 'http://host/abs/' || shard || '.tar'
    ELSE 'http://host/g' || (num % 4)::VARCHAR || '/' || shard || '.tar' END AS url, n AS nsamples,
  (num % 4 + 1)::DOUBLE AS weight, 'ds' || (num % 4)::VARCHAR AS name, NULL::VARCHAR AS dataset FROM s WHERE num % 2 = 0
UNION ALL SELECT num % 4, 'http://mirror/c/' || shard || '.tar', n, 0.5, NULL, 'comp' || (num % 4)::VARCHAR FROM s WHERE num % 2 = 1""",
)
def s11(spark, sf):
    m = fx_members(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("num", F.substring("shard", 4, 9).cast("int"))
    rel = F.when(F.col("num") % 3 == 0, F.concat(F.lit("/abs/"), "shard", F.lit(".tar"))).otherwise(F.concat("shard", F.lit(".tar")))
    top = m.filter(F.col("num") % 2 == 0).groupBy((F.col("num") % 4).alias("desc_id")).agg(
        F.array_sort(F.collect_list(F.struct(rel.alias("url"), F.col("n").alias("nsamples")))).alias("shardlist"))
    comp = m.filter(F.col("num") % 2 == 1).groupBy((F.col("num") % 4).alias("desc_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.concat("shard", F.lit(".tar")).alias("url"), F.col("n").alias("nsamples")))).alias("cshards"))
    j = top.join(comp, "desc_id", "full")
    desc = F.struct(
        F.lit(1).alias("wids_version"), F.concat(F.lit("ds"), F.col("desc_id").cast("string")).alias("name"),
        (F.col("desc_id") + 1).cast("double").alias("weight"),
        F.concat(F.lit("http://host/g"), F.col("desc_id").cast("string"), F.lit("/")).alias("base"),
        F.coalesce("shardlist", F.array().cast("array<struct<url:string,nsamples:bigint>>")).alias("shardlist"),
        F.array(F.struct(F.concat(F.lit("comp"), F.col("desc_id").cast("string")).alias("name"), F.lit(0.5).alias("weight"),
                         F.lit("http://mirror/c/").alias("base"),
                         F.coalesce("cshards", F.array().cast("array<struct<url:string,nsamples:bigint>>")).alias("shardlist"))).alias("datasets"),
    )
    descs = j.select("desc_id", F.to_json(desc).alias("json"))
    out = TS.resolve_index(descs)
    return out.select(F.col("desc_id").cast("int").alias("desc_id"), "url", "nsamples", "weight", "name", "dataset")


@query(
    "s11_index_closure",
    """WITH s AS (SELECT shard || '.tar' AS f, count(*) AS n, CAST(substr(shard, 4) AS INT) AS num FROM fx_members GROUP BY shard)
SELECT num % 5 AS desc_id, CASE num % 3 WHEN 0 THEN 'http://host/top/' || f WHEN 1 THEN 'http://host/one/data/' || f ELSE 'http://host/two/' || f END AS url, n AS nsamples,
  CASE num % 3 WHEN 0 THEN 2.0 ELSE 0.5 END AS weight, CASE num % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'one' ELSE 'two' END AS dataset,
  CASE num % 3 WHEN 1 THEN 'http://host/one/' || num % 5 || '.json' WHEN 2 THEN 'http://host/two/' || num % 5 || '.json' END AS source_url, NULL::VARCHAR AS error
FROM s WHERE num % 5 < 4
UNION ALL SELECT d, NULL, NULL, NULL, NULL, NULL, 'No shards found' FROM (SELECT unnest([4, 5, 6]) AS d)
UNION ALL SELECT 5, NULL, NULL, NULL, NULL, NULL, 'descriptors refer to each other: http://host/a.json'
UNION ALL SELECT 6, NULL, NULL, NULL, NULL, NULL, 'descriptor not fetched: http://host/lost.json'
UNION ALL SELECT d, NULL, NULL, NULL, NULL, NULL, 'No shards found' FROM range(4) r(d) WHERE d NOT IN (SELECT num % 5 FROM s)""",
)
def s11_closure(spark, sf):
    """Descriptors of three levels whose references and shards go up by ``..``; one is empty, one refers in a circle, one to nothing."""
    m = fx_members(spark, sf).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).withColumn("num", F.substring("shard", 4, 9).cast("int"))
    file, level = F.concat("shard", F.lit(".tar")), F.col("num") % 3
    url = F.when(level == 0, F.concat(F.lit("x/../"), file)).when(level == 1, F.concat(F.lit("data/./"), file)).otherwise(F.concat(F.lit("../two/"), file))
    lists = m.where("num % 5 < 4").groupBy((F.col("num") % 5).alias("d")).agg(
        *[F.array_sort(F.collect_list(F.when(level == k, F.struct(url.alias("url"), F.col("n").alias("nsamples"))))).alias(f"l{k}") for k in range(3)]
    )
    lists = lists.withColumn("l3", F.array().cast("array<struct<url:string,nsamples:bigint>>"))
    lists = spark.range(7).select(F.col("id").cast("int").alias("d")).join(lists, "d", "left")
    none = F.array().cast("array<struct<url:string,nsamples:bigint>>")
    inline_type = "array<struct<source_url:string,weight:double,name:string,base:string,shardlist:array<struct<url:string,nsamples:bigint>>>>"
    own = F.col("d") < 4
    link = lambda x: F.array(F.struct(x.alias("source_url"), F.lit(0.5).alias("weight"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("base"), none.alias("shardlist")))
    there = lambda up: F.concat(F.lit(up), F.col("d").cast("string"), F.lit(".json"))

    def desc(name, k, links, **fields):
        more = [F.lit(v).alias(n) for n, v in fields.items()]
        return F.to_json(F.struct(F.lit(1).alias("wids_version"), F.lit(name).alias("name"), *more, F.coalesce(f"l{k}", none).alias("shardlist"), links.alias("datasets")))

    first = link(F.when(own, there("http://host/top/../one/")).when(F.col("d") == 5, F.lit("http://host/a.json")).otherwise(F.lit("http://host/lost.json")))
    inline = F.array(F.struct(F.lit(None).cast("string").alias("source_url"), F.lit(2.0).alias("weight"), F.lit("top").alias("name"), F.lit("http://host/top").alias("base"), F.coalesce("l0", none).alias("shardlist")))
    links = F.when(F.col("d") == 4, F.array().cast(inline_type)).otherwise(F.concat(inline, first))
    roots = lists.select(F.col("d").alias("desc_id"), desc("root", 3, links).alias("json"))
    second = link(there("../two/"))
    known = lists.where(own).select(there("http://host/one/").alias("url"), desc("one", 1, second).alias("json")).union(
        lists.where(own).select(there("http://host/two/").alias("url"), desc("two", 2, F.array().cast(inline_type)).alias("json"))
    )
    circle = spark.createDataFrame([(f"http://host/{a}.json", json.dumps({"wids_version": 1, "shardlist": [], "datasets": [{"source_url": f"http://host/{b}.json"}]})) for a, b in ("ab", "ba")], "url string, json string")
    out = TS.resolve_index(roots, fetched=known.union(circle), mark=True)
    return out.select("desc_id", "url", "nsamples", "weight", "dataset", "source_url", "error")
