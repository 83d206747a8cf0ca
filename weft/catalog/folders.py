"""Registered queries for folder sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.catalog import query
from weft.fixtures import table
from weft.sources import files as S


@query(
    "s04_discover",
    """SELECT DISTINCT CASE WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN source || '_data' ELSE source END AS folder FROM documents
WHERE CAST(substr(source, 4) AS INT) % 2 = 0 AND source <> 'src4'""",
)
def s04(spark, sf):
    d = table(spark, sf, "documents")
    num = F.substring("source", 4, 10).cast("int")
    folder = F.when(num % 2 == 0, F.concat("source", F.lit("_data"))).otherwise(F.col("source"))
    root = S.shared_path(spark, "s04")
    files = d.select(F.concat(folder, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("lang").alias("content"))
    S.write_files(files, root, "name", "content")
    return S.discover(spark, root, suffix="_data", deny=["src4_data"])


@query(
    "s06_read_sidecars",
    "SELECT 'd' || doc_id::VARCHAR AS stem, quality FROM labels WHERE doc_id % 5 <> 0",
)
def s06(spark, sf):
    lab = table(spark, sf, "labels")
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct("quality")))
    root = S.shared_path(spark, "s06")
    S.write_files(lab.select(F.concat(stem, F.lit(".json")).alias("name"), body.alias("content")), root, "name", "content")
    media = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"))
    return S.read_sidecars(spark, media, root, "quality int").select("stem", F.col("ann.quality").alias("quality"))


@query(
    "s09_read_caption_dir",
    "SELECT 'c' || doc_id::VARCHAR AS stem, source AS caption, octet_length(encode(lang)) AS nbytes FROM documents WHERE doc_id % 4 <> 3",
)
def s09(spark, sf):
    d = table(spark, sf, "documents")
    stem = F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    root = S.shared_path(spark, "s09")
    txt = d.select(F.concat(stem, F.lit(".txt")).alias("name"), F.col("source").alias("content"))
    jpg = d.filter(F.col("doc_id") % 4 != 3).select(F.concat(stem, F.lit(".jpg")).alias("name"), F.encode("lang", "UTF-8").alias("content"))
    S.write_files(txt, root, "name", "content")
    S.write_files(jpg, root, "name", "content")
    out = S.read_caption_dir(spark, root)
    return out.select("stem", "caption", F.octet_length("media_bytes").cast("bigint").alias("nbytes"))
