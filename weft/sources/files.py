"""File sources and sinks.

All readers are ``spark.read`` formats (json, text, parquet, binaryFile) with schema,
path filters and recursive lookup; all writers are ``DataFrame.write`` with
``partitionBy``. Shard plans are computed from positions (:mod:`weft.ids`) so the
written parts do not depend on how Spark partitioned the rows.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.ids import keyed_hash, positions
from weft.session import ensure_checkpoint_dir
from weft.sources import jsonparts

#: Bytes of files that a task reads before it passes them on.
_BATCH_BYTES = 8_000_000


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-array files, with a JSON-lines fallback decided per file: a file whose
    text starts with ``[`` is an array, any other is read line by line. Both are read by
    byte ranges, an array with the states that :mod:`weft.sources.jsonparts` carries over.
    Elements that are no objects, and empty lines, are left out."""
    ranges = jsonparts.ranges(spark, path)
    signs = jsonparts.first_signs(ranges)
    arrays, lines = [f for f, c in signs.items() if c == "["], [f for f, c in signs.items() if c not in ("[", "")]
    texts = spark.createDataFrame([], "text string")
    if arrays:
        texts = jsonparts.elements(spark, arrays, ranges).where(F.ltrim("text").startswith("{")).select("text")
    if lines:
        texts = texts.union(spark.read.text(lines).where(F.trim("value") != ""))
    return texts.select(F.from_json("text", f"struct<{schema}>").alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): text lines with their 0-based number in their file.

    Lines are numbered where they are read, by byte range; the ranges of a file add up by
    a table of one row a range, like the driver's own list of splits. No line is sorted.
    """
    scan = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_wf_block"), F.monotonically_increasing_id().alias("_wf_mid"), "value"
    )
    ranges = scan.groupBy("file", "_wf_block").agg(F.count(F.lit(1)).alias("_wf_n"), F.min("_wf_mid").alias("_wf_first"))
    earlier = Window.partitionBy("file").orderBy("_wf_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("file", "_wf_block", "_wf_first", F.coalesce(F.sum("_wf_n").over(earlier), F.lit(0)).alias("_wf_start"))
    numbered = scan.join(F.broadcast(starts), ["file", "_wf_block"])
    return numbered.select("file", (F.col("_wf_start") + F.col("_wf_mid") - F.col("_wf_first")).alias("line"), "value")


# Longest matching extension wins (fixed values: the supported suffixes).
FORMATS = [(".jsonl", "jsonl"), (".json", "json"), (".txt", "text"), (".parquet", "parquet"), (".csv", "csv")]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch on the longest matching extension."""
    for ext, fmt in sorted(FORMATS, key=lambda x: -len(x[0])):
        if path.endswith(ext):
            if fmt == "jsonl":
                return spark.read.json(path)
            if fmt == "json":
                return spark.read.option("multiLine", "true").json(path)
            if fmt == "text":
                return spark.read.text(path)
            if fmt == "csv":
                return spark.read.option("header", "true").csv(path)
            return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def write_any(df: DataFrame, path: str) -> None:
    """Write by extension (json lines for .json/.jsonl, text for .txt)."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith(".txt"):
        df.write.mode("overwrite").text(path)
    elif path.endswith(".csv"):
        df.write.mode("overwrite").option("header", "true").csv(path)
    else:
        df.write.mode("overwrite").json(path)


def discover(spark: SparkSession, root: str, suffix: str | None = None, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """Folders under ``root`` (one level) kept by a name suffix rule, an allow
    list and a deny list; listed with ``binaryFile`` without reading any bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    folders = files.select(F.split(rel, "/").getItem(0).alias("folder")).distinct()
    if suffix:
        folders = folders.filter(F.col("folder").endswith(suffix))
    if allow:
        folders = folders.filter(F.col("folder").isin(list(allow)))
    if deny:
        folders = folders.filter(~F.col("folder").isin(list(deny)))
    return folders


def read_delimited(spark: SparkSession, path: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Text lines split on ``sep``; optional trailing fields may be missing; the
    last field is always the path."""
    parts = F.split(F.col("value"), sep, -1)
    cols = [F.get(parts, i).alias(n) for i, n in enumerate(names)]
    return spark.read.text(path).select(*cols, F.element_at(parts, -1).alias("path"))


def read_sidecars(spark: SparkSession, media: DataFrame, folder: str, schema: str) -> DataFrame:
    """One JSON annotation file per media file (same stem); missing or invalid
    JSON is skipped (PERMISSIVE parse, nulls dropped, inner join on the stem)."""
    raw = spark.read.option("wholetext", "true").text(folder)
    # invalid JSON has no object keys; such files are skipped
    raw = raw.filter(F.json_object_keys("value").isNotNull())
    side = raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("stem"), F.from_json("value", schema).alias("ann")
    )
    return media.join(side, "stem")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """A JSON object keyed by id -> one row per (key, value). A file is read by byte
    ranges; each member is parsed by itself, so a key that stands twice gives two rows."""
    member = F.concat(F.lit("{"), F.col("text"), F.lit("}"))
    parsed = F.from_json(member, f"map<string,{value_schema}>")
    return jsonparts.elements(spark, path).select(F.explode(parsed).alias("key", "value"))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(folder, name) of all files below a mounted folder, listed by tasks, a level of folders at a
    time, so the driver holds no list of files. Hidden names are left out, as Spark's readers do."""
    from weft.sources.tarshards import local_path

    def run(batches):
        for pdf in batches:
            for folder in pdf["folder"]:
                rows = []
                with os.scandir(folder) as entries:
                    for e in entries:
                        if not _hidden(e.name):
                            rows.append((folder, e.name, e.is_dir()))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["folder", "name", "is_dir"])
                            rows = []
                yield pd.DataFrame(rows, columns=["folder", "name", "is_dir"])

    ensure_checkpoint_dir(spark)
    top = local_path(root).rstrip("/") or "/"
    level, files = spark.createDataFrame([(top,)], "folder string"), None
    while True:
        found = level.mapInPandas(run, "folder string, name string, is_dir boolean").checkpoint()
        here = found.where("not is_dir").select("folder", "name")
        files = here if files is None else files.union(here)
        level = found.where("is_dir").select(F.concat(F.regexp_replace("folder", "/$", ""), F.lit("/"), "name").alias("folder"))
        if level.isEmpty():
            return files
        level = level.repartition("folder")


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def read_caption_dir(spark: SparkSession, root: str) -> DataFrame:
    """Extracted-archive folder: ``stem.txt`` captions next to ``stem.jpg`` media;
    rows are stems that have both in the same folder. Captions and media meet by their
    names, before a file is read, so equal stems of two folders stay apart."""
    names = list_files(spark, root).select("folder", F.regexp_extract("name", r"^(.+)\.[^.]+$", 1).alias("stem"), F.substring_index("name", ".", -1).alias("ext"))
    has = [F.max(F.col("ext") == e).alias(e) for e in ("txt", "jpg")]
    pairs = names.where(F.col("ext").isin("txt", "jpg") & (F.col("stem") != "")).groupBy("folder", "stem").agg(*has).where("txt and jpg")

    def content(path: str) -> bytes:
        with open(path, "rb") as fh:
            return fh.read()

    def run(batches):
        for pdf in batches:
            rows, size = [], 0
            for folder, stem in zip(pdf["folder"], pdf["stem"]):
                caption, media = (content(f"{folder}/{stem}.{e}") for e in ("txt", "jpg"))
                rows.append((stem, caption, media))
                size += len(caption) + len(media)
                if size > _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["stem", "caption", "media_bytes"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["stem", "caption", "media_bytes"])

    read = pairs.select("folder", "stem").mapInPandas(run, "stem string, caption binary, media_bytes binary")
    return read.select("stem", F.decode("caption", "UTF-8").alias("caption"), "media_bytes")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON-lines result sink."""
    df.write.mode("overwrite").json(path)


def submission(df: DataFrame, key: str, answer: str, valid: Sequence[str], default: str = "0") -> DataFrame:
    """Submission rows: an answer outside ``valid`` becomes ``default``."""
    return df.select(key, F.when(F.col(answer).isin(list(valid)), F.col(answer)).otherwise(F.lit(default)).alias(answer))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def fixed_shards(df: DataFrame, n: int, row_id: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Parts of exactly ``n`` rows by position (``part = row_id div n``); the
    short tail is dropped (Q9 kept). Returns (rows with ``part``, per-part counts)."""
    total = df.agg(F.count(F.lit(1)).alias("_wf_n"))
    d = df.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")
    d = d.filter(F.col(row_id) < F.floor(F.col("_wf_n") / n) * n).withColumn("part", F.floor(F.col(row_id) / n).cast("bigint")).drop("_wf_n")
    return d, d.groupBy("part").agg(F.count(F.lit(1)).alias("count"))


def write_fixed_shards(df: DataFrame, n: int, path: str, row_id: str = "row_id") -> None:
    rows, counts = fixed_shards(df, n, row_id)
    rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/data")
    counts.write.mode("overwrite").parquet(f"{path}/counts")


def equal_shards(df: DataFrame, k: int, key: str, seed: int = 1) -> DataFrame:
    """Shuffle by keyed hash (seed), then k equal shards of floor(N/k) rows; the
    remainder is dropped. Q10 fix: fewer rows than shards is an error."""
    pos = positions(df.withColumn("_wf_h", keyed_hash(seed, key)), ["_wf_h", key], name="_wf_pos")
    total = df.agg(F.count(F.lit(1)).alias("_wf_n"))
    d = pos.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").drop("_k")
    size = F.floor(F.col("_wf_n") / k)
    d = d.withColumn("_wf_size", F.when(size > 0, size).otherwise(F.raise_error(F.lit("fewer rows than shards")).cast("bigint")))
    d = d.filter(F.col("_wf_pos") < F.col("_wf_size") * k).withColumn("shard", F.floor(F.col("_wf_pos") / F.col("_wf_size")).cast("bigint"))
    return d.drop("_wf_h", "_wf_pos", "_wf_n", "_wf_size")


def write_filtered_with_counts(df: DataFrame, shard: str, path: str) -> DataFrame:
    """Per-shard output folders and a per-shard count table."""
    df.write.mode("overwrite").partitionBy(shard).parquet(f"{path}/data")
    counts = df.groupBy(shard).agg(F.count(F.lit(1)).alias("count"))
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    return counts


def assign_shards_to_ranks(index: DataFrame, world: int, name: str = "name", count: str = "count") -> DataFrame:
    """Shards sorted by name, ``n_shards div world`` per rank (extra shards
    unused); usable rows = min rows over ranks x world; ``offset`` = rank x that min.
    The index is one row per shard (a file listing), so one ordered window is fine."""
    from pyspark.sql import Window

    n_sh = index.agg(F.count(F.lit(1)).alias("_wf_s"))
    d = index.withColumn("_wf_i", F.row_number().over(Window.orderBy(name)) - 1)
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(n_sh.withColumn("_k", F.lit(1))), "_k").drop("_k")
    per = F.floor(F.col("_wf_s") / world)
    d = d.withColumn("rank", F.floor(F.col("_wf_i") / per).cast("bigint")).filter(F.col("rank") < world)
    ranks = d.groupBy("rank").agg(F.sum(count).alias("rank_rows"))
    m = ranks.agg(F.min("rank_rows").alias("_wf_min"))
    d = d.withColumn("_k", F.lit(1)).join(F.broadcast(m.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return d.select(name, count, "rank", (F.col("_wf_min") * world).alias("usable"), (F.col("rank") * F.col("_wf_min")).alias("offset"))


def upsert_labels(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keyed label store: new rows replace stored rows with the same key."""
    s = store.withColumn("_wf_v", F.lit(0))
    n = new.withColumn("_wf_v", F.lit(1))
    u = s.unionByName(n, allowMissingColumns=True)
    cols = [c for c in u.columns if c not in (key, "_wf_v")]
    return u.groupBy(key).agg(F.max_by(F.struct(*cols), "_wf_v").alias("_r")).select(key, "_r.*")


def read_json_folder(spark: SparkSession, folder: str, key: str, schema: str) -> DataFrame:
    """Merge a folder of JSON-lines files keyed by ``key``: later files (sorted by
    name) update earlier ones; unreadable lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder).withColumn("_wf_file", F.col("_metadata.file_path"))
    cols = [c for c in df.columns if c not in (key, "_wf_file")]
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), "_wf_file").alias("_r")).select(key, "_r.*")


def append_json_folder(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """S21, list form: all records of a folder's JSON files one after the other; a file
    holds a list of records or one record, and an unreadable file is skipped."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(folder)


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Every JSON file under a folder tree."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)


def media_bytes(b64: Column | str, raw: Column | str) -> Column:
    """base64 text decoded to bytes, else the raw bytes passed through."""
    b = F.col(b64) if isinstance(b64, str) else b64
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.unbase64(b), r)


def collate(df: DataFrame, batch: str, strict: bool = False) -> DataFrame:
    """Column-wise collate: every leaf becomes the list of its values in the batch
    (nested structs keep their shape). ``strict`` fails when a leaf is missing (null)
    in some row. The batch is a bounded group (a training batch)."""
    cols = [c for c in df.columns if c not in (batch, "_wf_order")]
    order = "_wf_order" if "_wf_order" in df.columns else cols[0]
    aggs = []
    for c in cols:
        lst = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("v")))), lambda x: x["v"])
        if strict:
            lst = F.when(F.exists(lst, lambda v: v.isNull()), F.raise_error(F.lit(f"Conflict at {c}"))).otherwise(lst)
        aggs.append(lst.alias(c))
    return df.groupBy(batch).agg(*aggs)


def shared_path(spark: SparkSession, name: str) -> str:
    from weft.streaming.jobs import work_dir

    return work_dir(spark, name)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("os", "pd", "annotations")]


def write_files(df: DataFrame, root: str, name: str, content: str) -> None:
    """One file per row (``root/<name>``) written by the executors holding the rows;
    ``content`` is a string or binary column. Needs a POSIX-visible shared folder."""
    from weft.sources.tarshards import local_path

    base = local_path(root)

    def write(it):
        import os

        os.makedirs(base, exist_ok=True)
        for pdf in it:
            for fname, data in zip(pdf[name], pdf[content]):
                os.makedirs(os.path.dirname(os.path.join(base, fname)), exist_ok=True)
                mode = "wb" if isinstance(data, (bytes, bytearray)) else "w"
                with open(os.path.join(base, fname), mode) as fh:
                    fh.write(data)
        yield from ()

    df.select(name, content).mapInPandas(write, "x int").collect()
