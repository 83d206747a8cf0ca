"""Tar-shard source (S08) as a Python Data Source, and the shard index.

``spark.read.format("tarshards").load(glob)`` gives one input partition per tar file;
a reader task streams its tar, groups members by sample key (base name up to the
first dot), decodes text-like extensions and leaves media as bytes. Members whose
name has no dot are dropped. Unreadable archives yield no rows and are reported by
:func:`build_shard_index` (Q26 fix: skipped, not fatal).
"""

from __future__ import annotations

import glob as _glob
import gzip
import hashlib
import io
import re
import tarfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weft.session import small_batches

SCHEMA = (
    "__shard__ string, __key__ string, __index__ long, txt string, cls string, json string, "
    "media map<string,binary>"
)
TEXT_EXT = ("txt", "cls", "json", "json.gz")


def local_path(uri: str) -> str:
    """A POSIX path for Python file access; ``file:`` URIs are converted. Any other scheme is
    refused: Python would take it for a folder on each executor's own disk. Mount the
    shared store (FUSE, NFS) and give the mounted path."""
    if uri.startswith("file://"):
        return uri[len("file://"):]
    if uri.startswith("file:"):
        return uri[len("file:"):]
    if "://" in uri or re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", uri):
        raise ValueError(f"{uri}: tar shards and file sinks need a mounted POSIX path")
    return uri


def split_name(name: str) -> tuple[str, str] | None:
    """(key, extension) split at the first dot of the base name; None without one."""
    base = name.rsplit("/", 1)[-1]
    if "." not in base:
        return None
    stem, ext = base.split(".", 1)
    prefix = name[: len(name) - len(base)]
    return prefix + stem, ext


class _TarPartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TarShardReader(DataSourceReader):
    def __init__(self, options):
        self.paths = sorted(_glob.glob(local_path(options.get("path", ""))))

    def partitions(self):
        return [_TarPartition(p) for p in self.paths]

    def read(self, partition):
        try:
            tf = tarfile.open(partition.path, "r:*")
        except (tarfile.TarError, OSError):
            return
        cur, fields, idx = None, {}, 0
        with tf:
            while (m := tf.next()) is not None:
                tf.members.clear()  # else the headers of the whole archive are kept
                if not m.isfile():
                    continue
                kv = split_name(m.name)
                if kv is None:
                    continue
                key, ext = kv
                data = tf.extractfile(m).read()
                if cur is not None and key != cur:
                    yield self._row(partition.path, cur, idx, fields)
                    idx += 1
                    fields = {}
                cur = key
                fields[ext] = data
            if cur is not None:
                yield self._row(partition.path, cur, idx, fields)

    @staticmethod
    def _row(shard, key, idx, fields):
        def text(ext):
            if ext not in fields:
                return None
            raw = fields[ext]
            return raw.decode("utf-8", "replace")

        js = text("json")
        if js is None and "json.gz" in fields:
            js = gzip.decompress(fields["json.gz"]).decode("utf-8", "replace")
        media = {k: v for k, v in fields.items() if k not in TEXT_EXT}
        return (shard, key, idx, text("txt"), text("cls"), js, media)


class TarShardSource(DataSource):
    @classmethod
    def name(cls):
        return "tarshards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TarShardReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TarShardSource)


def write_tar_shards(df: DataFrame, shard: str, key: str, members: dict[str, str], root: str) -> None:
    """Write one tar per ``shard`` value from a DataFrame (each task writes the shards
    it holds, rows sorted by key). ``members`` maps extension -> string column."""
    cols = [shard, key, *members.values()]
    exts = list(members.keys())
    root = local_path(root)

    def write(it):
        import os

        name, out, begun = None, None, set()
        os.makedirs(root, exist_ok=True)
        for pdf in it:
            for row in pdf.sort_values([shard, key]).itertuples(index=False):
                sh = str(getattr(row, shard))
                if sh != name:  # rows come by shard, so one archive is open at a time
                    if out is not None:
                        out.close()
                    name, out = sh, tarfile.open(f"{root}/{sh}.tar", "a" if sh in begun else "w")
                    begun.add(sh)
                for ext, col in zip(exts, members.values()):
                    data = str(getattr(row, col)).encode("utf-8")
                    info = tarfile.TarInfo(f"{getattr(row, key)}.{ext}")
                    info.size = len(data)
                    out.addfile(info, io.BytesIO(data))
                    out.members.clear()  # else the headers of the whole archive are kept
        if out is not None:
            out.close()
        yield from ()

    import pandas as pd  # noqa: F401

    small_batches(df.sparkSession)
    df.select(*cols).repartition(shard).sortWithinPartitions(shard, key).mapInPandas(write, "x int").collect()


def build_shard_index(spark: SparkSession, pattern: str) -> DataFrame:
    """Per archive: url, distinct sample keys, byte size and md5, sorted by url;
    unreadable archives are left out. Sizes come from the listing; a digest is taken block
    by block, so an archive never stands in one value."""
    register(spark)
    small_batches(spark)
    listed = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("url_full"), F.col("length").alias("filesize"))

    def digest(batches):
        for pdf in batches:
            yield pdf.assign(md5sum=[_md5(local_path(p)) for p in pdf["url_full"]])

    files = listed.mapInPandas(digest, "url_full string, filesize long, md5sum string")
    rows = spark.read.format("tarshards").load(pattern)
    keys = rows.groupBy("__shard__").agg(F.countDistinct("__key__").alias("nsamples"))
    files = files.withColumn("url", F.regexp_replace("url_full", "^file:", ""))
    return files.join(keys, files.url == keys.__shard__).select("url", "nsamples", "filesize", "md5sum").orderBy("url")


def _md5(path: str, block: int = 1 << 20) -> str:
    found = hashlib.md5()
    with open(path, "rb") as fh:
        while data := fh.read(block):
            found.update(data)
    return found.hexdigest()


def human_size(c) -> F.Column:
    """1234 -> 1.2k, 1234567 -> 1.2M, ... with one decimal."""
    x = c.cast("double")
    return (
        F.when(x >= 1e9, F.format_string("%.1fG", x / 1e9))
        .when(x >= 1e6, F.format_string("%.1fM", x / 1e6))
        .when(x >= 1e3, F.format_string("%.1fk", x / 1e3))
        .otherwise(F.format_string("%.1f", x))
    )


def index_info(index: DataFrame) -> DataFrame:
    """Totals, averages, first/last shard and counts of an index."""
    return index.agg(
        F.count(F.lit(1)).alias("shards"),
        F.sum("nsamples").alias("samples"),
        F.avg("nsamples").alias("avg_samples"),
        F.sum("filesize").alias("bytes"),
        F.min("url").alias("first"),
        F.max("url").alias("last"),
    ).withColumn("bytes_h", human_size(F.col("bytes")))


__all__ = ["TarShardSource", "register", "write_tar_shards", "build_shard_index", "index_info", "split_name", "human_size", "json"]


SHARDS = "array<struct<url:string,nsamples:bigint,weight:double,name:string>>"
COMPONENT = f"struct<name:string,weight:double,base:string,source_url:string,shardlist:{SHARDS}>"
DESC_SCHEMA = f"struct<wids_version:int,name:string,weight:double,base:string,shardlist:{SHARDS},datasets:array<{COMPONENT}>>"

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"


def _folded(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts; what leads above the root of an absolute path is dropped."""
    absolute = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != "..")
        kept = F.when((x == "..") & absolute, acc).otherwise(F.concat(acc, F.array(x)))
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(kept)

    out = F.array_join(F.aggregate(parts, none, step), "/")
    out = F.concat(F.when(absolute, F.lit("/")).otherwise(F.lit("")), out)
    return F.when(out == "", F.lit(".")).otherwise(out)


def rebase(url: Column, base: Column) -> Column:
    """A URL with a scheme is kept; a path from the root takes the scheme and host
    of the base; a relative path is appended to the folder that the base names, and ``.``
    and ``..`` are folded. Without a base the URL stays as it is."""
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]*)", 1)
    folder = F.substr(base, F.length(host) + 1)
    path, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"([?#].*)$", 1)
    joined = F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), path)
    return (
        F.when(base.isNull(), url)
        .when(url.rlike(_SCHEME), url)
        .when(url.startswith("/"), F.concat(host, url))
        .otherwise(F.concat(host, _folded(joined), rest))
    )


def folded_url(url: Column) -> Column:
    """The URL with ``.`` and ``..`` folded in its path, so that all spellings of it compare equal; other URLs as they stand."""
    host = F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(F.substr(url, F.length(host) + 1), r"^([^?#]*)", 1)
    rest = F.substr(url, F.length(host) + F.length(path) + 1)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(host, _folded(path), rest)).otherwise(url)


def url_folder(url: Column) -> Column:
    """The folder part of a URL; query and fragment stay behind."""
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^(.*)/[^/]*$", 1)


def _checked(descs: DataFrame, desc_id: str, json_col: str) -> DataFrame:
    d = descs.select(F.col(desc_id).alias("_wf_root"), F.from_json(json_col, DESC_SCHEMA).alias("d"))
    return d.withColumn("d", F.when(F.col("d.wids_version") == 1, F.col("d")).otherwise(F.raise_error(F.lit("Unknown wids_version")).cast(DESC_SCHEMA)))


def _rows(components: DataFrame) -> DataFrame:
    """One row per shard of (root, base, weight, name, dataset, source, shardlist); a shard's own weight and name stay."""
    s = components.select("_wf_root", "base", "weight", "name", "dataset", "source", F.explode("shardlist").alias("s"))
    return s.select(
        "_wf_root", rebase(F.col("s.url"), F.col("base")).alias("url"), F.col("s.nsamples").alias("nsamples"), F.coalesce("s.weight", "weight").alias("weight"),
        F.coalesce("s.name", "name").alias("name"), "dataset", F.col("source").alias("source_url"),
    )


def resolve_index(descs: DataFrame, desc_id: str = "desc_id", json_col: str = "json", fetched: DataFrame | None = None, mark: bool = False) -> DataFrame:
    """One row per shard of each descriptor: top-level shards rebased on the
    descriptor base and given its weight and name; each component's shards rebased on
    the component base, given the component weight and its name as ``dataset``.

    A component with a ``source_url`` stands for the descriptor of that URL in ``fetched``
    (``url``, ``json``; reading them is the caller's part). Its shards have the weight of the
    reference, and the folder of the URL as a base unless it names one. Its own components
    are resolved in turn until none is left, each level by a join of all roots at once;
    a weight that a nested reference lacks is that of the outer one.

    References that come back to a URL of their own path, a URL that was not fetched, and a
    descriptor without any shard fail the job. With ``mark`` they are rows with an ``error``
    and no URL instead. An unknown ``wids_version`` always fails it.
    """
    text = F.lit(None).cast("string")
    d = _checked(descs, desc_id, json_col)
    shards = _rows(d.select("_wf_root", "d.base", "d.weight", "d.name", text.alias("dataset"), text.alias("source"), F.col("d.shardlist").alias("shardlist")))
    start = {"outer": F.lit(None).cast("double"), "within": text, "trail": F.array().cast("array<string>")}
    nested = d.select("_wf_root", F.explode("d.datasets").alias("c"), *[v.alias(k) for k, v in start.items()])
    known = None
    if fetched is not None:
        known = _checked(fetched.select(folded_url(F.col("url")).alias("url"), "json"), "url", "json").select(F.col("_wf_root").alias("at"), "d", F.lit(True).alias("known"))
    faults = None
    weight = F.coalesce("c.weight", "outer").alias("weight")
    while True:
        inline = nested.where(F.col("c.source_url").isNull())
        base = F.coalesce("c.base", "within").alias("base")
        shards = shards.union(_rows(inline.select("_wf_root", base, weight, text.alias("name"), F.col("c.name").alias("dataset"), text.alias("source"), "c.shardlist")))
        linked = nested.where(F.col("c.source_url").isNotNull()).withColumn("at", folded_url(rebase(F.col("c.source_url"), F.col("within"))))
        if linked.isEmpty():
            break
        if known is None:
            raise ValueError("descriptors refer to others; pass those as fetched")
        reached = linked.join(known, "at", "left")
        fault = F.when(F.array_contains("trail", F.col("at")), F.concat(F.lit("descriptors refer to each other: "), "at")).when(
            F.col("known").isNull(), F.concat(F.lit("descriptor not fetched: "), "at")
        )
        reached = reached.withColumn("fault", fault if mark else F.when(fault.isNotNull(), F.raise_error(fault).cast("string")))
        base = F.coalesce("d.base", url_folder(F.col("at"))).alias("base")
        columns = ["d.name", F.col("at").alias("source"), F.col("d.shardlist").alias("shardlist"), F.col("d.datasets").alias("datasets"), "trail", "fault"]
        reached = reached.select("_wf_root", base, weight, *columns).checkpoint()  # read by the rows and by the next level
        faulty = reached.where("fault is not null").select("_wf_root", "fault")
        faults = faulty if faults is None else faults.union(faulty)
        reached = reached.where("fault is null")
        shards = shards.union(_rows(reached.select("_wf_root", "base", "weight", text.alias("name"), F.col("name").alias("dataset"), "source", "shardlist")))
        nested = reached.select("_wf_root", F.explode("datasets").alias("c"), F.col("weight").alias("outer"), F.col("base").alias("within"), F.concat("trail", F.array("source")).alias("trail"))
    counted = d.select("_wf_root").join(shards.groupBy("_wf_root").agg(F.count(F.lit(1)).alias("n")), "_wf_root", "left")
    none = counted.where(F.col("n").isNull()).select("_wf_root", F.lit("No shards found").alias("fault"))
    if mark:
        none = none if faults is None else none.union(faults)
        out = shards.withColumn("error", text).unionByName(none.withColumnRenamed("fault", "error"), allowMissingColumns=True)
    else:
        failing = none.select("_wf_root", F.raise_error(F.col("fault")).cast("string").alias("url"))
        out = shards.unionByName(failing, allowMissingColumns=True)
    return out.withColumnRenamed("_wf_root", desc_id)
