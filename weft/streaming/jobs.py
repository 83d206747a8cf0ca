"""Structured Streaming jobs.

Streams read files from a landing folder; every checkpoint and output table lives
under the session's shared checkpoint folder (``spark.checkpoint.dir``), never in a
machine-local temporary folder, so a restarted query resumes after executor or driver
loss. Each helper runs its query to completion with ``availableNow`` and returns the
sink read back as a batch DataFrame.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.windows import pack_onward
from weft.session import ensure_checkpoint_dir
from weft.sources.versions import KeyedTable


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex[:12]}"


def land(df: DataFrame, root: str, by: str | None = None, whole: bool = True) -> str:
    """Write ``df`` as parquet files a stream can pick up. With ``by`` each value has files of
    its own: a single one if ``whole`` (one shard per source, written by one task), else one
    from each task that holds rows of it, without an exchange."""
    w = df.repartition(by) if by and whole else df
    w = w.sortWithinPartitions(by) if by else w
    (w.write.partitionBy(by) if by else w.write).mode("overwrite").parquet(root)
    return root


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run what has landed to its end; the next call with the checkpoint goes on from there."""
    sink = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
    sink.trigger(availableNow=True).start().awaitTermination()


def stream_pack_constant(spark: SparkSession, waves: Iterable[DataFrame], seq_len: int) -> DataFrame:
    """Constant-length packing of an unbounded stream of (source, doc_id, tokens).

    A source goes on where the last micro-batch left it: its state, one row in a
    :class:`KeyedTable`, is the tokens that didn't fill an example and the number of the
    next one. So examples don't depend on the files or batches a source arrives in, only on
    its order: by arrival, and by ``doc_id`` in a micro-batch. Each of ``waves`` lands in
    turn, in as many files as its tasks write. Within a batch the work of a source is
    spread by running sums; the last tail, an unfinished example, stays in the state.
    A batch's folder is overwritten when the batch is retried.
    """
    landing, out, checkpoint = (work_dir(spark, f"t01-{x}") for x in ("in", "out", "ckpt"))
    schema = "source string, doc_id long, tokens array<int>"
    state = KeyedTable(spark, work_dir(spark, "t01-state"), "source string, tail array<int>, next long", ["source"])

    def each(batch: DataFrame, batch_id: int) -> None:
        pieces = pack_onward(batch, state.load(before=batch_id), "tokens", "source", "doc_id", seq_len).withColumn("whole", F.size("input_ids") == seq_len)
        pieces.write.mode("overwrite").partitionBy("whole").parquet(f"{out}/batch_id={batch_id}")
        pieces = spark.read.schema("source string, chunk long, input_ids array<int>").parquet(f"{out}/batch_id={batch_id}/whole=false")
        state.upsert(pieces.select("source", F.col("input_ids").alias("tail"), F.col("chunk").alias("next")), batch_id)

    for wave in waves:
        wave.select("source", "doc_id", "tokens").write.mode("append").parquet(landing)
        _run(spark.readStream.schema(schema).parquet(landing), each, checkpoint)
    found = spark.read.schema("source string, chunk long, input_ids array<int>, whole boolean, batch_id long").parquet(out)
    return found.where("whole").select("source", "chunk", "input_ids")


def stream_moments(spark: SparkSession, landing: str, schema, value: str) -> DataFrame:
    """Running mean / std / count over all batches (complete-mode aggregate; the
    state is three partial sums per key, merged across micro-batches). Each batch commits
    a version of the result; a reader sees the latest whole one."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    agg = src.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    out = KeyedTable(spark, work_dir(spark, "t02-out"), agg.schema, agg.columns)

    def each(batch: DataFrame, batch_id: int) -> None:
        out.replace(batch, batch_id)
        out.vacuum()

    _run(agg, each, work_dir(spark, "t02-ckpt"), "complete")
    return out.load()


def stream_prompt_advantages(spark: SparkSession, batches: Iterable[DataFrame], buffer: int = 16, min_count: int = 4) -> DataFrame:
    """Per-prompt advantages over a bounded buffer of rewards, kept across micro-batches.

    Each of ``batches`` (prompt, step, reward) lands in turn and is one micro-batch. A
    prompt's buffer takes the batch's rewards in step order and keeps the last ``buffer``
    ones. With at least ``min_count`` rewards in it, its mean and population deviation
    normalise the prompt's rewards; otherwise those of the whole micro-batch do.

    Buffers stand in a :class:`KeyedTable`: a batch writes those of its own prompts, not
    those of all prompts seen. Of a prompt's new rows only the last ``buffer`` are gathered
    (a rank filter), so a hot prompt never stands in one row. Results are a table by batch
    number, overwritten when a batch is retried.
    """
    landing, out, checkpoint = (work_dir(spark, f"t03-{x}") for x in ("in", "out", "ckpt"))
    schema = "prompt string, step long, reward double"
    state = KeyedTable(spark, work_dir(spark, "t03-state"), "prompt string, rewards array<double>", ["prompt"])

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = Window.partitionBy("prompt").orderBy(F.col("step").desc(), F.col("reward").desc())
        fresh = batch.withColumn("_wf_rn", F.row_number().over(newest)).where(F.col("_wf_rn") <= buffer)
        fresh = fresh.groupBy("prompt").agg(F.array_sort(F.collect_list(F.struct("step", "reward"))).alias("_wf_new"))
        none = F.array().cast("array<double>")
        both = F.concat(F.coalesce("rewards", none), F.transform("_wf_new", lambda x: x["reward"]))
        last = F.slice(both, F.greatest(F.size(both) - buffer + 1, F.lit(1)), F.lit(buffer))
        buffers = fresh.join(state.load(before=batch_id), "prompt", "left").select("prompt", last.alias("rewards"))
        whole = batch.agg(F.avg("reward").alias("_wf_mean"), F.stddev_pop("reward").alias("_wf_std")).withColumn("_wf_one", F.lit(1))
        mean = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x) / F.size("rewards")
        std = F.sqrt(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size("rewards"))
        buffers = buffers.checkpoint()
        j = batch.withColumn("_wf_one", F.lit(1)).join(F.broadcast(whole), "_wf_one").join(buffers, "prompt")
        enough = F.size("rewards") >= min_count
        mean, std = F.when(enough, mean).otherwise(F.col("_wf_mean")), F.when(enough, std).otherwise(F.col("_wf_std"))
        j = j.select("prompt", "step", "reward", ((F.col("reward") - mean) / (std + 1e-6)).alias("advantage"), F.size("rewards").cast("long").alias("buffered"))
        j.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        state.upsert(buffers, batch_id)

    for batch in batches:
        # the query stops and resumes from its checkpoint, so each landing is one micro-batch
        batch.select(F.col("prompt").cast("string"), F.col("step").cast("long"), F.col("reward").cast("double")).write.mode("append").parquet(landing)
        _run(spark.readStream.schema(schema).parquet(landing), each, checkpoint)
    return spark.read.parquet(out).drop("batch")


def stream_incremental_eval(spark: SparkSession, waves: Iterable[DataFrame], key: str, score: str, group: str, seen: str, horizon: str) -> DataFrame:
    """Result files arrive over time, an id already seen is ignored, and the metrics
    table is refreshed each batch.

    An id is remembered for ``horizon`` after its time ``seen`` and then expires, so the state holds
    the ids of that span and not of all history; the same id within it counts once. Metrics
    are sums by group in a :class:`KeyedTable`: a batch adds to the groups it has, and
    commits a version, so a reader always finds a whole one. Each of ``waves`` lands in turn.
    """
    landing, checkpoint = (work_dir(spark, f"t04-{x}") for x in ("in", "ckpt"))
    state = KeyedTable(spark, work_dir(spark, "t04-out"), "_wf_group string, total double, n long", ["_wf_group"])

    def each(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy(F.col(group).alias("_wf_group")).agg(F.sum(score).alias("_wf_sum"), F.count(score).alias("_wf_n"))
        old = state.load(before=batch_id).select(F.col("_wf_group").alias("_wf_old"), "total", "n")
        joined = added.join(old, F.col("_wf_group").eqNullSafe(F.col("_wf_old")), "left")
        total = F.coalesce("total", F.lit(0.0)) + F.coalesce("_wf_sum", F.lit(0.0))
        state.upsert(joined.select("_wf_group", total.alias("total"), (F.coalesce("n", F.lit(0)) + F.col("_wf_n")).alias("n")), batch_id)
        state.vacuum()

    schema = None
    for wave in waves:
        wave = wave.select(key, score, group, seen)
        schema = schema or wave.schema
        wave.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        _run(stream.withWatermark(seen, horizon).dropDuplicatesWithinWatermark([key]), each, checkpoint)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return state.load().select(F.col("_wf_group").alias(group), mean.alias("mean_score"), "n")
