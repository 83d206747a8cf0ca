"""Position-based plans (W01–W10, W15, W18–W20) and top-k.

Positions come from :func:`weft.ids.positions` / :func:`weft.ids.prefix_sum` (range
exchange on the full key + checkpoint + small offset table), never from a window
without a partition. Chunk/shard plans are arithmetic on ``row_id`` against one global
count, which is a single partial aggregate joined back as one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.ids import keyed_hash, positions, positions_by_key, prefix_sum, prefix_sums
from weft.operators.selection import select_top


def _one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.withColumn("_wf_k", F.lit(1)).join(F.broadcast(one.withColumn("_wf_k", F.lit(1))), "_wf_k").drop("_wf_k")


def with_count(df: DataFrame, name: str = "_wf_n") -> DataFrame:
    return _one_row(df, df.agg(F.count(F.lit(1)).alias(name)))


def reassign_ids(df: DataFrame, dataset_order: str, row_order: Sequence[str], name: str = "id") -> DataFrame:
    """Consecutive ids over the concatenation (datasets in ``dataset_order``, rows
    in ``row_order`` inside each, which is unique there). Q5 fix: ids are reassigned, never
    offset by a filtered count."""
    return positions_by_key(df, [dataset_order, *row_order], [dataset_order, *row_order], name=name)


def shard_position(df: DataFrame, shard: str, order: Sequence[str], name: str = "shard_idx") -> DataFrame:
    """0-based position within the shard (skew-safe for a hot shard); ``order`` is
    unique there."""
    return positions_by_key(df, [shard, *order], list(order), partition=[shard], name=name)


def group_n(df: DataFrame, n: int, row_id: str = "row_id", value: str = "value") -> DataFrame:
    """Groups of ``n`` consecutive rows; a short tail group is dropped."""
    g = df.withColumn("group", F.floor(F.col(row_id) / n)).groupBy("group").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(row_id, value))), lambda x: x[value]).alias("items")
    )
    return g.filter(F.size("items") == n)


def linspace_sample(df: DataFrame, m: int, row_id: str = "row_id") -> DataFrame:
    """Rows at ``int(linspace(0, N-1, m))``; an index repeats when m > N. The m
    indices are a distributed ``range`` joined on the row id."""
    spark = df.sparkSession
    n = df.agg(F.count(F.lit(1)).alias("_wf_n"))
    idx = _one_row(spark.range(m).withColumnRenamed("id", "sample_idx"), n)
    step = (F.col("_wf_n") - 1) / F.lit(float(max(m - 1, 1)))
    pos = F.when(F.col("sample_idx") == m - 1, F.col("_wf_n") - 1).otherwise(F.floor(F.col("sample_idx") * step))
    idx = idx.select("sample_idx", pos.cast("bigint").alias(row_id))
    return df.join(idx, row_id)


def chunk_last_rest(df: DataFrame, k: int, row_id: str = "row_id", name: str = "chunk") -> DataFrame:
    """K contiguous chunks of N div k rows, the last takes the remainder."""
    d = with_count(df)
    size = F.greatest(F.floor(F.col("_wf_n") / k), F.lit(1))
    return d.withColumn(name, F.least(F.floor(F.col(row_id) / size), F.lit(k - 1))).drop("_wf_n")


def chunk_ceil(df: DataFrame, k: int, row_id: str = "row_id", name: str = "chunk") -> DataFrame:
    """Chunks of ceil(N / k) rows."""
    d = with_count(df)
    return d.withColumn(name, F.floor(F.col(row_id) / F.ceil(F.col("_wf_n") / k))).drop("_wf_n")


def stride_split(df: DataFrame, k: int, row_id: str = "row_id", name: str = "rank") -> DataFrame:
    """``rows[rank::k]``."""
    return df.withColumn(name, F.col(row_id) % k)


def balanced_split(df: DataFrame, k: int, zigzag: bool = False, row_id: str = "row_id", name: str = "rank") -> DataFrame:
    """K contiguous chunks, the first N % k get one extra row. ``zigzag`` splits
    into 2k chunks and gives rank i the chunks i and 2k-1-i."""
    parts = 2 * k if zigzag else k
    d = with_count(df)
    base = F.floor(F.col("_wf_n") / parts)
    r = F.col("_wf_n") % parts
    big = r * (base + 1)
    chunk = F.when(F.col(row_id) < big, F.floor(F.col(row_id) / (base + 1))).otherwise(
        r + F.floor((F.col(row_id) - big) / F.greatest(base, F.lit(1)))
    )
    if zigzag:
        chunk = F.when(chunk < k, chunk).otherwise(2 * k - 1 - chunk)
    return d.withColumn(name, chunk.cast("bigint")).drop("_wf_n")


def pad_to_batch(df: DataFrame, batch: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Pad a dataset to a multiple of the global batch size: replicate ``batch // N``
    times when that is at least 2, then add ``residual`` rows picked by keyed hash (a
    sampling step: top-r by hash with r < batch). Q8 kept: an exact fit after
    replication adds one more full batch. ``copy`` marks the replica."""
    n = df.count()
    if n == 0:
        return df.withColumn("copy", F.lit(0))
    residual = batch - n % batch
    out = df.withColumn("copy", F.lit(0))
    if residual == batch:
        return out
    if batch // n >= 2:
        times = batch // n
        out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
        residual = batch - (n * times) % batch
    h = keyed_hash(seed, F.concat_ws("|", F.col(key).cast("string"), F.col("copy").cast("string")))
    extra = out.withColumn("_wf_h", h).orderBy("_wf_h", key, "copy").limit(residual).drop("_wf_h")
    return out.unionByName(extra.withColumn("copy", F.lit(-1)))


def shard_shuffle_order(df: DataFrame, shard: str, key: str, epoch: int, name: str = "order_key") -> DataFrame:
    """Epoch shuffle that keeps shards contiguous: order by (h(epoch, shard),
    h(epoch, key), key). Deterministic per epoch, independent of partitioning."""
    return df.withColumn(
        name, F.struct(keyed_hash(epoch, shard).alias("s"), keyed_hash(epoch, key).alias("r"), F.col(key).alias("k"))
    )


def chunk_shuffle(df: DataFrame, row_id: str, chunk_size: int, epoch: int, name: str = "order_key") -> DataFrame:
    """Shuffle chunks of ``chunk_size`` consecutive rows, then rows inside a chunk."""
    c = F.floor(F.col(row_id) / chunk_size)
    return df.withColumn(
        name, F.struct(keyed_hash(epoch, c).alias("c"), keyed_hash(epoch + 1, row_id).alias("r"), F.col(row_id).alias("k"))
    )


def rank_chunk(df: DataFrame, world: int, rank_col: str = "rank", row_id: str = "row_id", drop_last: bool = False) -> DataFrame:
    """Per-rank contiguous chunk; ``drop_last`` drops the tail, otherwise the
    last ranks wrap around to the first rows (padding) so every rank has equal length."""
    d = with_count(df)
    per = F.floor(F.col("_wf_n") / world) if drop_last else F.ceil(F.col("_wf_n") / world)
    out = d.withColumn(rank_col, F.floor(F.col(row_id) / per).cast("bigint"))
    if drop_last:
        return out.filter(F.col(row_id) < per * world).drop("_wf_n")
    pad_n = per * world - F.col("_wf_n")
    pads = d.filter(F.col(row_id) < pad_n).withColumn(rank_col, F.floor((F.col("_wf_n") + F.col(row_id)) / per).cast("bigint"))
    return out.unionByName(pads).drop("_wf_n")


def token_ids(text: Column) -> Column:
    """Test tokenizer (X07 default): white-space words, token id = word length."""
    return F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.length(w))


def _cut_lists(lists: DataFrame, own: str, buffer: str, order: str, seq_len: int) -> DataFrame:
    """(buffer, chunk, input_ids): the lists ``own`` of a buffer, one after the other in
    ``order``, cut into pieces of ``seq_len``; the last piece may be shorter.

    A running sum of the token counts gives each list its offset, and each list is cut at
    the borders of the examples it reaches into. Only one example's pieces ever meet in a
    group, however large the buffer.
    """
    sizes = lists.select(buffer, order, F.size(own).cast("bigint").alias("_wf_n"))
    at = prefix_sum(sizes, [order], "_wf_n", [buffer], "_wf_at", inclusive=False)
    placed = lists.select(buffer, order, own).join(at, [buffer, order]).where(F.col("_wf_n") > 0)
    first, last = F.floor(F.col("_wf_at") / seq_len), F.floor((F.col("_wf_at") + F.col("_wf_n") - 1) / seq_len)
    cut = placed.select(buffer, "_wf_at", own, F.explode(F.sequence(first, last)).alias("chunk"))
    lo = F.greatest(F.col("chunk") * seq_len - F.col("_wf_at"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 1) * seq_len - F.col("_wf_at"), F.size(own)).cast("int")
    pieces = cut.select(buffer, F.col("chunk").cast("bigint").alias("chunk"), "_wf_at", F.slice(own, lo + 1, hi - lo).alias("_wf_p"))
    whole = pieces.groupBy(buffer, "chunk").agg(F.array_sort(F.collect_list(F.struct("_wf_at", "_wf_p"))).alias("_wf_l"))
    return whole.select(buffer, "chunk", F.flatten(F.transform("_wf_l", lambda x: x["_wf_p"])).alias("input_ids"))


def pack_constant(df: DataFrame, tokens: str, buffer: str, order: str, seq_len: int, sep: int = 0, seed: int = 42) -> DataFrame:
    """Per buffer, token lists (each followed by ``sep``) are concatenated in
    ``order`` (unique in the buffer) and cut into ``seq_len`` examples; the short tail is
    dropped; examples are shuffled by keyed hash (``shuffle_key``).
    :func:`weft.plans.buffers.restarting_buffers` makes buffers over samples.
    """
    lists = df.select(buffer, order, F.concat(F.col(tokens), F.array(F.lit(sep))).alias("_wf_own"))
    out = _cut_lists(lists, "_wf_own", buffer, order, seq_len)
    return out.filter(F.size("input_ids") == seq_len).withColumn("shuffle_key", keyed_hash(seed, F.col(buffer), F.col("chunk")))


def pack_onward(df: DataFrame, carried: DataFrame, tokens: str, buffer: str, order: str, seq_len: int, sep: int = 0) -> DataFrame:
    """Constant-length packing that goes on where it stopped.

    ``carried`` has for a buffer the tokens left over (``tail``) and the number of the next
    example (``next``). Each buffer of ``df`` is packed as in :func:`pack_constant`, after
    its tail. Returns (buffer, chunk, input_ids) of whole examples and of one shorter last
    piece (maybe empty) for each buffer, which is its new tail and has its next number.
    """
    own = F.concat(F.col(tokens), F.array(F.lit(sep).cast("int")))
    new = df.select(buffer, F.struct(F.lit(1).alias("late"), F.col(order).alias("place")).alias("_wf_place"), own.cast("array<int>").alias("_wf_own"))
    tails = carried.join(df.groupBy(buffer).agg(F.min(order).alias("_wf_first")), buffer)
    old = tails.select(buffer, F.struct(F.lit(0).alias("late"), F.col("_wf_first").alias("place")).alias("_wf_place"), F.col("tail").alias("_wf_own"))
    cut = _cut_lists(old.union(new), "_wf_own", buffer, "_wf_place", seq_len)
    # a buffer that ends with a whole example has an empty tail behind it
    ends = cut.groupBy(buffer).agg(F.max(F.struct("chunk", F.size("input_ids").alias("n"))).alias("end")).where(F.col("end.n") == seq_len)
    empty = ends.select(buffer, (F.col("end.chunk") + 1).alias("chunk"), F.array().cast("array<int>").alias("input_ids"))
    start = tails.select(buffer, F.col("next").alias("_wf_next"))
    numbered = cut.union(empty).join(start, buffer, "left")
    return numbered.select(buffer, (F.col("chunk") + F.coalesce("_wf_next", F.lit(0))).alias("chunk"), "input_ids")


def chunk_tokens(df: DataFrame, tokens: str, key: str, seq_len: int, seed: int = 42, pad: int | None = None) -> DataFrame:
    """Cut one token array per row into ``seq_len`` rows: tail dropped (``pad`` None)
    or right-padded with ``pad`` (W19)."""
    n = F.size(tokens)
    n_chunks = F.floor(n / seq_len) if pad is None else F.ceil(n / seq_len)
    idx = F.filter(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))), lambda i: i < n_chunks)
    out = df.select(key, tokens, F.explode(idx).alias("chunk"))
    piece = F.slice(tokens, F.col("chunk") * seq_len + 1, seq_len)
    if pad is not None:
        piece = F.concat(piece, F.array_repeat(F.lit(pad), seq_len - F.size(piece)))
    out = out.select(key, F.col("chunk").cast("bigint").alias("chunk"), piece.alias("input_ids"))
    return out.withColumn("shuffle_key", keyed_hash(seed, F.col(key), F.col("chunk")))


def pack_padded(df: DataFrame, tokens: str, batch: str, order: str, seq_len: int, sep: int = 0, pad: int = 0) -> DataFrame:
    """A batch's texts joined by ``sep`` (between texts), cut into ``seq_len``
    rows, the last row right-padded."""
    g = df.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, tokens))), lambda x: x[tokens]).alias("_wf_l"))
    joined = F.flatten(F.transform("_wf_l", lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(sep)), x)).otherwise(x)))
    g = g.select(batch, joined.alias("_wf_all"))
    return chunk_tokens(g, "_wf_all", batch, seq_len, pad=pad).drop("shuffle_key")


def retention(df: DataFrame, size: str, mtime: str, key: str, max_bytes: int, max_files: int) -> DataFrame:
    """Newest files first; a file is kept while the running size and count stay
    within the limits. Only flags (``keep``) are returned; nothing is deleted."""
    order = [F.col(mtime).desc(), F.col(key)]
    d = prefix_sums(df.select(size, mtime, key), order, {"_wf_cum": size, "_wf_count": F.lit(1)})
    keep = (F.col("_wf_cum") <= max_bytes) & (F.col("_wf_count") <= max_files)
    return df.join(d.select(key, keep.alias("keep")), key)


def top_fraction(df: DataFrame, part: str, score: str, key: str, fraction: float, keep: Column | None = None) -> DataFrame:
    """Per part, rows ranked by score (desc, then key) and kept while
    rank < int(fraction * rows of the part **before** ``keep`` is applied). The cut is found
    by :func:`select_top`; rows away from it are neither sorted nor moved."""
    counts = df.groupBy(part).agg(F.floor(F.count(F.lit(1)) * fraction).alias("n"))
    return select_top(df.filter(keep) if keep is not None else df, part, score, key, counts)


def best_of_n(df: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """Top k candidates per query by score (ties by key). The rank filter is pushed
    below the exchange (each task keeps k rows of a query), so a hot query sends few rows."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key)))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("bigint"))


def cap_media(df: DataFrame, k: int, images: str = "images") -> DataFrame:
    """The first ``k`` media of a sample."""
    return df.withColumn(images, F.slice(images, 1, k))


def most_similar(text: Column, choices: Column) -> Column:
    """The choice with the smallest edit distance to ``text`` (first on ties)."""
    scored = F.transform(choices, lambda c, i: F.struct(F.levenshtein(text, c).alias("d"), i.alias("i"), c.alias("c")))
    return F.array_min(scored)["c"]
