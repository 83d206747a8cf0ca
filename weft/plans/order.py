"""Training order and packing plans.

Spark forms the groups (keyed-hash order, positions, group ids). The interleave slots are
integer arithmetic on columns. Only the two greedy rules run in ``applyInPandas``, on
integer columns (ids, lengths) of a group whose size the caller sets: a mega-batch
(W13/W14, world x batch rows) or a collate batch (W17). Plans are joined back by id.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.ids import keyed_hash, positions


def deal_evenly(lengths: list[int], k: int) -> list[int]:
    """Chunk of each item when items are dealt, in order, to ``k`` chunks of equal counts.

    An item goes to the chunk with the least total length that still has room (the lowest
    number of equal ones). When the count does not divide by ``k``, items go round robin.
    """
    room, rest = divmod(len(lengths), k)
    if rest:
        return [i % k for i in range(len(lengths))]
    # a heap of (total length, chunk, places left): a chunk without places is not put back
    open_chunks = [(0, c, room) for c in range(k)] if room else []
    heapify(open_chunks)
    dealt = []
    for n in lengths:
        total, c, places = heappop(open_chunks)
        dealt.append(c)
        if places > 1:
            heappush(open_chunks, (total + n, c, places - 1))
    return dealt


def length_grouped(df: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 42) -> DataFrame:
    """Random mega-batches of world x batch rows (keyed-hash order), sorted by
    length descending inside (stable), then dealt to ``world`` chunks of roughly
    equal total length. Adds (megabatch, chunk, pos)."""
    mb = world * batch
    d = positions(df.select(key, length).withColumn("_wf_h", keyed_hash(seed, key)), ["_wf_h", key], name="_wf_p")
    d = d.withColumn("megabatch", F.floor(F.col("_wf_p") / mb).cast("bigint"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, "_wf_p"], ascending=[False, True])
        out = pdf[[key, "megabatch"]].assign(chunk=deal_evenly(pdf[length].tolist(), world))
        return out.assign(pos=out.groupby("chunk").cumcount())

    schema = f"{key} {dict(df.dtypes)[key]}, megabatch bigint, chunk bigint, pos bigint"
    return d.groupBy("megabatch").applyInPandas(plan, schema)


def modality_grouped(df: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 42) -> DataFrame:
    """Media rows (length > 0) and text rows (length < 0) are length-grouped
    separately. When both occur, the last mega-batch of each, full or not, leaves its place:
    the two make one extra mega-batch, sorted by key, at the end. The others are shuffled by
    keyed hash. A zero length fails the job.

    Columns: modality, megabatch (-1 for the extra one), chunk (-1 there), pos, megabatch_order
    (the place of the mega-batch among all) and extra.
    """
    checked = df.withColumn(
        "_wf_len", F.when(F.col(length) == 0, F.raise_error(F.lit("Should not have zero length.")).cast("bigint")).otherwise(F.col(length))
    )
    parts = []
    for name, cond, sign in (("mm", F.col("_wf_len") > 0, 1), ("lang", F.col("_wf_len") < 0, -1)):
        sub = checked.filter(cond).select(key, (F.col("_wf_len") * sign).alias(length))
        parts.append(length_grouped(sub, key, length, batch, world, seed).withColumn("modality", F.lit(name)))
    allp = parts[0].unionByName(parts[1])
    last = allp.groupBy("modality").agg(F.max("megabatch").alias("_wf_last"))  # at most two rows
    both = last.agg(F.count(F.lit(1)).alias("_wf_kinds")).withColumn("_wf_one", F.lit(1))
    last = last.withColumn("_wf_one", F.lit(1)).join(F.broadcast(both), "_wf_one").drop("_wf_one")
    placed = allp.join(F.broadcast(last), "modality").withColumn("extra", (F.col("_wf_kinds") == 2) & (F.col("megabatch") == F.col("_wf_last")))
    full = placed.filter(~F.col("extra"))
    order = full.select("modality", "megabatch").distinct().withColumn(
        "_wf_h", keyed_hash(seed + 1, F.concat_ws("|", "modality", F.col("megabatch").cast("string")))
    )
    order = positions(order, ["_wf_h", "modality", "megabatch"], name="megabatch_order")
    full = full.join(order.select("modality", "megabatch", "megabatch_order"), ["modality", "megabatch"])
    # at most two mega-batches, whatever the data
    n_full = order.agg(F.count(F.lit(1)).alias("megabatch_order")).withColumn("_wf_one", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("extra").orderBy(key)) - 1
    extra = placed.filter("extra").withColumn("_wf_one", F.lit(1)).join(F.broadcast(n_full), "_wf_one")
    extra = extra.withColumn("pos", rank.cast("bigint")).withColumn("megabatch", F.lit(-1).cast("bigint")).withColumn("chunk", F.lit(-1).cast("bigint"))
    cols = [key, "modality", "megabatch", "chunk", "pos", "megabatch_order", "extra"]
    return full.select(*cols).unionByName(extra.select(*cols))


def interleave_sizes(sizes: dict[str, int], world: int, batch: int, accum: int, sp: int) -> dict[str, int]:
    """W11 sizes: per-rank samples of each dataset, truncated to whole batches with the
    reference's left-to-right integer arithmetic (Q27 kept)."""
    return {name: n // (world * batch * accum // sp) * batch * accum // sp for name, n in sizes.items()}


def interleave_plan(df: DataFrame, dataset: str, idx: str, world: int, batch: int, accum: int = 1, sp: int = 1,
                    seed: int = 42, epoch: int = 0, shuffle: str = "sample") -> DataFrame:
    """Each dataset is truncated to whole batches per rank, cut into one contiguous
    block per rank, shuffled inside the block (keyed hash of seed+epoch), and the
    datasets are interleaved proportionally, largest first: dataset i takes slots
    ``j * free // n_i`` of the slots still free. Returns (dataset, idx, rank, slot).

    Dataset names and sizes are driver-side (one row per dataset). A slot among those
    still free is brought back, level by level, to its number among all: when a dataset
    took slots ``j * free // n``, the k-th slot that it left is
    ``ceil((k + 1) * free / (free - n)) - 1``.
    """
    sizes = {r[dataset]: r["n"] for r in df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n")).collect()}
    per = interleave_sizes(sizes, world, batch, accum, sp)
    spark = df.sparkSession
    per_df = spark.createDataFrame([(k, int(v)) for k, v in per.items()], f"{dataset} string, _wf_per bigint")
    d = df.select(dataset, idx).join(F.broadcast(per_df), dataset).filter(F.col(idx) < F.col("_wf_per") * world)
    d = d.withColumn("rank", F.floor(F.col(idx) / F.col("_wf_per")).cast("bigint")).filter(F.col("_wf_per") > 0)
    if shuffle == "sample":
        d = d.withColumn("_wf_h", keyed_hash(seed + epoch, F.concat_ws("|", F.col(dataset), F.col(idx).cast("string"))))
        d = positions(d, ["_wf_h", idx], partition=[dataset, "rank"], name="j")
    elif shuffle == "batch":
        # W12 (Q17 fix: the batch shuffle is applied): whole batches of the block move
        # together, in keyed-hash order; rows keep their order inside a batch
        blk = F.floor((F.col(idx) % F.col("_wf_per")) / batch)
        d = d.withColumn("_wf_h", keyed_hash(seed + epoch, F.concat_ws("|", F.col(dataset), F.col("rank").cast("string"), blk.cast("string"))))
        d = positions(d, ["_wf_h", idx], partition=[dataset, "rank"], name="j")
    else:
        raise ValueError(shuffle)
    levels, free, rows = [], sum(per.values()), []
    for name, n in sorted(per.items(), key=lambda kv: (-kv[1], kv[0])):
        if n:
            rows.append((name, free, n, list(reversed(levels))))
            levels.append((free, n))
            free -= n
    level_df = spark.createDataFrame(rows, f"{dataset} string, _wf_free bigint, _wf_n bigint, _wf_levels array<struct<free:bigint,n:bigint>>")
    d = d.select(dataset, idx, "rank", "j").join(F.broadcast(level_df), dataset)
    taken = F.call_function("div", F.col("j") * F.col("_wf_free"), F.col("_wf_n"))
    slot = F.aggregate("_wf_levels", taken, lambda k, v: _ceil_div((k + 1) * v["free"], v["free"] - v["n"]) - 1)
    return d.select(dataset, idx, "rank", slot.alias("slot"))


def _ceil_div(a, b):
    """Exact integer division, rounded up."""
    return F.call_function("div", a + b - 1, b)


class _OpenPack:
    """The pack being filled, and the longest pack closed so far."""

    def __init__(self, max_len: int, max_images: int, sp: int):
        self.max_len, self.max_images, self.sp = max_len, max_images, sp
        self.number, self.longest = 0, 0
        self.samples = self.tokens = self.images = 0

    def takes(self, tokens: int, images: int) -> bool:
        if self.tokens + tokens > self.max_len:
            return False
        if self.images < max(self.sp, 1):
            return True  # it still needs images, so only its length counts
        return self.images + images <= self.max_images and self.tokens + tokens <= self.longest

    def place(self, tokens: int, images: int) -> tuple[int, int]:
        """(pack, offset) of the next sample."""
        if self.samples and not self.takes(tokens, images):
            self.longest = max(self.longest, self.tokens)
            self.number += 1
            self.samples = self.tokens = self.images = 0
        at = self.number, self.tokens
        self.samples, self.tokens, self.images = self.samples + 1, self.tokens + tokens, self.images + images
        return at


def pack_greedy(df: DataFrame, key: str, group: str, n_tokens: str, n_images: str, max_len: int, max_images: int,
                tokens_per_image: int = 1, sp: int = 1) -> DataFrame:
    """Inside a collate group, samples sorted by expanded length (media tokens
    counted) descending are packed greedily: a sample joins the open pack when the
    pack has fewer than ``sp`` images, or when it keeps within ``max_images`` and within
    the longest pack built so far, and always within ``max_len``. A sample longer than
    ``max_len`` on its own is flagged (``pack`` = -1). Adds (pack, offset, seqlen)."""

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        seqlen = (pdf[n_tokens] + pdf[n_images] * (tokens_per_image - 1)).astype(np.int64)
        pdf = pdf.assign(seqlen=seqlen).sort_values(["seqlen", key], ascending=[False, True])
        state = _OpenPack(max_len, max_images, sp)
        places = [(-1, 0) if n > max_len else state.place(n, m) for n, m in zip(pdf["seqlen"].tolist(), pdf[n_images].tolist())]
        packs, offsets = zip(*places)
        return pdf[[key, group]].assign(pack=packs, offset=offsets, seqlen=pdf["seqlen"])

    dt = dict(df.dtypes)
    schema = f"{key} {dt[key]}, {group} {dt[group]}, pack bigint, offset bigint, seqlen bigint"
    return df.select(key, group, n_tokens, n_images).groupBy(group).applyInPandas(plan, schema)


#: Padding of a sample's length for a kind of ring attention, in multiples of the sequence-parallel degree.
RING_MULTIPLE = {None: 0, "ring_varlen": 1, "zigzag_ring_varlen": 2}


class _MediaPacks:
    """Packs of one collate group: samples as the rule admits them, then a debt of media paid in dummies."""

    def __init__(self, max_len: int, max_images: int, sp: int, dummy_len: int):
        self.max_len, self.max_images, self.sp, self.dummy_len = max_len, max_images, sp, dummy_len
        self.kept = self.longest = 0  # packs kept so far, and the length of the longest of them
        self.tokens = self.images = 0
        self.open: list[tuple] = []  # (sample, offset, length, images) of the pack in the making
        self.rows: list[tuple] = []

    def add(self, sample, length: int, images: int) -> None:
        indebted = self.images < self.sp
        apt = indebted or (self.images + images <= self.max_images and self.tokens + length <= self.longest)
        if self.open and not (apt and self.tokens + length <= self.max_len):
            self.close()
        self.open.append((sample, self.tokens, length, images))
        self.tokens, self.images = self.tokens + length, self.images + images

    def close(self) -> None:
        """Pay the debt in dummies while the pack is short of its full length; a pack still in debt is dropped."""
        debt, room = max(self.sp - self.images, 0), max(self.max_len - self.tokens, 0)
        paid = min(debt, -(-room // self.dummy_len))
        dummies = [(None, self.tokens + k * self.dummy_len, self.dummy_len, 1) for k in range(paid)]
        if paid == debt:
            self.rows += [("dummy" if r[0] is None else "sample", self.kept, *r) for r in self.open + dummies]
            self.longest = max(self.longest, self.tokens + paid * self.dummy_len)
            self.kept += 1
        else:
            self.rows += [("dropped", -1, *r) for r in self.open]
        self.open, self.tokens, self.images = [], 0, 0


def pack_media(df: DataFrame, key: str, group: str, n_tokens: str, n_images: str, max_len: int, tokens_per_image: int = 1, sp: int = 1,
               ring: str | None = None, max_images: int | None = None) -> DataFrame:
    """W17 whole: packs of a collate group in which every pack has at least ``sp`` media.

    Samples come by expanded length (a medium counts ``tokens_per_image``), longest first and
    then by key. With a ``ring`` kind, each is padded to a multiple of ``sp`` (or of twice
    that). A pack admits samples while it has fewer than ``sp`` media, and then those that
    keep it within ``max_images`` (the most of any sample of the group, unless given) and
    within the longest pack so far; never beyond ``max_len``. A pack short of media is filled
    with dummies (begin, medium, end) while it is shorter than ``max_len``; if it is still
    short, it is dropped.

    Columns: group, kind (``sample``, ``dummy``, ``dropped`` or ``too_long``), pack (numbered
    among those kept; -1 without one), key (null for a dummy), offset, seqlen (padded) and
    images. A sample that is longer than ``max_len`` is returned, marked, and packed nowhere.
    """
    if ring not in RING_MULTIPLE:
        raise ValueError(f"ring must be one of {sorted(k for k in RING_MULTIPLE if k)}")
    multiple = max(1, RING_MULTIPLE[ring] * sp)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        length = (pdf[n_tokens] + pdf[n_images] * (tokens_per_image - 1)).astype(np.int64)
        pdf = pdf.assign(_wf_len=length).sort_values(["_wf_len", key], ascending=[False, True])
        most = int(pdf[n_images].max()) if max_images is None else max_images
        packs = _MediaPacks(max_len, most, sp, tokens_per_image + 2)
        for sample, n, images in zip(pdf[key].tolist(), (-(-pdf["_wf_len"] // multiple) * multiple).tolist(), pdf[n_images].tolist()):
            if n > max_len:
                packs.rows.append(("too_long", -1, sample, 0, n, images))
            else:
                packs.add(sample, n, images)
        if packs.open:
            packs.close()
        out = pd.DataFrame(packs.rows, columns=["kind", "pack", key, "offset", "seqlen", "images"])
        out[key] = out[key].astype(object)
        return out.assign(**{group: pdf[group].iloc[0]})[[group, "kind", "pack", key, "offset", "seqlen", "images"]]

    dt = dict(df.dtypes)
    schema = f"{group} {dt[group]}, kind string, pack bigint, {key} {dt[key]}, offset bigint, seqlen bigint, images bigint"
    return df.select(key, group, n_tokens, n_images).groupBy(group).applyInPandas(plan, schema)
