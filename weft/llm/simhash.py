"""SimHash near-duplicates by pigeonhole blocks (operator 3).

A fingerprint has 64 bits; bit i is set if it is set in over half of the hashes of the
text's word shingles. Fingerprints that differ in at most ``d`` bits agree, by the
pigeonhole principle, on all bits of at least ``n - d`` of ``n`` blocks. Every distinct
fingerprint is dealt out under each choice of ``n - d`` blocks, joined on the bits of
these, and each candidate pair is verified by its Hamming distance.

A bucket of a block choice may hold very many distinct fingerprints (a family of near
copies). Buckets over ``bucket`` fingerprints are not paired: their fingerprints are dealt
out anew under the points within ``ceil(d/2)`` bits of them (1 + 64 points for d = 2). Two
fingerprints within ``d`` bits share such a point, and all that share a point are within
``2 ceil(d/2)`` bits, so for even ``d`` each is linked to the least one there: the same
components without any pairs. For odd ``d`` the pairs of a point are verified.

Defined results: null and empty texts have fingerprint zero and link like any other;
copies share one fingerprint and are grouped before any join; rows with a null id keep
their fingerprint and belong to the group of equal fingerprints; an empty table gives an
empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import durable, map_texts
from weft.llm.graph import components

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
#: Distinct fingerprints of a bucket that are compared pair by pair.
BUCKET = 64


def fingerprints(texts: list[bytes], words: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints (unsigned) of UTF-8 texts."""
    hashes: list[int] = []
    sizes = np.zeros(len(texts), dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        parts = text.lower().split()  # bytes: only A-Z and only \x20 \x09-\x0D
        if not parts:
            continue
        if len(parts) <= words:
            grams = [b" ".join(parts)]
        else:
            grams = map(b" ".join, zip(*[parts[k:] for k in range(words)]))
        before = len(hashes)
        hashes.extend([digest(g, seed) for g in grams])
        sizes[i] = len(hashes) - before
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    h = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(sizes[some])
    starts = ends - sizes[some]
    bits = np.zeros((len(some), BITS), dtype=np.uint8)
    for byte in range(8):  # 8 bits at a time keep the unpacked table small
        ones = np.add.reduceat(np.unpackbits(h[:, byte : byte + 1], axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
        bits[:, byte * 8 : byte * 8 + 8] = 2 * ones > sizes[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def with_fingerprint(df: DataFrame, keep=("doc_id",), text: str = "text", words: int = SHINGLE_WORDS, name: str = "_fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long."""
    return map_texts(df, lambda: lambda texts: [fingerprints(texts, words).view(np.int64)], f"`{name}` long", keep=keep, text=text, binary=True)


def _block_choices(distance: int, blocks: int) -> list[int]:
    """Masks (signed 64-bit) of the bits that each choice of ``blocks - distance`` blocks keeps."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    out = []
    for choice in combinations(masks, blocks - distance):
        m = sum(choice)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _flips(distance: int) -> list[int]:
    """Masks of the bits flipped to reach each point within ``ceil(distance / 2)`` bits."""
    out = []
    for k in range((distance + 1) // 2 + 1):
        for bits in combinations(range(BITS), k):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def near_links(fps: DataFrame, distance: int = MAX_DISTANCE, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that connect the distinct fingerprints ``_fp`` within ``distance`` bits."""
    blocks = blocks or distance + 3
    choices = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("_fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(_block_choices(distance, blocks))])
    dealt = fps.select("_fp", F.explode(choices).alias("k")).select("_fp", "k.choice", "k.bits")
    sizes = dealt.groupBy("choice", "bits").agg(F.count("*").alias("_n")).where("_n > 1")
    dealt = durable(dealt.join(sizes, ["choice", "bits"]))
    small = dealt.where(F.col("_n") <= bucket)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    left, right = small.select("choice", "bits", F.col("_fp").alias("a")), small.select("choice", "bits", F.col("_fp").alias("b"))
    pairs = left.join(right, ["choice", "bits"]).where(F.col("a") < F.col("b")).where(close).select("a", "b")
    # buckets too large for pairs: the points around each of their fingerprints
    large = dealt.where(F.col("_n") > bucket).select("_fp").distinct()
    points = large.select("_fp", F.explode(F.array(*[F.lit(m) for m in _flips(distance)])).alias("flip")).select("_fp", F.col("_fp").bitwiseXOR(F.col("flip")).alias("point"))
    if distance % 2 == 0:
        stars = points.join(points.groupBy("point").agg(F.min("_fp").alias("a")), "point").select("a", F.col("_fp").alias("b"))
    else:
        stars = points.select("point", F.col("_fp").alias("a")).join(points.select("point", F.col("_fp").alias("b")), "point").where(close).select("a", "b")
    return pairs.union(stars.where("a <> b")).distinct()


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, keep=(), root: bool = False
) -> DataFrame:
    """id, the ``keep`` columns, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id that links of at most ``distance`` bits reach. With
    ``root``, ``_fp`` and the component's least fingerprint ``_root`` stay too: components of
    one id with several texts may share their ``component_id``.
    """
    rows = durable(with_fingerprint(df, keep=(id_col, *[c for c in keep if c != id_col]), text=text, words=words))
    classes = rows.groupBy("_fp").agg(F.min(id_col).alias("_low"))
    roots = components(near_links(classes.select("_fp"), distance))
    # the least id of each component of fingerprints
    named = classes.join(roots, classes["_fp"] == roots["node"], "left").select("_fp", "_low", F.coalesce("root", "_fp").alias("_root"))
    low = named.groupBy("_root").agg(F.min("_low").alias("component_id"))
    label = named.select("_fp", "_root").join(low, "_root")
    return rows.join(label.select("_fp", "component_id", *(["_root"] if root else [])), "_fp").withColumn("fingerprint", hex16(F.col("_fp"))).drop(*([] if root else ["_fp"]))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group: the smallest id, of its texts the one with the least fingerprint.

    Rows that share an id with texts of different groups stay, one for each group. A row
    without an id can't be named as the copy of another, so it stays.
    """
    columns = df.columns
    some = df.where(F.col(id_col).isNotNull())
    marked = near_duplicates(some, id_col, text, root=True).where(F.col(id_col) == F.col("component_id"))
    kept = marked.groupBy("_root").agg(F.min(id_col).alias("_id"), F.min("_fp").alias("_kept"))
    named = [f"_{i}" for i in range(len(columns))]  # so that no column falls together with a result
    own, words = named[columns.index(id_col)], named[columns.index(text)]
    rows = with_fingerprint(some.toDF(*named), keep=named, text=words)
    rows = rows.join(kept, (rows[own] == kept["_id"]) & (rows["_fp"] == kept["_kept"]), "left_semi")
    # equal ids and fingerprints: the least text, then the least hash of the row
    tie = F.xxhash64(*[f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])
    one = rows.groupBy(own, "_fp").agg(F.min_by(F.struct(*named), F.struct(words, tie)).alias("_one"))
    return one.select(*[F.col(f"_one.{n}").alias(c) for n, c in zip(named, columns)]).union(df.where(F.col(id_col).isNull()))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
