"""n-gram text metrics (G07 BLEU, G08 CIDEr, G09 ROUGE, G11 token F1) as Spark jobs.

Texts are dealt by id. BLEU counts the n-grams of an id where its texts are, and sums leave
the task. CIDEr keeps groups of ids as word numbers; a group asks for the document frequencies
of its distinct n-grams, by range of hashes and in rounds, so a very common gram (``the``)
costs one entry per group, and dot products need no join between candidates and references.
ROUGE-L's longest common subsequence runs in an Arrow-batched pandas UDF per row.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.lcs import lcs_length
from weft.session import shuffles_freed, small_batches

TINY, SMALL = 1e-15, 1e-9


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def ngrams(ws: Column, n: int) -> Column:
    """n-grams of a word array (empty when shorter than n), built by element access."""
    size = F.size(ws)
    idx = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.concat_ws(" ", *[F.element_at(ws, i + k) for k in range(n)]))


CAND = -1  # the side of a candidate text; references have their index, from 0


def _texts(cands: DataFrame, refs: DataFrame, id_col: str) -> DataFrame:
    """(id, side, text) of the texts that are not null, those of an id in one task and one after
    the other, references first; ids are spread over all task slots."""
    spark = cands.sparkSession
    small_batches(spark)
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = cands.select(id_col, F.lit(CAND).alias("side"), "text").unionByName(refs.select(id_col, F.col("ref_idx").cast("int").alias("side"), "text"))
    dealt = both.where(F.col("text").isNotNull() & F.col("side").isNotNull()).repartition(n, id_col).sortWithinPartitions(id_col, F.col("side").desc())
    return dealt.select(F.col(id_col).cast("string").alias("id"), "side", F.col("text").cast("binary").alias("text"))


def _grams_of(text: bytes, max_n: int) -> Iterator[tuple]:
    """The n-grams of a text, as tuples of its words."""
    ws = text.split()  # at the white space that a pattern takes for it, too
    return chain.from_iterable(zip(*[ws[i:] for i in range(n)]) for n in range(1, max_n + 1))


def _clipped_matches(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[tuple]:
    """(candidate words, words of the closest references, n-grams by n, clipped matches by n) of a task.

    Only the n-grams of one id's references, and those of its candidates among them, are
    held. Words are None without a candidate, or without a reference of one.
    """
    words, closest, guess, correct = None, None, [0] * max_n, [0] * max_n
    rows = ((i, s, t) for rb in batches for i, s, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2)))
    for _, texts in groupby(rows, key=lambda r: r[0]):
        best, ref_lens, longest, held = {}, [], None, Counter()
        for side, same in groupby(texts, key=lambda r: r[1]):
            found = Counter()
            for _, _, text in same:
                data = text.as_py()
                size = len(data.split())
                if side == CAND:
                    longest = size if longest is None else max(longest, size)
                    if best:
                        held.update(filter(best.__contains__, _grams_of(data, max_n)))
                else:
                    ref_lens.append(size)
                    found.update(_grams_of(data, max_n))
            for g, k in found.items():
                if k > best.get(g, 0):
                    best[g] = k
        for g, k in held.items():
            correct[len(g) - 1] += min(k, best[g])
        if longest is not None:
            words = (words or 0) + longest
            for n in range(1, max_n + 1):
                guess[n - 1] += max(longest - n + 1, 0)
            if ref_lens:
                closest = (closest or 0) + min((abs(x - longest), x) for x in ref_lens)[1]
    if words is not None:
        yield words, closest, guess, correct


def bleu(cands: DataFrame, refs: DataFrame, id_col: str = "id", max_n: int = 4) -> DataFrame:
    """Corpus BLEU-1..max_n (Papineni et al.): clipped n-gram matches against the
    per-id maximum reference count, brevity penalty from the closest reference length
    (shorter on ties), with the usual tiny/small smoothing constants.

    ``cands``: (id, text); ``refs``: (id, ref_idx, text). Returns one row.
    """
    sides = _texts(cands, refs, id_col)
    lens = ["testlen", "reflen"]
    per_n = [f"_{kind}{n}" for n in range(1, max_n + 1) for kind in ("guess", "correct")]

    def run(batches):
        for sums in _clipped_matches(batches, max_n):
            row = dict(zip(lens, sums[:2])) | {f"_guess{n}": sums[2][n - 1] for n in range(1, max_n + 1)} | {f"_correct{n}": sums[3][n - 1] for n in range(1, max_n + 1)}
            yield pa.RecordBatch.from_pydict({c: pa.array([row[c]], pa.int64()) for c in lens + per_n})

    fields = ", ".join(f"{c} long" for c in lens + per_n)
    one = sides.mapInArrow(run, fields).agg(*[F.sum(c).alias(c) for c in lens + per_n])
    ratio = (F.col("testlen") + TINY) / (F.col("reflen") + SMALL)
    bp = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(F.lit(1.0))
    cols, prod = [], F.lit(1.0)
    for n in range(1, max_n + 1):
        prod = prod * (F.col(f"_correct{n}") + TINY) / (F.col(f"_guess{n}") + SMALL)
        cols.append((F.pow(prod, 1.0 / n) * bp).alias(f"bleu_{n}"))
    return one.select(*cols)


def cider(cands: DataFrame, refs: DataFrame, id_col: str = "id", max_n: int = 4) -> DataFrame:
    """CIDEr (Vedantam et al.): tf-idf n-gram vectors, document frequency over
    each id's reference *set*, cosine per (reference, n), mean over n and references,
    x10, then the mean over ids. Returns (cider, per-id table is :func:`cider_per_id`)."""
    return cider_per_id(cands, refs, id_col, max_n).agg(F.avg("cider").alias("cider"))


GROUP_BYTES = 8 << 20  # of different texts in a group of ids, about
CELL_GRAMS = 2 << 20  # n-grams that meet in one task, about
PARTS = 3  # rounds of an n above 1; each holds so small a share of the n-grams on disk
ONE_PART = 8 << 20  # up to so many words in all, one round of an n is enough


def _squeeze(values: np.ndarray) -> bytes:
    """Numbers byte by byte (all first bytes, all second ones), compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _spread(data: bytes, count: int, kind: type) -> np.ndarray:
    """The ``count`` numbers of :func:`_squeeze`."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, count * size, codec="zstd") if count else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).reshape(count)


def _word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def _pack(batches: Iterator[pa.RecordBatch], task: int, group_bytes: int) -> Iterator[pa.RecordBatch]:
    """Groups of whole ids from rows (key, id, side, text) that come by id. A group holds its
    different texts once, as word numbers, and which id uses which text on which side."""
    made, last, size, kind = 0, None, 0, None
    ids, uses, texts, lens, codes = [], [], {}, [], []
    number = defaultdict()
    number.default_factory = number.__len__

    def group() -> pa.RecordBatch:
        of = np.array(uses, np.int32).reshape(-1, 3)
        words = np.fromiter((_word_hash(w) for w in number), np.uint64, len(number))
        row = {
            "grp": (task << 32) + made, "ids": ids, "n_uses": len(uses), "uses": _squeeze(of.reshape(-1)), "n_texts": len(lens), "lens": _squeeze(np.array(lens, np.int32)),
            "n_codes": sum(lens), "codes": _squeeze(np.concatenate(codes) if codes else np.empty(0, np.int32)), "n_words": len(number), "words": _squeeze(words),
        }
        return pa.RecordBatch.from_pydict({c: pa.array([ids], pa.list_(kind)) if c == "ids" else pa.array([v]) for c, v in row.items()})

    for rb in batches:
        kind = rb.schema.field(1).type
        for key, one, side, text in zip(rb.column(0).to_pylist(), rb.column(1), rb.column(2).to_pylist(), rb.column(3)):
            if not ids or key != last:
                if size >= group_bytes:
                    yield group()
                    made, size = made + 1, 0
                    for held in (ids, uses, texts, lens, codes, number):
                        held.clear()
                ids.append(one.as_py())
                last = key
            data = text.as_py()
            at = texts.setdefault(data, len(texts))
            if at == len(lens):
                ws = data.split()  # at the white space that a pattern takes for it, too
                codes.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
                lens.append(len(ws))
                size += len(data)
            uses.append((at, len(ids) - 1, side + 1))
    if ids:
        yield group()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits spread in place, one to one."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _cells(h: np.ndarray, count: int) -> np.ndarray:
    """Which of ``count`` equal ranges of hashes each is in."""
    return ((h >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def _counted(group: dict, n: int, part: int, parts: int, cells: int, n_refs: int) -> tuple[np.ndarray, ...]:
    """(hashes, gram, id, counts): the sorted hashes of a group's n-grams in a part of them;
    then for each n-gram of an id its place among the hashes, the id's in the group, and
    how often it is in the candidate and in each reference.

    Two n-grams of the same n are taken for one if 64 bits agree: about V^2 / 2^65 false
    matches for V distinct n-grams.
    """
    lens = _spread(group["lens"], group["n_texts"], np.int32)
    codes = _spread(group["codes"], group["n_codes"], np.int32)
    words = _spread(group["words"], group["n_words"], np.uint64)[codes]
    starts = max(len(codes) - n + 1, 0)
    h = words[:starts].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)  # the words' own hashes are spread
        h += words[k : k + starts]
    h = _mixed(h)
    ends = np.cumsum(lens)
    keep = _cells(h, parts) == part if parts > 1 else np.ones(starts, bool)
    for k in range(1, n):  # those that would go on into the next text
        past = ends - k
        keep[past[(past >= 0) & (past < starts)]] = False
    h, text = h[keep], np.repeat(np.arange(len(lens), dtype=np.int32), lens)[:starts][keep]
    order = np.argsort(h)
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    # each occurrence once for every use of its text, as one number of n-gram, id and side
    uses = _spread(group["uses"], group["n_uses"] * 3, np.int32).reshape(-1, 3).astype(np.int64)
    uses = uses[np.argsort(uses[:, 0], kind="stable")]
    n_uses = np.bincount(uses[:, 0], minlength=len(lens))
    n_ids, width = len(group["ids"]), n_refs + 1
    many = n_uses[text]
    use = np.repeat((np.cumsum(n_uses) - n_uses)[text] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    key = np.sort(np.repeat((np.cumsum(new) - 1) * (n_ids * width), many) + (uses[:, 1] * width + uses[:, 2])[use])
    at = np.flatnonzero(np.diff(key, prepend=-1))
    key, times = key[at], np.diff(at, append=len(key))
    pairs = key // width
    first = np.ones(len(key), bool)
    first[1:] = pairs[1:] != pairs[:-1]
    counts = np.zeros((first.sum(), width))
    counts[np.cumsum(first) - 1, key % width] = times
    key = pairs[first]
    return h[new], key // n_ids, key % n_ids, counts


def _asked(group: dict, n: int, part: int, parts: int, cells: int, n_refs: int) -> pa.RecordBatch:
    """(cell, grp, hashes, held): a group's n-grams by range of hashes, and how many of its ids
    have each in a reference."""
    h, gram, _, counts = _counted(group, n, part, parts, cells, n_refs)
    held = np.bincount(gram[counts[:, 1:].any(axis=1)], minlength=len(h)).astype(np.int64)
    cell = _cells(h, parts * cells)
    at = np.flatnonzero(np.diff(cell, prepend=cell[:1] + np.uint64(1)) != 0) if len(h) else np.empty(0, int)
    ends = np.append(at[1:], len(h))
    return pa.RecordBatch.from_pydict({
        "cell": pa.array(cell[at].astype(np.int64), pa.int64()), "grp": pa.array([group["grp"]] * len(at), pa.int64()), "count": pa.array(ends - at, pa.int64()),
        "hashes": pa.array([_squeeze(np.diff(h[a:b], prepend=np.uint64(0))) for a, b in zip(at, ends)], pa.binary()), "held": pa.array([_squeeze(held[a:b]) for a, b in zip(at, ends)], pa.binary()),
    })


def _answered(asked: pa.Table) -> pa.Table:
    """(grp, cell, count, df): for each group's n-grams of a cell, in their order, the ids of all
    groups that have them in a reference."""
    rows = asked.to_pylist()
    h = np.concatenate([np.cumsum(_spread(r["hashes"], r["count"], np.uint64), dtype=np.uint64) for r in rows])
    held = np.concatenate([_spread(r["held"], r["count"], np.int64) for r in rows])
    _, gram = np.unique(h, return_inverse=True)
    df = np.bincount(gram, held).astype(np.int64)[gram]
    each = np.split(df, np.cumsum([r["count"] for r in rows])[:-1])
    return pa.table({"grp": asked["grp"], "cell": asked["cell"], "count": asked["count"], "df": pa.array([_squeeze(x) for x in each], pa.binary())})


GROUP = "grp long, ids array<{id}>, n_uses long, uses binary, n_texts long, lens binary, n_codes long, codes binary, n_words long, words binary"
ASKED = "cell long, grp long, count long, hashes binary, held binary"


def _packed(cands: DataFrame, refs: DataFrame, n_refs: int, id_col: str) -> DataFrame:
    """The texts in groups of whole ids (see :func:`_pack`), checkpointed: what a group holds stays
    the same in all rounds. Ids near each other come into one group, where a text that several
    of them use is held once."""
    spark = cands.sparkSession
    small_batches(spark)
    n = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = cands.select(id_col, F.lit(CAND).alias("side"), "text").unionByName(refs.select(id_col, F.col("ref_idx").cast("int").alias("side"), "text"))
    dealt = both.where(F.col("text").isNotNull() & F.col("side").between(CAND, n_refs - 1)).repartitionByRange(n, id_col).sortWithinPartitions(id_col, F.col("side"))
    kind = both.schema[id_col].dataType
    limit = GROUP_BYTES

    def run(batches):
        yield from _pack(batches, TaskContext.get().partitionId(), limit)

    rows = dealt.select(F.col(id_col).cast("string").alias("key"), id_col, "side", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, GROUP.format(id=kind.simpleString())).checkpoint()


def _round(groups: DataFrame, n: int, part: int, parts: int, cells: int, n_refs: int, ref_len: float) -> DataFrame:
    """(grp, n, sums): for each id of a group, over the n-grams of a part, the sums of the squared
    weights of the candidate and of each reference, and of their products."""
    how = (n, part, parts, cells, n_refs)

    def ask(batches):
        for rb in batches:
            for k in range(rb.num_rows):
                yield _asked(rb.slice(k, 1).to_pylist()[0], *how)

    def weigh(group: pa.Table, answers: pa.Table) -> pa.Table:
        one = group.to_pylist()[0]
        h, gram, at, counts = _counted(one, *how)
        found = sorted(answers.to_pylist(), key=lambda r: r["cell"])
        df = np.concatenate([np.empty(0, np.int64), *[_spread(r["df"], r["count"], np.int64) for r in found]])
        if len(df) != len(h):
            raise ValueError(f"{len(h)} n-grams of a group, {len(df)} answers")
        x = counts * (ref_len - np.log(np.maximum(df, 1)))[gram][:, None]
        n_ids = len(one["ids"])
        of = [x[:, k] * x[:, k] for k in range(n_refs + 1)] + [x[:, 0] * x[:, k] for k in range(1, n_refs + 1)]
        sums = np.stack([np.bincount(at, v, minlength=n_ids) for v in of])
        return pa.table({"grp": pa.array([one["grp"]], pa.int64()), "n": pa.array([n], pa.int32()), "sums": pa.array([_squeeze(sums.reshape(-1))], pa.binary())})

    asked = groups.mapInArrow(ask, ASKED).repartition(cells, "cell")
    answers = asked.groupBy("cell").applyInArrow(_answered, "grp long, cell long, count long, df binary")
    return groups.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(weigh, "grp long, n int, sums binary").checkpoint()


def cider_per_id(cands: DataFrame, refs: DataFrame, id_col: str = "id", max_n: int = 4) -> DataFrame:
    """(id, cider). A group of ids asks, for its distinct n-grams, in how many ids' references
    they are, and gets the numbers back in the same order: no row for each n-gram, and
    a frequent one is asked for once a group. This is done in rounds, by n and by range of
    hashes; sums by id add up over them, and the files of a round are freed after it."""
    spark = cands.sparkSession
    # a number of columns, and that of all ids
    top, n_docs = refs.agg(F.max("ref_idx"), F.count_distinct(id_col)).first()
    n_refs = 0 if top is None else max(int(top) + 1, 0)
    with shuffles_freed(spark):
        groups = _packed(cands, refs, n_refs, id_col)
        n_codes = groups.agg(F.sum("n_codes")).first()[0] or 0
        parts = 1 if n_codes <= ONE_PART else PARTS
        rounds = [(n, part, parts if n > 1 else 1) for n in range(1, max_n + 1) for part in range(parts if n > 1 else 1)]
        cells = max(spark.sparkContext.defaultParallelism, -(-n_codes // (parts * CELL_GRAMS)))
        done = [_round(groups, *which, cells, n_refs, math.log(max(n_docs, 1))) for which in rounds]
    names = [f"r{k}" for k in range(n_refs)]
    kind = cands.select(id_col).unionByName(refs.select(id_col)).schema[id_col].dataType
    out = ", ".join([f"id {kind.simpleString()}", *[f"{r} double" for r in names]])

    def score(group: pa.Table, sums: pa.Table) -> pa.Table:
        ids, width = group["ids"].combine_chunks().flatten(), 2 * n_refs + 1
        total = defaultdict(lambda: np.zeros((width, len(ids))))
        for r in sums.to_pylist():
            total[r["n"]] += _spread(r["sums"], width * len(ids), np.float64).reshape(width, -1)
        scores = np.zeros((n_refs, len(ids)))
        for x in total.values():
            norm = np.sqrt(x[0]) * np.sqrt(x[1 : n_refs + 1])
            scores += x[n_refs + 1 :] / np.where(norm != 0, norm, 1.0) / max_n
        return pa.table({"id": ids} | {r: pa.array(scores[k]) for k, r in enumerate(names)})

    sums = reduce(DataFrame.unionByName, done)
    per_id = groups.select("grp", "ids").groupBy("grp").cogroup(sums.groupBy("grp")).applyInArrow(score, out).withColumnRenamed("id", id_col)
    # the mean over the references that an id has; one without a common n-gram scores zero
    have = refs.groupBy(id_col).agg(F.count_distinct("ref_idx").alias("_wf_refs"))
    total = sum((F.coalesce(F.col(r), F.lit(0.0)) for r in names), F.lit(0.0))
    return have.join(per_id, id_col, "left").select(id_col, (total / F.col("_wf_refs") * 10.0).alias("cider"))


def _rouge_words(text: Column) -> Column:
    """Sentences split on ``.``, white space collapsed, words flattened (the pip
    ``rouge`` package's tokenisation)."""
    sents = F.filter(F.split(text, r"\."), lambda s: F.length(s) > 0)
    return F.flatten(F.transform(sents, lambda s: words(s)))


def rouge_n_set(pred: Column, ref: Column, n: int) -> Column:
    """ROUGE-n F1 over n-gram **sets** (as the pip ``rouge`` package)."""
    e = F.array_distinct(ngrams(_rouge_words(pred), n))
    r = F.array_distinct(ngrams(_rouge_words(ref), n))
    ov = F.size(F.array_intersect(e, r)).cast("double")
    p = F.when(F.size(e) > 0, ov / F.size(e)).otherwise(F.lit(0.0))
    rc = F.when(F.size(r) > 0, ov / F.size(r)).otherwise(F.lit(0.0))
    return 2 * ((p * rc) / (p + rc + 1e-8))


@F.pandas_udf(T.DoubleType())
def rouge_l_f(pred: pd.Series, ref: pd.Series) -> pd.Series:
    """ROUGE-L F1 from the longest common subsequence of the token lists (Lin 2004)."""

    def words_of(text: str) -> list[str]:
        return [w for s in str(text).split(".") if s for w in s.split()]

    def f1(x: list[str], y: list[str]) -> float:
        m = lcs_length(x, y)
        if not m:
            return 0.0
        prec, rec = m / len(x), m / len(y)
        return 2 * prec * rec / (prec + rec + 1e-8)

    return pd.Series([f1(words_of(p), words_of(r)) for p, r in zip(pred, ref)], dtype="float64")


def rouge(df: DataFrame, pred: str, refs: str, with_l: bool = True) -> DataFrame:
    """Per row, references joined by a space; an empty prediction becomes
    ``dummy text``; mean ROUGE-1/2 (and -L) F1."""
    p = F.when(F.col(pred) == "", F.lit("dummy text")).otherwise(F.col(pred))
    r = F.array_join(F.col(refs), " ")
    d = df.select(p.alias("_p"), r.alias("_r"))
    aggs = [F.avg(rouge_n_set(F.col("_p"), F.col("_r"), 1)).alias("rouge_1"), F.avg(rouge_n_set(F.col("_p"), F.col("_r"), 2)).alias("rouge_2")]
    if with_l:
        aggs.append(F.avg(rouge_l_f(F.col("_p"), F.col("_r"))).alias("rouge_l"))
    return d.agg(*aggs)


# English number words and the Latin parts of the names of powers of 1000.
ONES = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ILLIONS = "m b tr quadr quint sext sept oct non".split()
ILLION_UNITS = ["", "un", "duo", "tre", "quattuor", "quin", "sex", "sept", "octo", "novem"]
ILLION_TENS = "dec vigint trigint quadragint quinquagint sexagint septuagint octogint nonagint".split()

_AROUND = r"[\p{L}\p{N}_]"
_CUT = "\u0001"


def _below_thousand() -> list[str]:
    """Words of 0..999 without hyphens (0 is empty: a group of zeros is not spoken)."""
    small = ONES + [t + (ONES[o] if o else "") for t in TENS for o in range(10)]
    out = ["", *small[1:]]
    for h in range(1, 10):
        out += [f"{ONES[h]} hundred" + (f" and {small[r]}" if r else "") for r in range(100)]
    return out


def _powers() -> list[str]:
    """Names of 1000^k for k = 0..101, up to the centillion."""
    names = ILLIONS + [u + t for t in ILLION_TENS for u in ILLION_UNITS] + ["cent"]
    return ["", "thousand", *[f"{n}illion" for n in names]]


def spell_number(digits: Column) -> Column:
    """English words of a run of digits of any length, in the letters-only form.

    Groups of three digits are looked up and named by their power of 1000; a last group
    below 100 is joined by ``and``. Beyond the largest name, names are multiplied.
    """
    table = F.split(F.lit(",".join(_below_thousand())), ",")  # one constant each
    powers = _powers()
    names = F.split(F.lit(",".join(powers)), ",")
    top = len(powers) - 1
    d = F.regexp_replace(digits, "^0+", "")
    padded = F.lpad(d, (3 * F.ceil(F.length(d) / 3)).cast("int"), "0")
    triples = F.regexp_extract_all(padded, F.lit("[0-9]{3}"), 0)

    def spoken(t: Column) -> Column:
        words = F.filter(F.transform(t, lambda s, i: group(s.cast("int"), F.size(t) - 1 - i, F.size(t))), lambda w: w.isNotNull())
        return F.array_join(words, " ")

    def group(value: Column, k: Column, groups: Column) -> Column:
        name = F.concat_ws(" ", F.element_at(names, k % top + 1), F.repeat(F.lit(f"{powers[-1]} "), F.floor(k / top).cast("int")))
        joined = F.when((k == 0) & (value < 100) & (groups > 1), F.lit("and ")).otherwise(F.lit(""))
        return F.when(value > 0, F.concat_ws(" ", F.concat(joined, F.element_at(table, value + 1)), name))

    said = F.element_at(F.transform(F.array(triples), spoken), 1)
    return F.when(F.length(d) == 0, F.lit(ONES[0])).otherwise(said)


def vqa_words(text: Column) -> Column:
    """digit runs that stand alone to words, letters and spaces only, lower-cased words."""
    marked = F.regexp_replace(F.replace(text, F.lit(_CUT), F.lit(".")), rf"(?<!{_AROUND})([0-9]+)(?!{_AROUND})", f"{_CUT}$1{_CUT}")
    # every other piece is a number
    spelled = F.transform(F.split(marked, _CUT, -1), lambda s, i: F.when(i % 2 == 1, spell_number(s)).otherwise(s))
    clean = F.lower(F.regexp_replace(F.array_join(spelled, ""), r"[^a-zA-Z ]", ""))
    return words(clean)


def vqa_f1_em(df: DataFrame, pred: str, gt: str) -> DataFrame:
    """Token F1 and the matched-word ratio (Q22: distinct reference words found in
    the candidate over the candidate word count; 0.0 for an empty candidate), averaged
    separately for yes/no ground truths (``closed``) and the rest (``open``)."""

    def scores(x: Column) -> Column:
        c, r, cs, rs = x["c"], x["r"], F.array_distinct(x["c"]), F.array_distinct(x["r"])
        tp = F.size(F.filter(c, lambda w: F.array_contains(r, w)))
        fp = F.size(c) - tp
        fn = F.size(F.filter(r, lambda w: ~F.array_contains(c, w)))
        prec, rec = tp / (tp + fp), tp / (tp + fn)
        f1 = F.when((F.size(c) == 0) | (F.size(r) == 0) | (tp == 0), F.lit(0.0)).otherwise(2 * prec * rec / (prec + rec))
        em = F.when(F.size(c) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(rs, cs)) / F.size(c))
        return F.struct(f1.alias("f1"), em.alias("em"))

    # both word lists are worked out once and bound to the lambda's argument
    both = F.array(F.struct(vqa_words(F.col(pred)).alias("c"), vqa_words(F.col(gt)).alias("r")))
    found = F.explode(F.transform(both, scores))
    kind = F.when(F.lower(F.col(gt)).isin("yes", "no"), F.lit("closed")).otherwise(F.lit("open"))
    return df.select(kind.alias("kind"), found.alias("s")).groupBy("kind").agg(
        F.avg("s.f1").alias("f1"), F.avg("s.em").alias("exact_match"), F.count(F.lit(1)).alias("n")
    )
