"""Phrase collocations by best-first branch and bound over a tree of prefixes (operator 11).

The score of a phrase is that of its weakest cut into a first part and a rest, ``a n / (l r)``.
No count exceeds that of a part, so a phrase that begins with the prefix ``p`` scores at
most ``n / f(p)``, and with the count of the first word the bound is tightest. The
frontier are prefixes that occur ``least`` times, first of one word. It is
expanded in rounds, those of the best bounds (the rarest first words) first: each level of
a round counts the prefixes longer by a word, and only frequent ones stay in the tree.
Candidates of the tree whose bound reaches the present score of the language's ``TOP``-th
survivor get their remaining counts (rests, and longer phrases to the left) by one more
pass, are scored exactly, and raise that score. A language is settled when no unopened
word has a bound that reaches it, ties included.

The texts are read once and kept as numbered words in the shared folder, in chunks of a
language. Counts of a chunk leave its task as one row per different phrase, and are summed
by phrase. What tasks must know of the frontier is sent as a Bloom filter, sized from the
number of prefixes up to ``MAX_BITS``: a false member costs a count, never a result, as
every phrase that is counted at all is counted wherever it stands, and as only phrases of
words that the round opens are candidates in it.

Defined results: null and empty texts have no words; rows without a language count as
``und``; repeated rows count each; a very long text is read whole, in runs of pieces of
some ``CHUNK`` bytes; ties go by count, then phrase; an empty table, or one without a
candidate, gives no rows; columns other than the language and text are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.batches import durable, small_batches
from weft.session import ensure_checkpoint_dir

LEAST = 100
TOP = 2000
WORDS = 5
#: Share of the occurrences of frequent words that has been opened after each round.
SHARES = (0.25, 0.6, 1.0)
#: Bytes of text in a chunk.
CHUNK = 4_000_000
#: Bits of a filter for each member, and at most.
BITS_EACH, MAX_BITS = 16, 1 << 26

_MARK = b"."
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(_SEPARATORS + b"\t", _MARK * len(_SEPARATORS) + b" ")
_PROBES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_FOLD = np.uint64(0xFF51AFD7ED558CCD)
_COUNTS = "lang string, phrase binary, f long"


# ---- texts as numbered words


def _runs(data: bytes) -> Iterator[bytes]:
    """Parts of about ``CHUNK`` bytes, cut at marks only."""
    start = 0
    while len(data) - start > CHUNK:
        end = data.rfind(_MARK, start, start + CHUNK)
        if end < 0 and (end := data.find(_MARK, start + CHUNK)) < 0:
            break
        yield data[start : end + 1]
        start = end + 1
    yield data[start:]


def numbered(texts: list[bytes]) -> Iterator[tuple[bytes, bytes, int]]:
    """(different words joined by spaces, their numbers in order of the text, words) by chunk.

    The first word is the mark, which stands between pieces. Numbers take two bytes if
    there are few enough, else four.
    """
    for data in _runs(_MARK.join(texts).lower().translate(_TABLE)):
        tokens = data.replace(_MARK, b" . ").split()
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        index[_MARK]
        codes = np.fromiter(map(index.__getitem__, tokens), np.uint32, len(tokens))
        if len(index) > 1:
            yield b" ".join(index), codes.astype(_kind(len(index))).tobytes(), int(np.count_nonzero(codes))


def _kind(words: int) -> str:
    return "<u2" if words <= 1 << 16 else "<u4"


def encoded(df: DataFrame, lang: str, text: str, path: str) -> DataFrame:
    """Chunks of the texts of a language: lang, words, codes, n; written to ``path``."""

    def run(batches):
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flush(name: str):
            rows = list(numbered(held.pop(name)))
            del sizes[name]
            if rows:
                columns = [pa.array([name] * len(rows), pa.string())] + [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.binary(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "codes", "n"])

        for rb in batches:
            for name, t in zip(rb.column(0).to_pylist(), rb.column(1)):
                if (size := len(b := t.as_py())) == 0:
                    continue
                held.setdefault(name, []).append(b)
                sizes[name] = sizes.get(name, 0) + size
                if sizes[name] > CHUNK:
                    yield from flush(name)
                elif sum(sizes.values()) > 4 * CHUNK:
                    yield from flush(max(sizes, key=sizes.get))
        for name in list(held):
            yield from flush(name)

    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("_text"))
    rows = rows.where(F.col("_text").isNotNull()).mapInArrow(run, "lang string, words binary, codes binary, n long")
    rows.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


# ---- hashes and filters


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _FOLD
    return h ^ (h >> np.uint64(32))


def _places(h: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return (h * _PROBES[probe]) >> np.uint64(65 - bits.bit_length())


class Filter:
    """A Bloom filter of phrases of a language, as it travels to the tasks."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def of(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for k in range(len(_PROBES)):
            p = _places(h, k, 64 * len(self.words))
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of the (lang, phrase) rows; its words come together by a bitwise aggregate."""
    members = phrases.count()
    bits = min(MAX_BITS, max(1 << 13, 1 << (BITS_EACH * members - 1).bit_length())) if members else 1 << 13

    def run(batches):
        for rb in batches:
            h = np.fromiter((_phrase_hash(a, b) for a, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist())), np.uint64, rb.num_rows)
            p = np.concatenate([_places(h, k, bits) for k in range(len(_PROBES))])
            bit = np.left_shift(np.uint64(1), p & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], names=["w", "b"])

    rows = phrases.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "w long, b long")
    found = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most bits / 64 rows
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Filter(words)


def _phrase_hash(lang: str, phrase: bytes) -> np.uint64:
    h = np.array([_seed(lang)])
    for w in phrase.split(b" "):
        h = _fold(h, np.array([xxhash.xxh64_intdigest(w)], dtype=np.uint64))
    return h[0]


# ---- counts of a chunk


class Chunk:
    """The words of one chunk, and the phrases at places in it."""

    def __init__(self, lang: str, words: bytes, codes: bytes):
        self.lang, self.words = lang, words.split(b" ")
        self.codes = np.frombuffer(codes, dtype=_kind(len(self.words))).astype(np.int64)
        self.hashes = _word_hashes(self.words)
        self.table = pa.array(self.words, pa.binary())

    def words_in(self, chosen: Filter) -> np.ndarray:
        """Whether each different word is a member; the mark is none."""
        found = chosen.of(_fold(np.full(len(self.words), _seed(self.lang)), self.hashes))
        found[0] = False
        return found

    def hash_at(self, at: np.ndarray, m: int) -> np.ndarray:
        h = np.full(len(at), _seed(self.lang))
        for j in range(m):
            h = _fold(h, self.hashes[self.codes[at + j]])
        return h

    def places(self, m: int, first: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Places of ``m`` words in a row, the first of them marked in ``first`` and the others in ``other``."""
        n = len(self.codes) - m + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        ok = first[self.codes[:n]]
        for j in range(1, m):
            ok &= other[self.codes[j : n + j]]
        return np.flatnonzero(ok)

    def counts(self, at: np.ndarray, m: int) -> pa.RecordBatch:
        """One row for each different phrase of ``m`` words at the places."""
        h = self.hash_at(at, m)
        _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        rows = [self.codes[at + j] for j in range(m)]
        if not all((r == r[first][inverse]).all() for r in rows):  # two phrases of one hash
            _, first, times = np.unique(np.stack(rows, axis=1), axis=0, return_index=True, return_counts=True)
        parts = [self.table.take(pa.array(r[first])) for r in rows]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(first), pa.string()), phrase, pa.array(times.astype(np.int64))], names=["lang", "phrase", "f"])


def _count(chunks: DataFrame, least: int, filters: dict, emit) -> DataFrame:
    """Frequent (lang, phrase, f) of what ``emit(chunk, filters)`` gives, summed over all chunks; durable."""
    sent = chunks.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for rb in batches:
            for lang, words, codes in zip(*(rb.column(k) for k in range(3))):
                yield from emit(Chunk(lang.as_py(), words.as_py(), codes.as_py()), sent.value)

    rows = chunks.select("lang", "words", "codes").mapInArrow(run, _COUNTS)
    out = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    out = durable(out.select("lang", F.col("phrase").cast("string").alias("phrase"), "f"))
    sent.destroy()
    return out


def frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    def emit(chunk: Chunk, _):
        yield chunk.counts(np.flatnonzero(chunk.codes), 1)

    return _count(chunks, least, {}, emit)


def longer_prefixes(chunks: DataFrame, least: int, words: Filter, opened: Filter, prefixes: Filter, m: int) -> DataFrame:
    """Frequent phrases of ``m`` words that begin with an opened word and a known prefix of ``m - 1``."""

    def emit(chunk: Chunk, sent):
        at = chunk.places(m, chunk.words_in(sent["opened"]), chunk.words_in(sent["words"]))
        if m > 2:
            at = at[sent["prefixes"].of(chunk.hash_at(at, m - 1))]
        if len(at):
            yield chunk.counts(at, m)

    return _count(chunks, least, {"words": words, "opened": opened, "prefixes": prefixes}, emit)


def missing_counts(chunks: DataFrame, least: int, words: Filter, wanted: Filter, grown: Filter) -> DataFrame:
    """Frequent phrases that are ``wanted``, and those longer by a word to the left of ``grown`` ones."""

    def emit(chunk: Chunk, sent):
        known = chunk.words_in(sent["words"])
        longer = np.empty(0, dtype=np.int64)  # places one to the left of the phrases that may grow
        for m in range(2, WORDS):
            at = chunk.places(m, known, known)
            h = chunk.hash_at(at, m)
            # a phrase may be both wanted and a longer one; its places count once
            if len(both := np.union1d(at[sent["wanted"].of(h)], longer)):
                yield chunk.counts(both, m)
            longer = at[sent["grown"].of(h)] - 1
            longer = longer[longer >= 0]
            longer = longer[known[chunk.codes[longer]]]
        if len(longer):
            yield chunk.counts(longer, WORDS)

    return _count(chunks, least, {"words": words, "wanted": wanted, "grown": grown}, emit)


# ---- scores


def _size(phrase: str = "phrase") -> Column:
    return F.length(phrase) - F.length(F.replace(F.col(phrase), F.lit(" "), F.lit(""))) + 1


def _cut(phrase: str, k: Column) -> tuple[Column, Column]:
    """The first ``k`` words, and the rest."""
    words = F.split(phrase, " ")
    return F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words) - k), " ")


def _ratio() -> Column:
    """floor(1000 a n / (l r)) in exact decimals."""
    return F.expr("cast((cast(1000 as decimal(5,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0))) as long)")


def weakest_cuts(candidates: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the cut that scores least, of equals the first."""
    first, rest = _cut("phrase", F.col("k"))
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), _size() - 1)).alias("k")).withColumns({"first": first, "rest": rest})
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(langs.select("lang", "n"), "lang")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(_ratio().alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def not_contained(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates that stand somewhere without any longer one around them.

    A longer phrase with the same count exists only if one longer by a single word does,
    so prefixes and rests by one word are all there is to compare.
    """
    longer = counts.where(_size() > 2)
    inner = [longer.select("lang", _cut("phrase", k)[side].alias("phrase"), F.col("f").alias("a")) for side, k in ((0, _size() - 1), (1, F.lit(1)))]
    return candidates.join(inner[0].union(inner[1]).distinct(), ["lang", "phrase", "a"], "left_anti")


def _reaching(candidates: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """Candidates whose bound from their last cut reaches the score that the language asks for."""
    prefix, _ = _cut("phrase", _size() - 1)
    last = F.substring_index("phrase", " ", -1)
    left = counts.select("lang", F.col("phrase").alias("_p"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_w"), F.col("f").alias("r"))
    known = candidates.withColumns({"_p": prefix, "_w": last}).join(left, ["lang", "_p"]).join(right, ["lang", "_w"]).join(langs, "lang")
    return known.where(_ratio() >= F.col("asked")).select("lang", "phrase", "a")


# ---- the search


def _limits(words: DataFrame, n: DataFrame) -> DataFrame:
    """(lang, n, reach): the greatest word count that each round may open.

    Words are summed by quarter powers of two of their counts, a few rows a language.
    """
    steps = words.groupBy("lang", F.floor(F.log2("f") * 4).alias("step")).agg(F.sum("f").alias("sum"), F.max("f").alias("top"))
    by_count = Window.partitionBy("lang").orderBy("step")
    share = F.sum("sum").over(by_count) / F.sum("sum").over(Window.partitionBy("lang"))
    lowest = F.row_number().over(by_count) == 1
    marked = steps.select("lang", "top", share.alias("share"), lowest.alias("lowest"))
    reach = [F.max(F.when((F.col("share") <= s) | F.col("lowest") | F.lit(s >= 1), F.col("top"))) for s in SHARES]
    return marked.groupBy("lang").agg(F.array(*reach).alias("reach")).join(n, "lang")


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases that occur ``least`` times."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/phrases-{uuid.uuid4().hex}"
    chunks = encoded(df, lang, text, folder)
    words = frequent_words(chunks, least)
    total = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    langs = durable(_limits(words, total).select("*", F.lit(0).cast("long").alias("opened"), F.lit(0).cast("long").alias("asked")))
    all_words = filter_of(words)
    counts, scored = words, None
    for k in range(len(SHARES)):
        bound = F.when(F.col("asked") > 0, F.expr("(1000L * n) div asked"))
        until = F.least(F.col("reach")[k], bound)  # of what is not null
        langs = langs.withColumn("until", until)
        fresh = durable(words.join(langs, "lang").where("f > opened and f <= until").select("lang", "phrase"))
        opened = filter_of(fresh)
        tree, prefixes = None, opened
        for m in range(2, WORDS + 1):
            level = longer_prefixes(chunks, least, all_words, opened, prefixes, m)
            tree = level if tree is None else tree.union(level)
            if level.isEmpty():
                break
            prefixes = filter_of(level)
        counts = durable(counts.union(tree).distinct())
        # words that the filter lets through in error have their own round
        own = fresh.select("lang", F.col("phrase").alias("_first"))
        candidates = tree.withColumns({"a": F.col("f"), "_first": F.substring_index("phrase", " ", 1)}).join(own, ["lang", "_first"], "left_semi").select("lang", "phrase", "a")
        if scored is not None:
            candidates = _reaching(candidates, counts, langs)
        candidates = durable(candidates)
        rests = candidates.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(_size() - 2, F.lit(1))), lambda i: _cut("phrase", i)[1])).alias("phrase"))
        wanted = filter_of(rests.where(_size() > 1).distinct())
        grown = filter_of(candidates.where(_size() < WORDS).select("lang", "phrase"))
        counts = durable(counts.union(missing_counts(chunks, least, all_words, wanted, grown)).distinct())
        found = weakest_cuts(not_contained(candidates, counts), counts, langs)
        scored = durable(found if scored is None else scored.union(found))
        asked = _ranked(scored, top).where(F.col("rank") == top).select("lang", F.col("score").alias("_asked"))
        langs = langs.join(asked, "lang", "left").select(
            "lang", "n", "reach", F.greatest("opened", "until").alias("opened"), F.coalesce("_asked", F.lit(0)).alias("asked")
        )
        langs = durable(langs)
    _delete(spark, folder)
    return _ranked(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language; the rank filter goes below the exchange."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
