"""Personal data by patterns, and information-theoretic sanitisation of what reveals it (operator 6).

Patterns find e-mail addresses, IP addresses, card and phone numbers; each distinct value
is a protected entity. All four numbers are counted over the different texts of the corpus
(copies of a text count once): ``n(e, t)`` is how many hold entity ``e`` and term ``t`` outside
of the patterns' matches, ``n(e)`` how many hold ``e``, ``n(t)`` how many hold ``t``, and ``N`` all
of them. What a reader of ``t`` learns of ``e`` is estimated with care for small numbers: of
the share ``n(e, t) / n(t)`` the lower bound ``p`` of its confidence interval (Wilson's, one-sided
95 %) counts. A term discloses an entity if it gives away ``SHARE`` of the entity's
information content,

    log(p N / n(e)) / log(N / n(e)),

and leaves few bits of it open: in every text of the entity, wherever they stand, terms are
removed where ``p`` reaches ``REMOVE_FROM``, and generalised (to a word, name or number sign)
from ``GENERALISE_FROM``. A term that stands in a single text, like most rare words beside an
address, has a bound of 0.27 in a corpus of any size, and stays.

Texts are counted for those terms only that some entity shares: a Bloom filter of fixed
size goes to the tasks, and what it lets through in error drops out in the join.

Defined results: null counts as an empty text, which has no spans; repeated rows have equal
spans each; an empty table gives an empty result; a very long text is read whole; ties
between kinds of a term go to removal; columns other than the id and text are not read, and
:func:`sanitise` returns them as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weft.llm.batches import durable, map_texts, small_batches, spare_memory, text_runs

KINDS = ("email", "ip", "card", "phone", "general", "term")
#: Quantile of the normal distribution for the one-sided confidence bound of 95 %.
Z = 1.645
#: Share of an entity's information content that a disclosing term gives away at least.
SHARE = 0.6
#: Bounds of the share of a term's texts that hold the entity.
REMOVE_FROM = 0.4
GENERALISE_FROM = 0.3
#: Bits of the filters of the terms to count and of the texts that have copies.
TERM_BITS = 1 << 23
COPY_BITS = 1 << 22
#: Distinct terms that a counting task holds before it passes them on.
TASK_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses from left to right. Only places with an @ are looked at, so long runs of letters cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", free if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """What the value of a match stands under: its kind and its signs without case or separators."""
    start, kind, end = span
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _digits(value)}"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def distinct_document_counts(df: DataFrame, terms: DataFrame, text: str = "text") -> tuple[DataFrame, float]:
    """(term, n): the different texts that hold each of ``terms``, over all of ``df``; and the number of all different texts.

    Texts without a copy are counted where they stand. Those that may have one, by a filter
    of fixed size, are brought together by their hash and counted once.
    """
    wanted_bits, _ = _filter_bits(terms.select(F.xxhash64("term").alias("_key")).distinct(), TERM_BITS)
    hashes = df.select(_text_key(text).alias("_key")).groupBy("_key").agg(F.count("*").alias("k"))
    copied_bits, total = _filter_bits(hashes, COPY_BITS, F.col("k") > 1)
    sent = df.sparkSession.sparkContext.broadcast((wanted_bits.tobytes(), copied_bits.tobytes()))

    def copied(keys):
        p = keys % COPY_BITS
        return (np.frombuffer(sent.value[1], dtype="<u4")[p // 32] >> (p % 32).astype(np.uint32) & 1).astype(bool)

    def count(batches, texts_of, column):
        bits = np.frombuffer(sent.value[0], dtype="<u4")
        counts: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for rb in batches:
            for part in text_runs(rb, column):
                documents = [set(_WORD.findall(t.lower())) for t in texts_of(part) if t]
                distinct = list(set().union(*documents))
                p = np.fromiter((_text_hash(w) for w in distinct), dtype=np.int64, count=len(distinct)) % TERM_BITS
                wanted = {distinct[i] for i in np.flatnonzero(bits[p // 32] >> (p % 32).astype(np.uint32) & 1)}
                if wanted:
                    for words in documents:
                        counts.update(words & wanted)
                if len(counts) > TASK_TERMS:
                    yield flush()
        yield flush()

    def single(batches):
        yield from count(batches, lambda part: part.column(1).filter(pa.array(~copied(part.column(0).to_numpy()))).to_pylist(), 1)

    def may_repeat(batches):
        seen: set[int] = set()  # one number for each text of the task that may have copies
        for rb in batches:
            keys = rb.column(0).to_numpy()
            fresh = []
            for i in np.flatnonzero(copied(keys)).tolist():
                if (k := int(keys[i])) not in seen:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                yield rb.take(pa.array(fresh))

    def once(batches):
        yield from count(batches, lambda part: part.column(1).to_pylist(), 1)

    small_batches(df.sparkSession)
    rows = df.select(_text_key(text).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    copies = rows.mapInArrow(may_repeat, "_key long, text string").dropDuplicates(["_key"])
    fields = "term string, n long"
    counted = rows.mapInArrow(single, fields).union(copies.mapInArrow(once, fields))
    return counted.join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), total


def _filter_bits(keys: DataFrame, bits: int, chosen: Column | None = None) -> tuple[np.ndarray, float]:
    """A filter of ``bits`` bits, in words of 32, of the ``chosen`` different hashes ``_key``; and the number of all of them."""
    place = F.pmod("_key", F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(pmod(_key, 32) as int))")
    words = keys.groupBy(F.floor(place / 32).alias("w")).agg(F.count("*").alias("n"), F.bit_or(bit if chosen is None else F.when(chosen, bit).otherwise(F.lit(0))).alias("b"))
    out = np.zeros(bits // 32, dtype="<u4")
    total = 0.0
    for r in words.collect():  # at most bits / 32
        out[r["w"]] = r["b"]
        total += r["n"]
    return out, total


def find_entities(df: DataFrame, keep=("doc_id",), text: str = "text", texts: bool = True) -> DataFrame:
    """``keep`` columns, ``_spans`` of the patterns, ``_entities`` in them and the text's hash; with ``texts``, ``_text`` where there is a span."""
    names = ("start", "kind", "end")

    def run(batch):
        spans = [base_spans(t) for t in batch]
        out = [
            [[dict(zip(names, s)) for s in x] for x in spans],
            [sorted({entity(t, s) for s in x}) for t, x in zip(batch, spans)],
            [_text_hash(t) for t in batch],
        ]
        return out + ([[t if x else None for t, x in zip(batch, spans)]] if texts else [])

    fields = "_spans array<struct<start:int,kind:int,end:int>>, _entities array<string>, _hash long"
    return map_texts(df, lambda: run, fields + (", _text string" if texts else ""), keep=keep, text=text)


def _text_hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42))


def free_words(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words that no span touches; ``spans`` are in order."""
    at, reach = 0, 0  # reach: the furthest end of the spans that begin before the word's end
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach:
            yield m[0].lower(), m.start(), m.end()


def _document_terms(found: DataFrame, text: str) -> DataFrame:
    """(_hash, term) of the different texts of ``found``."""

    def run(batches):
        for rb in batches:
            for part in text_runs(rb, 1):
                for h, t, spans in zip(*(part.column(i).to_pylist() for i in range(3))):
                    terms = sorted({w[0] for w in free_words(t, [(x["start"], x["kind"], x["end"]) for x in spans])})
                    yield pa.RecordBatch.from_arrays([pa.array([h] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["_hash", "term"])

    small_batches(found.sparkSession)
    return found.select("_hash", F.col(text).alias("_t"), "_spans").dropDuplicates(["_hash"]).mapInArrow(run, "_hash long, term string")


def lower_bound(hits: Column, tries: Column) -> Column:
    """Wilson's lower confidence bound of a share."""
    share, z2 = hits / tries, Z * Z
    spread = F.sqrt(share * (1 - share) / tries + z2 / (4 * tries * tries))
    return (share + z2 / (2 * tries) - Z * spread) / (1 + z2 / tries)


def revealing(df: DataFrame, found: DataFrame, text: str = "text", found_text: str = "_text") -> DataFrame:
    """(_hash, _terms) of the texts of ``found`` in which terms reveal an entity; a term comes with the kind of its span."""
    present = found.select("_hash", F.explode("_entities").alias("entity")).distinct()
    # entities of the same texts have equal counts with every term: one of them stands for all
    signature = [F.bit_xor(F.xxhash64("_hash", F.lit(k))).alias(f"_s{k}") for k in (1, 2)]
    counted = present.groupBy("entity").agg(F.count("*").alias("n_entity"), *signature)
    classes = counted.groupBy("n_entity", "_s1", "_s2").agg(F.min("entity").alias("entity")).select("entity", "n_entity")
    members = durable(present.join(classes, "entity"))
    terms = _document_terms(found, found_text)
    counts, total = distinct_document_counts(df, terms.select("term").distinct(), text)
    most = members.agg(F.max("n_entity")).first()[0] or 1
    # a term of more texts, or of one, can't reach the threshold with any entity
    counts = counts.where((F.col("n") > 1) & (F.col("n") <= most / GENERALISE_FROM))
    held = durable(terms.join(counts, "term"))
    content = F.log(F.lit(total) / F.col("n_entity"))

    def discloses(bound: Column) -> Column:
        return (bound >= GENERALISE_FROM) & (content > 0) & (F.log(bound * F.lit(total) / F.col("n_entity")) >= SHARE * content)

    possible = members.join(held, "_hash").where(discloses(lower_bound(F.least("n_entity", "n"), F.col("n"))))
    pairs = possible.groupBy("entity", "term", "n_entity", "n").agg(F.count("*").alias("n_pair"))
    pairs = pairs.withColumn("disclosure", lower_bound(F.col("n_pair"), F.col("n")))
    scored = durable(pairs.where(discloses(F.col("disclosure"))).select("entity", "term", "disclosure"))
    kind = F.when(F.col("disclosure") >= REMOVE_FROM, F.lit(KINDS.index("term"))).otherwise(F.lit(KINDS.index("general")))
    hits = possible.select("_hash", "entity", "term").join(scored, ["entity", "term"]).groupBy("_hash", "term").agg(F.max(kind).alias("kind"))
    # at most the text's own words
    return hits.groupBy("_hash").agg(F.collect_list(F.struct("term", "kind")).alias("_terms"))


def all_spans(text: str, spans: list[dict], terms: list[dict] | None) -> list[tuple[int, int, int]]:
    """The patterns' spans and those of ``terms`` wherever they stand in the text, in order."""
    own = [(x["start"], x["kind"], x["end"]) for x in spans]
    if not terms:
        return own
    kinds = {x["term"]: x["kind"] for x in terms}
    return sorted(own + [(a, kinds[t], b) for t, a, b in free_words(text, own) if t in kinds])


def spans(df: DataFrame, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and ``_spans``: (start, kind, end) of patterns and revealing terms, in order."""
    marked = durable(find_entities(df, keep=keep, text=text))
    found = marked.where(F.size("_spans") > 0)
    kept = [c for c in found.columns if c not in ("_spans", "_entities", "_hash", "_text")]
    with_terms = found.join(revealing(df, found, text), "_hash", "left").select(*kept, "_text", "_spans", "_terms")
    place = len(kept)
    out = with_terms.select(*kept, "_spans").schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for rb in batches:
            for part in text_runs(rb, place):
                texts, own, terms = (part.column(place + i).to_pylist() for i in range(3))
                every = [[{"start": a, "kind": k, "end": b} for a, k, b in all_spans(*x)] for x in zip(texts, own, terms)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(place)), pa.array(every, arrow.field(place).type)], schema=arrow)

    return marked.where(F.size("_spans") == 0).select(*kept, "_spans").union(with_terms.mapInArrow(run, out))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_documents(documents: DataFrame) -> DataFrame:
    """doc_id, the counts and hash of the patterns' spans, and all spans as text."""
    base = F.filter("_spans", lambda s: s["kind"] < 4)
    number = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return spans(documents).select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("_spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's sign in its place; overlapping spans share the first one's sign."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], _sign(text[start:end], KINDS[kind])]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _sign(value: str, kind: str) -> str:
    if kind == "term":
        return "[removed]"
    if kind == "general":
        return "[number]" if value.isdigit() else "[name]" if value[:1].isupper() else "[word]"
    return f"[{kind}]"


def sanitise(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``df`` with its texts redacted; all columns stay. Null texts stay null.

    Where a text changes, a column named ``length`` gets its new number of characters.
    """
    columns = df.columns
    named = [f"_{i}" for i in range(len(columns))]  # so that no column falls together with a result
    rows, words = df.toDF(*named), named[columns.index(text)]
    size = columns.index(length) if length in columns else None
    marked = find_entities(rows, keep=named, text=words, texts=False)
    # only rows with a match are kept for the joins; the others pass as they are
    found = durable(marked.where(F.size("_spans") > 0))
    place = columns.index(text)

    def run(batches):
        spare_memory()
        for rb in batches:
            for part in text_runs(rb, place):
                texts, own, terms = part.column(place).to_pylist(), part.column(len(named)).to_pylist(), part.column(len(named) + 1).to_pylist()
                new = [redact(t, all_spans(t, x, y)) for t, x, y in zip(texts, own, terms)]
                arrays = [pa.array(new, part.column(i).type) if i == place else part.column(i) for i in range(len(named))]
                if size is not None:
                    arrays[size] = pa.array([len(t) for t in new], part.column(size).type)
                yield pa.RecordBatch.from_arrays(arrays, names=named)

    small_batches(df.sparkSession)
    hidden = found.join(revealing(rows, found, words, found_text=words), "_hash", "left").select(*named, "_spans", "_terms").mapInArrow(run, rows.schema)
    return marked.where(F.size("_spans") == 0).select(*named).union(hidden).toDF(*columns)
