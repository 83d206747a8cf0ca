"""Vector best-fit packing of whole tokenised documents (operator 13).

A sequence has three capacities: tokens, documents, and attention cost (the sum of the
squared lengths of its pieces). A document is an item that needs some of each. Items are
taken by falling length, and each goes to the open sequence with room for it in every
dimension that the rule likes best: ``norm`` takes the least weighted norm of what would
be left of the capacities, ``dot`` the greatest weighted dot product of the item's needs
and the room left. Where no open sequence has room, a new one is opened.

Only a document longer than a sequence may hold is cut, its first piece being the shorter
one; pieces that fill a sequence have one of their own. The other pieces are dealt by a
hash into groups of about ``GROUP`` pieces, so a group's work is bounded however many rows
a source or an id has; a group loses part of its last few sequences only.

By default the document and cost capacities follow from that of the tokens (``window`` and
``window`` squared) and never bind, for the fewest sequences; both can be set lower.

Defined results: null and empty texts have the end token only; repeated rows and rows with
a null id are packed one by one; a very long text is read whole, and its ids are held
until its pieces are cut; ties between sequences go to the one opened first; an empty
table gives an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

import json
import math
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.batches import durable, small_batches, spare_memory, text_runs
from weft.llm.memo import Memo

WINDOW = 1024
#: Pieces that are packed together.
GROUP = 20_000
#: Of tokens, documents and attention cost in the score of a sequence.
WEIGHTS = (1.0, 1e-4, 1e-4)
RULES = ("norm", "dot")

_ID_BYTES = 4
_LOCAL_BITS = 33
_ENCODERS: dict[str, tuple] = {}  # a worker's, by tokenizer file
#: Texts that both libraries cut alike: ASCII, Latin letters, common punctuation and signs.
_PLAIN = re.compile("[\x00-\x7f¡-©«-±´¶-¸»¿-ɏ‐-‧‰-⁞]*")
#: Longer runs without a cut are left to the library whose time doesn't grow with their square.
_LONG_RUN = re.compile(r"[^ ]{1000}|[\t-\r ]{1000}")
#: In other texts, a word with the white space before it, or white space at the end. No
#: token reaches from a word into the white space behind it. The four separators 1C to 1F
#: are white space to Python alone.
_UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
#: The first step of byte-level vocabularies: words, numbers and signs with the space before
#: them, endings behind an apostrophe, white space (a fixed value of the tokenizer's library).
_FIRST_STEP = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: How byte-level vocabularies spell the bytes that have no sign of their own.
_SPELLING = {256 + k: b for k, b in enumerate([*range(33), *range(127, 161), 173])}


def _by_rank(tokenizer):
    """``fn(text)`` giving the ids of a plain text by the order of the vocabulary's numbers.

    None if the tokenizer has another first step, or merges pairs in another order than
    that of their numbers.
    """
    import tiktoken

    told = json.loads(tokenizer.to_str())
    step, model = told["pre_tokenizer"] or {}, told["model"]
    if told["normalizer"] or (step.get("type"), step.get("use_regex"), step.get("add_prefix_space")) != ("ByteLevel", True, False) or model["type"] != "BPE":
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    special = {t["content"] for t in told["added_tokens"]}
    ranks = {t.translate(_SPELLING).encode("latin-1"): n for t, n in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=_FIRST_STEP, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_level_ids(path: str) -> Callable[[list[str]], list[bytes]]:
    """``fn(texts)`` giving each text's ids as little-endian unsigned 32-bit integers.

    Plain texts are encoded by rank, which is the same rule and several times faster. The
    ids of others are those of their words, each with the white space before it; each goes
    through the tokenizer once, as long as the worker remembers it.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def unit_ids(units: list[str]) -> Iterator[bytes]:
            for a in range(0, len(units), 4096):
                for e in tokenizer.encode_batch_fast(units[a : a + 4096], add_special_tokens=False):
                    yield struct.pack(f"<{len(e.ids)}I", *e.ids)

        _ENCODERS[path] = _by_rank(tokenizer), Memo(unit_ids)
    by_rank, memo = _ENCODERS[path]

    def plain(text: str) -> bool:
        # special tokens begin with these signs
        return by_rank is not None and "<|" not in text and bool(_PLAIN.fullmatch(text)) and not _LONG_RUN.search(text)

    def encode(texts: list[str]) -> list[bytes]:
        units = [None if plain(t) else _UNIT.findall(t) for t in texts]
        get = memo.getter([u for u in units if u])
        out = []
        for t, u in zip(texts, units):
            if u is None:
                ids = by_rank(t)
                out.append(struct.pack(f"<{len(ids)}I", *ids))
            else:
                out.append(b"".join(map(get, u)))
        return out

    return encode


def best_fit(
    sizes: np.ndarray, window: int, max_docs: int, max_cost: int, weights: tuple[float, float, float] = WEIGHTS, rule: str = RULES[0]
) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (numbered from 0) and the offset there of each item, given by its tokens."""
    sizes = np.asarray(sizes, dtype=np.int64)
    capacity = np.array([window, max_docs, max_cost], dtype=np.float64)
    share = np.asarray(weights, dtype=np.float64) / capacity**2
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    room = np.empty((3, len(sizes)), dtype=np.int64)  # of the open sequences, which stand in the first columns
    names = np.empty(len(sizes), dtype=np.int64)
    n_open = n_bins = closed = 0
    least = int(sizes.min()) if len(sizes) else 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        need = np.array([size, 1, size * size])
        now = room[:, :n_open]
        fits = np.flatnonzero((now[0] >= size) & (now[1] >= 1) & (now[2] >= need[2]))
        if len(fits):
            left = now[:, fits].astype(np.float64)
            if rule == "norm":
                left -= need[:, None]
                at = int(fits[np.argmin(share @ (left * left))])
            else:
                at = int(fits[np.argmax((share * need) @ left)])
        else:
            at = n_open
            room[:, at] = window, max_docs, max_cost
            names[at] = n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = names[at], window - room[0, at]
        room[:, at] -= need
        if room[0, at] < least or room[1, at] < 1:
            room[0, at] = -1
            closed += 1
            if 4 * closed > n_open:
                keep = np.flatnonzero(room[0, :n_open] >= 0)
                room[:, : len(keep)], names[: len(keep)] = room[:, keep], names[keep]
                n_open, closed = len(keep), 0
    return bins, offsets


def document_pieces(df: DataFrame, tokenizer_path: str, id_col: str, text: str, longest: int, end_id: int) -> DataFrame:
    """One row per piece of at most ``longest`` tokens, with a row number that is unique in the table."""
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32", "doc_tokens", "_row"]

    def run(batches):
        spare_memory()
        encode = byte_level_ids(tokenizer_path)
        row = TaskContext.get().partitionId() << _LOCAL_BITS
        for rb in batches:
            for some in text_runs(rb, 1):
                source, rows = [], []
                for k, ids in enumerate(encode([t or "" for t in some.column(1).to_pylist()])):
                    view = memoryview(ids + end)
                    tokens = len(view) // _ID_BYTES
                    start, length = 0, tokens % longest or longest
                    for piece in range(-(-tokens // longest)):
                        cut = view[start * _ID_BYTES : (start + length) * _ID_BYTES]
                        source.append(k)
                        rows.append((piece, start, length, zlib.crc32(cut), tokens, row))
                        start, length, row = start + length, longest, row + 1
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(source, pa.int64())), *columns], names=[id_col, *names])

    small_batches(df.sparkSession)
    fields = ", ".join(f"{n} long" for n in names)
    rows = df.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, {fields}")


def pack_whole(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    max_docs: int | None = None,
    max_cost: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = RULES[0],
    end_id: int = 2,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, doc_tokens.

    A sequence holds at most ``window`` tokens, ``max_docs`` pieces and an attention cost
    of ``max_cost``. Its number is the row number of its first piece.
    """
    max_docs = window if max_docs is None else max_docs
    max_cost = window * window if max_cost is None else max_cost
    if min(window, max_docs, max_cost) < 1 or rule not in RULES:
        raise ValueError("capacities must be positive and the rule one of " + ", ".join(RULES))
    longest = min(window, math.isqrt(max_cost))
    pieces = durable(document_pieces(df, tokenizer_path, id_col, text, longest, end_id))
    out = [F.col(f"`{id_col}`"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "doc_tokens"]
    alone = pieces.where(F.col("length") == window).withColumn("sequence_id", F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    loose = pieces.where(F.col("length") < window)
    groups = max(1, -(-loose.count() // GROUP))

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by("_row")  # the order of rows that a shuffle brings is arbitrary
        rows = table.column("_row").to_numpy()
        bins, offsets = best_fit(table.column("length").to_numpy(), window, max_docs, max_cost, weights, rule)
        first = np.empty(int(bins.max()) + 1, dtype=np.int64)
        first[bins[offsets == 0]] = rows[offsets == 0]
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(first[bins])).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"
    dealt = loose.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    packed = dealt.groupBy("_group").applyInArrow(place, schema)
    return alone.unionByName(packed).select(*out)
