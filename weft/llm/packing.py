"""Sum-of-squares online packing of tokenised documents into fixed windows (operator 10).

Every task packs its own run of documents. Whole documents of at most one window are the
items; a longer document first gives full windows and leaves its rest as an item. The
level array ``N[h]`` counts the open windows filled to ``h`` tokens, and an item goes to
the level (an open one, or an empty window) for which the sum of the squared counts is
least afterwards. At the end of the task the windows still open are poured together:
their pieces are cut freely into full windows, and the last rest into windows of powers
of two, which need no padding.

Defined results: null and empty texts have the end token only; repeated rows are packed
one by one; an empty table gives an empty result; columns other than the id and text are
not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.batches import CHUNK_CHARS, durable, small_batches, spare_memory, text_runs
from weft.llm.memo import Memo

WINDOW = 2048
_ID_BYTES = 4
_ENCODERS: dict[str, tuple] = {}  # a worker's, by tokenizer file


#: ASCII letters, or anything else; and a word between marks of ASCII punctuation.
_ASCII_RUNS = re.compile("[A-Za-z]+|[^A-Za-z]+")
#: Letters of the first blocks, all of them whole characters that lower to one character.
_LATIN_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ƿǄ-ɏ]+")
#: How byte-level vocabularies spell the bytes that have no sign of their own.
_SPELLING = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
_MARKS = r"[!-&(-/:-@\[-`{-~]*"
_CORE = re.compile(f"({_MARKS})(.*?)({_MARKS})", re.DOTALL)
#: Marks, neither letters nor numbers nor white space, that the tokenizer leaves as they are.
_SIGNS = "!-/:-@\\[-`{-~¡-©«¬\xad®-±´¶-¸»¿×÷‐-‧‰-⁞"
_RUN = f"[0-9{_SIGNS}{_LATIN_WORD.pattern[1:-2]}]{{0,1000}}"
#: Texts that are encoded by rank: printable ASCII, Latin letters and signs, without very long runs,
#: as the time of those grows with their square.
_PLAIN = re.compile(f"(?:{_RUN}[ \t\n\r])*+{_RUN}")
#: Where the tokenizer's first step takes marks off the letters: a digit, an ending, a run of signs.
_CUT = re.compile(f"[0-9{_SIGNS}](?:(?<=[0-9])|(?<=')(?:s|t|re|ve|m|ll|d)|[{_SIGNS}]*)")
#: The steps before the model for which ``_CUT`` and lowering do the same on plain texts.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_FIRST_STEP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_parts(word: str) -> list[str]:
    """A word cut where the tokenizer's own first step always cuts, with ASCII letters lowered as it does.

    That step takes runs of letters apart from runs of other marks, but for apostrophes
    and its special tokens, which stay uncut here. Outside ASCII only marks around a core
    that begins and ends in a letter are cut off.
    """
    if "'" in word or "<|" in word:
        return [word]
    if word.isascii():
        return _ASCII_RUNS.findall(word.lower())
    before, core, after = _CORE.fullmatch(word).groups()
    if core and core[0].isalpha() and core[-1].lower()[-1].isalpha():
        return [p for p in (before, core, after) if p]
    return [word]


def _by_rank(tokenizer) -> Callable[[str], bytes] | None:
    """``fn(text)`` giving the ids of a plain text by the order of the vocabulary's numbers.

    A space stands for the end of a word: a byte and the space behind it are joined first,
    as the vocabulary has numbers for these pairs below those of all merges. None if the
    tokenizer has other steps before its model, or merges pairs in another order than that
    of their numbers.
    """
    import tiktoken

    told = json.loads(tokenizer.to_str())
    model, steps = told["model"], (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    end = model.get("end_of_word_suffix")
    first = {"type": "Split", "pattern": {"Regex": _FIRST_STEP}, "behavior": "Removed", "invert": True}
    if (told["normalizer"] or {}).get("normalizers") != _NORMALIZERS or len(steps) != 2 or steps[0] != first:
        return None
    if (steps[1].get("type"), steps[1].get("use_regex"), steps[1].get("add_prefix_space")) != ("ByteLevel", False, False) or model["type"] != "BPE":
        return None
    if not end or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges")):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in told["added_tokens"]}
    byte_of = {k: b for b, k in _SPELLING.items()}
    ranks = {}
    for t, n in vocab.items():
        if t not in special:
            core = t.removesuffix(end) or t
            ranks[core.translate(byte_of).encode("latin-1") + b" " * (core != t)] = n
    ends = [ranks.get(bytes([b, 32]), len(vocab)) for b in range(256)]
    if merged != sorted(merged) or max(ends) >= min(merged) or len(ranks) != len(vocab.keys() - special):
        return None
    encode = tiktoken.Encoding("ranks", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def id_bytes(text: str) -> bytes:
        text = text.lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        out, start = [], 0
        while start < len(text):  # a long text goes in stretches, cut at a space
            end = text.find(" ", start + CHUNK_CHARS) + 1 or len(text)
            ids = encode(_CUT.sub(r" \g<0> ", text[start:end]) + " ")
            out.append(struct.pack(f"<{len(ids)}I", *ids))
            start = end
        return b"".join(out)

    return id_bytes


def word_id_bytes(path: str) -> Callable[[list[str]], list[bytes]]:
    """``fn(texts)`` giving each text's ids as little-endian unsigned 32-bit integers.

    Plain texts are encoded by rank, which is the same rule and twice as fast. For the
    others: the tokenizer drops white space and never joins characters across a space or a
    line end, so a text's ids are those of its space-separated words, one after the other.
    Each distinct part of a word goes through the tokenizer once, as long as the worker
    remembers it.
    """
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model

        def part_ids(parts: list[str]) -> Iterator[bytes]:
            other = [p for p in parts if not _LATIN_WORD.fullmatch(p)]
            encoded = {}
            for a in range(0, len(other), 4096):
                some = other[a : a + 4096]
                encoded.update(zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)))
            for p in parts:
                if (e := encoded.get(p)) is not None:
                    ids = e.ids
                else:  # one word of letters: the steps before the model only lower it and spell its bytes
                    ids = [t.id for t in model.tokenize(p.lower().encode().decode("latin-1").translate(_SPELLING))]
                yield struct.pack(f"<{len(ids)}I", *ids)

        parts_memo = Memo(part_ids)

        def word_ids(words: list[str]) -> Iterator[bytes]:
            cut = [tokenizer_parts(w) for w in words]
            get = parts_memo.getter(cut)
            return (b"".join(map(get, c)) for c in cut)

        _ENCODERS[path] = _by_rank(tokenizer), Memo(word_ids, 64 << 20)
    by_rank, memo = _ENCODERS[path]

    def plain(text: str) -> bool:
        # special tokens begin with these signs
        return by_rank is not None and "<|" not in text and bool(_PLAIN.fullmatch(text))

    def encode(texts: list[str]) -> list[bytes]:
        words = [None if plain(t) else t.replace("\n", " ").split(" ") for t in texts]
        get = memo.getter([w for w in words if w])
        return [by_rank(t) if w is None else b"".join(map(get, w)) for t, w in zip(texts, words)]

    return encode


class LevelPacker:
    """Open windows by fill level; :meth:`place` puts an item where the sum of squares grows least."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)  # the level array
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.delta = np.empty(window + 1, dtype=np.int64)

    def place(self, piece: tuple, size: int) -> list | None:
        """Add a piece of ``size`` tokens (under a window); return the window if it is now full."""
        n, top = self.counts, self.window - size
        # a window of level h moves to level h + size: the squares change by 2 (N[h+size] - N[h] + 1)
        delta = self.delta[: top + 1]
        np.subtract(n[size:], n[: top + 1], out=delta)
        delta += 1
        delta *= 2
        delta[n[: top + 1] == 0] = np.iinfo(np.int64).max  # no such window is open
        delta[0] = 2 * n[size] + 1  # a new window only adds to level size
        if n[top]:
            delta[top] = 1 - 2 * n[top]  # a full window only leaves level top
        best = int(top - np.argmin(delta[::-1]))  # of equal levels the fullest
        if best:
            bin_ = self.open[best].pop()
            n[best] -= 1
        else:
            bin_ = []
        bin_.append(piece)
        level = best + size
        if level == self.window:
            return bin_
        n[level] += 1
        self.open.setdefault(level, []).append(bin_)
        return None

    def rest(self) -> list[list]:
        """The windows still open, fullest first."""
        return [b for level in sorted(self.open, reverse=True) for b in self.open[level]]


def pour(pieces: Sequence[tuple], window: int) -> Iterator[list[tuple]]:
    """Cut (document, start, length) pieces into full windows, the last rest into powers of two."""
    total = sum(p[2] for p in pieces)
    sizes = [window] * (total // window)
    rest = total % window
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    at, used = 0, 0
    for size in sizes:
        out, room = [], size
        while room:
            doc, start, length = pieces[at]
            take = min(room, length - used)
            out.append((doc, start + used, take))
            room, used = room - take, used + take
            if used == length:
                at, used = at + 1, 0
        yield out


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, _part int, _seq long, offset long"


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["start", "length", "ids_crc32", "doc_tokens", "_part", "_seq", "offset"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        spare_memory()
        encode = word_id_bytes(tokenizer_path)
        part = TaskContext.get().partitionId()
        packer, seq, open_ids = LevelPacker(window), 0, {}
        rows: list[tuple] = []

        def close(bin_):
            nonlocal seq
            offset = 0
            for (doc, base, tokens, ids, skip), start, length in bin_:
                cut = memoryview(ids)[(start - skip) * _ID_BYTES : (start - skip + length) * _ID_BYTES]
                rows.append((doc, start, length, zlib.crc32(cut), tokens, part, seq, offset))
                offset += length
            seq += 1

        def flush():
            cols = list(zip(*rows)) if rows else [[]] * 8
            out = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=id_arrow)] + [pa.array(c, type=k) for c, k in zip(cols[1:], kinds)], names=[id_col, *names]
            )
            rows.clear()
            return out

        id_arrow = None
        for rb in batches:
            id_arrow = rb.schema.field(0).type
            for some in text_runs(rb, 1):
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), encode(texts)):
                    ids += end
                    tokens = len(ids) // _ID_BYTES
                    full = tokens // window * window
                    for start in range(0, full, window):
                        close([((doc, 0, tokens, ids, 0), start, window)])
                    if tokens > full:
                        rest = ids[full * _ID_BYTES :]  # an open window holds the rest only
                        if done := packer.place(((doc, 0, tokens, rest, full), full, tokens - full), tokens - full):
                            close(done)
                yield flush()
        if id_arrow is not None:
            for bin_ in pour([p for b in packer.rest() for p in b], window):
                close(bin_)
            yield flush()

    small_batches(spark)
    pieces = df.select(F.col(f"`{id_col}`"), F.col(text).cast("string").alias("_text"))
    pieces = durable(pieces.mapInArrow(run, f"`{id_col}` {id_type}, {_PIECES}"))
    # one row per task, as many as the driver's own task list: sequences of earlier tasks come first
    sizes = pieces.groupBy("_part").agg(F.max("_seq").alias("_last"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum(F.col("_last") + 1).over(before), F.lit(0)).alias("_base"))
    return pieces.join(F.broadcast(offsets), "_part").select(
        F.col(f"`{id_col}`"), "start", "length", "ids_crc32", "doc_tokens", (F.col("_base") + F.col("_seq")).cast("long").alias("sequence_id"), "offset"
    )
