"""SentencePiece byte-pair encoding by a prefix table, and decoding (operator 5).

For byte-pair merges in score order, every prefix of a text has one encoding, so one last
token. An automaton over the vocabulary lists the pieces that end at each position; of
these, exactly one is compatible with the last token of the prefix before it: a pair is
compatible if encoding their joined text gives back the pair. The table stores that last
token for each prefix, and the ids are read backwards from its end.

No piece holds the space mark after another character, so merges never cross the start of
a run of space marks; each distinct unit (space marks and the characters up to the next
run) is encoded once per worker. Pieces of several space marks share one score, for which
the pair test does not hold; they merge after all others, so a run left over beside a
word is merged by itself, leftmost pair first.

Defined results: null counts as an empty text (begin and end ids only); a character
outside the vocabulary gives its byte ids; repeated rows are encoded alike; an empty
table gives an empty result; columns other than the id and text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from weft.llm.batches import map_texts
from weft.llm.memo import Memo

MARK = "▁"  # the vocabulary's sign for a space
#: Pair tests kept by a worker.
CACHE_PAIRS = 1_000_000

_UNIT = re.compile(f"{MARK}+[^{MARK}]*")
_SHIFT = 24  # a pair of ids as one number
_OTHER = -1  # last token of a prefix that ends in a character outside the vocabulary


class PieceTable:
    """Vocabulary, automaton and the memo of pair tests for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a piece that merging does not give back whole is never a token
        self.last_merge: dict[str, tuple[str, str]] = {}
        self.tokens = {p for p in self.ids if MARK not in p[1:] and self.merge(p, self.last_merge) == [p]}
        self.piece_of = {self.ids[p]: p for p in self.tokens}
        self.automaton = ahocorasick.Automaton()
        for p in self.tokens:
            self.automaton.add_word(p, (len(p), self.ids[p]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units = Memo(lambda units: map(self.unit_ids, units))

    def merge(self, text: str, last: dict | None = None) -> list[str]:
        """Symbols left after merging the best-scored adjacent pair, leftmost first, again and again.

        ``last`` gets the two parts of the merge that made ``text``, if one did.
        """
        symbols: list[str | None] = list(text)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols):
                joined = symbols[i] + symbols[after[i]]
                if joined in self.scores:
                    heapq.heappush(heap, (-self.scores[joined], i, joined))

        for i in range(len(symbols) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if symbols[i] is None or after[i] >= len(symbols) or symbols[i] + symbols[after[i]] != joined:
                continue  # one of the two has merged meanwhile
            gone = after[i]
            if last is not None and joined == text:
                last[text] = (symbols[i], symbols[gone])
            symbols[i], symbols[gone], after[i] = joined, None, after[gone]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s is not None]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text encodes to just these two.

        Undoes the merges beside the border from the latest to the earliest. Two symbols
        that met at the border at some time would have merged if their joined piece came
        before the merge that took one of them away (of equal pieces the left one does).
        """
        key = left << _SHIFT | right
        found = self.pairs.get(key)
        if found is not None:
            return found
        a, b = self.piece_of[left], self.piece_of[right]
        found, scores, parts = True, self.scores, self.last_merge
        bound, tie_joins = float("-inf"), True
        while True:
            joined = scores.get(a + b)
            if joined is not None and (joined > bound or joined == bound and tie_joins):
                found = False
                break
            if a in parts and (b not in parts or scores[a] < scores[b]):
                bound, tie_joins, a = scores[a], False, parts[a][1]
            elif b in parts:
                bound, tie_joins, b = scores[b], True, parts[b][0]
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def last_tokens(self, text: str) -> list[int]:
        """The table: for each prefix of ``text`` its last token."""
        table = [_OTHER] * len(text)
        known, compatible = self.pairs.get, self.compatible
        for end, (length, token) in self.automaton.iter(text):
            at = end - length
            if at < 0:
                table[end] = token
                continue
            left = table[at]
            if left != _OTHER and (fits := known(left << _SHIFT | token)) is not True and (fits is False or not compatible(left, token)):
                continue
            table[end] = token
        return table

    def word_ids(self, text: str) -> list[int]:
        table, out, at = self.last_tokens(text), [], len(text)
        while at:
            token = table[at - 1]
            if token == _OTHER:
                out.extend(self.bytes[b] for b in reversed(text[at - 1].encode()))
                at -= 1
            else:
                out.append(token)
                at -= len(self.piece_of[token])
        out.reverse()
        return out

    def unit_ids(self, unit: str) -> bytes:
        """Ids of a unit as little-endian unsigned 32-bit integers; the unit's first space mark is left out."""
        word = unit.lstrip(MARK)
        marks = 1 + len(unit) - len(word)
        ids = self.word_ids(MARK + word)
        if marks > 1:
            alone = ids[0] == self.ids[MARK]
            run = self.merge(MARK * (marks if alone else marks - 1))
            ids = [self.ids[p] for p in run] + ids[alone:]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or MARK in t or t[0] == " ":
                cut.append([u[1:] for u in _UNIT.findall(MARK + t.replace(" ", MARK))])
            else:
                cut.append(t.split(" "))
        get = self.units.getter(cut)
        begin, end = (np.array([i], dtype="<u4").tobytes() for i in (self.begin, self.end))
        return [b"".join([begin, *map(get, c), end]) for c in cut]

    def decode(self, encoded: list[bytes]) -> list[str]:
        return self.processor.decode([np.frombuffer(e, dtype="<u4").tolist() for e in encoded])


_TABLES: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The worker's table for a model file."""
    if path not in _TABLES:
        _TABLES[path] = PieceTable(path)
    return _TABLES[path]


def encode_texts(df: DataFrame, model_path: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) and ``decoded`` text."""

    def make() -> Callable:
        table = piece_table(model_path)

        def run(texts):
            encoded = table.encode(texts)
            return [[np.frombuffer(e, dtype="<u4").astype(np.int32) for e in encoded], table.decode(encoded)]

        return run

    return map_texts(df, make, "ids array<int>, decoded string", keep=keep, text=text)


def digest_texts(df: DataFrame, model_path: str, keep=("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 of the same encoding."""

    def make() -> Callable:
        table = piece_table(model_path)

        def run(texts):
            encoded = table.encode(texts)
            sha = lambda b: hashlib.sha256(b).hexdigest()
            return [[len(e) // 4 for e in encoded], [sha(e) for e in encoded], [sha(d.encode()) for d in table.decode(encoded)]]

        return run

    return map_texts(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep=keep, text=text)
