"""SentencePiece (merge type) encoding and decoding with a prefix table.

A merge-type encoding of a text has one last token for every prefix of the text. Scanning left to right, an
automaton lists the tokens that end at a position; the one that is compatible with the last token of the prefix
before it is that position's entry. Reading the entries backwards from the end gives the ids, in time linear in the
text and without a merge queue.

Pieces hold no word mark after another character, so that each run of word marks with what follows is encoded by
itself and, if short, kept in a bounded memo of the worker. Two or more word marks in a row have pieces of one score
only, which are merged leftmost first (with a heap, as pieces themselves are once, in time n log n).

Models that this doesn't hold for, and those with pieces set by a user (which are never merged), are refused.

Edge cases: a null or empty text has the end id alone and decodes to an empty text; characters without a piece
become byte pieces; repeated rows give repeated results; an empty table gives an empty result; other columns of the
input are not read.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text
from .memo import Memo

MARK = "▁"
#: Compatibility tests of two tokens that a worker remembers.
PAIRS = 400_000


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, at = value | (message[at] & 127) << shift, shift + 7, at + 1
            if message[at - 1] < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(tag & 7) or varint(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


#: Fixed values of the model file's format: the field of a piece, that of its type, and the type of a piece that a user has set.
PIECE_FIELD, TYPE_FIELD, USER_DEFINED = 1, 3, 4


class PieceModel:
    """The vocabulary of a .model file, its automaton and the compatibility test of neighbouring tokens."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end_id = sp.eos_id()
        self.byte_ids: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.surface: list[str] = []
        self.id_of: dict[str, int] = {}
        score: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.surface.append("" if sp.is_control(i) else piece.replace(MARK, " "))
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece], score[piece] = i, sp.get_score(i)
        probe = "  two  spaces "
        self.identity = b"\n\x08identity" in sp.serialized_model_proto()[-200:] and sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        if any(MARK in p.lstrip(MARK) for p in self.id_of):
            raise ValueError("a piece holds a word mark after another character")
        if len({score[p] for p in score if len(p) > 1 and not p.strip(MARK)}) > 1:
            raise ValueError("pieces of word marks alone have different scores")
        if any((TYPE_FIELD, USER_DEFINED) in fields(piece) for number, piece in fields(sp.serialized_model_proto()) if number == PIECE_FIELD):
            raise ValueError("the model has user-defined pieces")
        # A higher score merges first; single characters are there from the start.
        self.rank = {p: (-score[p] if len(p) > 1 else float("-inf")) for p in self.id_of}
        self.single = {p for p in self.id_of if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        self.pairs: dict[int, bool] = {}  # whether two tokens stay apart, by both their ids
        self.words, self.units, self.tails = Memo(self.word_ids), Memo(self.unit_ids), Memo(lambda t: array("i", self.plain_ids(t)).tobytes())
        self.inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.length = [len(p) for p in self.surface]
        self.automaton = ahocorasick.Automaton()
        for p in self.id_of:
            if len(p) == 1 or self.merged(p, keep_halves=True) == [p]:
                self.automaton.add_word(p, (len(p), self.id_of[p]))
        self.automaton.make_automaton()

    def merged(self, text: str, keep_halves: bool = False) -> list[str]:
        """Merges step by step, the best pair first and the leftmost of equals; a heap holds the pairs there are."""
        parts: list[str | None] = list(text)
        after, before, rank = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), self.rank
        heap = [(rank[parts[i] + parts[i + 1]], i, parts[i] + parts[i + 1]) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in rank]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != joined:
                continue  # one of the two has been merged since
            if keep_halves and len(joined) == len(text):
                self.halves[text] = (parts[i], parts[j])
            parts[i], parts[j], after[i] = joined, None, after[j]
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts):
                    before[y] = x
                    if (pair := parts[x] + parts[y]) in rank:
                        heapq.heappush(heap, (rank[pair], x, pair))
        return [p for p in parts if p is not None]

    def compatible(self, left_id: int, right_id: int) -> bool:
        """Do the two tokens stay apart when their texts stand side by side?

        Undoes the later merge of the two at the border, again and again: at each step the tokens at the border
        must not form a token that would have been merged before.
        """
        left, right = self.piece_of[left_id], self.piece_of[right_id]
        rank, limit, from_right, ok = self.rank, float("inf"), False, True
        while True:
            joined = rank.get(left + right)
            if joined is not None and (joined < limit or (from_right and joined == limit)):
                ok = False
                break
            a, b = rank[left], rank[right]
            if a == b == float("-inf"):
                break
            if a > b:
                limit, from_right, left = a, False, self.halves[left][1]
            else:
                limit, from_right, right = b, True, self.halves[right][0]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[left_id << 20 | right_id] = ok
        return ok

    def known_run(self, run: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last = [-1] * (len(run) + 1)
        known, compatible = self.pairs.get, self.compatible
        for at, (size, token) in self.automaton.iter(run):
            at += 1
            if last[at] < 0:  # a prefix has one last token
                if at == size:
                    last[at] = token
                elif (before := last[at - size]) >= 0:
                    ok = known(before << 20 | token)
                    if ok or (ok is None and compatible(before, token)):
                        last[at] = token
        ids, at, length = [], len(run), self.length
        while at:
            ids.append(token := last[at])
            at -= length[token]
        return ids[::-1]

    def unit_ids(self, unit: str) -> bytes:
        marks = len(unit) - len(unit.lstrip(MARK))
        if marks < 2:
            ids = self.plain_ids(unit)
        else:
            # Runs of word marks share one score, worse than all others: they merge last, the leftmost first. The
            # last mark goes with what follows where that takes it.
            ids = self.plain_ids(unit[marks - 1 :])
            free = ids[0] == self.id_of[MARK]
            ids = [self.id_of[t] for t in self.merged(unit[: marks - 1 + free])] + ids[free:]
        return array("i", ids).tobytes()

    def plain_ids(self, unit: str) -> list[int]:
        if self.single.issuperset(unit):
            return self.known_run(unit)
        ids, start = [], 0
        for at, ch in enumerate(unit):
            if ch not in self.rank:
                ids += self.known_run(unit[start:at])
                ids += [self.byte_ids[b] for b in ch.encode()]
                start = at + 1
        return ids + self.known_run(unit[start:])

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if self.identity else self.lib.normalize(text)

    def encode(self, text: str) -> bytes:
        """Ids as 32-bit integers, with the end id."""
        end = array("i", [self.end_id]).tobytes()
        if not text:
            return end
        if self.identity and MARK not in text and "\n" not in self.single:
            # A word goes by itself, marked; what follows a line feed, never part of a piece, goes with it, unmarked.
            words = text.replace("\n", " \n").split(" ")
            if "" not in words:
                return self.words.joined(words) + end
        return self.units.joined(UNITS(self.normal(text))) + end

    def word_ids(self, word: str) -> bytes:
        if not word.isalpha():
            # No piece goes over two characters that stand side by side in none.
            for k in range(len(word) - 1, 0, -1):
                if word[k - 1 : k + 1] not in self.inside and word[k - 1 : k] != "\n":
                    return self.words.one(word[:k]) + self.tails.one(word[k:])
        return array("i", self.plain_ids(word if word[0] == "\n" else MARK + word)).tobytes()

    def decode(self, ids: list[int]) -> str:
        surface, byte_of = self.surface, self.byte_of
        if byte_of.keys().isdisjoint(ids):
            text = "".join([surface[i] for i in ids])
        else:
            parts, held = [], bytearray()
            for i in ids:
                if i in byte_of:
                    held.append(byte_of[i])
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held = bytearray()
                parts.append(surface[i])
            parts.append(held.decode("utf-8", "replace"))
            text = "".join(parts)
        return text.removeprefix(" ")


UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One for each worker and file."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def piece_ids(text: Column, path: str) -> Column:
    """array<int>: the ids of the whole text and the end id."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for batch in batches:
            rows = [m.encode(t.as_py() or "") for t in batch]
            ends = np.cumsum([0] + [len(r) // 4 for r in rows])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))

    return ids(text)


def piece_text(ids: Column, path: str) -> Column:
    """The text of a list of ids."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for batch in batches:
            yield pa.array([m.decode(row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else []) for row in batch], pa.string())

    return text(ids)


def coded(text: Column, path: str) -> Column:
    """struct<ids array<int>, decoded string>: the ids of the whole text with the end id, and the text of the ids."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for (batch,) in slices((b,) for b in batches):
            # Copies inside a slice are coded once.
            place: dict[str, int] = {}
            own = [place.setdefault(t.as_py() or "", len(place)) for t in batch]
            rows = [m.encode(t) for t in place]
            texts = [m.decode(np.frombuffer(r, np.int32).tolist()) for r in rows]
            rows = [rows[k] for k in own]
            ends = np.cumsum([0] + [len(r) // 4 for r in rows])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array([texts[k] for k in own], pa.string())], ["ids", "decoded"])

    return both(text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>, decoded string. Narrow: one pass, no shuffle, one Python worker for each task."""
    return docs.select(F.col(id_col), coded(whole_text(text_col), path).alias("c")).select(id_col, "c.ids", "c.decoded")
