"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of 13 consecutive words of benchmark items (an item of fewer words is one window). For
all windows of one length m, the shift table tells for each block of two words how far the search may move on before
a window can end; most positions of a text are never looked at. Where the shift is 0, the block is some window's
suffix: its bucket, divided by the windows' first blocks, names the windows to compare directly. Items with the same
words are kept once.

Long items are cut into pieces that overlap by all but one word of a window, so that each window lies in one of them
whole. The pieces go to the executors in blocks of bounded size (BLOCK_BYTES of text). One block is searched in one narrow
pass over the documents. More blocks are searched one after the other: each is sent, its hits are written, and it is
released before the next is read. The hits of a text, found by its digest, are then put together.

Edge cases: null or word-less texts have no words and no hits; items without words are never found; words of an item
without an id are hit like any other's, but the item is not listed; equal texts under several item ids count as several
items; a repeated document has the same result each time; an empty benchmark gives no hits and an empty documents table
an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved, whole_text

WINDOW = 13
BLOCK_BYTES = 8_000_000
#: Words of a piece of a long item.
PIECE_WORDS = 4_096
#: Words are runs of digits, a-z and all characters beyond ASCII, after A-Z are lower-cased.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
HITS = "struct<n_words: bigint, spans: array<struct<start: int, end: int>>, items: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    return WORDS(text.encode().lower()) if text else []


class Windows:
    """Shift and bucket tables of all windows of m words."""

    def __init__(self, m: int):
        self.m, self.b = m, min(2, m)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        self.far = m - self.b + 1

    def add(self, item: int, words: list[bytes], at: int) -> None:
        m, b = self.m, self.b
        for j in range(b, m + 1):  # a block that ends j words into the window
            block = tuple(words[at + j - b : at + j])
            if self.shift.get(block, self.far) > m - j:
                self.shift[block] = m - j
        suffix, first = tuple(words[at + m - b : at + m]), tuple(words[at : at + b])
        self.buckets.setdefault(suffix, {}).setdefault(first, []).append((item, at))

    def search(self, words: list[bytes], items: list[list[bytes]], spans: list, found: set) -> None:
        m, b, far, shift = self.m, self.b, self.far, self.shift
        i, n = m, len(words)
        while i <= n:
            block = tuple(words[i - b : i])
            step = shift.get(block, far)
            if step:
                i += step
                continue
            start = i - m
            for item, at in self.buckets[block].get(tuple(words[start : start + b]), ()):
                if items[item][at : at + m] == words[start:i]:
                    if not spans or spans[-1] != (start, i):
                        spans.append((start, i))
                    found.add(item)
            i += 1


class Searcher:
    def __init__(self, rows: list[tuple[str | None, str]]):
        by_words: dict[tuple, list[str | None]] = {}
        for item_id, text in rows:
            if words := words_of(text):
                by_words.setdefault(tuple(words), []).append(item_id)
        self.items = [list(w) for w in by_words]
        self.ids = list(by_words.values())
        self.tables: dict[int, Windows] = {}
        for k, words in enumerate(self.items):
            m = min(WINDOW, len(words))
            t = self.tables.setdefault(m, Windows(m))
            for at in range(len(words) - m + 1):
                t.add(k, words, at)

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words, joined spans of hit words, ids of the items with a window that occurs."""
        words, spans, found = words_of(text), [], set()
        for t in self.tables.values():
            t.search(words, self.items, spans, found)
        return len(words), joined(spans), sorted({i for k in found for i in self.ids[k] if i is not None})


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_searcher: list = [None, None]


def searcher(name: str, rows: Broadcast) -> Searcher:
    """The worker's tables: those of one block at a time."""
    if _searcher[0] != name:
        _searcher[:] = [name, Searcher(rows.value)]
    return _searcher[1]


def hits_column(text: Column, rows: Broadcast) -> Column:
    name = uuid.uuid4().hex

    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s = searcher(name, rows)
        for batch in batches:
            found = [s.hits(t.as_py()) for t in batch]
            yield pa.array(
                [{"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": items} for n, spans, items in found],
                pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]),
            )

    return hits(text)


def overlapping(text: Column) -> Column:
    """The item's words in pieces, each window in one of them; no piece without words."""

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = words_of(t.as_py())
            out.append([b" ".join(words[a : a + PIECE_WORDS + WINDOW - 1]).decode() for a in range(0, max(1, len(words) - WINDOW + 1), PIECE_WORDS)] if words else [])
        return pa.array(out, pa.list_(pa.string()))

    return pieces(text)


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column name: n_words, spans of hit words, ids of items found."""
    context = docs.sparkSession.sparkContext
    pieces = saved(benchmark.select(F.col(item_col).cast("string").alias("item"), F.explode(overlapping(F.col(item_text))).alias("piece")), "benchmark-pieces")
    size = pieces.agg(F.coalesce(F.sum(F.octet_length("piece") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).head()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    block = F.pmod(F.xxhash64("item", "piece"), F.lit(blocks))
    send = lambda k: context.broadcast([(r["item"], r["piece"]) for r in pieces.filter(block == k).collect()])
    if blocks == 1:
        return docs.withColumn(name, hits_column(F.col(text_col), send(0)))
    keyed = docs.withColumn(key := free_name(docs, "text_digest"), F.sha2(whole_text(text_col), 256))
    each = None
    for k in range(blocks):
        rows = send(k)
        own = keyed.select(F.col(key), hits_column(F.col(text_col), rows).alias("h")).filter("size(h.spans) > 0").dropDuplicates([key])
        own = saved(own, "block-hits")
        rows.unpersist()
        each = own if each is None else each.unionByName(own)
    put = each.groupBy(key).agg(F.flatten(F.collect_list("h.spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("items"))

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def join_spans(lists: pa.Array) -> pa.Array:
        rows = [joined([(s["start"], s["end"]) for s in x or []]) for x in lists.to_pylist()]
        return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    put = put.withColumn("spans", join_spans("spans")).select(key, F.struct("spans", "items").alias(hit := free_name(keyed, "hit")))
    # Written, so that copies of one text are rows of a plain join, which Spark can split.
    out = keyed.join(saved(put, "hits"), key, "left").withColumn(name, hits_column(F.col(text_col), context.broadcast([])))
    whole = F.struct(F.col(f"{name}.n_words").alias("n_words"), F.coalesce(F.col(f"{hit}.spans"), F.col(f"{name}.spans")).alias("spans"), F.coalesce(F.col(f"{hit}.items"), F.col(f"{name}.items")).alias("items"))
    return out.withColumn(name, whole).drop(key, hit)


def n_hit(hits: str) -> Column:
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated(hits: str) -> Column:
    """At least one word in twenty lies inside a benchmark window."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))
