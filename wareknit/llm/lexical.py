"""Ranked lexical search, a term at a time with a limited number of accumulators.

Items (queries) are sets of terms. One narrow pass over the documents makes index blocks of bounded size: for each of the
items' terms that a block's documents hold, the documents and how often they hold it. Blocks are written; counts of
documents and terms, summed over all of them, give the weights.

A second pass over the blocks scores. An item takes its terms rarest first. While the best scores that the terms still
to come allow (each term's largest contribution in this block) reach the kth best score known so far, a document that
holds the term gets an accumulator. Once they don't, no new accumulator can end among the best k, and none is made; those
that can still reach them are continued, with every remaining term, to their exact scores. The kth best score is the
greater of that of the block's own accumulators and that of the blocks the task has finished before. Each task hands on
k documents for each item at most, and the best k of all are taken by a window.

The items' terms go to the executors in blocks of bounded size (ITEM_BYTES), one after the other: each is searched,
its results are written, and it is released. Only the distinct terms of one item must fit a block together.

Edge cases: null and term-less texts are not counted and never found; an item without terms has no results; rows of one
item id are one item, with the terms of all of them; terms are counted once for each item; equal scores go by document id,
one without an id comes last; repeated documents are found each by itself; an empty table of either kind gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces_of, saved

BEST = 10
#: Bytes of the items' terms in one block; of texts, and documents, in one index block.
ITEM_BYTES, TEXT_BYTES, ROWS = 8_000_000, 16_000_000, 8_000
#: Share (of 100) of a document's length in the measure of a term's weight in it.
LENGTH_SHARE = 90
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
BLOCK = "docs long, total long, ids array<long>, sizes array<long>, terms array<int>, starts array<int>, places array<int>, times array<int>"
NO_ID = np.iinfo(np.int64).max


def term_counts(text: str) -> tuple[int, Counter]:
    """How many terms the text has, and how often each."""
    n, counts = 0, Counter()
    for piece in pieces_of(text.encode().lower()):
        terms = TERMS(piece)
        n += len(terms)
        counts.update(terms)
    return n, counts


def distinct_terms(text: Column) -> Column:
    @F.arrow_udf("array<binary>")
    def terms(texts: pa.Array) -> pa.Array:
        return pa.array([list(term_counts(t.as_py() or "")[1]) for t in texts], pa.list_(pa.binary()))

    return terms(text)


def index_blocks(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """docs (id, text) as rows of BLOCK; vocabulary: the number of each term that is asked for."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = vocabulary.value
        asked = numbers.keys()
        block, held = Block(), 0
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py() or ""
                n, counts = term_counts(text)
                if n:
                    block.add(i.as_py(), n, [(numbers[t], counts[t]) for t in counts.keys() & asked])
                    held += len(text)
                if held > TEXT_BYTES or len(block.ids) >= ROWS:
                    yield block.row()
                    block, held = Block(), 0
        if block.docs:
            yield block.row()

    return docs.mapInArrow(build, BLOCK)


class Block:
    def __init__(self) -> None:
        self.docs = self.total = 0
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.terms, self.places, self.times = [], [], []

    def add(self, i: int | None, n: int, counts: list[tuple[int, int]]) -> None:
        self.docs += 1
        self.total += n
        if counts:
            terms, times = zip(*counts)
            self.terms.append(np.array(terms, np.int32))
            self.times.append(np.array(times, np.int32))
            self.places.append(np.full(len(terms), len(self.ids), np.int32))
            self.ids.append(i)
            self.sizes.append(n)

    def row(self) -> pa.RecordBatch:
        terms, places, times = (np.concatenate([*x, np.empty(0, np.int32)]) for x in (self.terms, self.places, self.times))
        order = np.argsort(terms, kind="stable")
        own, starts = np.unique(terms[order], return_index=True)
        arrays = [self.ids, self.sizes, own, [*starts, len(terms)], places[order], times[order]]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, k)) for a, k in zip(arrays, kinds)]
        names = ["docs", "total", "ids", "sizes", "terms", "starts", "places", "times"]
        return pa.RecordBatch.from_arrays([pa.array([self.docs], pa.int64()), pa.array([self.total], pa.int64()), *lists], names)


class Postings:
    """One index block: for each of its terms the documents' places and what the term adds to their scores."""

    def __init__(self, row: dict, weights: dict[int, int], docs: int, total: int):
        ids = row["ids"]
        self.no_id = np.array([i is None for i in ids], bool)
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        self.length = 8 * np.array([100 - LENGTH_SHARE + LENGTH_SHARE * n * docs // total for n in row["sizes"]], np.int64)
        self.row, self.weights, self.made = row, weights, {}
        self.at = {t: k for k, t in enumerate(row["terms"].tolist())}

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Places, contributions and the largest of them."""
        if term not in self.made:
            self.made[term] = None
            k, w = self.at.get(term), self.weights.get(term, 0)
            if k is not None and w > 0:
                a, b = self.row["starts"][k : k + 2]
                places, times = self.row["places"][a:b], self.row["times"][a:b].astype(np.int64)
                adds = w * (1_000_000_000 * times // (1_000 * times + self.length[places]))
                self.made[term] = places, adds, int(adds.max())
        return self.made[term]


def best_in_block(postings: Postings, terms: list[int], k: int, reached: int) -> list[tuple[int, int, bool]]:
    """The best of the block's documents that score reached or more: (score, id, no id), k at most. terms: rarest first."""
    found = [p for p in map(postings.of, terms) if p]
    # What the terms from each on can add at most.
    ahead = np.cumsum([0, *[most for _, _, most in reversed(found)]])[::-1].tolist()
    scores, alive = np.zeros(len(postings.ids), np.int64), None
    for j, (places, adds, _) in enumerate(found):
        if alive is None and ahead[j] < reached:
            if not j:
                return []
            alive = (scores > 0) & (scores + ahead[j] >= reached)
        if alive is not None:
            on = alive[places]
            scores[places[on]] += adds[on]
            continue
        scores[places] += adds
        if len(scores) >= k:
            reached = max(reached, int(np.partition(scores, -k)[-k]))
    good = np.nonzero((scores >= max(1, reached)) & (True if alive is None else alive))[0]
    order = np.lexsort([postings.ids[good], -scores[good]])[:k]
    return [(int(scores[p]), int(postings.ids[p]), bool(postings.no_id[p])) for p in good[order]]


def scored(blocks: DataFrame, items: Broadcast, item_type: T.DataType, k: int) -> DataFrame:
    """item, id, score: each task's best k for each item. items: (weights, docs, total, [(item, terms rarest first)])."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, docs, total, asked = items.value
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].values for n in ("ids", "sizes", "terms", "starts", "places", "times")}
                row = {n: v.to_pylist() if n in ("ids", "sizes") else v.to_numpy() for n, v in row.items()}
                postings = Postings(row, weights, docs, total)
                for held, (_, terms) in zip(best, asked):
                    reached = held[-1][0] if len(held) == k else 0
                    if more := best_in_block(postings, terms, k, reached):
                        held[:] = sorted(held + more, key=lambda x: (-x[0], x[1]))[:k]
        out = [(asked[n][0], None if no_id else i, s) for n, held in enumerate(best) for s, i, no_id in held]
        columns = [list(c) for c in zip(*out)] or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow(item_type)), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["item", "id", "score"])

    return blocks.mapInArrow(score, T.StructType([T.StructField("item", item_type), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]))


def to_arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def search_block(docs: DataFrame, asked: DataFrame, item_type: T.DataType, k: int) -> DataFrame:
    """The best documents for one block of items. asked: item, term of the block, each once."""
    context = docs.sparkSession.sparkContext
    terms: dict = {}
    numbers: dict[bytes, int] = {}
    for r in asked.collect():
        terms.setdefault(r["item"], []).append(numbers.setdefault(bytes(r["term"]), len(numbers)))
    vocabulary = context.broadcast(numbers)
    blocks = saved(index_blocks(docs, vocabulary), "index-blocks")
    sums = blocks.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).head()
    held = F.transform("terms", lambda t, k: F.struct(t.alias("term"), (F.get("starts", k + 1) - F.get("starts", k)).alias("n")))
    # At most one row for each term of the block's items.
    df = {r["term"]: r["n"] for r in blocks.select(F.explode(held).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n")).collect()}
    weights = {t: math.floor(1000 * math.log((2 * sums["docs"] + 2) / (2 * n + 1))) for t, n in df.items()}
    rarest_first = [(i, sorted((t for t in ts if t in df), key=lambda t: (df[t], t))) for i, ts in terms.items()]
    items = context.broadcast((weights, sums["docs"], sums["total"], rarest_first))
    found = saved(scored(blocks, items, item_type, k), "best-in-tasks")
    vocabulary.unpersist()
    items.unpersist()
    return found


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents for each item that score above 0."""
    asked = items.select(F.col(item_col).alias("item"), F.explode(distinct_terms(F.col(item_text))).alias("term")).distinct()
    asked = saved(asked, "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).head()[0]
    parts = max(1, -(-2 * size // item_bytes)) if size > item_bytes else 1
    block, rows = F.pmod(F.xxhash64("item"), F.lit(parts)), docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = None
    for p in range(parts):
        own = search_block(rows, asked.filter(block == p), asked.schema["item"].dataType, k)
        found = own if found is None else found.unionByName(own)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
