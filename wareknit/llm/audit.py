"""How five filters act on each other, in every order, from a sparse document-term matrix.

Documents are cut into shards: stretches of a partition of bounded size. One narrow pass makes each shard's part of the
matrix in compressed sparse rows, with columns numbered by the shard's own words, and keeps with each document what else
a filter needs. All shards' words make the global dictionary, numbered without gaps; each shard's columns are then
renumbered by it. A word goes through the shuffle once for each shard that has it, not for each document. A row's sum is
the document's number of words, its non-zero entries are its distinct words: they decide filters A and B. Marks and
capitals (C, D) come with the row, copies (E) are found by the text's digest.

Documents then count as (part, set of failed filters): at most 32 rows for each part, from which the counts of all 120
orders follow. Of a document that fails n filters, each of them is the first in 120 / n of the orders.

Edge cases: a null text is empty, and fails A; an empty text has no words and doesn't fail B; a null source is the part
with the empty name, as an empty one is; a document without an id is no copy and makes none; rows of one id and one text
are no copies of each other; documents without labels are lost neither as good nor as toxic; labels that repeat an id
count as good or toxic if one of them says so; each repeated row counts; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, saved, whole_text

#: Bytes of text and documents in a shard.
SHARD_BYTES, SHARD_ROWS = 16_000_000, 10_000
#: Words of all shards in a part of the dictionary; bits of a word's number (beside 26 of its place in a shard).
PART_WORDS, NUMBER_BITS = 1_000_000, 37
LEAST_WORDS = 50
#: Shares of a hundred: least distinct words among words, most capitals among characters.
LEAST_DISTINCT, MOST_CAPITALS = 65, 5
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = re.compile(rb"[#$%&*|]").search
FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}


class Shard:
    """Rows of the matrix, with columns numbered by the shard's own words."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids, self.parts, self.failed, self.digests = [], [], [], []
        self.starts, self.columns, self.times = [0], [], []
        self.bytes = 0

    def add(self, i: int | None, part: str, text: str) -> None:
        data, number = text.encode(), self.words.__getitem__
        runs = [np.fromiter(map(number, words), np.int32, len(words)) for piece in pieces_of(data) if (words := piece.split())]
        columns, times = np.unique(np.concatenate([*runs, np.empty(0, np.int32)]), return_counts=True)
        capitals = len(data) - len(data.translate(None, CAPITALS))
        self.ids.append(i)
        self.parts.append(part)
        self.failed.append(BIT["C"] * (100 * capitals > MOST_CAPITALS * len(text)) + BIT["D"] * bool(MARKS(data)))
        self.digests.append(hashlib.sha256(data).digest())
        self.columns.append(columns)
        self.times.append(times)
        self.starts.append(self.starts[-1] + len(columns))
        self.bytes += len(data)

    def row(self, number: int) -> pa.RecordBatch:
        of = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        packed = lambda arrays: pa.array([np.concatenate([*arrays, np.empty(0, np.int32)]).astype("<i4").tobytes()], pa.binary())
        arrays = {
            "shard": pa.array([number], pa.int64()),
            "ids": of(self.ids, pa.int64()),
            "parts": of(self.parts, pa.string()),
            "failed": packed([self.failed]),
            "digests": of(self.digests, pa.binary()),
            "starts": packed([self.starts]),
            "columns": packed(self.columns),
            "times": packed(self.times),
            "words": of(list(self.words), pa.binary()),
        }
        return pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))


#: Rows, and their matrix in compressed sparse rows: 32-bit numbers, packed.
SHARD = "shard long, ids array<long>, parts array<string>, failed binary, digests array<binary>, starts binary, columns binary, times binary, words array<binary>"


def local_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs (id, part, text) as rows of SHARD."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number = Shard(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, part, text in zip(*batch.columns):
                shard.add(i.as_py(), part.as_py(), text.as_py())
                if shard.bytes >= shard_bytes or len(shard.ids) >= shard_rows:
                    yield shard.row(number)
                    shard, number = Shard(), number + 1
        if shard.ids:
            yield shard.row(number)

    return docs.mapInArrow(build, SHARD)


def dictionary(words: DataFrame, count: int) -> DataFrame:
    """words (shard, at, word; count rows) with word's number: distinct words are numbered from 0 without gaps.

    Words are dealt out by their hash, numbered where they arrive, and partitions are numbered one after the other. A word
    comes once for each shard that has it, so that no word makes a partition large.
    """

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        part = TaskContext.get().partitionId()
        for batch in batches:
            own = np.fromiter(map(numbers.__getitem__, batch.column(2).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(own), part, np.int32)), pa.array(own)], ["shard", "at", "part", "n"])

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_WORDS))
    # Written once: words of a second evaluation could arrive in another order.
    found = saved(words.select("shard", "at", "word").repartition(parts, "word").mapInArrow(numbered, "shard long, at int, part int, n long"), "numbered-words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    firsts = found.groupBy("part").agg((F.max("n") + 1).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return found.join(saved(firsts, "first-numbers"), "part").select("shard", "at", (F.col("first") + F.col("n")).alias("number"))


def csr_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Shards of the matrix, as of SHARD but for the words, with own: the global number of each of the shard's columns."""
    local = saved(local_shards(docs, shard_bytes, shard_rows), "local-shards")
    count = local.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).head()[0]
    numbers = dictionary(local.select("shard", F.posexplode("words").alias("at", "word")), count)
    # Place and number in one long, so that a shard's words are sorted as plain numbers.
    packed = F.shiftleft(F.col("at").cast("long"), NUMBER_BITS).bitwiseOR(F.col("number"))
    own = numbers.groupBy("shard").agg(F.sort_array(F.collect_list(packed)).alias("own"))
    return local.drop("words").join(own.select("shard", F.transform("own", lambda n: n.bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))).alias("own")), "shard", "left")


def matrix_of(starts: bytes, columns: bytes, times: bytes, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """starts, columns (global numbers) and times of a shard's rows."""
    starts, columns, times = (np.frombuffer(x, "<i4") for x in (starts, columns, times))
    return starts, own[columns], times


def row_facts(csr: DataFrame) -> DataFrame:
    """id, part, failed (bits of A to D) and digest of each document: row sums and non-zero entries decide A and B."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in ("ids", "parts", "failed", "digests", "starts", "columns", "times", "own")}
                own = row["own"].values.to_numpy() if row["own"].is_valid else np.empty(0, np.int64)
                starts, columns, times = matrix_of(*(row[n].as_py() for n in ("starts", "columns", "times")), own)
                sums = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
                words = sums[starts[1:]] - sums[starts[:-1]]
                # A row's columns are different ones, as the shard's words have different numbers.
                assert len(np.unique(own)) == len(own)
                distinct = np.diff(np.concatenate([[0], np.cumsum((times > 0) & (columns >= 0))])[starts]).astype(np.int64)
                failed = np.frombuffer(row["failed"].as_py(), "<i4") | BIT["A"] * (words < LEAST_WORDS) | BIT["B"] * (100 * distinct < LEAST_DISTINCT * words)
                yield pa.RecordBatch.from_arrays([row["ids"].values, row["parts"].values, row["digests"].values, pa.array(failed.astype(np.int32))], ["id", "part", "digest", "failed"])

    return csr.mapInArrow(facts, "id long, part string, digest binary, failed int")


def with_copies(facts: DataFrame) -> DataFrame:
    """facts with the bit of E where a smaller id has the same text."""
    repeated = facts.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    repeated = saved(repeated.select("digest", "least"), "repeated-texts")
    later = F.when(F.col("id") > F.col("least"), BIT["E"]).otherwise(0)
    return facts.join(repeated, "digest", "left").select("id", "part", F.col("failed").bitwiseOR(later).alias("failed"))


def counted(facts: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """part, failed, n, good, toxic: how many documents fail just those filters."""
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")
    known = labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").groupBy("id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    known = saved(known.filter("good + toxic > 0"), "labels-by-id")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return facts.join(known, "id", "left").groupBy("part", "failed").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def steps() -> Column:
    """All orders and their steps: filter_order, step, the bit of the step's filter, the bits of those before."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(BIT[f]).alias("own"), F.lit(before).alias("before")))
            before |= BIT[f]
    return F.array(*rows)


def report(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of each step."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))  # 32 at most
    own, before = F.col("s.own"), F.col("s.before")

    def total(test, of) -> Column:
        return F.aggregate(F.filter("sets", test), F.lit(0).cast("long"), lambda a, x: a + of(x))

    fails, gone = (lambda x: x["failed"].bitwiseAND(own) != 0), (lambda x: x["failed"].bitwiseAND(before) != 0)
    removed = lambda x: fails(x) & ~gone(x)
    n, every = (lambda x: x["n"]), len(list(permutations(FILTERS)))
    columns = {
        "kept": total(lambda x: ~fails(x) & ~gone(x), n),
        "removed": total(removed, n),
        "redundant": total(lambda x: fails(x) & gone(x), n),
        "unique_fails": total(lambda x: x["failed"] == own, n),
        "good_lost": total(removed, lambda x: x["good"]),
        "toxic_lost": total(removed, lambda x: x["toxic"]),
        "shapley": total(fails, lambda x: x["n"] * (F.lit(every) / F.bit_count(x["failed"])).cast("long")),
    }
    each = parts.select("part", "sets", F.explode(steps()).alias("s"))
    return each.select("part", "s.filter_order", "s.step", *[c.alias(k) for k, c in columns.items()])


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for each part,
    order and step. labels: id_col, quality, toxic."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole_text(text_col).alias("text"))
    facts = saved(row_facts(csr_shards(rows, shard_bytes, shard_rows)), "row-facts")
    return report(counted(with_copies(facts), labels, id_col))
