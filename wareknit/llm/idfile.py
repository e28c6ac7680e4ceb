"""Token ids in binary files: Simple-8b words in blocks, with offsets for vectorised decoding.

A 64-bit word holds a selector in its upper four bits and, below, as many ids of equal width as fit in 60 bits.
Selector 15 is an escape: the next word is one id of up to 64 bits as it is. A block is a run of whole documents:

    words    uint64, little-endian: the packed ids of the block's documents, one after the other
    lengths  uint32, one for each document: its number of ids
    offsets  uint32, one for each document: the word it starts at (each document starts a word)

Blocks are rows of a Parquet folder (part, block, ids before it in its part, ids in it, doc_ids, lengths, offsets, words), so that the folder can lie
in any store that Spark writes, and a lost task writes its blocks again.

Order: documents are dealt to parts by ranges of their id whose bounds come from the id column alone, ordered inside
each part, and numbered with the counts of the parts before. Rows with equal ids stand in the order of their packed
ids; null ids come first.

Edge cases: a null or empty text has the end id alone; a repeated row is written as often as it is there; an empty
table gives an empty folder and result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import bpe
from .common import scratch, slices, whole_text

#: How many ids a word of each selector holds, and of how many bits; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
WIDTHS = 60 // COUNTS
ESCAPE = 15
BLOCK_WORDS = 32_768
#: Ids are packed so many at a time.
IDS_AT_ONCE = 200_000
#: Bounds of parts go to every task: more parts than these are not made, larger ones are.
MOST_PARTS = 4_000


def pack(ids: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words of lists of ids, and the number of words before each list: each word takes the most ids that fit.

    ends: where each list ends in ids; None: one list.
    """
    ids, n = np.asarray(ids), len(ids)
    ends = np.array([n]) if ends is None else np.asarray(ends)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    # The bits that each id needs and, from there, the most that any of so many ids in a row needs.
    widest, reach = np.frexp(ids.astype(np.float64))[1].astype(np.uint8), 1
    if int(ids.max()) >> 53:
        widest = np.array([int(x).bit_length() for x in ids.tolist()], np.uint8)
    choice, step = np.full(n, ESCAPE, dtype=np.int8), np.ones(n, dtype=np.int64)
    for s in range(len(COUNTS) - 1, -1, -1):
        count, width = int(COUNTS[s]), int(WIDTHS[s])
        while reach < count:
            more = min(reach, count - reach)
            np.maximum(widest[:-more], widest[more:], out=widest[:-more])
            reach += more
        fits = np.flatnonzero((widest <= width) & (left >= count))
        choice[fits], step[fits] = s, count
    firsts = followed(np.arange(n) + step, ends)
    ids = ids.astype(np.uint64)
    chosen = choice[firsts]
    size = 1 + (chosen == ESCAPE)
    place = np.cumsum(size) - size
    words = np.zeros(size.sum(), dtype=np.uint64)
    for s in np.unique(chosen):
        own = chosen == s
        word = np.full(own.sum(), int(s) << 60, dtype=np.uint64)
        if s == ESCAPE:
            words[place[own] + 1] = ids[firsts[own]]
        else:
            for k in range(COUNTS[s]):
                word |= ids[firsts[own] + k] << np.uint64(k * WIDTHS[s])
        words[place[own]] = word
    return words, np.append(0, np.append(place, len(words))[np.searchsorted(firsts, ends)])


def followed(after: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where words begin, if each begins where the one before, in after, says: all lists at once, the last few by themselves."""
    firsts, at = [], np.append(0, ends[:-1])
    at, end = at[at < ends], ends[at < ends]
    while len(at) > 16:
        firsts.append(at)
        at = after[at]
        live = at < end
        if not live.all():
            at, end = at[live], end[live]
    for i, stop in zip(at.tolist(), end.tolist()):
        start, rest, own = i, after[i:stop].tolist(), []
        while i < stop:
            own.append(i)
            i = rest[i - start]
        firsts.append(np.array(own, np.int64))
    return np.sort(np.concatenate(firsts))


def unpack(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and the number of ids before each word."""
    words = np.asarray(words, dtype=np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.append(COUNTS, [0, 1])[selector]
    raw = np.zeros(len(words), dtype=bool)
    marked = np.flatnonzero(selector == ESCAPE)
    i = -1
    for m in marked.tolist():  # the word after an escape is an id, whatever its upper bits
        if m > i:
            i = m + 1
            raw[i] = True
    held[raw] = 0
    selector[raw] = -1
    before = np.concatenate(([0], np.cumsum(held)))
    ids = np.empty(before[-1], dtype=np.uint64)
    for s in np.unique(selector):
        own = np.flatnonzero(selector == s)
        if s == ESCAPE:
            ids[before[own]] = words[own + 1]
        elif s >= 0:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            for k in range(COUNTS[s]):
                ids[before[own] + k] = words[own] >> np.uint64(k * WIDTHS[s]) & mask
    return ids, before


def packed_ids(doc_id: Column, text: Column, bounds: list[int], path: str, end_id: int) -> Column:
    """struct<part int, n long, words binary>: the part of the id, and the packed ids of the text and the end id."""
    upper = np.array(bounds, np.int64)

    @F.arrow_udf("struct<part: int, n: bigint, words: binary>")
    def packed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        b, end = bpe(path), np.uint32(end_id).tobytes()
        for doc_ids, batch in slices(batches):
            # The number of bounds below the id; null ids lie before all.
            part = np.where(np.array(doc_ids.is_valid()), np.searchsorted(upper, doc_ids.fill_null(0).to_numpy(zero_copy_only=False)), 0)
            # Copies inside a slice are coded once.
            place: dict[str, int] = {}
            own = [place.setdefault(t.as_py() or "", len(place)) for t in batch]
            n, words = [], []
            rows, held = [], 0
            for i, t in enumerate(place):
                rows.append(b.ids(t) + end)
                held += len(rows[-1]) // 4
                if held >= IDS_AT_ONCE or i + 1 == len(place):
                    sizes = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                    flat, at = pack(np.frombuffer(b"".join(rows), np.uint32), np.cumsum(sizes))
                    n += sizes.tolist()
                    words += [flat[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]
                    rows, held = [], 0
            n, binary = np.array([n[k] for k in own], np.int64), pa.array([words[k] for k in own], pa.binary())
            yield pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(n), binary], ["part", "n", "words"])

    return packed(doc_id, text)


def part_bounds(docs: DataFrame, id_col: str, parts: int | None) -> list[int]:
    """Upper bounds of the id ranges, from the id column alone; at most one for each part.

    parts: None for as many as the scan has, which follows from the table's bytes, and the session's shuffle partitions
    at least.
    """
    if parts is None:
        scanned = docs.select(F.spark_partition_id().alias("scanned")).agg(F.max("scanned")).head()[0] or 0
        parts = min(MOST_PARTS, max(scanned + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)] or [0.5], 10_000)).head()
    return sorted(set(cut[0] or []))


def write_blocks(docs: DataFrame, tokenizer: str, end_id: int, path: str, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The ids of every whole text and the end id, in the order of id_col, as blocks under path."""
    bounds = part_bounds(docs, id_col, parts)
    doc_id = F.col(id_col).cast("long")
    coded = docs.select(doc_id.alias("doc_id"), packed_ids(doc_id, whole_text(text_col), bounds, tokenizer, end_id).alias("p"))
    coded = coded.select("p.part", "doc_id", "p.n", "p.words")
    # A part is a partition by its number, not by a hash of it, so that each task has one.
    ordered = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "doc_id", "words")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


BLOCK_SCHEMA = "part int, block int, ids_before long, ids_in_block long, doc_ids array<bigint>, lengths binary, offsets binary, words binary"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the sorted rows of a partition to blocks."""
    part, block, before = None, 0, 0
    doc_ids, lengths, offsets, words, held = [], [], [], [], 0

    def taken() -> pa.RecordBatch:
        arrays = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64()))]
        arrays += [pa.array([x], pa.binary()) for x in (np.array(lengths, "<u4").tobytes(), np.array(offsets, "<u4").tobytes(), b"".join(words))]
        return pa.RecordBatch.from_arrays(arrays, ["part", "block", "ids_before", "ids_in_block", "doc_ids", "lengths", "offsets", "words"])

    for batch in batches:
        for p, d, n, w in zip(*(c.to_pylist() for c in batch.columns)):
            if doc_ids and (p != part or held + len(w) // 8 > BLOCK_WORDS):
                yield taken()
                block, before = (block + 1, before + sum(lengths)) if p == part else (0, 0)
                doc_ids, lengths, offsets, words, held = [], [], [], [], 0
            part = p
            doc_ids.append(d)
            lengths.append(n)
            offsets.append(held)
            words.append(w)
            held += len(w) // 8
    if doc_ids:
        yield taken()


def read_blocks(spark, path: str, ids: bool = True, crc: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, and of the ids read from the blocks: ids array<bigint>,
    ids_crc32 (unsigned, of them as little-endian unsigned 32-bit integers)."""
    stored = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    sums = stored.groupBy("part").agg(F.sum("ids_in_block").alias("n"))
    before = {r["part"]: r["n"] for r in sums.collect()}  # one number for each part; their count is a parameter
    total, part_starts = 0, {}
    for p in sorted(before):
        part_starts[p] = total
        total += before[p]
    starts = F.create_map(*[F.lit(x) for pair in part_starts.items() for x in pair]) if part_starts else F.create_map(F.lit(0), F.lit(0))
    placed = stored.select((F.col("ids_before") + starts[F.col("part")]).alias("block_start"), "doc_ids", "lengths", "offsets", "words")
    schema = "doc_id long, start long, n_tokens long" + ", ids array<bigint>" * ids + ", ids_crc32 long" * crc
    return placed.mapInArrow(documents(ids, crc), schema)


def documents(with_ids: bool, with_crc: bool):
    """Decodes blocks, one at a time."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, doc_ids, lengths, offsets, words = (c[i] for c in batch.columns)
                ids, before = unpack(np.frombuffer(words.as_buffer(), "<u8"))
                lengths = np.frombuffer(lengths.as_buffer(), "<u4").astype(np.int64)
                # A document's ids begin with the word at its offset.
                firsts = before[np.frombuffer(offsets.as_buffer(), "<u4")]
                ends = firsts + lengths
                columns = {"doc_id": pa.array(doc_ids.as_py(), pa.int64()), "start": pa.array(start.as_py() + firsts), "n_tokens": pa.array(lengths)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(firsts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int64)))
                if with_crc:
                    flat = ids.astype("<u4")
                    columns["ids_crc32"] = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(firsts, ends)], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    return decoded


def store_ids(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None, path: str | None = None, ids: bool = True, crc: bool = False) -> DataFrame:
    """Writes the ids of docs and reads them back."""
    path = path or scratch(docs.sparkSession, "token-ids")
    write_blocks(docs, tokenizer, end_id, path, parts)
    return read_blocks(docs.sparkSession, path, ids, crc)
