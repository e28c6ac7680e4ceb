"""Sharding by jump consistent hashing.

The shard of a row follows from its key and the number of shards alone: the key seeds a series of jumps, and the last
shard reached below the number of shards is the row's. One more shard takes only the rows whose next jump lands on it.

Rows of a shard are divided into buckets by another hash of the key and the text's crc32, so that no task holds a whole
shard, nor all rows of one key; the counts of the buckets before give each bucket its first slot.

Edge cases: null keys share one shard; null texts have no bytes and crc32 0; rows with equal keys are ordered by their
text's crc32 and size and have slots of their own; an empty table gives an empty result; other columns are written as
they are, unless they have the name of a result column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, scratch, whole_text

ROWS_PER_BUCKET = 4_000
#: Result columns: an input column of one of these names, in whatever case, is left out.
RESULTS = ("shard", "slot", "grown_shard")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key."""
    key = keys.astype(np.uint64)
    at, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = ahead < shards
    with np.errstate(over="ignore"):
        while live.any():
            at[live] = ahead[live]
            key = key * np.uint64(2862933555777941757) + np.uint64(1)
            reach = (at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))
            ahead[live] = reach[live].astype(np.int64)
            live = ahead < shards
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    @F.arrow_udf("int")
    def jumped(keys: pa.Array) -> pa.Array:
        return pa.array(jump_hash(keys.to_numpy(zero_copy_only=False).view(np.uint64), shards))

    return jumped(F.xxhash64(key.cast("string")))


def write_shards(docs: DataFrame, shards: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """docs with shard, slot and grown_shard, under path/shard=k. Returns the path."""
    path = path or scratch(docs.sparkSession, "shards")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    own_bucket, first_slot = free_name(docs, "bucket"), free_name(docs, "first_slot")
    buckets = max(1, -(-docs.count() // (shards * ROWS_PER_BUCKET)))
    key = F.col(id_col)
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), key.cast("string"), F.crc32(whole_text(text_col).cast("binary"))), F.lit(buckets)).cast("int")
    placed = lambda df: df.withColumns({"shard": shard_of(key, shards), own_bucket: bucket})
    sizes = placed(docs.select(id_col, text_col)).groupBy("shard", own_bucket).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(own_bucket).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", own_bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first_slot))
    inside = Window.partitionBy("shard", own_bucket).orderBy(key, F.crc32(whole_text(text_col).cast("binary")), F.octet_length(whole_text(text_col)))
    rows = placed(docs).withColumn("grown_shard", shard_of(key, shards + 1)).withColumn("slot", F.row_number().over(inside))
    rows = rows.join(firsts, ["shard", own_bucket]).withColumn("slot", F.col("slot") - 1 + F.col(first_slot))
    rows.drop(own_bucket, first_slot).write.partitionBy("shard").parquet(path)
    return path


def read_shards(docs: DataFrame, path: str) -> DataFrame:
    """The rows of all shards, with their shard as an int."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in RESULTS]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["grown_shard int", "slot long", "shard int"])
    return docs.sparkSession.read.schema(schema).parquet(path)
