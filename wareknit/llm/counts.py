"""Token counts of whole texts through a cache of digests.

A text's content is normalised (white space that the tokenizer only divides by becomes one space) and hashed; digest
and tokenizer version are joined to the counts stored before, only the distinct contents that are missing there are
encoded, and their counts are appended to the cache. Cache tables are Parquet folders; a file appended is never
rewritten, so that a run that is broken off leaves complete counts behind.

Copies of a content are dropped inside each input partition before the shuffle on the digest, so that a content that
a third of all rows share is sent once by each partition. Texts are shuffled once, at most; ids and digests once.

Edge cases: null counts as the empty text and has 0 bytes and 0 tokens; repeated rows each have a row; an empty table
gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .common import saved, scratch, whole_text

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
#: A partition remembers so many digests when it drops its own copies; those beyond are dropped after the shuffle.
LOCAL_DIGESTS = 200_000


def tokenizer_version(path: str) -> str:
    """Changes with the file's content."""
    with open(path, "rb") as f:
        return f"{os.path.basename(path)}:{hashlib.sha256(f.read()).hexdigest()[:16]}"


def content(text: Column, collapse_space: bool) -> Column:
    """The text whose count is stored. Only ASCII white space is touched, and only for a tokenizer that drops it."""
    return F.regexp_replace(text, "[\\x09-\\x0D\\x20]+", " ") if collapse_space else text


def without_local_copies(rows: DataFrame) -> DataFrame:
    """The first row of each digest in each partition."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            at = []
            for i, d in enumerate(batch.column(0).to_pylist()):
                if d not in seen:
                    at.append(i)
                    if len(seen) < LOCAL_DIGESTS:
                        seen.add(d)
            yield batch.take(pa.array(at, pa.int64()))

    return rows.mapInArrow(keep, rows.schema)


def token_count(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        b = bpe(path)
        for batch in batches:
            yield pa.array([b.count(t.as_py() or "") for t in batch], pa.int64())

    return count(text)


def read_cache(spark: SparkSession, cache: str | None) -> DataFrame:
    empty = spark.createDataFrame([], CACHE_SCHEMA)
    if cache is None:
        return empty
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, collapse_space: bool | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes long, n_tokens long. cache: folder of stored counts, read and appended to; None: a new one."""
    spark = docs.sparkSession
    if collapse_space is None:
        collapse_space = bpe(path).lower
    version = F.lit(tokenizer_version(path))
    text = whole_text(text_col)
    # The digest is that of the content; with the tokenizer's version it is the key of a stored count.
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), content(text, collapse_space).alias("content"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    stored = read_cache(spark, cache).filter(F.col("version") == version).select("digest", "n_tokens")
    misses = without_local_copies(rows.select("digest", "content")).join(stored.select("digest"), "digest", "left_anti")
    misses = misses.groupBy("digest").agg(F.first("content").alias("content"))
    cache = cache or scratch(spark, "token-counts")
    misses.select("digest", version.alias("version"), token_count(F.col("content"), path).alias("n_tokens")).write.mode("append").parquet(cache)
    # A run that another one overtook may have appended a digest twice, with the same count.
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # Written, so that the join is one of plain tables, in which Spark can split a frequent digest.
    counts = saved(counts, "digest-counts")
    return rows.select(id_col, "n_bytes", "digest").join(counts, "digest").select(id_col, "n_bytes", "n_tokens")
