"""Helpers shared by the text operators: tables, scratch folders, column names."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir.

    Only a local session, whose executors are threads of the driver, may go without: it gets a temporary folder. On a
    cluster that would be a folder of each machine's own, so that it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "wareknit-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows that a worker turns into Python objects at a time.
SLICE_ROWS = 2_000


def slices(batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[tuple[pa.Array, ...]]:
    """The batches in parts of SLICE_ROWS rows, an empty one as it is."""
    for columns in batches:
        for k in range(0, max(1, len(columns[0])), SLICE_ROWS):
            yield tuple(c[k : k + SLICE_ROWS] for c in columns)


BLANK = re.compile(rb"[\x20\x09-\x0d]")


def pieces_of(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A very long text in pieces of about size bytes, cut where a blank stands, so that no word is cut."""
    at = 0
    while len(data) - at > size and (blank := BLANK.search(data, at + size)):
        yield data[at : blank.start()]
        at = blank.start()
    yield data[at:]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(col: str | Column) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def default_tokenizer(name: str) -> str:
    """Path of a public tokenizer file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)
