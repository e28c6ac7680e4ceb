"""The row-wise jobs on streams. They are stateless: a streaming table goes through the same expressions as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wareknit.operators.features import validate_features
from wareknit.operators.measures import extract_measures
from wareknit.operators.offers import validate_each
from wareknit.plans.rules import MeasureRules


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, as they come."""
    return spark.readStream.schema(schema).parquet(path)


def stream_features(pairs: DataFrame, client: str, source: str, rules: MeasureRules) -> DataFrame:
    return validate_features(pairs, client, source, rules)


def stream_measures(names: DataFrame, col: str, rules: MeasureRules) -> DataFrame:
    return extract_measures(names, col, rules)


def stream_offers(offers: DataFrame, catalog: DataFrame, text_col: str = "row_text") -> DataFrame:
    """Offers of a stream against a fixed catalogue."""
    return validate_each(offers, catalog, text_col)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come so far to a Parquet folder, exactly once, and ends."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
