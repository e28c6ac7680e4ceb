"""Product tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_products(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """A CSV (with header) or Parquet table; fails if a required column is missing. CSV columns are strings unless a
    schema says otherwise."""
    if path.rstrip("/").lower().endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        df = (reader.schema(schema) if schema else reader).csv(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return df


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Parquet or CSV; arrays and structs become JSON text in CSV."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        from pyspark.sql import functions as F
        from pyspark.sql.types import ArrayType, MapType, StructType

        flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else F.col(f.name) for f in df.schema.fields]
        df.select(flat).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
