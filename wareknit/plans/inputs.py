"""Product tables derived from the driver's tables, by expressions that SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("g", "kg", "ml", "l", "gb", "pcs")
SMALLER = ("mg", "g", "ml", "ml", "mb", "pcs")


def cases(values: tuple[str, ...]) -> str:
    return "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


NAME = f"(p_name || ' ' || CAST(p_size AS VARCHAR(10)) || ' ' || {cases(UNITS)})"
BIGGER = f"(p_name || ' ' || CAST(p_size + 1 AS VARCHAR(10)) || ' ' || {cases(UNITS)})"
CONVERTED = f"(p_name || ' ' || CAST(p_size * 1000 AS VARCHAR(10)) || ' ' || {cases(SMALLER)})"
SOURCE = f"(CASE l_linenumber % 3 WHEN 0 THEN {NAME} WHEN 1 THEN {BIGGER} ELSE {CONVERTED} END)"
SIZES = "(p_name || ' ' || CAST(p_size AS VARCHAR(10)) || 'x' || CAST(p_partkey % 50 + 1 AS VARCHAR(10)) || CASE WHEN p_partkey % 2 = 0 THEN 'x' || CAST(p_partkey % 7 + 1 AS VARCHAR(10)) ELSE '' END || ' ')"
CATALOG_SQL = f"(SELECT p_partkey, {NAME} AS name, {SIZES} AS size_name, p_name FROM part)"
PAIRS_SQL = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, {NAME} AS client, {SOURCE} AS source FROM lineitem JOIN part ON l_partkey = p_partkey)"
PAIR_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, name, size_name, p_name."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"), F.expr(SIZES).alias("size_name"), "p_name")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of a lineitem, its part's name (client) and a name that is the same, another or converted (source)."""
    joined = table(spark, sf_dir, "lineitem").select(*PAIR_KEYS).join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(*PAIR_KEYS, "p_name", F.expr(NAME).alias("client"), F.expr(SOURCE).alias("source"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(*PAIR_KEYS, F.col("p_name").alias("product"), F.col("source").alias("row_text"))


FIRST, SECOND = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
#: For each product: both words must be there, some units must not, and an expression must match.
RULES_SQL = f"""(SELECT DISTINCT p_name AS product, {SECOND} || '|' || {FIRST} AS plus_words,
 CASE WHEN length(p_name) % 2 = 0 THEN '|kg|gb|' ELSE 'mb' END AS minus_words,
 '(?=.*(' || {FIRST} || '))(?=.*([0-9] *(?:g|kg|mg|l|ml)))' AS regex FROM part)"""


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.expr(FIRST), F.expr(SECOND)
    return (
        table(spark, sf_dir, "part")
        .select("p_name")
        .distinct()
        .select(
            F.col("p_name").alias("product"),
            F.concat(second, F.lit("|"), first).alias("plus_words"),
            F.when(F.length("p_name") % 2 == 0, "|kg|gb|").otherwise("mb").alias("minus_words"),
            F.concat(F.lit("(?=.*("), first, F.lit("))(?=.*([0-9] *(?:g|kg|mg|l|ml)))")).alias("regex"),
        )
    )
