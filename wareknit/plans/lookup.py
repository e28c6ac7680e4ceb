"""Joins of many rows to a table of keys whose frequency is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if more than one in FREQUENT of all rows have it: there are fewer than FREQUENT such keys.
FREQUENT = 1_000


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], count: str, frequent: int = FREQUENT) -> DataFrame:
    """df inner-joined to table (a stored one, each of its keys once) on keys; count: how often df has the key.

    Fewer than `frequent` keys can each have more than that share of all rows: they are broadcast, so that no task gets
    all rows of one. Rows with other keys are shuffled; none of those keys makes a task large.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).head()[0]
    often = F.col(count) * frequent > total
    hot = F.broadcast(table.filter(often).select(*keys, F.struct(*[F.col(c) for c in table.columns if c not in keys]).alias("__found")))
    met = df.join(hot, keys, "left")
    mine = met.filter("__found is not null").select(*df.columns, "__found.*")
    rest = met.filter("__found is null").drop("__found").join(table.filter(~often), keys)
    return mine.unionByName(rest.select(*mine.columns))
