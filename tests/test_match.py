"""Names against expressions without given pairs: as trying all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from wareknit.operators import match, measures
from wareknit.plans import inputs
from wareknit.plans.rules import Unit, shipped_rules

RULES = shipped_rules()


def names(rng, n):
    units = "г гр кг мг мкг ug мл л ml l литров шт уп kb гб tb мм см м км доз мкг/доза мг\\сут".split()
    words = "Мука Сок red синий чёрный Box n x № N".split()
    number = lambda: rng.choice(["1", "10", "0.1", "0,10", "1000", "2.5", "12.345", "5", "500", "0.5", "1.", ".5", "10,", "1.000.5", "7" * 45])
    out = [None, "", "  ", "10", "№10", "x 10 x10 n5", "10 кг 10 кг", "10,5кг", "10 г/мл", "0.10 г"]
    for _ in range(n):
        out.append(rng.choice([" ", "", " "]).join(rng.choice([rng.choice(words), number(), rng.choice(units)]) if rng.random() < 0.3 else f"{rng.choice(words)} {number()}{rng.choice(['', ' '])}{rng.choice(units)} " for _ in range(rng.randint(1, 3))))
    return out


@pytest.mark.parametrize("mode", ["1", "overall", "none"])
def test_catalogue_as_all_pairs(spark, mode):
    rng, rules = random.Random(mode), RULES.merged(mode)
    clients, sources = (spark.createDataFrame([(n, "clash") for n in names(rng, 110)], "name string, regex string") for _ in "cs")
    found = match.match_catalogue(clients, "name", sources, "name", rules)
    got = {(r.client, r.source) for r in found.members.join(found.pairs, "regex").select("client", "source").collect()}
    each = lambda df, c: df.select(F.coalesce("name", F.lit("")).alias(c)).distinct()
    pairs = measures.extract_measures(each(clients, "client"), "client", rules, regex_col="rx").crossJoin(each(sources, "source"))
    want = {(r.client, r.source) for r in measures.match_regex(pairs, "source", "rx", "m").filter("m").select("client", "source").collect()}
    assert got == want and len(want) > 300


def test_few_candidates(spark, sf_dir):
    """An expression with a measure is tried on a small part of the names only."""
    parts = inputs.catalog(spark, sf_dir)
    found = match.match_catalogue(parts, "name", parts, "name", RULES)
    bound = found.candidates.filter(F.col("regex").contains("(?=")).count()
    classes = found.members.select("regex").distinct().filter(F.col("regex").contains("(?=")).count()
    distinct = parts.select("name").distinct().count()
    assert bound < 0.05 * classes * distinct


def test_a_frequent_value(spark):
    """Half of both tables ask for and offer one value: one class, and one row for each source name."""
    rows = [(f"Сок {i} 1 л" if i % 2 else f"Сок {i} {i} л",) for i in range(600)]
    df = spark.createDataFrame(rows, "name string")
    found = match.match_catalogue(df, "name", df, "name", RULES)
    n = found.pairs.count()
    assert n < 1_000 and found.candidates.count() < 1_500
    assert found.members.join(found.pairs, "regex").filter((F.col("client") == "Сок 1 1 л") & F.col("source").endswith(" 1 л")).count() == 300


def test_symbols_like_digits_are_refused():
    with pytest.raises(ValueError):
        match.offered_numbers(F.lit("x"), Unit("u", "kg|[0-9]g", 1))


def test_empty_tables(spark):
    df = spark.createDataFrame([("Сок 1 л",)], "name string")
    assert match.match_catalogue(df.limit(0), "name", df, "name", RULES).pairs.count() == 0
    assert match.match_catalogue(df, "name", df.limit(0), "name", RULES).pairs.count() == 0
