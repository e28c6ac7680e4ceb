"""Which names of one table satisfy the expressions of another's, without comparing all pairs.

A name's expression is a series of lookaheads, each of which asks for one value in any of its allied units, after
exclusions. Names with the same expression are one class, so that an expression is decided once for each other name,
however many names share it.

An index holds what every source name offers: (unit, number) for each number that stands at a unit's symbol, and the unit
alone where a unit of a string measure is found. A number can be met by any end of a run of digits (by any beginning, where
the symbol comes first), since a lookahead may start inside it: all of them are in the index, so that no match is lost. Each
class looks up one of its lookaheads, the one that the fewest sources offer, in an equi-join; expressions are tried on
these candidates only. Classes without a lookahead are few (their expressions are made of exclusions alone): each is tried on every
source name, once for the whole class.
"""

from __future__ import annotations

import re
from functools import partial
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareknit.functions.words import text_of
from wareknit.operators.measures import ANY_CASE, extract_measures, in_unit, matched_numbers, matches, padded, unit_matches
from wareknit.plans.rules import Measure, MeasureRules, Unit
from wareknit.plans.scratch import spread, written

KEY = "struct<unit: int, number: string>"
#: Numbers of expressions are decimals of 38 digits at most.
LONGEST_NUMBER = 42


class Matched(NamedTuple):
    members: DataFrame  # client, regex: each distinct client name's class
    pairs: DataFrame  # regex, source: what satisfies each class
    candidates: DataFrame  # regex, source: what was tried


def numbered_units(rules: MeasureRules) -> dict[tuple[str, str], int]:
    return {(m.name, u.name): k for k, (m, u) in enumerate((m, u) for m in rules.for_regexes() for u in m.units)}


def check_symbols(unit: Unit) -> None:
    """Symbols that could be taken for digits would be read as parts of numbers."""
    if re.search(r"(^|\|)[0-9.,\[(?]|[0-9](\||$)", unit.symbol):
        raise ValueError(f"{unit.name}: each symbol must begin with a letter or a sign and must not end with a digit")


def offered_numbers(name: Column, unit: Unit) -> Column:
    """The numbers that a lookahead for the unit could find, with points."""
    check_symbols(unit)
    if unit.search_mode == "front":
        runs = F.regexp_extract_all(name, F.lit(rf"{ANY_CASE}(?:{unit.symbol})\s*([0-9][0-9.,]*)"), 1)
        part, edge = F.left, "[0-9]$"
    else:
        runs = F.regexp_extract_all(name, F.lit(rf"{ANY_CASE}(?<![0-9.,])[0-9.,]*[0-9](?=\s*(?:{unit.symbol}))"), 0)
        part, edge = F.right, "^[0-9]"
    parts = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.least(F.length(r), F.lit(LONGEST_NUMBER))), lambda k: part(r, k))))
    return F.transform(F.filter(parts, lambda p: p.rlike(edge)), lambda p: F.replace(p, F.lit(","), F.lit(".")))


def key(unit: int, number: Column) -> Column:
    return F.struct(F.lit(unit).alias("unit"), number.alias("number"))


def source_index(names: DataFrame, rules: MeasureRules) -> DataFrame:
    """source, unit, number of distinct names (source)."""
    numbers, text, keys = numbered_units(rules), padded("source"), []
    for m in rules.for_regexes():
        for u in m.units:
            at = numbers[m.name, u.name]
            if m.kind == "numeric":
                keys.append(F.transform(offered_numbers(text, u), partial(key, at)))
            else:
                keys.append(F.when(text.rlike(ANY_CASE + u.search), F.array(key(at, F.lit("")))).otherwise(F.array().cast(f"array<{KEY}>")))
    return names.select("source", F.explode(F.array_distinct(F.concat(*keys))).alias("k")).select("source", "k.unit", "k.number")


def in_any_unit(measure: Measure, unit: Unit, numbers: dict[tuple[str, str], int], value: Column) -> Column:
    """The keys that satisfy a lookahead for the unit's value."""
    keys = F.array(*[key(numbers[measure.name, other.name], in_unit(value, unit, other)) for other in measure.allied(unit)])
    return F.filter(keys, lambda k: k["number"].isNotNull())


def demanded(name: str, rules: MeasureRules) -> Column:
    """array<array<struct<unit, number>>>: for each lookahead of the name's expression what it can be satisfied by."""
    numbers, out = numbered_units(rules), []
    for m in rules.for_regexes():
        for u in m.units:
            if m.kind == "numeric":
                out.append(F.transform(matched_numbers(unit_matches(name, u)), partial(in_any_unit, m, u, numbers)))
            else:
                one = F.array(F.array(key(numbers[m.name, u.name], F.lit(""))))
                out.append(F.when(padded(name).rlike(ANY_CASE + u.search), one).otherwise(F.array().cast(f"array<array<{KEY}>>")))
    return F.filter(F.concat(*out), lambda keys: F.size(keys) > 0)


def match_catalogue(clients: DataFrame, client_col: str, sources: DataFrame, source_col: str, rules: MeasureRules) -> Matched:
    """All pairs of a class of client names and a source name that satisfies the class's expression; nulls are empty names."""
    names = spread(clients.select(text_of(client_col).alias("client")).distinct(), "client")
    named = extract_measures(names.withColumn("looks", demanded("client", rules)), "client", rules, regex_col="regex")
    named = written(named.select("client", "regex", "looks"), "client-classes")
    classes = written(named.groupBy("regex").agg(F.first("looks").alias("looks")), "classes")
    offers = written(sources.select(text_of(source_col).alias("source")).distinct(), "source-names")
    index = written(source_index(spread(offers, "source"), rules), "source-index")
    often = written(index.groupBy("unit", "number").agg(F.count("*").alias("n")), "source-counts")
    looks = classes.select("regex", F.posexplode("looks").alias("look", "keys")).select("regex", "look", F.explode("keys").alias("k")).select("regex", "look", "k.unit", "k.number")
    costs = looks.join(often, ["unit", "number"], "left").groupBy("regex", "look").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    rarest = costs.groupBy("regex").agg(F.min(F.struct("n", "look")).alias("least")).select("regex", F.col("least.look").alias("look"))
    asked = written(looks.join(rarest, ["regex", "look"]).select("regex", "unit", "number"), "asked-values")
    found = asked.join(index, ["unit", "number"]).select("regex", "source").distinct()
    # At most one for each set of exclusions.
    free = [r["regex"] for r in classes.filter(F.size("looks") == 0).select("regex").collect()]
    every = offers.select(F.explode(F.array(*[F.lit(r) for r in free]).cast("array<string>")).alias("regex"), "source")
    candidates = written(found.unionByName(every), "candidates")
    return Matched(named.select("client", "regex"), candidates.filter(matches("source", "regex")), candidates)
