"""From product names to expressions: measures, sizes, and their use on other names.

Everything is a column expression; names are padded with two spaces on each side, which prefixes and postfixes of the
rules consume. Expressions are searched without regard to letter case in both scripts, and white space, digits and word
edges are those of Unicode: a no-break space is a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareknit.functions.words import text_of
from wareknit.plans.rules import VALUE, Measure, MeasureRules, Unit, ratio
from wareknit.plans.scratch import spread

ANY_CASE = "(?iuU)"
#: How an exclusion begins, alone and inside a whole expression.
CARET_EXCLUSION, EXCLUSION = "^(?!.*(", "(?!.*("


def padded(col: str | Column) -> Column:
    return F.concat(F.lit("  "), text_of(col), F.lit("  "))


def unit_matches(col: str | Column, unit: Unit) -> Column:
    """What the unit's search finds: whole matches, or values where the rule has an expression of its own for them."""
    found = F.regexp_extract_all(padded(col), F.lit(ANY_CASE + unit.search), unit.group)
    return F.slice(found, 1, unit.max_count) if unit.max_count is not None else found


def plain_number(number: Column) -> Column:
    """A decimal without trailing zeros."""
    text = F.replace(F.format_number(number.try_cast("decimal(38,20)"), 20), F.lit(","), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def matched_numbers(matches: Column) -> Column:
    """The first number of each match, as a decimal; a comma counts as a point."""
    number = lambda m: F.regexp_replace(F.regexp_extract(m, VALUE, 0), ",", ".").try_cast("decimal(26,12)")
    return F.filter(F.transform(matches, number), lambda n: n.isNotNull())


def in_unit(number: Column, unit: Unit, other: Unit) -> Column:
    """A unit's value as a plain number of another unit."""
    factor = ratio(unit.weight, other.weight)
    digits, places = format(factor, "f"), max(0, -factor.as_tuple().exponent)
    return plain_number(number * F.lit(digits).cast(f"decimal({len(digits.replace('.', ''))},{places})"))


def numeric_unit_regex(col: str | Column, unit: Unit, allied: list[Unit]) -> Column:
    """A lookahead for each value, which accepts it in every allied unit."""

    def accepts(number: Column) -> Column:
        parts = []
        for other in allied:
            shown = F.replace(in_unit(number, unit, other), F.lit("."), F.lit("[.,]"))
            before, after = other.exactly()
            parts.append(F.concat(F.lit(before), shown, F.lit(after)))
        return F.concat_ws("|", *parts)

    each = F.transform(matched_numbers(unit_matches(col, unit)), accepts)
    return F.when(F.size(each) > 0, F.concat(F.lit("(?=.*("), F.array_join(each, "))(?=.*("), F.lit("))"))).otherwise("")


def string_unit_regex(col: str | Column, unit: Unit) -> Column:
    return F.when(padded(col).rlike(ANY_CASE + unit.search), F.lit(f"(?=.*({unit.search}))")).otherwise("")


def unit_regex(col: str | Column, measure: Measure, unit: Unit) -> Column:
    return numeric_unit_regex(col, unit, measure.allied(unit)) if measure.kind == "numeric" else string_unit_regex(col, unit)


def exclusion_pattern(measure: Measure) -> str:
    """Rejects names with two or more of the measure."""
    behind = "|".join(u.symbol for u in measure.units if u.search_mode == "behind")
    front = "|".join(u.symbol for u in measure.units if u.search_mode == "front")
    parts = []
    if behind:
        parts.append(rf"(?:[0-9][0-9]\d*|[2-9]\d*?)\s*(?:{behind})")
    if front:
        parts.append(rf"(?:{front})\s*(?:[0-9][0-9]\d*|[2-9]\d*)")
    return CARET_EXCLUSION + "|".join(parts) + "))"


def exclusion_regex(measure: Measure, unit_columns: list[Column]) -> Column:
    """The exclusion, where no unit of the measure was found."""
    none = F.lit(True)
    for c in unit_columns:
        none &= F.trim(c) == ""
    return F.when(none, F.lit(exclusion_pattern(measure))).otherwise("")


def extract_measure(df: DataFrame, col: str, measure: Measure, name: str | None = None) -> DataFrame:
    """df with the concatenated expressions of one measure."""
    return df.withColumn(name or measure.name, F.concat(*[unit_regex(col, measure, u) for u in sorted(measure.units, key=lambda u: u.weight)]))


def extract_measures(df: DataFrame, col: str, rules: MeasureRules, drop_units: bool = True, regex_col: str = "Regex") -> DataFrame:
    """df with a column for each unit and, of all of them and the exclusions, the name's whole expression."""
    measures = rules.for_regexes()
    named = {u.name: unit_regex(col, m, u) for m in measures for u in sorted(m.units, key=lambda u: u.weight)}
    found = df.withColumns(named)
    excluded = [exclusion_regex(m, [F.col(f"`{u.name}`") for u in m.units]) for m in measures if m.exclude]
    exclusions = F.concat(*[F.replace(e, F.lit(CARET_EXCLUSION), F.lit(EXCLUSION)) for e in excluded]) if excluded else F.lit("")
    caret = F.when(exclusions != "", "^").otherwise("")
    found = found.withColumn(regex_col, F.concat(caret, exclusions, *[F.col(f"`{n}`") for n in named]))
    return found.drop(*named) if drop_units else found


def extract_sizes(df: DataFrame, col: str, sep: str = r"\D+", left_step: int = 10, right_step: int = 10, name: str = "Sizes") -> DataFrame:
    """df with a lookahead for the first three numbers side by side, else the first two, at a tenth, once and ten times
    their size. Numbers are exact decimals; a comma counts as a point."""
    number = r"(\d*[.,]?\d+)"
    text = text_of(col)
    three, two = f"{number}(?:{sep}){number}(?:{sep}){number}", f"{number}(?:{sep}){number}"
    values = F.when(text.rlike(three), F.array(*[F.regexp_extract(text, three, i) for i in (1, 2, 3)])).when(text.rlike(two), F.array(*[F.regexp_extract(text, two, i) for i in (1, 2)]))
    numbers = F.transform(values, lambda v: F.regexp_replace(v, ",", ".").try_cast("decimal(18,8)"))

    def scaled(factor) -> Column:
        shown = F.transform(numbers, lambda n: plain_number(n * F.lit(factor).cast("decimal(18,10)")))
        return F.concat(F.lit(r"\D"), F.array_join(shown, r"\D+"), F.lit(r"\D"))

    from decimal import Decimal

    steps = [Decimal(1) / Decimal(left_step), Decimal(1), Decimal(right_step)]
    whole = F.concat(F.lit("(?=.*("), F.concat_ws("|", *[scaled(s) for s in steps]), F.lit("))"))
    return df.withColumn(name, F.when(values.isNotNull(), whole).otherwise(""))


#: A lookahead inside a whole expression, and what stands before and after its body.
LOOKAHEAD, BODY_START, BODY_END = r"\(\?=\.\*.*?\)\)+", r"^\(\?=\.\*\(", r"\)\)$"


def parse_regex(col: str | Column) -> Column:
    """The bodies of an expression's lookaheads."""
    found = F.regexp_extract_all(text_of(col), F.lit(LOOKAHEAD), 0)
    return F.transform(found, lambda b: F.regexp_replace(F.regexp_replace(b, BODY_START, ""), BODY_END, ""))


def strip_by_regex(df: DataFrame, col: str, regex_col: str = "Regex", name: str | None = None) -> DataFrame:
    """df with the text (and one space after it) without all that the bodies of its own expression match."""
    text = F.concat(text_of(col), F.lit(" "))
    left = F.aggregate(parse_regex(regex_col), text, lambda t, body: F.regexp_replace(t, F.concat(F.lit(ANY_CASE), body), F.lit("")))
    return df.withColumn(name or col, left)


def matches(name: str | Column, regex: str | Column) -> Column:
    """Does a name satisfy an expression? An empty expression is satisfied."""
    return F.rlike(padded(name), F.concat(F.lit(ANY_CASE), text_of(regex)))


def match_names(pairs: DataFrame, client: str, source: str, rules: MeasureRules, name: str = "matched") -> DataFrame:
    """pairs with whether each source name satisfies its client name's expression.

    Expressions are made once for each client name, and decided once for each pair of names; nulls are empty names.
    """
    keyed = pairs.withColumns({"__client": text_of(client), "__source": text_of(source)})
    once = keyed.select("__client", "__source").distinct()
    regexes = extract_measures(spread(once.select("__client").distinct(), "__client"), "__client", rules, regex_col="__regex")
    decided = match_regex(once.join(regexes, "__client"), "__source", "__regex", name).select("__client", "__source", name)
    return keyed.join(decided, ["__client", "__source"]).drop("__client", "__source")


def match_regex(pairs: DataFrame, name_col: str, regex_col: str, name: str = "matched") -> DataFrame:
    return pairs.withColumn(name, matches(name_col, regex_col))
