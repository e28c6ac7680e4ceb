"""Do two names carry the same measures? Features are struct<feature, unit, raw, canon>; canon is a plain decimal, a
unit's name, or the sorted values of a dimension.

validate_features is narrow: a pair is decided where it lies. validate_names finds the features of each distinct name once,
in a stored table that later batches extend, and compares what both sides of a pair have there.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareknit.functions.words import text_of
from wareknit.operators.measures import ANY_CASE, plain_number
from wareknit.plans.rules import Measure, MeasureRules, Unit
from wareknit.plans.scratch import free_name, scratch, spread, written

#: Expressions of complex features. Separators of dimensions are case-sensitive, as weights of
#: concentrations are: an upper-case unit has none, and the first that is found in their order counts.
NUMBER = r"\d*[.,]?\d+"
SIGN = "(?:см|cm|мм|mm|м|m)?"
TIMES = "(?:[xх]|на)"
DIMENSION = rf"{NUMBER}\s*{SIGN}\s*{TIMES}\s*{NUMBER}\s*{SIGN}(?:\s*{SIGN}\s*{TIMES}\s*{NUMBER}\s*{SIGN})*(?:(?U)\b|$)"
METRES = [("0.001", "(?iuU)мм|mm"), ("0.01", "(?iuU)см|cm"), ("1", r"(?iuU)m([^m]|\b|$)|м([^м]|\b|$)")]
OVER = r"[\\\/]"
CONCENTRATION = rf"{NUMBER}\s*(?:мкг|мг|г|кг)?\s*{OVER}\s*\d*[.,]?\d*\s*(?:мл|л)"
PERCENT = rf"{NUMBER}\s*%"
TOPS = [("0.001", "мкг"), ("1", "мг"), ("1000", "г"), ("1000000", "кг")]
BOTTOMS = [("1", "мл"), ("1000", "л")]


def feature(name: str, unit: str, raw: Column, canon: Column) -> Column:
    return F.struct(F.lit(name).alias("feature"), F.lit(unit).alias("unit"), raw.alias("raw"), F.coalesce(canon, raw).alias("canon"))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY_CASE + pattern), group)


def first_number(text: Column, pattern: str = r"\d+[.,]?\d*") -> Column:
    return F.regexp_replace(F.regexp_extract(text, pattern, 0), ",", ".").try_cast("decimal(26,12)")


def numeric_features(text: Column, measure: Measure, unit: Unit) -> Column:
    """Every match of the unit, its first number times the unit's weight."""
    value = lambda m: plain_number(first_number(m) * F.lit(unit.weight).cast("decimal(11,0)"))
    return F.transform(found(text, unit.search, unit.group), lambda m: feature(measure.name, unit.name, m, value(m)))


def string_features(text: Column, measure: Measure, unit: Unit) -> Column:
    return F.transform(found(text, unit.search), lambda m: feature(measure.name, unit.name, m, F.lit(unit.name)))


def dimension_features(text: Column, name: str = "Complex Dimension") -> Column:
    """a x b x ...: the set of values in metres. A value without a unit has the last one stated, else centimetres."""

    def metres(raw: Column) -> Column:
        parts = F.split(raw, TIMES, 3)

        def weight(p: Column) -> Column:
            out = F.when(p.rlike(METRES[0][1]), F.lit(METRES[0][0]))
            for w, rx in METRES[1:]:
                out = out.when(p.rlike(rx), F.lit(w))
            return out.cast("decimal(8,4)")

        stated = F.filter(F.transform(parts, weight), lambda w: w.isNotNull())
        usual = F.coalesce(F.element_at(F.when(F.size(stated) > 0, stated).otherwise(F.array(F.lit("0.01").cast("decimal(8,4)"))), -1))
        value = lambda p: first_number(p, NUMBER) * F.coalesce(weight(p), usual)
        return F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform(parts, value))), plain_number), "x")

    return F.transform(found(text, DIMENSION), lambda m: feature(name, "n-размерность", m, metres(m)))


def concentration_features(text: Column, percent: bool, name: str = "Complex Concentration") -> Column:
    """Mass per volume on the scale of percent, or percent; quotients are rounded to twelve places."""
    if percent:
        value = lambda m: plain_number(first_number(m, NUMBER).cast("decimal(38,12)"))
        return F.transform(found(text, PERCENT), lambda m: feature(name, "Complex Percent Concentation", m, value(m)))

    def side(part: Column, weights: list[tuple[str, str]]) -> Column:
        number = F.coalesce(first_number_or_null(part), F.lit("1").cast("decimal(26,12)"))
        factor = F.when(part.contains(weights[0][1]), F.lit(weights[0][0]))
        for w, symbol in weights[1:]:
            factor = factor.when(part.contains(symbol), F.lit(w))
        return number * F.coalesce(factor, F.lit("1")).cast("decimal(11,3)")

    def value(m: Column) -> Column:
        parts = F.split(m, OVER, 3)
        bottom = side(F.get(parts, 1), BOTTOMS)
        quotient = side(F.get(parts, 0), TOPS).try_cast("decimal(24,6)") / F.nullif(bottom.try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)"))
        return F.coalesce(plain_number(F.round(quotient.try_cast("decimal(36,13)") * F.lit("0.1").cast("decimal(2,1)"), 12)), F.lit("0"))

    return F.transform(found(text, CONCENTRATION), lambda m: feature(name, "Complex Numeric Concentration", m, value(m)))


def first_number_or_null(part: Column) -> Column:
    text = F.regexp_replace(F.regexp_extract(part, NUMBER, 0), ",", ".")
    return F.when(text != "", text).try_cast("decimal(26,12)")


def steps_of(measure: Measure) -> list[tuple[str, int, callable]]:
    """The measure's units in order: the expression that is blanked after them, its group, and the features."""
    if measure.kind == "numeric":
        return [(u.search, u.group, lambda t, u=u: numeric_features(t, measure, u)) for u in measure.units]
    if measure.kind == "string":
        return [(u.search, 0, lambda t, u=u: string_features(t, measure, u)) for u in measure.units]
    if measure.name == "Complex Dimension":
        return [(DIMENSION, 0, lambda t: dimension_features(t, measure.name))]
    return [(CONCENTRATION, 0, lambda t: concentration_features(t, False, measure.name)), (PERCENT, 0, lambda t: concentration_features(t, True, measure.name))]


def blanked(text: Column, pattern: str, ignore_case: bool) -> Column:
    return F.regexp_replace(text, (ANY_CASE if ignore_case else "(?U)") + pattern, "  ")


def extract_features(df: DataFrame, sides: dict[str, str], rules: MeasureRules, blank_ignore_case: bool = False) -> tuple[DataFrame, list[tuple[Measure, dict[str, str]]]]:
    """df with an array of features for each measure and side (a prefix of new columns, and the text's column).

    Measures go by priority. What a unit matched is blanked, so that later units cannot use it; blanking minds letter
    case unless told otherwise. Each blanked text is a column of its own select, so that it is computed once.
    """
    texts = {s: f"__text_{s}" for s in sides}
    df = df.withColumns({texts[s]: F.concat(F.lit("  "), text_of(c), F.lit("   ")) for s, c in sides.items()})
    out = []
    for k, measure in enumerate(rules.for_features()):
        parts: dict[str, list[str]] = {s: [] for s in sides}
        for j, (pattern, _, make) in enumerate(steps_of(measure)):
            new, after = {}, {}
            for s in sides:
                parts[s].append(name := f"__f{k}_{j}_{s}")
                new[name] = make(F.col(texts[s]))
                after[texts[s]] = blanked(F.col(texts[s]), pattern, blank_ignore_case)
            df = df.withColumns(new | after)
        named = {s: f"__m{k}_{s}" for s in sides}
        df = df.withColumns({named[s]: F.concat(*[F.col(p) for p in parts[s]]) for s in sides}).drop(*[p for ps in parts.values() for p in ps])
        out.append((measure, named))
    return df.drop(*texts.values()), out


def compare_sets(client: Column, source: Column, mode: str = "strict") -> Column:
    """strict: equal sets; modest: the smaller inside the larger; client, source: that side inside the other."""
    both, c, s = F.size(F.array_intersect(client, source)), F.size(client), F.size(source)
    if mode == "strict":
        return (both == c) & (both == s)
    return both == {"modest": F.least(c, s), "client": c, "source": s}[mode]


def not_found(client: Column, source: Column, mode: str = "strict") -> Column:
    """The decision where a side is empty (null where neither is): both empty pass; one empty passes if modest."""
    c, s = F.size(client) == 0, F.size(source) == 0
    return F.when(c & s, F.lit(True)).when(c | s, F.lit(mode == "modest"))


def decide(client: Column, source: Column, measure: Measure) -> Column:
    values = [F.array_distinct(F.transform(x, lambda f: f["canon"])) for x in (client, source)]
    return F.coalesce(not_found(*values, measure.not_found_mode), compare_sets(*values, measure.validation_mode))


def validate_features(pairs: DataFrame, client: str, source: str, rules: MeasureRules, blank_ignore_case: bool = False) -> DataFrame:
    """pairs with client_features, source_features and `features validation`: 1 if all features agree."""
    df, found_ = extract_features(pairs, {"c": client, "s": source}, rules, blank_ignore_case)
    agree = F.lit(True)
    for measure, named in found_:
        agree &= decide(F.col(named["c"]), F.col(named["s"]), measure)
    lists = {f"{side}_features": F.concat(*[F.col(n[k]) for _, n in found_]) for side, k in (("client", "c"), ("source", "s"))}
    df = df.withColumns(lists | {"features validation": F.when(agree, 1).otherwise(0)})
    return df.drop(*[n for _, named in found_ for n in named.values()])


STORED = "name string, rules string, features array<array<struct<feature: string, unit: string, raw: string, canon: string>>>"


def rules_digest(rules: MeasureRules, blank_ignore_case: bool) -> str:
    """Names the rules that stored features were found by."""
    return hashlib.sha256(repr((rules.for_features(), blank_ignore_case)).encode()).hexdigest()


def stored_features(names: DataFrame, rules: MeasureRules, path: str, blank_ignore_case: bool = False) -> DataFrame:
    """name, features (an array for each measure, by priority) of the given names (name); what path doesn't have is added.

    Only one job at a time may extend a path.
    """
    spark, digest = names.sparkSession, rules_digest(rules, blank_ignore_case)
    spark.createDataFrame([], STORED).write.mode("append").parquet(path)
    own = lambda: spark.read.schema(STORED).parquet(path).filter(F.col("rules") == digest)
    asked = names.select(text_of("name").alias("name")).distinct()
    new = spread(written(asked.join(own().select("name"), "name", "left_anti"), "new-names"), "name")
    found, named = extract_features(new, {"n": "name"}, rules, blank_ignore_case)
    each = F.array(*[F.transform(F.col(columns["n"]), as_stored) for _, columns in named])
    found.select("name", F.lit(digest).alias("rules"), each.alias("features")).write.mode("append").parquet(path)
    return own().select("name", "features").join(asked, "name", "left_semi")


def as_stored(f: Column) -> Column:
    return F.struct(*[f[n].cast("string").alias(n) for n in ("feature", "unit", "raw", "canon")])


def validate_names(pairs: DataFrame, client: str, source: str, rules: MeasureRules, blank_ignore_case: bool = False, path: str | None = None) -> DataFrame:
    """As validate_features, for pairs whose names repeat. path: the table of name features, kept for later batches."""
    path = path or scratch(pairs.sparkSession, "name-features")
    c, s = (free_name(pairs, n) for n in ("client_name", "source_name"))
    keyed = pairs.withColumns({c: text_of(client), s: text_of(source)})
    once = written(keyed.select(F.col(c).alias("c"), F.col(s).alias("s")).distinct(), "name-pairs")
    table = written(stored_features(once.select(F.explode(F.array("c", "s")).alias("name")), rules, path, blank_ignore_case), "features")
    side = lambda n: table.select(F.col("name").alias(n), F.col("features").alias(f"{n}_features"))
    both, agree = once.join(side("c"), "c").join(side("s"), "s"), F.lit(True)
    for k, measure in enumerate(rules.for_features()):
        agree &= decide(F.get("c_features", k), F.get("s_features", k), measure)
    lists = [F.flatten(f"{n}_features").alias(f"{side}_features") for n, side in (("c", "client"), ("s", "source"))]
    decided = written(both.select(F.col("c").alias(c), F.col("s").alias(s), *lists, F.when(agree, 1).otherwise(0).alias("features validation")), "decided-names")
    return keyed.drop("client_features", "source_features", "features validation").join(decided, [c, s]).drop(c, s)
