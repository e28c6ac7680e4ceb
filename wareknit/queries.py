"""One query for each operator, over whole driver tables, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareknit.functions import words as W
from wareknit.operators import cross, features, match, measures, offers, similarity
from wareknit.plans import inputs
from wareknit.plans.inputs import CATALOG_SQL, PAIR_KEYS, PAIRS_SQL, RULES_SQL
from wareknit.plans.rules import Measure, MeasureRules, SimilarityRules, Unit, load_measure_rules, load_similarity_rules, shipped_rules
from wareknit.plans.scratch import spread, written
from wareknit.sources.tables import read_products, write_result

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ", ".join(PAIR_KEYS)
RULES = shipped_rules()


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A pattern of the rules as SQL text; without Java's flag for Unicode classes."""
    return q(pattern.replace("(?iuU)", "(?i)").replace("(?U)", ""))


# Words and tokens: the English rule with digits and a hyphen, without boundaries (SQL's know ASCII only).
PLAIN = W.WordRule("english", with_numbers=True, symbols="-", word_boundary=False, check_letters=True)
CAPITAL = W.WordRule("english", case="capital", word_boundary=False)
CAPS = W.WordRule("english", case="caps", word_boundary=False)
WORDS_SQL = f"list_filter(regexp_extract_all(coalesce(text, ''), {q(PLAIN.pattern)}), lambda w: regexp_matches(lower(w), '[a-z]'))"


@query(f"SELECT doc_id, array_to_string({WORDS_SQL}, '|') AS words FROM documents")
def w1_words(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", W.join_words(W.extract_words("text", PLAIN)).alias("words"))


@query(f"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), {q(CAPITAL.pattern)}, ' ', 'g'), ' +', ' ', 'g') AS rest FROM documents")
def w2_delete_words(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", W.delete_words("text", CAPITAL).alias("rest"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), {q(CAPS.pattern + '|' + PLAIN.pattern)}), '|') AS words FROM documents")
def w3_words_multi(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", W.join_words(W.extract_words_multi("text", [CAPS, PLAIN])).alias("words"))


@query(f"SELECT doc_id, array_to_string(list_filter({WORDS_SQL}, lambda w: length(w) >= 5)[1:10], '+') AS words FROM documents")
def w4_w5_filter_join(spark, sf_dir):
    words = W.filter_words(W.extract_words("text", PLAIN), 5, 10)
    return inputs.table(spark, sf_dir, "documents").select("doc_id", W.join_words(words, "+").alias("words"))


@query()
def w6_stems(spark, sf_dir):
    from wareknit.functions.scores import stem

    words = W.extract_words("text", W.WordRule("english"))
    vocabulary = inputs.table(spark, sf_dir, "documents").select(F.explode(words).alias("w")).select(F.lower("w").alias("word")).distinct()
    return vocabulary.select("word", stem(F.col("word"), "english").alias("stem"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[а-яa-z0-9][а-яa-z0-9-]+'))), '|') AS tokens FROM documents")
def w7_simple_tokens(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.array_join(W.simple_tokens("text"), "|").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_concat({WORDS_SQL}, regexp_extract_all(coalesce(text, ''), {q(CAPITAL.pattern)})), lambda w: lower(w)))), '|') AS tokens FROM documents")
def w8_rule_tokens(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", F.array_join(W.rule_tokens("text", [PLAIN, CAPITAL]), "|").alias("tokens"))


# Measures. SQL is written from the same rules; numbers are decimals on both sides.
def sql_plain(number: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST({number} AS DECIMAL(38,20)) AS VARCHAR), '0+$', ''), '[.]$', '')"


def sql_matches(text: str, unit) -> str:
    limit = f"[1:{unit.max_count}]" if unit.max_count is not None else ""
    return f"regexp_extract_all('  ' || coalesce({text}, '') || '  ', {re2('(?i)' + unit.search)}, {unit.group}){limit}"


def sql_numeric_regex(text: str, measure: Measure, unit) -> str:
    from wareknit.plans.rules import VALUE, ratio

    parts = []
    for other in measure.allied(unit):
        before, after = other.exactly()
        number = f"CAST(replace(regexp_extract(m, {q(VALUE)}), ',', '.') AS DECIMAL(17,8)) * CAST('{format(ratio(unit.weight, other.weight), 'f')}' AS DECIMAL(20,9))"
        parts.append(f"{q(before)} || replace({sql_plain(number)}, '.', '[.,]') || {q(after)}")
    each = f"list_transform({sql_matches(text, unit)}, lambda m: {' || {} || '.format(q('|')).join(parts)})"
    return f"CASE WHEN len({sql_matches(text, unit)}) > 0 THEN '(?=.*(' || array_to_string({each}, '))(?=.*(') || '))' ELSE '' END"


def sql_unit_regex(text: str, measure: Measure, unit) -> str:
    if measure.kind == "numeric":
        return sql_numeric_regex(text, measure, unit)
    return f"CASE WHEN regexp_matches('  ' || coalesce({text}, '') || '  ', {re2('(?i)' + unit.search)}) THEN {q('(?=.*(' + unit.search + '))')} ELSE '' END"


def sql_regex(table: str, text: str, keep: str, rules: MeasureRules = RULES) -> str:
    """SELECT keep and the whole expression of text."""
    columns, names = [], []
    for m in rules.for_regexes():
        for u in sorted(m.units, key=lambda u: u.weight):
            names.append((m, u, f"u{len(names)}"))
            columns.append(f"{sql_unit_regex(text, m, u)} AS {names[-1][2]}")
    excluded = []
    for m in rules.for_regexes():
        if m.exclude:
            none = " AND ".join(f"{n} = ''" for mm, _, n in names if mm is m)
            excluded.append(f"CASE WHEN {none} THEN {q(measures.exclusion_pattern(m))} ELSE '' END")
    return f"SELECT {keep}, {' || '.join([*excluded, *[n for _, _, n in names]])} AS regex FROM (SELECT {keep}, {', '.join(columns)} FROM {table})"


MG = next((m, u) for m in RULES.measures for u in m.units if u.name == "Грамм")
RED = next((m, u) for m in RULES.measures for u in m.units if u.name == "Цвет Красный")
WEIGHT = MG[0]


@query(f"SELECT p_partkey, array_to_string({sql_matches('name', MG[1])}, '|') AS found FROM {CATALOG_SQL}")
def m1_unit_matches(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("p_partkey", F.array_join(measures.unit_matches("name", MG[1]), "|").alias("found"))


@query(f"SELECT p_partkey, {sql_numeric_regex('name', *MG)} AS regex FROM {CATALOG_SQL}")
def m2_m4_numeric_regex(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("p_partkey", measures.numeric_unit_regex("name", MG[1], MG[0].allied(MG[1])).alias("regex"))


@query(f"SELECT p_partkey, {sql_unit_regex('name', *RED)} AS regex FROM {CATALOG_SQL}")
def m3_string_regex(spark, sf_dir):
    return inputs.catalog(spark, sf_dir).select("p_partkey", measures.string_unit_regex("name", RED[1]).alias("regex"))


QUANTITY = next(m for m in RULES.measures if m.exclude)


@query(f"SELECT p_partkey, CASE WHEN {' AND '.join(f'len({sql_matches("name", u)}) = 0' for u in QUANTITY.units)} THEN {q(measures.exclusion_pattern(QUANTITY))} ELSE '' END AS regex FROM {CATALOG_SQL}")
def m5_exclusion(spark, sf_dir):
    units = [measures.unit_regex("name", QUANTITY, u) for u in QUANTITY.units]
    return inputs.catalog(spark, sf_dir).select("p_partkey", measures.exclusion_regex(QUANTITY, units).alias("regex"))


@query(f"SELECT p_partkey, {' || '.join(sql_unit_regex('name', WEIGHT, u) for u in WEIGHT.units)} AS regex FROM {CATALOG_SQL}")
def m6_one_measure(spark, sf_dir):
    return measures.extract_measure(inputs.catalog(spark, sf_dir), "name", WEIGHT, "regex").select("p_partkey", "regex")


@query(sql_regex(CATALOG_SQL, "name", "p_partkey"))
def m7_all_measures(spark, sf_dir):
    return measures.extract_measures(inputs.catalog(spark, sf_dir), "name", RULES, regex_col="regex").select("p_partkey", "regex")


def sql_sizes() -> str:
    n = r"(\d*[.,]?\d+)"
    three, two = q(rf"{n}\D+{n}\D+{n}"), q(rf"{n}\D+{n}")
    values = f"CASE WHEN regexp_matches(size_name, {three}) THEN [regexp_extract(size_name, {three}, 1), regexp_extract(size_name, {three}, 2), regexp_extract(size_name, {three}, 3)] WHEN regexp_matches(size_name, {two}) THEN [regexp_extract(size_name, {two}, 1), regexp_extract(size_name, {two}, 2)] END"
    step = lambda f: f"'\\D' || array_to_string(list_transform(v, lambda x: {sql_plain(f'CAST(x AS DECIMAL(17,8)) * CAST({f} AS DECIMAL(20,9))')}), '\\D+') || '\\D'"
    return f"SELECT p_partkey, CASE WHEN v IS NULL THEN '' ELSE '(?=.*(' || {step('0.1')} || '|' || {step('1')} || '|' || {step('10')} || '))' END AS sizes FROM (SELECT p_partkey, {values} AS v FROM {CATALOG_SQL})"


@query(sql_sizes())
def m8_sizes(spark, sf_dir):
    return measures.extract_sizes(inputs.catalog(spark, sf_dir), "size_name", name="sizes").select("p_partkey", "sizes")


BODIES_SQL = r"list_transform(regexp_extract_all(regex, '\(\?=\.\*.*?\)\)+'), lambda b: regexp_replace(regexp_replace(b, '^\(\?=\.\*\(', ''), '\)\)$', ''))"


@query(f"SELECT p_partkey, array_to_string({BODIES_SQL}, '&') AS bodies FROM ({sql_regex(CATALOG_SQL, 'name', 'p_partkey')})")
def m9_parse_regex(spark, sf_dir):
    df = measures.extract_measures(inputs.catalog(spark, sf_dir), "name", RULES, regex_col="regex")
    return df.select("p_partkey", F.array_join(measures.parse_regex("regex"), "&").alias("bodies"))


@query(f"SELECT p_partkey, list_reduce(list_prepend(coalesce(name, '') || ' ', {BODIES_SQL}), lambda t, b: regexp_replace(t, '(?i)' || b, '', 'g')) AS stripped FROM ({sql_regex(CATALOG_SQL, 'name', 'p_partkey, name')})")
def m10_strip(spark, sf_dir):
    df = measures.extract_measures(inputs.catalog(spark, sf_dir), "name", RULES, regex_col="regex")
    return measures.strip_by_regex(df, "name", "regex", "stripped").select("p_partkey", "stripped")


@query(
    f"SELECT {KEYS}, coalesce(list_bool_and(list_transform({BODIES_SQL}, lambda b: regexp_matches('  ' || source || '  ', '(?i)' || b))), true)"
    rf" AND NOT (starts_with(regex, '^') AND regexp_matches('  ' || source || '  ', {re2('(?i)' + measures.exclusion_pattern(QUANTITY)[len(measures.CARET_EXCLUSION) : -2])})) AS matched"
    f" FROM ({sql_regex(PAIRS_SQL, 'client', KEYS + ', source')})"
)
def m11_match(spark, sf_dir):
    return measures.match_names(inputs.pairs(spark, sf_dir), "client", "source", RULES).select(*PAIR_KEYS, "matched")


# All names against all expressions: SQL tries each body on each name, all names being one text (so that a body is compiled once).
MATCH_SQL = f"""WITH c AS (SELECT p_partkey, name, regex FROM ({sql_regex(CATALOG_SQL, 'name', 'p_partkey, name')})),
 r AS (SELECT DISTINCT regex, list_distinct({BODIES_SQL}) AS bodies, starts_with(regex, '^') AS excludes FROM c),
 n AS (SELECT name, row_number() OVER (ORDER BY name) AS i, count(*) AS k, sum(p_partkey) AS s, regexp_matches('  ' || name || '  ', {re2('(?i)' + measures.exclusion_pattern(QUANTITY)[len(measures.CARET_EXCLUSION) : -2])}) AS excluded FROM c GROUP BY name),
 b AS (SELECT DISTINCT unnest(bodies) AS body FROM r),
 h AS (SELECT string_agg('§' || i || chr(9) || '  ' || name || '  ', '') || '§' AS every FROM n),
 f AS (SELECT body, CAST(unnest(regexp_extract_all(every, '(?i)§([0-9]+)' || chr(9) || '[^§]*?(?:' || body || ')', 1)) AS BIGINT) AS i FROM b, h),
 t AS (SELECT body, name FROM f JOIN n USING (i)),
 m AS (SELECT regex, name FROM (SELECT regex, unnest(bodies) AS body, len(bodies) AS k FROM r) JOIN t USING (body) GROUP BY regex, name, k HAVING count(*) = k
  UNION ALL SELECT regex, name FROM r, n WHERE len(bodies) = 0),
 g AS (SELECT regex, sum(k) AS n_matched, sum(s) AS matched_sum FROM m JOIN n USING (name) JOIN r USING (regex) WHERE NOT (excludes AND excluded) GROUP BY regex)
 SELECT p_partkey, CAST(coalesce(n_matched, 0) AS BIGINT) AS n_matched, CAST(coalesce(matched_sum, 0) AS BIGINT) AS matched_sum FROM c LEFT JOIN g USING (regex)"""


@query(MATCH_SQL)
def m11_match_catalogue(spark, sf_dir):
    """For each part the parts whose names satisfy its expression: how many, and the sum of their keys."""
    parts = inputs.catalog(spark, sf_dir)
    found = match.match_catalogue(parts, "name", parts, "name", RULES)
    sources = parts.groupBy(F.col("name").alias("source")).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s"))
    totals = found.pairs.join(sources, "source").groupBy("regex").agg(F.sum("n").alias("n_matched"), F.sum("s").alias("matched_sum"))
    own = found.members.join(totals, "regex", "left").select(F.col("client").alias("name"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_matched", "matched_sum")])
    return parts.join(own, "name").select("p_partkey", "n_matched", "matched_sum")


# Features.
def sql_features(side: str, key: str) -> str:
    """A chain of selects: each step finds a unit's values and blanks what it matched."""
    sql = f"SELECT {key}, '  ' || coalesce({side}, '') || '   ' AS t FROM src"
    columns: list[tuple[Measure, str]] = []
    for m in RULES.for_features():
        for pattern, group, value in sql_steps(m):
            name = f"f{len(columns)}"
            columns.append((m, name))
            kept = ", ".join(n for _, n in columns[:-1])
            found = f"list_transform(regexp_extract_all(t, {re2('(?i)' + pattern)}, {group}), lambda m: {value})"
            sql = f"SELECT {key}, {kept + ', ' if kept else ''}{found} AS {name}, regexp_replace(t, {re2(pattern)}, '  ', 'g') AS t FROM ({sql})"
    sets = []
    for k, m in enumerate(RULES.for_features()):
        own = [n for mm, n in columns if mm is m]
        whole = own[0]
        for n in own[1:]:
            whole = f"list_concat({whole}, {n})"
        sets.append(f"list_sort(list_distinct({whole})) AS s{k}")
    return f"SELECT {key}, {', '.join(sets)} FROM ({sql})"


def sql_steps(m: Measure) -> list[tuple[str, int, str]]:
    number = lambda p, n=r"\d+[.,]?\d*": f"CAST(replace(regexp_extract({p}, {q(n)}), ',', '.') AS DECIMAL(20,8))"
    if m.kind == "numeric":
        return [(u.search, u.group, sql_plain(f"{number('m')} * CAST({u.weight} AS DECIMAL(11,0))")) for u in m.units]
    if m.kind == "string":
        return [(u.search, 0, q(u.name)) for u in m.units]
    if m.name == "Complex Dimension":  # the driver's names hold no dimension: only that is compared
        return [(features.DIMENSION, 0, "m")]
    return [(features.CONCENTRATION, 0, "m"), (features.PERCENT, 0, "m")]


def sql_validation(columns: str) -> str:
    agree = " AND ".join(f"c.s{k} = s.s{k}" for k in range(len(RULES.for_features())))
    return f"""WITH p AS (SELECT {KEYS}, client, source FROM {PAIRS_SQL}),
 names AS (SELECT client AS name FROM p UNION SELECT source FROM p), src AS (SELECT name FROM names),
 f AS ({sql_features('name', 'name')})
 SELECT {columns.format(agree=agree)} FROM p JOIN f c ON p.client = c.name JOIN f s ON p.source = s.name"""


@query(sql_validation(f"{KEYS}, CASE WHEN {{agree}} THEN 1 ELSE 0 END AS decision"))
def f5_f8_validate_features(spark, sf_dir):
    decided = features.validate_names(inputs.pairs(spark, sf_dir), "client", "source", RULES)
    return decided.select(*PAIR_KEYS, F.col("features validation").alias("decision"))


ONE = lambda kind: next(m for m in RULES.measures if m.kind == kind)
GRAM = MG[1]


@query(f"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('  ' || name || '   ', {re2('(?i)' + GRAM.search)}), lambda m: {sql_steps(MG[0])[MG[0].units.index(GRAM)][2]}), '|') AS canon FROM {CATALOG_SQL}")
def f1_numeric_features(spark, sf_dir):
    text = F.concat(F.lit("  "), F.col("name"), F.lit("   "))
    found = features.numeric_features(text, MG[0], GRAM)
    return inputs.catalog(spark, sf_dir).select("p_partkey", F.array_join(F.transform(found, lambda f: f["canon"]), "|").alias("canon"))


@query(f"SELECT p_partkey, array_to_string(list_transform(regexp_extract_all('  ' || name || '   ', {re2('(?i)' + RED[1].search)}), lambda m: {q(RED[1].name)}), '|') AS canon FROM {CATALOG_SQL}")
def f2_string_features(spark, sf_dir):
    text = F.concat(F.lit("  "), F.col("name"), F.lit("   "))
    return inputs.catalog(spark, sf_dir).select("p_partkey", F.array_join(F.transform(features.string_features(text, *RED), lambda f: f["canon"]), "|").alias("canon"))


@query(
    "SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_transform(regexp_split_to_array(trim(substr(size_name, length(p_name) + 2)), 'x'), lambda x: CAST(x AS DECIMAL(17,8)) * CAST(0.01 AS DECIMAL(20,9))))), lambda v: "
    + sql_plain("v")
    + f"), 'x') AS canon FROM {CATALOG_SQL}"
)
def f3_dimensions(spark, sf_dir):
    found = features.dimension_features(F.col("size_name"))
    return inputs.catalog(spark, sf_dir).select("p_partkey", F.array_join(F.transform(found, lambda f: f["canon"]), "|").alias("canon"))


@query(f"SELECT p_partkey, {sql_plain('CAST(CAST(p_size AS DECIMAL(20,6)) * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(24,8))')} AS canon FROM part")
def f4_concentrations(spark, sf_dir):
    text = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("мг/5мл "))
    found = features.concentration_features(text, False)
    return inputs.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda f: f["canon"]), "|").alias("canon"))


# Dimensions in several shapes: units on some sides, both scripts' signs, two and three values; a value without a unit has the
# last one stated, or centimetres. SQL states the values that each shape means.
A, B, C = "CAST(p_size AS VARCHAR(10))", "CAST(p_partkey % 50 + 1 AS VARCHAR(10))", "CAST(p_partkey % 7 + 1 AS VARCHAR(10))"
SHAPES = f"CASE p_partkey % 5 WHEN 0 THEN {A} || 'см x ' || {B} || 'мм' WHEN 1 THEN {A} || '.5м на ' || {B} WHEN 2 THEN {A} || 'х' || {B} || 'х' || {C} WHEN 3 THEN {A} || 'mm x ' || {B} || 'м x ' || {C} ELSE {A} || ' cm на ' || {B} || ' cm' END"
SHAPE_VALUES = "CASE p_partkey % 5 WHEN 0 THEN [p_size * 0.01, b * 0.001] WHEN 1 THEN [p_size + 0.5, b * 1.0] WHEN 2 THEN [p_size * 0.01, b * 0.01, c * 0.01] WHEN 3 THEN [p_size * 0.001, b * 1.0, c * 1.0] ELSE [p_size * 0.01, b * 0.01] END"


@query(
    f"SELECT p_partkey, array_to_string(list_transform(list_sort(list_distinct(list_transform({SHAPE_VALUES}, lambda v: CAST(v AS DECIMAL(20,6))))), lambda v: {sql_plain('v')}), 'x') AS canon"
    " FROM (SELECT *, p_partkey % 50 + 1 AS b, p_partkey % 7 + 1 AS c FROM part)"
)
def f3_dimension_shapes(spark, sf_dir):
    found = features.dimension_features(F.concat(F.col("p_name"), F.lit(" "), F.expr(SHAPES), F.lit(" ")))
    return inputs.table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda f: f["canon"]), "|").alias("canon"))


# Concentrations: percent, mass over a volume without a number, over one with a number, in several units.
BOTTOM = "(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 5 END)"
STRENGTHS = f"CASE p_partkey % 5 WHEN 0 THEN {A} || ',5 %' WHEN 1 THEN {A} || 'г/л' WHEN 2 THEN {A} || ' мкг/мл' WHEN 3 THEN {A} || 'мг/' || CAST({BOTTOM} AS VARCHAR(10)) || ' мл' ELSE {A} || 'г' || chr(92) || CAST({BOTTOM} AS VARCHAR(10)) || 'л' END"
STRENGTH_VALUES = f"CASE p_partkey % 5 WHEN 1 THEN p_size * 0.1 WHEN 2 THEN p_size * 0.0001 WHEN 3 THEN p_size * 0.1 / {BOTTOM} ELSE p_size * 0.1 / {BOTTOM} END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE {sql_plain(f'CAST({STRENGTH_VALUES} AS DECIMAL(24,8))')} END AS numeric_canon, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) || '.5' ELSE '' END AS percent_canon FROM part")
def f4_concentration_shapes(spark, sf_dir):
    text = F.concat(F.col("p_name"), F.lit(" "), F.expr(STRENGTHS), F.lit(" "))
    shown = lambda percent: F.array_join(F.transform(features.concentration_features(text, percent), lambda f: f["canon"]), "|")
    return inputs.table(spark, sf_dir, "part").select("p_partkey", shown(False).alias("numeric_canon"), shown(True).alias("percent_canon"))


TOKENS_SQL = "list_sort(list_distinct(regexp_extract_all(lower({}), '[а-яa-z0-9][а-яa-z0-9-]+')))"


@query(
    f"SELECT {KEYS}, len(list_intersect(a, b)) = len(a) AND len(a) = len(b) AS strict, len(list_intersect(a, b)) = least(len(a), len(b)) AS modest, len(list_intersect(a, b)) = len(a) AS client, len(list_intersect(a, b)) = len(b) AS source, CASE WHEN len(a) = 0 AND len(b) = 0 THEN true WHEN len(a) = 0 OR len(b) = 0 THEN false END AS none"
    f" FROM (SELECT {KEYS}, {TOKENS_SQL.format('client')} AS a, {TOKENS_SQL.format('source')} AS b FROM {PAIRS_SQL})"
)
def f6_f7_compare_sets(spark, sf_dir):
    df = inputs.pairs(spark, sf_dir).select(*PAIR_KEYS, W.simple_tokens("client").alias("a"), W.simple_tokens("source").alias("b"))
    a, b = F.col("a"), F.col("b")
    return df.select(*PAIR_KEYS, *[features.compare_sets(a, b, m).alias(m) for m in ("strict", "modest", "client", "source")], features.not_found(a, b).alias("none"))


# Similarity.
SIM = load_similarity_rules()


@query("SELECT doc_id, regexp_replace(coalesce(text, ''), '''|\\|\"|/', '', 'g') AS clean FROM documents")
def s1_clean(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", similarity.clean_names("text").alias("clean"))


# The driver's names are in one script, so that ASCII boundaries do.
def sql_tokens(col: str) -> str:
    words = f"list_filter(regexp_extract_all({col}, '\\b[A-Za-z0-9]+\\b'), lambda w: regexp_matches(w, '[A-Za-z]') AND length(w) >= 2)"
    cls = "CASE WHEN regexp_matches(w, '^[A-Z0-9]+$') THEN 0 WHEN regexp_matches(w, '^[A-Z0-9]') THEN 1 ELSE 2 END"
    classes = [f"list_filter({words}, lambda w: {cls} = {c})" for c in (0, 1, 2)]
    low = f"list_transform(list_concat(list_concat({classes[0]}, {classes[1]}), {classes[2]}), lambda w: lower(w))"
    return f"list_filter({low}, lambda w, i: list_position({low}, w) = i)"


def values(col: str):
    return F.array_join(F.transform(col, lambda t: t["value"]), "|").alias(col)


def sides():
    return {"l": similarity.clean_names("client"), "r": similarity.clean_names("source")}


@query(f"SELECT {KEYS}, array_to_string({sql_tokens('client')}, '|') AS l, array_to_string({sql_tokens('source')}, '|') AS r FROM {PAIRS_SQL}")
def s2_s3_tokens(spark, sf_dir):
    return similarity.with_tokens(inputs.pairs(spark, sf_dir), sides(), SIM).select(*PAIR_KEYS, values("l"), values("r"))


# Words with symbols inside, between blanks: eight searches, each of which deletes what it finds.
STAGED = SimilarityRules(symbols="#-", custom_boundary=" ")
STAGED_TEXT = "p_brand || ' ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' ' || name || '-X ' || p_type || ' ' || size_name"
CLASS_CASES = (("caps", True), ("capital", True), ("any", True), ("any", False))


def sql_staged(text: str) -> str:
    sql, names = f"SELECT p_partkey, {text} AS t FROM (SELECT *, {inputs.NAME} AS name, {inputs.SIZES} AS size_name FROM part)", []
    for language in ("russian", "english"):
        for case, letters in CLASS_CASES:
            rule = W.WordRule(language, case, True, STAGED.symbols, custom_boundary=STAGED.custom_boundary)
            keep = f"regexp_matches(lower(w), '[{rule.letters}]')" if letters else "true"
            names.append(f"w{len(names)}")
            found = f"list_filter(regexp_extract_all(s, {re2(rule.bounded)}, 1), lambda w: {keep}) AS {names[-1]}"
            left = f"regexp_replace(regexp_replace(s, {re2(rule.bounded)}, ' ', 'g'), ' +', ' ', 'g') AS t"
            sql = f"SELECT p_partkey, {', '.join([*names[:-1], found, left])} FROM (SELECT *, replace('  ' || t || '  ', ' ', '   ') AS s FROM ({sql}))"
    low = f"list_filter(list_transform({'list_concat(' * (len(names) - 1)}{names[0]}{''.join(f', {n})' for n in names[1:])}, lambda w: lower(w)), lambda w: length(w) >= 2)"
    return f"SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') AS tokens FROM (SELECT p_partkey, {low} AS w FROM ({sql}))"


@query(sql_staged(STAGED_TEXT))
def s2_staged_tokens(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").withColumns({"name": F.expr(inputs.NAME), "size_name": F.expr(inputs.SIZES)})
    return similarity.with_tokens(parts, {"tokens": F.expr(STAGED_TEXT)}, STAGED).select("p_partkey", values("tokens"))


@query()
def s4_align(spark, sf_dir):
    def aligned(names):
        tokens = written(similarity.with_tokens(names, sides(), SIM), "tokens")
        return similarity.align_tokens(tokens, "l", "r").select("client", "source", values("l"), values("r"))

    return similarity.once_for_names(inputs.pairs(spark, sf_dir), "client", "source", aligned).select(*PAIR_KEYS, "l", "r")


RATES_SQL = f"""WITH p AS (SELECT {KEYS}, {sql_tokens('client')} AS a, {sql_tokens('source')} AS b FROM {PAIRS_SQL}),
 c AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(a, b)) AS token FROM p) GROUP BY token),
 r AS (SELECT token, n, CASE WHEN n <= 2 THEN 0.0 ELSE 1.0 END * greatest(0.1, least(0.2, {{rate}})) AS rate FROM c)"""


@query(RATES_SQL.format(rate="1.0 / sqrt(n)") + " SELECT token, n, round(rate, 9) AS rate FROM r")
def s5_token_rates(spark, sf_dir):
    names = similarity.name_counts(inputs.pairs(spark, sf_dir), ["client", "source"])
    tokens = similarity.with_tokens(spread(names, "name"), {"tokens": similarity.clean_names("name")}, SIM)
    # Written once: they are read for the largest count and for the rates.
    counts = written(similarity.token_counts(tokens, ["tokens"], F.col("n")), "token-counts")
    return similarity.token_rates(counts, SIM).select("token", "n", F.round("rate", 9).alias("rate"))


FUNCTIONS_SQL = {"default": "n", "sqrt2": "sqrt(n)", "sqrt3": "pow(n, 0.33)", "sqrt4": "pow(n, 0.25)", "log": "log10(n)", "parabaloid": "coalesce(1.0 / nullif(-4.0 * (n / m) * (n / m) + 4.0 * (n / m), 0), 0)"}


@query("SELECT l_partkey, " + ", ".join(f"round({v}, 6) AS r_{k}" for k, v in FUNCTIONS_SQL.items()) + " FROM (SELECT l_partkey, CAST(count(*) AS DOUBLE) AS n, CAST(max(count(*)) OVER () AS DOUBLE) AS m FROM lineitem GROUP BY l_partkey)")
def s6_rate_functions(spark, sf_dir):
    counts = inputs.table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    both = counts.crossJoin(F.broadcast(counts.agg(F.max("n").alias("m"))))
    return both.select("l_partkey", *[F.round(similarity.rate_expr(k, F.col("n"), F.col("m")).cast("double"), 6).alias(f"r_{k}") for k in FUNCTIONS_SQL])


MARKS_SQL = (
    RATES_SQL.format(rate="1.0 / sqrt(n)")
    + f""", t AS (SELECT {KEYS}, unnest(list_distinct(list_concat(a, b))) AS token, a, b FROM p),
 w AS (SELECT {KEYS}, rate, list_contains(a, token) AS l, list_contains(b, token) AS r FROM t JOIN r USING (token)),
 s AS (SELECT {KEYS}, sum(CASE WHEN l AND r THEN rate ELSE 0 END) AS b, sum(rate) AS u, sum(CASE WHEN l THEN rate ELSE 0 END) AS c, sum(CASE WHEN r THEN rate ELSE 0 END) AS o FROM w GROUP BY {KEYS}),
 m AS (SELECT {KEYS}, coalesce(b / nullif(u, 0), 0) AS um, coalesce(b / nullif(c, 0), 0) AS cm, coalesce(b / nullif(o, 0), 0) AS sm FROM p LEFT JOIN s USING ({KEYS}))
 SELECT {KEYS}, round(coalesce(um, 0), 6) AS union_mark, round(coalesce(cm, 0), 6) AS client_mark, round(coalesce(sm, 0), 6) AS source_mark, CASE WHEN coalesce(um, 0) >= 0.5 THEN 1 ELSE 0 END AS decision FROM m"""
).replace("coalesce(b / nullif(u, 0), 0) AS um", "coalesce(s.b / nullif(u, 0), 0) AS um").replace("coalesce(b / nullif(c, 0), 0)", "coalesce(s.b / nullif(c, 0), 0)").replace("coalesce(b / nullif(o, 0), 0)", "coalesce(s.b / nullif(o, 0), 0)")


def marks(spark: SparkSession, sf_dir: str, fuzzy: float) -> DataFrame:
    out = similarity.validate_similarity(inputs.pairs(spark, sf_dir), "client", "source", SIM, fuzzy)
    return out.select(*PAIR_KEYS, *[F.round(c, 6).alias(c) for c in ("union_mark", "client_mark", "source_mark")], F.col("fuzzy validation").alias("decision"))


@query(MARKS_SQL)
def s7_s8_exact_marks(spark, sf_dir):
    return marks(spark, sf_dir, 1.0)


@query()
def s9_similarity(spark, sf_dir):
    return marks(spark, sf_dir, 0.75)


# Cross words, against all pairs of rows.
CROSS_SQL = f"""WITH c AS (SELECT p_partkey, name || ' ' AS text, {TOKENS_SQL.format('name')} AS t FROM {CATALOG_SQL}),
 d AS (SELECT a.p_partkey AS ai, b.p_partkey AS bi, a.text AS a_text, b.text AS b_text, list_filter(a.t, lambda x: NOT list_contains(b.t, x)) AS ab, list_filter(b.t, lambda x: NOT list_contains(a.t, x)) AS ba
  FROM c a JOIN c b ON a.p_partkey <> b.p_partkey AND abs(len(a.t) - len(b.t)) <= 1 AND len(list_intersect(a.t, b.t)) >= greatest(len(a.t), len(b.t)) - 1),
 w AS (SELECT ai AS id, 'minus' AS k, ba[1] AS w FROM d WHERE len(ab) = 0 AND len(ba) = 1 AND NOT contains(lower(a_text), ba[1])
  UNION SELECT bi, 'plus', ba[1] FROM d WHERE len(ab) = 0 AND len(ba) = 1 AND contains(lower(b_text), ba[1])
  UNION SELECT ai, 'intersect', ab[1] FROM d WHERE len(ab) = 1 AND len(ba) = 1 AND contains(lower(a_text), ab[1]))
 SELECT p_partkey, coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM w WHERE id = p_partkey AND k = 'minus'), '') AS cross_minus,
  coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM w WHERE id = p_partkey AND k = 'plus'), '') AS cross_plus,
  coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM w WHERE id = p_partkey AND k = 'intersect'), '') AS cross_intersect FROM c"""


@query(CROSS_SQL)
def x1_x2_cross_words(spark, sf_dir):
    return cross.cross_words(inputs.catalog(spark, sf_dir), "p_partkey", "name").select("p_partkey", "cross_minus", "cross_plus", "cross_intersect")


@query("SELECT p_partkey, row_number() OVER (ORDER BY name, p_partkey) - 1 AS pos FROM " + CATALOG_SQL)
def x3_positions(spark, sf_dir):
    return cross.positions(inputs.catalog(spark, sf_dir), "p_partkey", "name")


@query()
def x4_cross_words_job(spark, sf_dir):
    """The shipped job: measures stripped, words of both scripts of three letters or more, stemmed, 250 neighbours."""
    rules = [W.WordRule(lang, with_numbers=True, min_length=3, stem=True, check_letters=True) for lang in ("russian", "english")]
    df = measures.extract_measures(inputs.catalog(spark, sf_dir), "name", RULES)
    return cross.cross_words(df, "p_partkey", "name", rules, "Regex", 250).select("p_partkey", "cross_minus", "cross_plus", "cross_intersect")


# Offers.
OFFERS_SQL = f"(SELECT {KEYS}, p_name AS product, source AS row_text FROM {PAIRS_SQL})"
CHECKS_SQL = f"""SELECT {KEYS}, product, row_text,
 CASE WHEN regexp_matches(row_text, '(?i)' || trim(minus_words, '|')) THEN '0' ELSE '1' END AS m,
 CASE WHEN list_bool_and(list_transform(string_split(plus_words, '|'), lambda w: regexp_matches(row_text, '(?i)' || w))) THEN '1' ELSE '0' END AS p,
 CASE WHEN regexp_matches(row_text, '(?i)' || split_part(product, ' ', 1)) AND regexp_matches(row_text, '(?i)[0-9] *(?:g|kg|mg|l|ml)') THEN '1' ELSE '0' END AS x,
 plus_words, minus_words FROM {OFFERS_SQL} JOIN {RULES_SQL} USING (product)"""


@query(f"SELECT {KEYS}, product, plus_words, minus_words FROM {OFFERS_SQL} LEFT JOIN {RULES_SQL} USING (product)")
def r1_join_rules(spark, sf_dir):
    return offers.join_rules(inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir)).select(*PAIR_KEYS, "product", "plus_words", "minus_words")


@query(f"SELECT {KEYS}, m || p || x AS reason, CASE WHEN m || p || x = '111' THEN 1 ELSE 0 END AS validation_mark FROM ({CHECKS_SQL})")
def r2_r5_validate_offers(spark, sf_dir):
    return offers.validate_offers(inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir)).select(*PAIR_KEYS, "reason", "validation_mark")


HITS_SQL = f"""SELECT {KEYS}, list_sum(list_transform(string_split(plus_words, '|'), lambda w: CASE WHEN regexp_matches(row_text, '(?i)' || w) THEN 1 ELSE 0 END)) AS hp, len(string_split(plus_words, '|')) AS np,
 list_sum(list_transform(string_split(minus_words, '|'), lambda w: CASE WHEN regexp_matches(row_text, '(?i)' || w) THEN 0 ELSE 1 END)) AS hm, len(string_split(minus_words, '|')) AS nm,
 CASE WHEN regexp_matches(row_text, '(?i)' || split_part(product, ' ', 1)) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(row_text, '(?i)[0-9] *(?:g|kg|mg|l|ml)') THEN 1 ELSE 0 END AS hx, 2 AS nx FROM {OFFERS_SQL} JOIN {RULES_SQL} USING (product)"""


@query(f"SELECT {KEYS}, round((hp * 2.0 + hm + hx) / (np * 2.0 + nm + nx), 6) AS validation_mark FROM ({HITS_SQL})")
def r6_score_offers(spark, sf_dir):
    scored = offers.score_offers(inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir), {"plus": 2.0})
    return scored.select(*PAIR_KEYS, F.round("validation_mark", 6).alias("validation_mark"))


@query()
def r7_fuzzy_score(spark, sf_dir):
    scored = offers.score_offers(inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir), fuzzy=frozenset({"plus"}))
    return scored.select(*PAIR_KEYS, F.round("validation_mark", 6).alias("validation_mark"))


@query(f"SELECT {KEYS}, CASE WHEN hp < np OR hx < nx THEN 0.0 ELSE round(CAST(hp + hm + hx AS DOUBLE) / (np + nm + nx), 6) END AS validation_mark FROM ({HITS_SQL})")
def r8_strict_score(spark, sf_dir):
    scored = offers.score_offers(inputs.offers(spark, sf_dir), inputs.rules(spark, sf_dir), strict=frozenset({"plus", "regex"}))
    return scored.select(*PAIR_KEYS, F.round("validation_mark", 6).alias("validation_mark"))


# Sources. Rules as a user's file has them, and what they mean: the SQL is written from the latter.
def json_unit(name: str, symbol: str, weight: int, **other) -> dict:
    usual = {"prefix": "common", "postfix": "common", "max_count": "common", "search_mode": "behind", "use_it": True}
    return {"unit_name": name, "symbol": symbol, "relative_weight": weight} | usual | other


def json_measure(name: str, units: list[dict], **other) -> dict:
    data = {"common_prefix": "[^0-9]", "common_postfix": "", "common_max_count": 2, "special_value_search": None, "units": units}
    return {"measure_name": name, "SemantiX": {"merge_mode": "1", "exclude_rx": False, "use_it": True} | other, "FeatureFlow": {"use_it": False}, "measure_data": data}


JSON_RULES = {
    "numeric_measures": {
        "use_it": True,
        "measures": [
            json_measure("Weight", [json_unit("Gram", "gr?", 1, postfix="[^a-z]"), json_unit("Kilogram", "kg", 1000, max_count=1), json_unit("Ton", "t", 1000000, use_it=False)], merge_mode="overall"),
            json_measure("Volume", [json_unit("Millilitre", "ml", 1), json_unit("Litre", "l", 1000, postfix="[^a-z]")], merge_mode="none"),
            json_measure("Memory", [json_unit("Gigabyte", "gb", 1)], use_it=False),
        ],
    },
    "string_measures": {"use_it": True, "measures": [json_measure("Colour", [json_unit("Red", "red", 1), json_unit("Blue", "blue", 1)])]},
}
READ_RULES = MeasureRules((
    Measure("Weight", "numeric", (Unit("Gram", "gr?", 1, "[^0-9]", "[^a-z]", "behind", 2), Unit("Kilogram", "kg", 1000, "[^0-9]", "", "behind", 1)), "overall", in_features=False),
    Measure("Volume", "numeric", (Unit("Millilitre", "ml", 1, "[^0-9]", "", "behind", 2), Unit("Litre", "l", 1000, "[^0-9]", "[^a-z]", "behind", 2)), "none", in_features=False),
    Measure("Colour", "string", (Unit("Red", "red", 1, "[^0-9]", "", "behind", 2, ""), Unit("Blue", "blue", 1, "[^0-9]", "", "behind", 2, "")), "1", in_features=False),
))


@query(sql_regex(CATALOG_SQL, "name", "p_partkey", READ_RULES))
def io3_rules(spark, sf_dir):
    """Expressions by rules from JSON: common values, own ones, units and measures that are switched off."""
    rules = load_measure_rules(json.dumps(JSON_RULES))
    return measures.extract_measures(inputs.catalog(spark, sf_dir), "name", rules, regex_col="regex").select("p_partkey", "regex")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand FROM part")
def io1_io2_csv(spark, sf_dir):
    from wareknit.plans.scratch import scratch

    path = scratch(spark, "parts") + ".csv"
    write_result(inputs.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), path, "csv")
    return read_products(spark, path, ["p_partkey", "p_name"]).select("p_partkey", "p_name", "p_brand")
