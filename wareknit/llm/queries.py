"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import CONTROL, END, JOIN, START
from .common import default_tokenizer, table, whole_text


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, loss_text, read_turns

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_conversations(turns.unionByName(extra)).select("conv_id", "formatted", loss_text(F.col("pieces")).alias("loss"), read_turns(F.col("formatted")).alias("turns"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, learn_from_documents, predicted

    docs = table(spark, sf_dir, "documents")
    guess = predicted(F.col("text"), learn_from_documents(docs))
    return docs.select("doc_id", held_out().alias("held_out"), guess.alias("g")).select("doc_id", "held_out", F.col("g.lang").alias("lang_pred"), "g.score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import count_tokens

    counts = count_tokens(table(spark, sf_dir, "documents"), default_tokenizer("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import fingerprint_groups, fingerprint_hex

    found = fingerprint_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_documents

    coded = encode_documents(table(spark, sf_dir, "documents"), default_tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_id_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfile import store_ids

    docs, tokenizer = table(spark, sf_dir, "documents"), default_tokenizer("byte_bpe_50k.json")
    return store_ids(docs, tokenizer, 2, ids=False, crc=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated, n_hit, with_hits

    found = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "hits")
    return found.select("doc_id", "hits").select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        n_hit("hits").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated("hits").alias("contaminated"),
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import read_shards, write_shards

    docs = table(spark, sf_dir, "documents")
    text = whole_text("text")
    return read_shards(docs, write_shards(docs, 16)).select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import learn, learnable, toxicity

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (~learnable()).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import drop_frequent_lines

    cut = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "cut")
    return cut.select("doc_id", "cut.n_lines", "cut.n_dropped", F.sha2("cut.kept", 256).alias("kept_sha256"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat, op2_neighbours, op3_language, op4_token_counts, op5_simhash, op6_pieces, op7_id_file, op8_decontamination, op9_shards, op10_toxicity, op11_lines, op12_lexical, op13_filters)
}

# The template's lengths follow from its control strings; an escape adds one character.
CHAT_SQL = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g')) AS text_chars,
  length(regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '([<\[])(\\*)({CONTROL})', '\1\\\2\3', 'g')) AS role_chars,
  coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS starts FROM t)
 SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(text_chars + CASE WHEN starts THEN {len(START)} + role_chars + 1 + {len(END)} + 1 ELSE {len(JOIN)} END) AS BIGINT) AS formatted_chars
 FROM e GROUP BY conv_id"""


LOWERED_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words_sql(table_name: str, key: str) -> str:
    lowered = LOWERED_SQL.format("coalesce(text, '')")
    return f"(SELECT {key}, regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_name})"


DECONTAMINATION_SQL = f"""WITH d AS {words_sql('documents', 'doc_id')},
 b AS (SELECT item_id, w, least(len(w), 13) AS k FROM {words_sql('benchmark', 'item_id')} WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
 dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
 h AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
 p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
 f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN p USING (doc_id) LEFT JOIN f USING (doc_id)"""

BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINES_SQL = f"""WITH l AS (SELECT doc_id, i, lines[i] AS line, {LOWERED_SQL.format(f'trim(lines[i], {BLANKS_SQL})')} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
 f AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
 k AS (SELECT doc_id, i, line, key IN (SELECT key FROM f) AS gone FROM l)
 SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id"""

TERMS_SQL = f"regexp_extract_all({LOWERED_SQL.format('coalesce(text, chr(0))')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
LEXICAL_SQL = f"""WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0),
 s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
 q AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
 r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id)
 SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10"""

FAILS_SQL = " UNION ALL ".join(f"SELECT '{f}' AS f" for f in "ABCDE")
AUDIT_SQL = f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
 w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
 d AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN labels USING (doc_id)),
 c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY part, fails),
 l AS ({FAILS_SQL}),
 o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
 s AS (SELECT filter_order, k AS step, filter_order[k] AS f, filter_order[1 : k - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS k)),
 r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS own, fails = f AS only_own,
  before <> '' AND len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND fails <> '' AS gone FROM s, c),
 x AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed, sum(n) FILTER (own AND gone) AS redundant,
  sum(n) FILTER (only_own) AS unique_fails, sum(good) FILTER (own AND NOT gone) AS good_lost, sum(toxic) FILTER (own AND NOT gone) AS toxic_lost FROM r GROUP BY ALL)
 SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM x"""

ORACLE_SQL: dict[str, str] = {"op1_chat": CHAT_SQL, "op8_decontamination": DECONTAMINATION_SQL, "op11_lines": LINES_SQL, "op12_lexical": LEXICAL_SQL, "op13_filters": AUDIT_SQL}
