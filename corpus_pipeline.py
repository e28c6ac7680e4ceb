"""From documents to token ids: toxic texts go, texts in no known language go, one of each group of near duplicates
stays, texts with benchmark passages go, and what is left is encoded.

Near duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, over any number of
links; op5's groups (three-word shingles, fingerprints within 3 bits) hold only few of them.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again. Stages keep
rows and columns as they are, but for the rows that go. In all of them a null text is an empty one, rows without an id are
rows like any other, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareknit.llm import decontam, langid, pieces, simhash, toxicity
from wareknit.llm.common import default_tokenizer, free_name, saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score says toxic go. Repeated rows are scored alike; an empty text has a score too, and stays as long as
    fewer than half of the labels say toxic; without labels nothing goes."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(F.col("text"), model) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go that have no letter (so do null and empty texts) or share no n-gram with any language. Repeated rows go or
    stay together; without a row that languages can be learned from, all go."""
    guess = free_name(docs, "guess")
    known = docs.withColumn(guess, langid.predicted(F.col("text"), langid.learn_from_documents(docs)))
    return known.filter((F.col(f"{guess}.lang") != "und") & (F.col(f"{guess}.score") > 0)).drop(guess)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with similar five-word shingles stays, that with the smallest id."""
    return simhash.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go of whose words a twentieth or more lies in benchmark passages. A text without words has no hits and stays;
    repeated rows go or stay together; an empty benchmark takes nothing."""
    hits = free_name(docs, "hits")
    found = decontam.with_hits(docs, table(spark, sf_dir, "benchmark"), hits)
    return found.filter(~decontam.contaminated(hits)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text with the end id, their number, and the SHA-256 of the text that they decode to. An
    empty text is the end id alone; repeated rows each have a row."""
    coded = pieces.encode_documents(docs, default_tokenizer("piece_bpe_32k.model"))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: The stages learn from the rows they get and encode with a vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
