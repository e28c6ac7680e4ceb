"""The pipeline's stages on small tables, each against what its operator says of its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import __spark_entry__ as entry
from tests.llm.test_near_duplicates import brute_pairs, roots
from wareknit.llm.common import saved


def test_stages(spark, sf_dir):
    """Each stage's output is written and read, as run() does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, before, sf_dir), name)
        if name != "encoding":
            assert out.columns == docs.columns
            assert out.exceptAll(before).count() == 0
        assert 0 < out.count() <= before.count()
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in out.collect()} == roots([i for i, _ in texts], brute_pairs(texts))
        if name == "decontamination":
            assert corpus_pipeline.decontam.with_hits(out, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "h").filter(corpus_pipeline.decontam.contaminated("h")).count() == 0
        before = out
    assert set(before.columns) == {"doc_id", "ids", "n_tokens", "decoded_sha256"}
    assert entry.queries()["pipeline"](spark, sf_dir).count() == before.count()


def test_odd_rows(spark, sf_dir):
    rows = [(1, None), (2, ""), (3, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "x y z"), (5, "12 34"), (6, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("guess", "hits", "score", "ids")})
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, sf_dir)
            assert out.count() <= some.count()
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 3, 5, 6, None}


@pytest.mark.parametrize("name", [f"op{n}" for n in range(1, 14)])
def test_registered(spark, sf_dir, name):
    found = [q for q in entry.queries() if q.split("_")[0] == name]
    assert len(found) == 1
    assert entry.queries()[found[0]](spark, sf_dir).count() > 0
