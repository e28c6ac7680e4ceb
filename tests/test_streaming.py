"""Streams give what batches give."""

from wareknit.operators import features, measures, offers
from wareknit.plans.rules import shipped_rules
from wareknit.streaming import jobs


def test_streams(spark, tmp_path):
    schema = "pair_id long, client string, source string"
    rows = [(1, "Вес 1 кг", "Вес 1000 г"), (2, "a 5 мл", "b 6 мл"), (3, None, "red cup")]
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    catalog = spark.createDataFrame([("Вес 1 кг", "вес", "", "")], "product string, plus_words string, minus_words string, regex string")
    rules = shipped_rules()
    jobs_of = {
        "features": (lambda df: jobs.stream_features(df, "client", "source", rules), features.validate_features(batch, "client", "source", rules)),
        "measures": (lambda df: jobs.stream_measures(df, "client", rules), measures.extract_measures(batch, "client", rules)),
        "offers": (lambda df: jobs.stream_offers(df, catalog, "source"), offers.validate_offers(batch, catalog, "source", "client")),
    }
    for name, (run, want) in jobs_of.items():
        stream = jobs.read_stream(spark, f"{tmp_path}/in", schema)
        if name == "offers":
            stream = stream.withColumnRenamed("client", "product")
            want = want.withColumnRenamed("client", "product")
        jobs.write_stream(run(stream), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/{name}").select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
