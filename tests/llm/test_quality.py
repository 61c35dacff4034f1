import pytest

from lakeatlas.llm._common import table
from lakeatlas.llm.quality import classify, keep_good, rate_documents
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def rated(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    # the labels that the test knows are not those that the model learns from
    known = labels.where("doc_id % 2 = 0")
    return rate_documents(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()


def test_held_out_labels(rated):
    good = (rated["quality"] > 0) & (rated["toxic"] == 0)
    assert (rated["keep"][good]).mean() > 0.99
    assert (~rated["keep"][rated["quality"] == 0]).mean() > 0.97
    assert (~rated["keep"][rated["toxic"] > 0]).mean() >= 0.9


def test_ids_beyond_doubles(spark):
    rows = [(2**53 + 1, "plain words", "a", "en"), (None, "other words", "a", "en"), (2**53 + 3, "more of them", "b", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (rate_documents(df, none), keep_good(df, none)):
        assert {r.doc_id for r in got.collect()} == {2**53 + 1, None, 2**53 + 3}


def test_sparse_sites_keep_near_the_global_rate(spark):
    rows = [("big", "big/x", 3.0)] * 400 + [("big", "big/x", -3.0)] * 400 + [("bad", "bad/x", -3.0)] * 300 + [("good", "good/x", 3.0)] * 300 + [("one", "one/x", -3.0), ("good", "good/y", -3.0)]
    df = spark.createDataFrame([(h, p, q, 0.0) for h, p, q in rows], "host string, path string, _la_quality double, _la_toxic double")
    rate = {(r.host, r.path): r._la_rate for r in classify(df, "host", "path").groupBy("host", "path").agg(F.avg("_la_rate").alias("_la_rate")).collect()}
    assert rate["bad", "bad/x"] < rate["one", "one/x"] < rate["big", "big/x"] < rate["good", "good/x"]
    assert rate["one", "one/x"] > 0.2 and rate["good", "good/y"] > 0.4


def test_edges(spark):
    schema = "doc_id long, text string, source string, lang string, host int, path int, n int, s int"
    rows = [(1, None, "a", None), (2, "", None, "en"), (None, "some plain words here", None, None), (4, "some plain words here", "a", "en"), (4, "some plain words here", "a", "en"), (5, "word " * 300_000, "a", "en")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (4, None, 0), (1, 0, None)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = rate_documents(df, labels).collect()
        assert len(got) == 6 and {r.doc_id for r in got if not r.keep} == {1, 2}
    kept = keep_good(df, none)
    assert kept.columns == df.columns and kept.count() == 4
    assert rate_documents(df.limit(0), none).count() == 0 and keep_good(df.limit(0), odd).count() == 0
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert rate_documents(df.withColumn("n", F.lit(1)), labels).count() == 6
