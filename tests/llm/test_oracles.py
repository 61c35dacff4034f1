import duckdb
import pytest

from lakeatlas.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got.select(*order).collect()), key=str) == sorted(c.sql(f"SELECT {', '.join(order)} FROM ({ORACLES[name]})").fetchall(), key=str)


def test_mixing_sql_under_a_hot_source(spark):
    """As above where the exponent has to be found: half of the sources' documents are moved to one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'src0', source) AS source")
    from pyspark.sql import functions as F

    from lakeatlas.llm.oracles import mixing
    from lakeatlas.llm.temperature_mixing import mix_sources

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 'src0' ELSE source END AS source FROM '{SF}/documents.parquet'")
    want = c.sql(f"SELECT doc_id, source, tokens, block, place, weight FROM ({mixing(0.95, 4, 1)})").fetchall()
    got = mix_sources(docs, head_docs=50).withColumn("weight", F.round("weight", 6)).select("doc_id", "source", "tokens", "block", "place", "weight").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len({r.block for r in got}) > 1
