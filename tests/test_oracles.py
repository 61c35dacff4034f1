"""Each query with SQL gives the rows that DuckDB gives for the SQL."""

import glob
import math
import os

import duckdb
import pytest

from lakeatlas.plans.queries import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.sql(ORACLES[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    assert got or name in ("merge_conflicts",)


def test_every_query_is_registered_with_rows_or_sql():
    assert set(ORACLES) <= set(QUERIES)
