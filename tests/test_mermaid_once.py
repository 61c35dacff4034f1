"""Columns of diagrams are neither written before nor dealt by name."""

import pytest

from lakeatlas.operators import reports, store
from lakeatlas.plans import documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def names(monkeypatch):
    seen, keep = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name="table": (seen.append(name), keep(df, name))[1])
    return seen


def test_mermaid_text_does_not_write_columns(spark, names):
    out = documents.mermaid_text(spark, SF)
    assert out.count() and "columns" not in names and "tables" in names


def test_keys_are_told_for_each_table_without_dealing_columns_by_name(spark):
    columns = spark.createDataFrame([("s", "a", "x", True), ("s", "a", "y", False), ("s", "a", "z", None), ("s", "b", "y", None)], "schema_id string, table_name string, name string, primary boolean")
    keys = spark.createDataFrame([("s", "a", "x"), ("s", "a", "y"), ("s", "a", "y"), ("s", "a", None)], "schema_id string, table_name string, foreign_key string")
    out = reports.key_label(columns, keys)
    assert sorted((r.table_name, r.name, r.key) for r in out.collect()) == [("a", "x", "PK"), ("a", "y", "FK"), ("a", "z", ""), ("b", "y", "")]
    assert "Join LeftOuter, ((schema_id" in plan(out) and "(name#" not in plan(out).split("Join LeftOuter")[1].split("\n")[0]
