"""Columns that one text shows are not written before, and facts of every fragment have one winner."""

import pytest

from lakeatlas.operators import merge, store
from lakeatlas.plans import documents

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def names(monkeypatch):
    seen, keep = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name="table": (seen.append(name), keep(df, name))[1])
    return seen


def test_facts_of_every_fragment_have_one_winner(spark):
    rows = [
        ("s", 1, "db", "t", 2, "a", ["type", "nullable", "primary", "comment"], "int", False, True, None, "x"),
        ("s", 2, "sketch", "t", 1, "a", ["type", "nullable", "primary", "default"], None, None, None, "7", None),
        ("s", 3, "db", "t", 1, "b", ["type", "nullable", "primary"], None, None, None, None, None),
        ("s", 4, "sketch", "t", 1, "b", ["type", "nullable", "primary", "comment"], "text", True, False, None, None),
    ]
    f = spark.createDataFrame(rows, "schema_id string, layer_seq long, kind string, table_name string, pos int, name string, present array<string>, type string, nullable boolean, primary boolean, default string, comment string")
    one = merge.place_columns(merge.merge_columns(f, ("type", "nullable", "primary")))
    each = merge.place_columns(merge.merge_columns(f))
    assert one.columns == each.columns and sorted(one.collect()) == sorted(each.collect())
    assert {tuple(r) for r in one.select("name", "pos", "type", "nullable", "primary", "default", "comment").collect()} == {
        ("a", 1, "int", False, True, "7", "x"),
        ("b", 2, "", False, False, None, None),
    }
    assert plan(one).count("max_by(") < plan(each).count("max_by(")


def test_fingerprint_does_not_write_columns(spark, names):
    out = documents.fingerprint(spark, SF)
    assert out.count() and "columns" not in names and "tables" in names
