"""Columns of schema files are written as text once, and read in one pass."""

import pytest

from lakeatlas.operators import edges, store
from lakeatlas.plans import documents, extraction
from lakeatlas.sources import corpus

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def names(monkeypatch):
    seen, keep = [], store.written
    monkeypatch.setattr(store, "written", lambda df, name="table": (seen.append(name), keep(df, name))[1])
    return seen


def test_schema_rb_text_does_not_write_columns(spark, names):
    out = extraction.schema_rb_text(documents.final(spark, SF))
    assert out.count() and "columns" not in names and "tables" in names


def test_columns_of_schema_files_are_read_in_one_pass(spark):
    text = """create_table "a", id: :uuid, primary_key: "key" do |t|
  t.string "x", 'y', :z, null: false
  t.integer "n", default: "1, 'q"
  t.belongs_to :owner, polymorphic: true, type: :uuid
  t.references "b", foreign_key: true
  t.timestamps
  t.timestamp :at
end
create_table "bs", id: false do |t|
  t.index ["x"], unique: true
end
"""
    got = corpus.schema_rb(spark.createDataFrame([("p", "f", text)], "project string, path string, content string"))
    assert "Union" not in plan(got["columns"])
    rows = got["columns"].orderBy("table_name", "pos").collect()
    assert [(r.pos, r.name, r.type, r.nullable, r.default, r.primary) for r in rows] == [
        (1, "key", "uuid", False, None, True),
        (2, "x", "string", False, None, False),
        (3, "y", "string", False, None, False),
        (4, "z", "string", False, None, False),
        (5, "n", "integer", True, "1, 'q", False),
        (6, "owner_id", "uuid", True, None, False),
        (7, "owner_type", "string", True, None, False),
        (8, "b_id", "bigint", True, None, False),
        (9, "created_at", "datetime", False, None, False),
        (10, "updated_at", "datetime", False, None, False),
        (11, "at", "timestamp", True, None, False),
    ]
    assert [(r.table_name, r.type, r.target, r.foreign_key) for r in got["edges"].collect()] == [("a", "belongs_to", "bs", "b_id")]


def test_keys_said_twice_give_one_edge(spark):
    pending = spark.createDataFrame([("p", "f", "a", "b_id", "b")] * 2 + [("p", "f", "a", "c_id", "b"), ("p", "f", "a", "b_id", "q"), ("p", "f", "z", "b_id", "b")], "project string, path string, table_name string, column_name string, ref_table string")
    tables = spark.createDataFrame([("p", "f", "a"), ("p", "f", "b"), ("p", "f", "b")], "project string, path string, table_name string")
    columns = spark.createDataFrame([("p", "f", "a", "b_id")] * 2, "project string, path string, table_name string, name string")
    indexes = spark.createDataFrame([("p", "f", "a", ["b_id"], True)] * 2, "project string, path string, table_name string, columns array<string>, unique boolean")
    good, bad = edges.pending_fks(pending, tables, columns, indexes, ["project", "path"])
    assert [tuple(r) for r in good.collect()] == [("p", "f", "a", "has_one", "b", "b", "b_id", "schema_fk")]
    assert sorted((r.table_name, r.column_name, r.ref_table, r.reason) for r in bad.collect()) == [("a", "b_id", "q", "unknown target"), ("a", "c_id", "b", "unknown column"), ("z", "b_id", "b", "unknown table")]
