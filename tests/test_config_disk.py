"""What config queries leave on disk: fragments once, fields of the documents that are read, and no document as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from lakeatlas.operators import edges as edges_
from lakeatlas.operators import reports
from lakeatlas.operators.store import shared_folder
from lakeatlas.plans import configs

SF = "/root/testdata/sf0.001"


def kinds(spark):
    return [n.rsplit("-", 1)[0] for n in os.listdir(shared_folder(spark).removeprefix("file://"))]


@pytest.mark.parametrize("name", ["config_source_layers", "config_relation_edges", "config_notes_resolved", "config_round_trip"])
def test_documents_are_not_written_whole(spark, name):
    before = kinds(spark)
    assert configs.QUERIES[name](spark, SF).count()
    now = kinds(spark)
    for n in before:
        now.remove(n)
    assert now.count("column_frag") == 1
    assert not {"config_files", "parsed", "config_tables", "notes"} & set(now)


def schema(spark):
    tables = spark.createDataFrame([("s", "t", "c"), ("s", "u", ""), ("r", "t", None)], "schema_id string, table_name string, comment string")
    columns = spark.createDataFrame(
        [("s", "t", 1, "b", "int", False, True, "0"), ("s", "t", 2, "a", "int", False, True, None), ("x", "t", 1, "id", "int", False, True, None)],
        "schema_id string, table_name string, pos int, name string, type string, nullable boolean, primary boolean, default string",
    )
    indexes = spark.createDataFrame([("s", "t", None, ["a", "b"], True)], "schema_id string, table_name string, name string, columns array<string>, unique boolean")
    edges = spark.createDataFrame(
        [("s", "t", "belongs_to", "u", "u", "a", None, False), ("s", "t", "has_many", "us", "u", None, "v", None), ("s", "gone", "has_one", "w", "u", None, None, True)],
        "schema_id string, table_name string, type string, name string, target string, foreign_key string, through string, polymorphic boolean",
    )
    return tables, columns, indexes, edges


def test_rows_are_dealt_by_schema_once(spark):
    plan = reports.config_document(*schema(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(schema_id" in plan


def test_a_note_on_each_edge(spark):
    tables, columns, indexes, edges = schema(spark)
    links = F.lit(None).cast("array<struct<label:string,url:string>>")
    none = F.lit(None).cast("string")
    own = spark.createDataFrame([("s", "m", "global", "all"), ("r", "m", "global", "one"), ("y", "m", "global", "lost")], "schema_id string, note_id string, scope string, text string")
    missing = {c: none for c in ("title", "table_name", "source_table", "target", "type", "name", "foreign_key", "through")}
    own = own.withColumns(missing | {"polymorphic": F.lit(None).cast("boolean"), "links": links})
    said = edges.withColumns({"note_id": F.concat("type", F.lit("!")), "scope": F.lit("relation"), "title": F.col("name"), "text": F.lit("x"), "source_table": F.col("table_name"), "links": links})
    one = reports.config_document(tables, columns, indexes, edges, own.unionByName(said.withColumn("table_name", none)))
    note = F.struct(F.concat("type", F.lit("!")).alias("note_id"), F.col("name").alias("title"), F.lit("x").alias("text"), links.alias("links"))
    other = reports.config_document(tables, columns, indexes, edges, own, edge_note=note)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(one) == rows(other) and {r[0] for r in rows(one)} == {"r", "s"}
    assert [d.count('"id":') for _, d in rows(one)] == [1, 4]


def test_notes_are_resolved_without_a_broadcast(spark):
    data = [("s", "a", "t", "u", ["name"], None, "x", None, None, None), ("s", "b", "t", "u", [], None, None, None, None, None), ("s", "b", "t", "w", [], None, None, None, None, None), (None, "c", None, "u", [], None, None, None, None, None), ("s", None, "t", "w", [], None, None, None, None, None)]
    notes = spark.createDataFrame(data, "schema_id string, note_id string, table_name string, target string, present array<string>, foreign_key string, name string, through string, type string, polymorphic boolean")
    own = spark.createDataFrame([("s", "t", "has_one", "x", "u"), ("s", "t", "has_one", "y", "u"), ("s", "t", "has_one", "z", "w")], "schema_id string, table_name string, type string, name string, target string")
    own = own.withColumns({"foreign_key": F.lit(None).cast("string"), "through": F.lit(None).cast("string"), "polymorphic": F.lit(None).cast("boolean")})
    good, bad = edges_.resolve_notes(notes, own)
    assert [(r.note_id, r.name, r.polymorphic) for r in good.collect()] == [("a", "x", False)]
    assert sorted(((r.note_id or "", r.n) for r in bad.collect())) == [("", 0), ("b", 3), ("b", 3), ("c", 0)]
    assert "Broadcast" not in good._jdf.queryExecution().executedPlan().toString()
