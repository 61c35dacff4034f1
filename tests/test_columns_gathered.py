"""Columns are gathered for each table once, and rounds of walks join by shuffle."""

from lakeatlas.operators import graph, reports

COLUMNS = "schema_id string, table_name string, pos int, name string, type string, nullable boolean, primary boolean, default string"


def plans(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dbml_joins_tables_only(spark):
    tables = spark.createDataFrame([("s", "a", None), ("s", "b", None)], "schema_id string, table_name string, comment string")
    columns = spark.createDataFrame([("s", "a", 1, "x", "int", False, True, ""), ("s", "a", 2, "y", "int", True, True, "3"), ("s", "a", 3, "z", "int", True, None, None)], COLUMNS)
    indexes = spark.createDataFrame([("s", "a", None, ["y"], True), ("s", "b", None, ["q", "r"], True)], "schema_id string, table_name string, name string, columns array<string>, unique boolean")
    refs = spark.createDataFrame([], "schema_id string, table_name string, foreign_key string, target string, target_column string")
    out = reports.dbml(tables, columns, indexes, refs)
    assert plans(out).count("Join") <= 4
    assert out.first().text == (
        "Table a {\n  x int [not null]\n  y int [unique, default: 3]\n  z int\n\n  indexes {\n    (x, y) [pk]\n    (y) [unique]\n  }\n}\n\n"
        "Table b {\n\n  indexes {\n    (q, r) [unique]\n  }\n}\n"
    )


def test_rounds_of_walks_send_no_table_whole(spark, monkeypatch):
    seen = []
    keep = graph.written
    monkeypatch.setattr(graph, "written", lambda df, *a: (seen.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, *a))[1])
    edges = spark.createDataFrame([("s", i, (i + 1) % 4) for i in range(4)], "schema_id string, src int, dst int")
    assert {(r.node, r.length) for r in graph.cycles(edges).collect()} == {(i, 4) for i in range(4)}
    assert seen and not any("BroadcastHashJoin" in p for p in seen)
