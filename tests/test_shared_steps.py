"""Steps that several queries share are made once, and only where they are asked for."""

from lakeatlas.operators import hashtree
from lakeatlas.plans import details

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_notes_and_groups_do_not_derive_columns(spark):
    r = details.rich(spark, SF)
    assert r["notes"].count() and r["groups_"].count() and "column_frag" not in r
    assert r["rich"].count() and "column_frag" in r


def test_leaves_without_indexes_and_edges_join_columns_only(spark):
    tables = spark.createDataFrame([("s", "t", "c"), ("s", "u", None)], "schema_id string, table_name string, comment string")
    columns = spark.createDataFrame([("s", "t", 1, "a", "int", True, False)], "schema_id string, table_name string, pos int, name string, type string, nullable boolean, primary boolean")
    out = hashtree.leaves({"tables": tables, "columns": columns})
    assert plan(out).count("Join") == 1
    assert {(x.kind, x.item) for x in out.collect()} == {("table", "t"), ("table", "u")}
