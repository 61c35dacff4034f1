"""The data source of catalogues: landed files and servers, filters, nulls, empty folders, broken lines."""

import json
import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from lakeatlas.sources import fleet
from lakeatlas.sources.catalogue import FK_ROWS, catalogue_from_rows

FK = [("s1", "orders", "user_id", "users"), ("s1", "orders", "view_id", "v"), ("s2", "a", "b_id", "b")]


def server(path, schema):
    """A server with one base table, one view and rows of a system schema."""
    c = sqlite3.connect(path)
    c.executescript(
        f"""
        CREATE TABLE tables (table_schema, table_name, table_comment, table_type);
        INSERT INTO tables VALUES ('{schema}', 'users', 'people', 'BASE TABLE'), ('{schema}', 'v', '', 'VIEW'), ('{schema}', 'orders', '', 'BASE TABLE'), ('mysql', 'x', '', 'BASE TABLE');
        CREATE TABLE columns (table_schema, table_name, ordinal_position, column_name, data_type, column_type, is_nullable, column_key, column_default, extra, column_comment);
        INSERT INTO columns VALUES ('{schema}', 'users', 1, 'id', 'bigint', 'bigint', 'NO', 'PRI', NULL, '', ''), ('{schema}', 'v', 1, 'id', 'bigint', 'bigint', 'NO', '', NULL, '', ''),
          ('{schema}', 'orders', 1, 'user_id', 'bigint', 'bigint', 'YES', '', NULL, '', '');
        CREATE TABLE key_column_usage (table_schema, table_name, column_name, referenced_table_name);
        INSERT INTO key_column_usage VALUES ('{schema}', 'orders', 'user_id', 'users'), ('{schema}', 'users', 'id', NULL);
        CREATE TABLE statistics (table_schema, table_name, index_name, non_unique, seq_in_index, column_name);
        INSERT INTO statistics VALUES ('{schema}', 'users', 'PRIMARY', 0, 1, 'id'), ('{schema}', 'orders', 'u', 0, 1, 'user_id');
        """
    )
    c.commit()
    c.close()
    return {"path": str(path)}


def test_servers_are_read_by_their_own_connections(spark, tmp_path):
    servers = [server(tmp_path / f"{s}.db", s) for s in ("shop", "blog", "ohara")]
    options = {"servers": json.dumps(servers), "connector": "tests.fleet_connector:connect", "mark": "?"}
    rows = fleet.row_sets(spark, **options)
    assert rows["columns"].rdd.getNumPartitions() == 3
    c = catalogue_from_rows(rows)
    assert sorted((t.schema_id, t.table_name, t.comment, t.primary_key) for t in c["tables"].where("schema_id = 'shop'").collect()) == [("shop", "orders", None, None), ("shop", "users", "people", ["id"])]
    assert c["columns"].where("table_name = 'v'").count() == 0 and c["columns"].count() == 6
    edges = c["associations"].collect()
    assert sorted((e.schema_id, e.type, e.target) for e in edges) == [(s, "has_one", "users") for s in ("blog", "ohara", "shop")]


def test_filters_go_into_the_statement():
    schema = StructType.fromDDL(FK_ROWS)
    r = fleet.ServerReader("fks", schema, [], "m:f", "?")
    filters = [In(("schema_id",), ("a", "b")), EqualTo(("table_name",), "t; --"), GreaterThan(("column_name",), "c"), EqualTo(("ref_table",), None)]
    assert r.pushFilters(filters) == filters
    sql, values = r.statement()
    assert sql.endswith("q WHERE schema_id IN (?, ?) AND table_name IN (?)") and values == ["a", "b", "t; --"]


def test_landed_rows_come_back_and_filters_reach_the_lines(spark, tmp_path):
    fleet.register(spark)
    path = f"file://{tmp_path}/x"
    fleet.land({"fks": spark.createDataFrame(FK * 2, FK_ROWS)}, path, servers=4)
    df = spark.read.format("catalogues").options(relation="fks", path=path).load()
    assert sorted(map(tuple, df.collect())) == sorted(FK * 2)  # repeated rows stay
    one = df.where("schema_id = 's2' AND ref_table > 'a'")
    assert [tuple(r) for r in one.collect()] == [FK[2]] * 2
    r = fleet.LandedReader("fks", StructType.fromDDL(FK_ROWS), path, 1)
    assert len(r.partitions()) == 2  # a task for each file, as none fits into another's
    r.pushFilters([EqualTo(("schema_id",), "s2")])
    assert sum(b.num_rows for p in r.partitions() for b in r.read(p)) == 2


def test_nulls_further_fields_and_empty_input(spark, tmp_path):
    (tmp_path / "fks").mkdir()
    load = lambda where: fleet.register(spark) or spark.read.format("catalogues").options(relation="fks", path=str(where)).load()
    assert load(tmp_path).count() == 0 and load(tmp_path / "none").count() == 0
    (tmp_path / "fks" / "a.json").write_text('{"schema_id": null, "table_name": "t", "server": 3}\n\n')
    assert [tuple(r) for r in load(tmp_path).collect()] == [(None, "t", None, None)]
    (tmp_path / "fks" / "b.json").write_text('{"schema_id": "s"}\n[1]\n')
    with pytest.raises(Exception, match="line 2: no JSON object"):
        load(tmp_path).count()


def test_options_are_checked(spark):
    fleet.register(spark)
    for options, text in (({}, "relation must be"), ({"relation": "fks"}, "either path or servers"), ({"relation": "fks", "servers": "[]"}, "connector")):
        with pytest.raises(Exception, match=text):
            spark.read.format("catalogues").options(**options).load().count()


def test_landed_files_are_compressed_and_packed_by_what_they_hold(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    fleet.land({"fks": spark.createDataFrame([(f"s{i % 9}", "t" * 50, f"c{i}", "users") for i in range(9000)], FK_ROWS)}, path, servers=4)
    files = list((tmp_path / "x" / "fks").rglob("*.json*"))
    held = [f for f in files if f.name.endswith(".json.gz")]
    assert held and sum(f.stat().st_size for f in held) < 9000 * 20  # a line has 100 bytes and more
    assert spark.read.format("catalogues").options(relation="fks", path=path).load().distinct().count() == 9000
    size = max(f.stat().st_size for f in held)
    assert len(fleet.LandedReader("fks", StructType.fromDDL(FK_ROWS), path, size * 2).partitions()) == len(held)
