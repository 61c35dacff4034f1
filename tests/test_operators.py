import datetime
import hashlib
import json

from pyspark.sql import functions as F

from lakeatlas.functions import names
from lakeatlas.operators import canonical, diff, edges, filters, graph, merge, profile, reports, validate
from lakeatlas.streaming import drift

EDGE = "schema_id string, table_name string, type string, name string, target string, foreign_key string, through string, polymorphic boolean, provenance string"


def edge(table, type_, name, target, fk=None, prov="declared", through=None, poly=False):
    return ("s", table, type_, name, target, fk, through, poly, prov)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    words = ["person", "category", "day", "box", "church", "user", "leaf"]
    assert [one(spark, names.pluralize(F.lit(w))) for w in words] == ["people", "categories", "days", "boxes", "churches", "users", "leaves"]
    assert [one(spark, names.singularize(F.lit(w))) for w in ["people", "categories", "days", "boxes", "users"]] == ["person", "category", "day", "box", "user"]
    assert one(spark, names.class_to_table(F.lit("Admin::HTMLPage"))) == "html_pages"
    assert one(spark, names.coarse_type(F.lit("TIMESTAMP with time zone"))) == "datetime" and one(spark, names.coarse_type(F.lit("GeoJSON"))) == "geojson"
    assert one(spark, names.one_line(F.lit(" a \n b "))) == "a b"
    assert one(spark, names.password_free(F.lit("postgres://u:p@h:1/d"))) == "postgres://u@h:1/d"
    assert one(spark, names.dbml_default(F.lit("-1.5"))) == "-1.5" and one(spark, names.dbml_default(F.lit("it's"))) == "'it\\'s'"
    assert one(spark, names.join_table(F.lit("users"), F.lit("tags"))) == "tags_users"
    for glob, yes, no in [("a*b", "axxb", "axxc"), ("[!a]?", "bc", "ac"), ("x.y", "x.y", "xzy"), ("[ab]", "a", "c")]:
        assert one(spark, F.lit(yes).rlike(names.glob_to_regex(glob))) and not one(spark, F.lit(no).rlike(names.glob_to_regex(glob)))


def test_merge_present_null_wins_and_order_does_not_matter(spark):
    schema = "schema_id string, layer_seq int, kind string, table_name string, pos int, name string, present array<string>, type string, nullable boolean, primary boolean, default string, comment string"
    data = [
        ("s", 0, "db", "t", 1, "a", ["type", "nullable", "comment"], "bigint", False, None, None, "db says"),
        ("s", 1, "framework", "t", 1, "a", ["type", "comment"], "string", None, None, None, "model says"),
        ("s", 2, "config", "t", 1, "a", ["comment"], None, None, None, None, None),
        ("s", 3, "db", "t", 1, "a", ["type"], "integer", None, None, None, None),
        ("s", 1, "framework", "t", 2, "b", [], None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, schema)
    for d in (df, df.repartition(4), df.orderBy(F.desc("layer_seq"))):
        got = merge.place_columns(merge.merge_columns(d))
        assert rows(got, "name", "pos", "type", "nullable", "primary", "comment") == [("a", 1, "integer", False, False, None), ("b", 2, "", False, False, None)]
    assert rows(merge.fact_conflicts(df, "type"), "name", "winner", "n_values") == [("a", "integer", 2)]


def test_association_identity(spark):
    schema = "schema_id string, layer_seq int, kind string, pos int, " + EDGE.replace("schema_id string, ", "")
    data = [
        ("s", 0, "db", 0, *edge("posts", "belongs_to", "user", "users", "user_id", "db_fk")[1:]),
        ("s", 1, "framework", 0, *edge("posts", "has_one", "user", "users", "user_id")[1:]),
        ("s", 1, "framework", 1, *edge("posts", "belongs_to", "author", "users", "user_id")[1:]),
        ("s", 2, "config", 0, *edge("users", "has_many", "posts", "posts", None, "declared", "x")[1:]),
    ]
    got = merge.merge_associations(spark.createDataFrame(data, schema))
    assert rows(got, "table_name", "name", "type", "provenance") == [
        ("posts", "author", "belongs_to", "declared"),
        ("posts", "user", "has_one", "declared"),
        ("users", "posts", "has_many", "manual"),
    ]


def test_primary_keys(spark):
    cols = spark.createDataFrame(
        [("s", "t", "a", True), ("s", "t", "b", False), ("s", "u", "a", True)],
        "schema_id string, table_name string, name string, primary boolean",
    )
    tabs = spark.createDataFrame(
        [("s", "t", ["b", "z"], True), ("s", "u", None, False)],
        "schema_id string, table_name string, primary_key array<string>, config_pk boolean",
    )
    assert rows(merge.normalize_primary_key(cols, tabs).where("primary"), "table_name", "name") == [("t", "b"), ("u", "a")]
    assert rows(merge.missing_key_columns(cols, tabs), "table_name", "missing") == [("t", "z")]


def test_composites(spark):
    schema = "schema_id string, table_name string, kind string, name string, columns_mode string, drop boolean"
    df = spark.createDataFrame(
        [
            ("s", "t", "db", "a", None, None),
            ("s", "t", "db", "b", None, None),
            ("s", "u", "db", "a", None, None),
            ("s", "t", "config", "a", None, True),
            ("s", "u", "config", "z", "replace", False),
        ],
        schema,
    )
    assert rows(merge.apply_composites(df, ["name"], "columns_mode"), "table_name", "name") == [("t", "b"), ("u", "z")]


def test_reconcile(spark):
    data = [
        edge("posts", "belongs_to", "user", "users", "user_id", "db_fk"), edge("users", "has_many", "posts", "posts"),  # covered
        edge("posts", "belongs_to", "editor", "people", "editor_id", "db_fk"), edge("posts", "belongs_to", "writer", "people", "writer_id"),  # another key
        edge("profiles", "has_one", "user", "users", "user_id", "db_fk"), edge("profiles", "belongs_to", "owner", "users", "user_id"),  # upgraded
        edge("a", "has_one", "b", "b", "b_id", "schema_fk"), edge("a", "belongs_to", "b", "b", "b_id", "manual"), edge("b", "has_many", "a", "a"),  # cardinality told
        edge("x", "belongs_to", "y", "y", "y_id", "inferred"),
    ]
    got = edges.reconcile(spark.createDataFrame(data, EDGE))
    assert rows(got, "table_name", "type", "name", "provenance") == sorted(
        [
            ("users", "has_many", "posts", "declared"),
            ("posts", "belongs_to", "editor", "db_fk"),
            ("posts", "belongs_to", "writer", "declared"),
            ("profiles", "has_one", "owner", "declared"),
            ("a", "belongs_to", "b", "manual"),
            ("b", "has_many", "a", "declared"),
            ("x", "belongs_to", "y", "inferred"),
        ],
        key=str,
    )


def test_infer(spark):
    tables = spark.createDataFrame([("s", t) for t in ("users", "logs", "staff", "orders")], "schema_id string, table_name string")
    cols = [
        ("logs", 1, "user_id", False),
        ("logs", 2, "staff_id", False),
        ("logs", 3, "log_id", False),
        ("logs", 4, "order_id", True),
        ("orders", 1, "user_id", False),
        ("users", 1, "order_id", False),
        ("logs", 5, "nothing_id", False),
    ]
    columns = spark.createDataFrame([("s", *c) for c in cols], "schema_id string, table_name string, pos int, name string, primary boolean")
    indexes = spark.createDataFrame([("s", "logs", ["staff_id"], True)], "schema_id string, table_name string, columns array<string>, unique boolean")
    none = spark.createDataFrame([], EDGE)
    got = edges.infer_fks(tables, columns, indexes, none)
    assert rows(got, "table_name", "target", "type", "foreign_key") == [
        ("logs", "staff", "has_one", "staff_id"),
        ("logs", "users", "belongs_to", "user_id"),
        ("orders", "users", "belongs_to", "user_id"),
        ("users", "orders", "belongs_to", "order_id"),
    ]
    there = spark.createDataFrame([edge("users", "has_many", "logs", "logs")], EDGE)
    assert ("logs", "users") not in rows(edges.infer_fks(tables, columns, indexes, there), "table_name", "target")


def test_display_edges(spark):
    tables = spark.createDataFrame([("s", t) for t in ("a", "b", "c", "a_c")], "schema_id string, table_name string")
    data = [
        edge("a", "has_many", "bs", "b"),
        edge("b", "belongs_to", "a", "a", "a_id"),
        edge("a", "has_and_belongs_to_many", "cs", "c"),
        edge("b", "has_one", "c", "c"),
        edge("b", "belongs_to", "any", "any", "any_id", poly=True),
        edge("c", "has_many", "x", "a", through="b"),
        edge("b", "has_and_belongs_to_many", "bb", "b"),
    ]
    got = edges.display_edges(tables, spark.createDataFrame(data, EDGE).withColumn("pos", F.lit(0)))
    assert rows(got, "a", "b", "kind", "many", "label") == [("a", "b", "1n", "b", "bs"), ("b", "b", "nn", None, "bb"), ("b", "c", "11", None, "c")]


def test_notes(spark):
    es = spark.createDataFrame(
        [edge("p", "belongs_to", "user", "u", "user_id"), edge("p", "belongs_to", "author", "u", "user_id"), edge("p", "has_many", "us", "u")],
        EDGE,
    )
    schema = "schema_id string, note_id string, table_name string, target string, present array<string>, foreign_key string, name string, through string, type string, polymorphic boolean"
    notes = spark.createDataFrame(
        [
            ("s", "many", "p", "u", [], None, None, None, None, None),
            ("s", "named", "p", "u", ["name"], None, "author", None, None, None),
            ("s", "without", "p", "u", ["foreign_key"], None, None, None, None, None),
            ("s", "none", "p", "u", ["name"], None, "z", None, None, None),
        ],
        schema,
    )
    good, bad = edges.resolve_notes(notes, es)
    assert rows(good, "note_id", "name") == [("named", "author"), ("without", "us")] and rows(bad, "note_id", "n") == [("many", 3), ("none", 0)]


def test_drop_matches_and_pending(spark):
    es = spark.createDataFrame(
        [edge("p", "belongs_to", "user", "u", "user_id"), edge("p", "belongs_to", "author", "u", "user_id"), edge("p", "has_many", "us", "u")],
        EDGE,
    )
    drop = spark.createDataFrame([edge("p", "belongs_to", None, "u", "user_id", poly=None)], EDGE)
    assert rows(edges.drop_matches(es, drop), "name") == [("us",)]
    tables = spark.createDataFrame([("s", "p"), ("s", "u")], "schema_id string, table_name string")
    cols = spark.createDataFrame([("s", "p", "u_id")], "schema_id string, table_name string, name string")
    ix = spark.createDataFrame([("s", "p", ["u_id"], True)], "schema_id string, table_name string, columns array<string>, unique boolean")
    pending = spark.createDataFrame(
        [("s", "p", "u_id", "u"), ("s", "p", "u_id", "u"), ("s", "p", "x_id", "u"), ("s", "z", "u_id", "u"), ("s", "p", "u_id", "q")],
        "schema_id string, table_name string, column_name string, ref_table string",
    )
    good, bad = edges.pending_fks(pending, tables, cols, ix)
    assert rows(good, "type", "target", "provenance") == [("has_one", "u", "schema_fk")] and rows(bad, "reason") == [
        ("unknown column",),
        ("unknown table",),
        ("unknown target",),
    ]


def test_graph(spark):
    g = spark.createDataFrame(
        [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "d", "a"), ("s", "x", "y"), ("s", "z", "z")],
        "schema_id string, src string, dst string",
    )
    start = spark.createDataFrame([("s", "d")], "schema_id string, start string")
    assert rows(graph.neighbourhood(g, start, 2, "out"), "node", "depth") == [("a", 1), ("b", 2), ("d", 0)]
    assert rows(graph.neighbourhood(g, start, 5, "both"), "node", "depth") == [("a", 1), ("b", 2), ("c", 2), ("d", 0)]
    assert rows(graph.neighbourhood(g, start, 1, "in"), "node") == [("d",)]
    assert rows(graph.cycles(g), "node", "length") == [("a", 3), ("b", 3), ("c", 3), ("z", 1)]
    nodes = spark.createDataFrame([("s", n) for n in "abcdxyzo"], "schema_id string, node string")
    assert rows(graph.components(nodes, g), "node", "component") == [
        ("a", "a"),
        ("b", "a"),
        ("c", "a"),
        ("d", "a"),
        ("o", "o"),
        ("x", "x"),
        ("y", "x"),
        ("z", "z"),
    ]
    assert rows(graph.orphans(nodes, g), "node") == [("o",)]
    fields = spark.createDataFrame([("s", "Base", "id", 1), ("s", "User", "name", 1)], "schema_id string, cls string, field string, pos int")
    bases = spark.createDataFrame([("s", "User", "Base", 0)], "schema_id string, src string, dst string, pos int")
    assert rows(graph.inherited_fields(bases, fields).where("cls = 'User'"), "pos", "field") == [(1, "id"), (2, "name")]


def schema_frames(spark):
    tables = spark.createDataFrame([("s", "users", 'who "is"'), ("s", "odd-name", None)], "schema_id string, table_name string, comment string")
    columns = spark.createDataFrame(
        [
            ("s", "users", 1, "id", "bigint", False, True, None, None),
            ("s", "users", 2, "org_id", "integer", True, False, "1", "see\norg"),
            ("s", "odd-name", 1, "id", "bigint", False, True, None, None),
        ],
        "schema_id string, table_name string, pos int, name string, type string, nullable boolean, primary boolean, default string, comment string",
    )
    indexes = spark.createDataFrame(
        [("s", "users", "ix", ["org_id"], True)],
        "schema_id string, table_name string, name string, columns array<string>, unique boolean",
    )
    es = spark.createDataFrame([edge("users", "belongs_to", "org", "odd-name", "org_id")], EDGE).withColumn(
        "sources",
        F.array(F.struct(F.lit("db").alias("kind"), F.lit("mysql").alias("provider"))),
    ).withColumn("pos", F.lit(0))
    return {"tables": tables, "columns": columns, "indexes": indexes, "associations": es}


def test_canonical_json_is_python_json(spark):
    f = schema_frames(spark)
    doc = canonical.schema_json(canonical.table_json(f["tables"], f["columns"], f["indexes"], f["associations"]))
    want = {
        "tables": {
            "odd-name": {"associations": [], "columns": [{"name": "id", "nullable": False, "primary": True, "type": "bigint"}], "indexes": []},
            "users": {
                "associations": [
                    {
                        "foreign_key": "org_id",
                        "name": "org",
                        "provenance": "declared",
                        "sources": [{"kind": "db", "provider": "mysql"}],
                        "target": "odd-name",
                        "type": "belongs_to",
                    }
                ],
                "columns": [
                    {"name": "id", "nullable": False, "primary": True, "type": "bigint"},
                    {"comment": "see\norg", "default": "1", "name": "org_id", "nullable": True, "type": "integer"},
                ],
                "comment": 'who "is"', "indexes": [{"columns": ["org_id"], "name": "ix", "unique": True}],
            },
        }
    }
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = doc.select("doc", canonical.fingerprint(F.col("doc")).alias("fp"), canonical.snapshot(F.col("doc")).alias("snap")).first()
    assert row.doc == dump(want)
    assert row.fp == "sha256:" + hashlib.sha256(dump({"format": 1, "schema": want}).encode()).hexdigest()
    assert row.snap == dump({"format": 1, "fingerprint": row.fp, "schema": want})
    assert one(spark, canonical.lower_escapes(F.to_json(F.struct(F.lit("\x1f\\u001F").alias("a"))))) == json.dumps({"a": "\x1f\\u001F"}).replace(": ", ":")


def test_texts(spark):
    f = schema_frames(spark)
    display = edges.display_edges(f["tables"], f["associations"])
    assert reports.digest(f["tables"], f["columns"], f["associations"], verbose=True).first().text == (
        '# Schema digest\n\n## Tables (2)\n\n### odd-name\n- id: bigint, pk\n\n### users  — who "is"\n- id: bigint, pk\n- org_id: integer, fk→odd-name, null, default=1, "see org"\nRel: belongs_to odd-name as org fk=org_id\n'
    )
    refs = edges.dbml_refs(f["associations"], f["columns"])
    assert reports.dbml(f["tables"], f["columns"], f["indexes"], refs).first().text == (
        'Table "odd-name" {\n  id bigint [pk, not null]\n}\n\nTable users {\n  id bigint [pk, not null]\n  org_id integer [unique, default: 1]\n\n  indexes {\n    (org_id) [unique, name: \'ix\']\n  }\n\n  Note: \'who "is"\'\n}\n\nRef: users.org_id > "odd-name".id\n'
    )
    assert reports.mermaid(f["tables"], f["columns"], f["associations"], display).first().text == (
        'erDiagram\n    odd-name ||--o{ users : "org"\n    odd-name {\n        bigint id PK\n    }\n    users {\n        bigint id PK\n        integer org_id FK\n    }\n'
    )
    assert reports.plantuml(f["tables"], f["columns"], f["associations"], display).first().text == (
        '@startuml\nhide circle\nskinparam linetype ortho\n\nentity "odd-name" as odd_name {\n  * id : bigint <<PK>>\n}\n\nentity "users（who \'is\'）" as users {\n  * id : bigint <<PK>>\n  --\n  org_id : integer <<FK>>\n}\n\nodd_name ||--o{ users : org\n@enduml\n'
    )


def test_diff(spark):
    left, right = schema_frames(spark), schema_frames(spark)
    assert diff.schema_diff(left, right, True).count() == 0
    right["columns"] = right["columns"].withColumn("default", F.lit("")).where("NOT (table_name = 'users' AND name = 'id')")
    right["indexes"] = right["indexes"].withColumn("name", F.lit("renamed"))
    right["tables"] = right["tables"].where("table_name = 'users'").withColumn("comment", F.lit(None).cast("string"))
    right["associations"] = right["associations"].withColumn("name", F.lit("firm"))
    got = diff.schema_diff(left, right)
    assert rows(got, "level", "table_name", "change", "field", "old", "new") == sorted(
        [
            ("table", "odd-name", "added", None, None, None),
            ("table", "users", "changed", "comment", "", 'who "is"'),
            ("column", "users", "added", None, None, None),
            ("column", "users", "changed", "default", "", "1"),
            ("association", "users", "added", None, None, None),
            ("association", "users", "removed", None, None, None),
        ],
        key=str,
    )
    assert diff.as_text(got).first().text.splitlines()[0].startswith("+ association users.belongs_to")
    assert len(json.loads(diff.as_json(got).first().json)) == 6


def test_filters(spark):
    t = spark.createDataFrame([("s", n) for n in ("users", "user_logs", "tmp")], "schema_id string, table_name string")
    left = filters.keep_tables(t, ["user*,x*"], ["*_logs"])
    assert rows(left, "table_name") == [("users",)] and filters.emptied_schemas(t, filters.keep_tables(t, ["q"])).count() == 1
    notes = spark.createDataFrame(
        [
            ("s", 1, "global", None, None, None, None),
            ("s", 2, "table", "tmp", None, None, None),
            ("s", 3, "relation", None, "users", "tmp", False),
            ("s", 4, "relation", None, "users", "any", True),
        ],
        "schema_id string, note_id int, scope string, table_name string, source_table string, target string, polymorphic boolean",
    )
    assert rows(filters.keep_notes(notes, left), "note_id") == [(1,), (4,)]
    groups = spark.createDataFrame([("s", "g", "", "#fff"), ("s", "h", "H", None)], "schema_id string, group_id string, title string, color string")
    members = spark.createDataFrame([("s", "g", "users"), ("s", "g", "tmp"), ("s", "h", "tmp")], "schema_id string, group_id string, table_name string")
    g, m = filters.keep_groups(groups, members, left)
    assert rows(g, "group_id") == [("g",)] and rows(m, "table_name") == [("users",)]
    assert rows(reports.group_labels(groups, members), "table_name", "label") == [("tmp", "H"), ("tmp", "g"), ("users", "g")]
    assert validate.group_overlap(members).count() == 1


def test_validation(spark):
    tables = spark.createDataFrame([("s", 0, ""), ("s", 0, "t")], "schema_id string, layer_seq int, table_name string")
    columns = spark.createDataFrame(
        [("s", 0, "t", "", "int", True), ("s", 0, "t", "a", None, None)],
        "schema_id string, layer_seq int, table_name string, name string, type string, nullable boolean",
    )
    indexes = spark.createDataFrame([("s", 0, "t", [], True)], "schema_id string, layer_seq int, table_name string, columns array<string>, unique boolean")
    es = spark.createDataFrame(
        [("s", 0, "t", "owns", "x", None)],
        "schema_id string, layer_seq int, table_name string, type string, name string, target string",
    )
    assert {r.rule for r in validate.fragments(tables, columns, indexes, es, True).collect()} == {
        "table without a name",
        "column without a name",
        "index without columns",
        "unknown association type",
        "association without a target",
        "column without a type",
        "column without nullable",
    }
    layers = spark.createDataFrame(
        [("s", 0, "db", "x", False), ("s", 1, "odd", "", True)],
        "schema_id string, layer_seq int, kind string, provider string, allow_empty boolean",
    )
    assert validate.layers(layers).count() == 2 and validate.empty_layers(layers, tables.where("table_name = 'none'")).count() == 1


def test_keys_from_data(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, None)], "a int, b int, c string")
    assert rows(profile.discover_keys(df, "t", ["a", "b", "c"]), "key_columns") == [("a,b",)]
    parent = spark.createDataFrame([(1,)], "k int")
    got = profile.integrity(df, "a", parent, "k", "e").first()
    assert (got.n_rows, got.n_null, got.n_orphans) == (3, 0, 1)
    assert profile.orphans(df, "a", parent, "k").count() == 1
    assert profile.cardinality(parent, "k", "e").first().type == "has_one"


def snap(spark, comment, extra=""):
    schema = {"tables": {"t": {"associations": [], "columns": [{"name": "a", "nullable": True, "type": "int" + extra}], "comment": comment, "indexes": []}}}
    return json.dumps({"fingerprint": "sha256:x", "format": 1, "schema": schema}, sort_keys=True, separators=(",", ":"))


def test_stream(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [("s", "1", t(1), snap(spark, "x")), ("s", "2", t(2), snap(spark, "x")), ("s", "3", t(3), snap(spark, "y")), ("bad", "1", t(1), "{")]
    spark.createDataFrame(first, drift.EVENT).coalesce(1).write.parquet(src)
    drift.watch(spark, src, out).awaitTermination()
    spark.createDataFrame(
        [("s", "4", t(4), snap(spark, "y")), ("s", "5", t(5), snap(spark, "y", "eger"))],
        drift.EVENT,
    ).coalesce(1).write.mode("append").parquet(src)
    drift.watch(spark, src, out).awaitTermination()
    assert rows(spark.read.parquet(f"{out}/changes"), "snapshot_id") == [("1",), ("3",), ("5",)]
    assert rows(spark.read.parquet(f"{out}/diff"), "schema_id", "field", "old", "new") == [("s@3", "comment", "x", "y"), ("s@5", "type", "int", "integer")]
    assert rows(spark.read.parquet(f"{out}/quarantine"), "schema_id") == [("bad",)]
    stream = spark.readStream.schema(drift.EVENT).parquet(src)
    q = drift.drift_rate(stream).writeStream.format("memory").queryName("rate").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rate").columns == ["window", "schema_id", "n"]


def test_config_syntax(spark):
    import json

    good = {
        "version": 1,
        "only": [],
        "infer_fk": True,
        "max_rows": 3,
        "models": ["a"],
        "tables": {
            "t": {
                "comment": None,
                "primary_key": ["a", "b"],
                "columns_mode": "merge",
                "columns": [{"name": "a", "type": None}],
                "indexes": [{"columns": ["a"]}, {"name": "x", "drop": True}],
                "associations": [{"type": "has_many", "name": "n", "target": "u", "foreign_key": None}, {"drop": True, "target": "u", "foreign_key": "k"}],
            }
        },
    }
    bad = {
        "version": True,
        "infer_fk": 1,
        "max_rows": True,
        "only": "x",
        "wrong": 1,
        "tables": {
            "t": {
                "drop": "yes",
                "indexes_mode": "other",
                "columns": [{"type": "int"}],
                "indexes": [{"drop": True}, {"name": "y"}],
                "associations": [{"type": "odd", "name": "n", "target": "u", "foreign_key": ["a", "b"]}, {"type": "has_one"}, {"drop": True, "target": "u"}],
            }
        },
    }
    df = spark.createDataFrame([("good", json.dumps(good)), ("bad", json.dumps(bad)), ("none", "[1")], "schema_id string, content string")
    got = sorted((r.schema_id, r.path, r.rule) for r in validate.config_documents(df).collect())
    assert [g[0] for g in got if g[0] != "bad"] == ["none"]
    a = "tables.t.associations"
    assert {g[1:] for g in got if g[0] == "bad"} == {
        ("version", "is not bigint"), ("version", "is not 1"), ("infer_fk", "is not boolean"), ("max_rows", "is not bigint"), ("only", "is not array"), ("wrong", "unknown key"), ("tables.t.drop", "is not boolean"), (
            "tables.t.indexes_mode",
            "is not merge or replace",
        ),
        ("tables.t.columns[0]", "lacks name"), ("tables.t.indexes[0]", "lacks name"), ("tables.t.indexes[1]", "lacks columns"), (
            f"{a}[0]",
            "foreign key of several columns",
        ), (f"{a}[0].foreign_key", "is not string"), (f"{a}[0]", "unknown association type"),
        (f"{a}[1]", "lacks name"), (f"{a}[1]", "lacks target"), (f"{a}[2]", "lacks type"), (f"{a}[2]", "lacks name"),
    }


def test_config_document_is_read_back(spark):
    import json

    from lakeatlas.operators import reports
    from lakeatlas.sources import documents

    tables = spark.createDataFrame([("s", "t", "c"), ("s", "u", "")], "schema_id string, table_name string, comment string")
    columns = spark.createDataFrame(
        [("s", "t", 1, "b", "int", False, True, "0"), ("s", "t", 2, "a", "int", False, True, None), ("s", "u", 1, "id", "int", False, True, None)],
        "schema_id string, table_name string, pos int, name string, type string, nullable boolean, primary boolean, default string",
    )
    indexes = spark.createDataFrame(
        [("s", "t", None, ["a", "b"], True)],
        "schema_id string, table_name string, name string, columns array<string>, unique boolean",
    )
    edge_rows = spark.createDataFrame(
        [("s", "t", "belongs_to", "u", "u", "a", None, False, "declared", [("db", "x")])],
        "schema_id string, table_name string, type string, name string, target string, foreign_key string, through string, polymorphic boolean, provenance string, sources array<struct<kind:string,provider:string>>",
    )
    notes = spark.createDataFrame(
        [
            ("s", "n2", "relation", None, "why", None, "t", "u", "belongs_to", "u", "a", None, False, [("l", "https://x")]),
            ("s", "n1", "global", "T", "all", None, None, None, None, None, None, None, None, None),
        ],
        "schema_id string, note_id string, scope string, title string, text string, table_name string, source_table string, target string, type string, name string, foreign_key string, through string, polymorphic boolean, links array<struct<label:string,url:string>>",
    )
    groups = spark.createDataFrame([("s", "g", ["u", "t"], "", "#fff")], "schema_id string, group_id string, tables array<string>, title string, color string")
    doc = reports.config_document(tables, columns, indexes, edge_rows, notes, groups).first().doc
    d = json.loads(doc)
    assert doc == json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert d["version"] == 1 and d["tables"]["t"]["primary_key"] == ["b", "a"] and "primary_key" not in d["tables"]["u"]
    assert d["tables"]["t"]["associations"] == [{"foreign_key": "a", "name": "u", "target": "u", "type": "belongs_to"}]
    assert d["notes"][1]["target"] == {
        "assoc_type": "belongs_to",
        "foreign_key": "a",
        "name": "u",
        "polymorphic": False,
        "source_table": "t",
        "target_table": "u",
        "through": None,
        "type": "relation",
    }
    assert d["notes"][0] == {
        "id": "n1",
        "target": {"type": "global"},
        "text": "all",
        "title": "T",
    } and d["groups"] == [{"color": "#fff", "id": "g", "tables": ["t", "u"]}]
    back = documents.config_fragments(spark.createDataFrame([("s", 0, doc)], "schema_id string, layer_seq int, content string"))
    assert back["columns"].count() == 3 and back["associations"].first().target == "u"
    assert validate.config_documents(spark.createDataFrame([("s", doc)], "schema_id string, content string")).count() == 0
    assert json.loads(reports.config_document(tables, columns, indexes, edge_rows).first().doc) == {"version": 1, "tables": d["tables"]}
