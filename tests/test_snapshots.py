"""Snapshots as a whole: the fixed fingerprint of format 1, and the hash tree."""

import json

from pyspark.sql import functions as F

from lakeatlas.operators import canonical, diff, hashtree
from lakeatlas.sources.documents import read_snapshots

# A schema with every element of format 1, and its fingerprint.
FINGERPRINT = "sha256:ca034e782a6de4d2e708a0c522348d08b74a7a8b71bb28271dcae377a9af6b12"
TABLES = {"users": "Application users", "posts": None, "comments": "Comments on posts, or (polymorphically) other things", "categories": None, "organizations": "", "memberships": None}
ID = ("id", "bigint", False, True, "bigint unsigned", None, "auto_increment", None)
COLUMNS = {
    "users": [ID, ("email", "string", False, False, "varchar(255)", None, None, "login email"), ("status", "string", False, False, "varchar(20)", "active", None, None), ("bio", "text", True, False, "text", None, None, None)],
    "posts": [
        ID,
        ("user_id", "bigint", False, False, "bigint unsigned", None, None, None),
        ("category_id", "bigint", True, False, "bigint unsigned", None, None, None),
        ("editor_id", "bigint", True, False, "bigint unsigned", None, None, None),
        ("created_by_id", "bigint", True, False, "bigint unsigned", None, None, None),
        ("title", "string", False, False, "varchar(255)", None, None, "post title"),
        ("body", "text", True, False, None, None, None, None),
        ("legacy_flag", "integer", False, False, "tinyint(1)", "0", "unsigned", "legacy migration flag"),
    ],
    "comments": [
        ID,
        ("post_id", "bigint", True, False, "bigint unsigned", None, None, None),
        ("commentable_id", "bigint", False, False, "bigint unsigned", None, None, None),
        ("commentable_type", "string", False, False, "varchar(60)", None, None, None),
        ("body", "text", False, False, None, None, None, None),
    ],
    "categories": [ID, ("parent_id", "bigint", True, False, "bigint unsigned", None, None, None), ("name", "string", False, False, "varchar(100)", None, None, None)],
    "organizations": [ID, ("name", "string", False, False, "varchar(100)", None, None, None)],
    "memberships": [("org_id", "bigint", False, True, "bigint unsigned", None, None, None), ("user_id", "bigint", False, True, "bigint unsigned", None, None, None), ("role", "string", True, False, "varchar(30)", "member", None, None)],
}
INDEXES = [("users", "idx_users_email", ["email"], True), ("users", None, ["status"], False), ("posts", None, ["user_id"], False), ("memberships", "idx_memberships_role", ["role"], False)]
DB, RAILS, SCHEMA, CONFIG = ("db", "mysql"), ("framework", "rails"), ("schema", "rails.schema"), ("config", "config")
EDGES = [
    ("users", "has_many", "posts", "posts", None, None, False, "declared", [RAILS]),
    ("users", "has_many", "comments", "comments", None, "posts", False, "declared", [RAILS]),
    ("posts", "belongs_to", "user", "users", "user_id", None, False, "db_fk", [RAILS, DB, RAILS]),
    ("posts", "belongs_to", "category", "categories", "category_id", None, False, "schema_fk", [SCHEMA]),
    ("posts", "belongs_to", "editor", "users", "editor_id", None, False, "manual", [CONFIG]),
    ("posts", "belongs_to", "creator", "users", "created_by_id", None, False, "inferred", []),
    ("posts", "has_many", "comments", "comments", None, None, False, "declared", [RAILS]),
    ("comments", "belongs_to", "post", "posts", "post_id", None, False, "db_fk", [DB]),
    ("comments", "belongs_to", "commentable", "commentables", "commentable_id", None, True, "declared", [RAILS]),
    ("categories", "belongs_to", "parent", "categories", "parent_id", None, False, "db_fk", [DB]),
    ("categories", "has_many", "posts", "posts", None, None, False, "declared", [RAILS]),
    ("organizations", "has_many", "memberships", "memberships", None, None, False, "declared", [RAILS]),
    ("memberships", "belongs_to", "org", "organizations", "org_id", None, False, "db_fk", [DB, RAILS]),
    ("memberships", "belongs_to", "member", "users", "user_id", None, False, "db_fk", [DB, RAILS]),
]
NO_EDGE = (None, None, None, None, None, None, None)
NOTES = [
    ("note-global", "global", "Overview", "This schema models a small blog with org membership.", None, *NO_EDGE, [("Design doc", "https://example.com/design")]),
    ("note-table-users", "table", None, "Users table stores auth + profile fields.", "users", *NO_EDGE, None),
    ("note-rel-post-user", "relation", "Author relation", "Every post has exactly one author.", None, "posts", "users", "belongs_to", "user", "user_id", None, False, [(None, "https://example.com/authors")]),
    ("note-rel-users-comments", "relation", None, "Indirect: a user's comments, reached via their posts.", None, "users", "comments", "has_many", "comments", None, "posts", False, []),
    ("note-rel-commentable", "relation", "", "Polymorphic: may point at posts or other commentable types.", None, "comments", "commentables", "belongs_to", "commentable", "commentable_id", None, True, None),
]
GROUPS = [("g-core", ["users", "posts"], "Core commerce", "#0d9488"), ("g-content", ["comments", "categories"], None, None)]


def golden(spark):
    key = "schema_id string, table_name string"
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {
        "tables": make([("s", t, c) for t, c in TABLES.items()], f"{key}, comment string"),
        "columns": make([("s", t, i, *c) for t, cs in COLUMNS.items() for i, c in enumerate(cs)], f"{key}, pos int, name string, type string, nullable boolean, primary boolean, sql_type string, default string, extra string, comment string"),
        "indexes": make([("s", *i) for i in INDEXES], f"{key}, name string, columns array<string>, unique boolean"),
        "associations": make([("s", *e) for e in EDGES], f"{key}, type string, name string, target string, foreign_key string, through string, polymorphic boolean, provenance string, sources array<struct<kind:string,provider:string>>"),
        "notes": make([("s", *n) for n in NOTES], "schema_id string, note_id string, scope string, title string, text string, table_name string, source_table string, target string, type string, name string, foreign_key string, through string, polymorphic boolean, links array<struct<label:string,url:string>>"),
        "groups": make([("s", *g) for g in GROUPS], "schema_id string, group_id string, tables array<string>, title string, color string"),
    }


def doc_of(state):
    tables = canonical.table_json(state["tables"], state["columns"], state["indexes"], state["associations"])
    return canonical.schema_json(tables, canonical.note_json(state["notes"]), canonical.group_json(state["groups"]))


def test_fixed_fingerprint(spark):
    state = golden(spark)
    doc = doc_of(state).select("schema_id", "doc", canonical.fingerprint(F.col("doc")).alias("f")).first()
    schema = json.loads(doc.doc)
    assert doc.f == FINGERPRINT
    assert doc.doc == json.dumps(schema, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    # written otherwise and read back, it is the same
    loose = json.dumps({"schema": schema, "format": 1, "fingerprint": "x"}, indent=1)
    parsed = read_snapshots(spark.createDataFrame([("s", loose)], "schema_id string, doc string"))[0]
    assert parsed.select(canonical.fingerprint(canonical.document_json(F.col("d"))).alias("f")).first().f == FINGERPRINT
    again = canonical.exploded(parsed)
    assert doc_of(again).first().doc == doc.doc
    leaves = lambda df: sorted(map(tuple, df.collect()))
    assert leaves(hashtree.leaves(state)) == leaves(hashtree.document_leaves(parsed)) and len(leaves(hashtree.leaves(again))) == 13
    assert diff.schema_diff(state, again).count() == 0


def test_only_leaves_that_differ_are_compared(spark):
    now = golden(spark)
    base = dict(now)
    base["notes"] = now["notes"].withColumn("text", F.when(F.col("note_id") == "note-global", "other").otherwise(F.col("text")))
    base["groups"] = now["groups"].where("group_id <> 'g-core'")
    base["columns"] = now["columns"].withColumn("type", F.when((F.col("table_name") == "posts") & (F.col("name") == "body"), "string").otherwise(F.col("type")))
    moved = hashtree.changed_leaves(hashtree.leaves(now), hashtree.leaves(base))
    assert sorted(map(tuple, moved.select("kind", "item", "change").collect())) == [("group", "g-core", "added"), ("note", "note-global", "changed"), ("table", "posts", "changed")]
    under = hashtree.of_leaves(now, moved)
    assert {k: df.count() for k, df in under.items()} == {"tables": 1, "columns": 8, "indexes": 1, "associations": 5, "notes": 1, "groups": 1}
    rows = diff.schema_diff(under, hashtree.of_leaves(base, moved)).select("level", "item", "change", "field").collect()
    assert sorted(map(tuple, rows), key=str) == [("column", "body", "changed", "type"), ("group", "g-core", "added", None), ("note", "note-global", "changed", "text")]
    got = diff.gate(now, base).first()
    assert (got.changed, got.n_leaves, got.n_items) == (True, 3, 3)
    same = diff.gate(now, now).first()
    assert (same.changed, same.n_leaves, same.n_items) == (False, 0, 0)
