import json

from lakeatlas.operators import edges
from lakeatlas.sources.configs import config_fragments, relation_notes, source_layers
from lakeatlas.sources.documents import order_layers

CONFIG = {
    "version": 1,
    "infer_fk": True,
    "only": ["a*"],
    "colour": "blue",
    "table_map": {"Person": "people"},
    "relations": [
        {"table": "posts", "column": "author_id", "references": "users", "name": "writer"},
        {"table": "posts", "column": "editor_id", "references": "users", "one_to_one": True, "through": "x"},
    ],
    "sources": [
        {"id": "app", "type": "rails.project", "path": "/srv/app/"},
        {"id": "doc", "type": "dbml", "path": "/srv/a.dbml", "allow_empty": True, "glob": "*"},
    ],
    "tables": {
        "posts": {
            "comment": None,
            "columns": [{"name": "id", "default": None, "nullable": False, "lenght": 4}, {"name": "t", "type": "text", "drop": True}],
            "primary_key": "id",
            "associations": [{"type": "belongs_to", "name": "u", "target": "users", "foreign_key": None}],
            "columns_mode": "replace",
        },
        "users": {"primary_key": ["a", "b"], "indexes": [{"columns": ["a"], "unique": True}]},
        "gone": {"drop": True},
    },
    "notes": [
        {"id": "g", "target": {"type": "global"}, "text": "x", "links": [{"url": "https://a", "label": "l", "rel": "y"}]},
        {"id": "t", "target": {"type": "table", "table": "posts", "name": "n"}, "text": "x", "title": "T"},
        {"id": "all", "target": {"type": "relation", "source_table": "posts", "target_table": "users"}, "text": "x"},
        {"id": "null", "target": {"type": "relation", "source_table": "posts", "target_table": "users", "foreign_key": None}, "text": "x"},
        {"id": "role", "target": {"type": "relation", "source_table": "posts", "target_table": "users", "assoc_type": "has_one", "polymorphic": False, "name": "u", "through": None}, "text": "x"},
        {"id": "odd", "target": {"type": "column"}, "text": "x"},
    ],
    "groups": [{"id": "g1", "tables": ["posts"], "title": None, "color": "#fff", "layout": 1}],
}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_a_config_document_with_all_fields(spark):
    docs = spark.createDataFrame([("s", 3, json.dumps(CONFIG)), ("bad", 1, "{"), ("list", 1, "[1]"), ("none", 1, None)], "schema_id string, layer_seq int, content string")
    f = config_fragments(docs)
    assert rows(f["tables"], "table_name", "present", "primary_key", "drop", "columns_mode") == [
        ("gone", [], [], True, None),
        ("posts", ["comment", "primary_key"], ["id"], False, "replace"),
        ("users", ["primary_key"], ["a", "b"], False, None),
    ]
    assert rows(f["columns"], "pos", "name", "present", "nullable", "default", "drop", "mode") == [(0, "id", ["nullable", "default"], False, None, None, "replace"), (1, "t", ["type"], None, None, True, "replace")]
    assert rows(f["associations"], "name", "present") == [("u", ["type", "name", "target", "foreign_key"])]
    assert rows(f["relations"], "table_name", "column_name", "target", "name", "one_to_one") == [("posts", "author_id", "users", "writer", None), ("posts", "editor_id", "users", None, True)]
    assert rows(edges.config_relations(f["relations"], f["indexes"]), "type", "name", "foreign_key") == [("belongs_to", "writer", "author_id"), ("has_one", "editor", "editor_id")]
    assert rows(f["notes"], "note_id", "scope", "present") == [
        ("all", "relation", []),
        ("g", "global", []),
        ("null", "relation", ["foreign_key"]),
        ("odd", "column", []),
        ("role", "relation", ["name", "through", "type", "polymorphic"]),
        ("t", "table", []),
    ]
    assert rows(f["groups"], "group_id", "tables", "title", "color") == [("g1", ["posts"], None, "#fff")]
    assert rows(f["table_map"], "model", "table_name") == [("Person", "people")]
    assert rows(f["options"], "infer_fk", "only", "exclude") == [(True, ["a*"], None)]
    assert rows(f["warnings"], "schema_id", "path", "message") == [
        ("bad", "", "not a JSON object"),
        ("list", "", "not a JSON object"),
        ("none", "", "not a JSON object"),
        ("s", "colour", "unknown key"),
        ("s", "groups[0].layout", "unknown key"),
        ("s", "notes[0].links[0].rel", "unknown key"),
        ("s", "notes[1].target.name", "unknown key"),
        ("s", "notes[5].target.type", "unknown scope"),
        ("s", "relations[1].through", "unknown key"),
        ("s", "sources[1].glob", "unknown key"),
        ("s", "tables.posts.columns[0].lenght", "unknown key"),
    ]
    layers = order_layers(source_layers(f["sources"]))
    assert rows(layers, "layer_seq", "provider", "location") == [(0, "rails.schema", "/srv/app/db/schema.rb"), (1, "rails.models", "/srv/app/app/models"), (2, "dbml", "/srv/a.dbml")]


def test_notes_of_a_document_mean_one_edge(spark):
    docs = spark.createDataFrame([("s", 3, json.dumps(CONFIG))], "schema_id string, layer_seq int, content string")
    data = [("s", "posts", "has_one", "u", "users", "u_id", None, None), ("s", "posts", "has_many", "us", "users", None, None, False)]
    es = spark.createDataFrame(data, "schema_id string, table_name string, type string, name string, target string, foreign_key string, through string, polymorphic boolean")
    good, bad = edges.resolve_notes(relation_notes(config_fragments(docs)["notes"]), es)
    assert rows(good, "note_id", "name") == [("null", "us"), ("role", "u")] and rows(bad, "note_id", "n") == [("all", 2)]


def test_no_documents(spark):
    docs = spark.createDataFrame([], "schema_id string, layer_seq int, content string")
    assert all(df.count() == 0 for df in config_fragments(docs).values())


def test_documents_are_parsed_once_and_only_for_what_is_wanted(spark):
    odd = [("null", "null"), ("text", '"a"'), ("number", "1"), ("list", "[{}]"), ("empty", "{}"), ("tilde", '{"~": null}')]
    docs = spark.createDataFrame([("s", 0, json.dumps(CONFIG)), *((n, 0, t) for n, t in odd)], "schema_id string, layer_seq int, content string")
    every = config_fragments(docs)
    for name, df in every.items():
        assert "parse_json" not in df._jdf.queryExecution().toString()
        one = config_fragments(docs, [name])
        assert list(one) == [name]
        assert sorted(map(str, one[name].collect())) == sorted(map(str, df.collect()))
    told = {r.schema_id for r in every["warnings"].where("message = 'not a JSON object'").collect()}
    assert told == {"null", "text", "number", "list"}
