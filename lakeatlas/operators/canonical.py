"""The canonical form of a schema, its JSON, and its fingerprint.

JSON keys are sorted at every level, absent facts are left out, and there is no space between tokens, so that the same schema
always gives the same bytes. One row for each schema; tables are turned to JSON first, each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLE = ["schema_id", "table_name"]
PROVENANCES = ("declared", "manual", "db_fk", "schema_fk", "inferred")
#: Columns of indexes and associations beside those of their table.
INDEX_ROWS = "name string, columns array<string>, unique boolean"
EDGE_ROWS = "type string, name string, target string, foreign_key string, through string, polymorphic boolean, provenance string, sources array<struct<kind:string,provider:string>>"


def nothing(tables: DataFrame, ddl: str) -> DataFrame:
    """A relation of tables without rows; Spark leaves out joins with it."""
    own = StructType.fromDDL(ddl)
    return tables.select(*TABLE, *(F.lit(None).cast(f.dataType).alias(f.name) for f in own)).limit(0)


def blank(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def column_struct(columns: list[str]) -> Column:
    """Name, type and nullable always; other facts where they say something."""
    has = lambda c: blank(c).alias(c) if c in columns else F.lit(None).cast("string").alias(c)
    return F.struct(has("comment"), has("default"), has("extra"), "name", "nullable", F.when(F.col("primary"), True).alias("primary"), has("sql_type"), "type")


def index_struct() -> Column:
    return F.struct("columns", blank("name").alias("name"), "unique")


def _sources(x: Column) -> Column:
    """Each (kind, provider) once, in order; none where there is none."""
    return F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x)))


def association_struct() -> Column:
    return F.struct(
        blank("foreign_key").alias("foreign_key"),
        blank("name").alias("name"),
        F.when(F.col("polymorphic"), True).alias("polymorphic"),
        "provenance",
        _sources(F.col("sources")).alias("sources"),
        "target",
        blank("through").alias("through"),
        "type",
    )


def association_order() -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.struct(
        text("type"),
        text("name"),
        text("foreign_key"),
        text("target"),
        text("through"),
        F.coalesce("polymorphic", F.lit(False)),
        text("provenance"),
        F.to_json(association_struct()),
    )


def _listed(df: DataFrame, item: Column, order: Column, name: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("v"))))
    return df.groupBy(*TABLE).agg(pairs.getField("v").alias(name))


def lower_escapes(json: Column) -> Column:
    """Control characters as backslash-u with lower-case digits."""
    lowered = json
    for a in "ABCDEF":
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*\\u00[01]){a}", f"$1{a.lower()}")
    return F.when(F.contains(json, F.lit("\\u00")), lowered).otherwise(json)  # most texts have none and are not walked


def table_json(tables: DataFrame, columns: DataFrame, indexes: DataFrame, associations: DataFrame) -> DataFrame:
    """(schema_id, table_name, json): canonical JSON of each table. ``associations`` have array columns ``sources``."""
    cols = _listed(columns, column_struct(columns.columns), F.struct("pos"), "columns")
    ixs = _listed(indexes, index_struct(), F.struct(F.coalesce("name", F.lit("")), "columns", "unique"), "indexes")
    edges = _listed(associations, association_struct(), association_order(), "associations")
    joined = tables.select(*TABLE, "comment").join(cols, TABLE, "left").join(ixs, TABLE, "left").join(edges, TABLE, "left")
    none = lambda df, c: F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(c)
    doc = F.struct(none(edges, "associations"), none(cols, "columns"), blank("comment").alias("comment"), none(ixs, "indexes"))
    return joined.select(*TABLE, lower_escapes(F.to_json(doc)).alias("json"))


def _piece(key: str, value: Column, always: bool = False) -> Column:
    """``"key":value`` of a JSON object; a null is left out, or said where it is to be there ``always``."""
    whole = F.to_json(F.struct(value.alias(key)))
    own = F.nullif(F.substr(whole, F.lit(2), F.length(whole) - 2), F.lit(""))
    return F.coalesce(own, F.lit(f'"{key}":null')) if always else own


def note_text(n: Column) -> Column:
    """Canonical JSON of a resolved note. One on a relation says all that its edge has, nulls included; titles and links are
    there where they say something; links keep their order."""
    text = lambda k: F.nullif(n[k], F.lit(""))
    links = F.when(F.size(n["links"]) > 0, F.transform(n["links"], lambda x: F.struct(x["label"].alias("label"), x["url"].alias("url"))))
    on_edge, on_table = n["scope"] == "relation", n["scope"] == "table"
    own = lambda k: F.when(on_edge, _piece(k, n[k], True))
    parts = [
        own("foreign_key"),
        _piece("id", n["id"]),
        _piece("links", links),
        own("name"),
        F.when(on_edge, _piece("polymorphic", F.coalesce(n["polymorphic"], F.lit(False)))),
        _piece("scope", n["scope"]),
        own("source_table"),
        F.when(on_table, _piece("table", n["table"])),
        own("target"),
        _piece("text", n["text"]),
        own("through"),
        _piece("title", text("title")),
        own("type"),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def group_text(g: Column) -> Column:
    text = lambda k: F.nullif(g[k], F.lit("")).alias(k)
    return F.to_json(F.struct(text("color"), g["id"].alias("id"), F.array_sort(g["tables"]).alias("tables"), text("title")))


NOTE_FIELDS = ["foreign_key", "id", "links", "name", "polymorphic", "scope", "source_table", "table", "target", "text", "through", "title", "type"]
GROUP_FIELDS = ["color", "id", "tables", "title"]


def note_json(notes: DataFrame) -> DataFrame:
    """(schema_id, note_id, json) of resolved notes (columns as in ``exploded``)."""
    renamed = notes.withColumnsRenamed({"note_id": "id", "table_name": "table"})
    return renamed.select("schema_id", F.col("id").alias("note_id"), lower_escapes(note_text(F.struct(*NOTE_FIELDS))).alias("json"))


def group_json(groups: DataFrame) -> DataFrame:
    """(schema_id, group_id, json) of groups (schema_id, group_id, title, color, tables)."""
    renamed = groups.withColumnRenamed("group_id", "id")
    return renamed.select("schema_id", F.col("id").alias("group_id"), lower_escapes(group_text(F.struct(*GROUP_FIELDS))).alias("json"))


def _list_json(rows: DataFrame, key: str, name: str) -> DataFrame:
    entries = F.transform(F.array_sort(F.collect_list(F.struct(key, "json"))), lambda x: x["json"])
    return rows.groupBy("schema_id").agg(F.concat(F.lit(f'"{name}":['), F.array_join(entries, ","), F.lit("]")).alias(f"_{name}"))


def schema_json(tables: DataFrame, notes: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """(schema_id, doc): ``{"groups":[...],"notes":[...],"tables":{...}}`` from the JSON of tables in name order, and of notes and
    groups (``note_json``, ``group_json``) by id; lists without items are left out."""
    own = _tables_json(tables)
    for rows, key, name in ((groups, "group_id", "groups"), (notes, "note_id", "notes")):
        own = own.withColumn(f"_{name}", F.lit(None).cast("string")) if rows is None else own.join(_list_json(rows, key, name), "schema_id", "left")
    return own.select("schema_id", F.concat(F.lit("{"), F.concat_ws(",", "_groups", "_notes", F.substr("doc", F.lit(2)))).alias("doc"))


def _tables_json(tables: DataFrame) -> DataFrame:
    pair = F.concat(F.expr("substring(to_json(struct(table_name as k)), 6, length(to_json(struct(table_name as k))) - 6)"), F.lit(":"), F.col("json"))
    entries = F.sort_array(F.collect_list(F.struct("table_name", pair.alias("pair"))))
    return tables.groupBy("schema_id").agg(
        F.concat(F.lit('{"tables":{'), F.array_join(entries.getField("pair"), ","), F.lit("}}")).alias("doc")
    )


def fingerprint(doc: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit('{"format":1,"schema":'), doc, F.lit("}")), 256))


def _key_json(name: Column) -> Column:
    """A string as JSON, by way of an object that holds it."""
    whole = F.to_json(F.struct(name.alias("k")))
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _document_tables(d: Column) -> Column:
    """(k, json) of each table of a parsed snapshot, json being the canonical JSON of the table."""
    text = lambda x: F.nullif(x, F.lit(""))
    none = lambda x: F.coalesce(x, F.lit(""))

    def column(c: Column) -> Column:
        return F.struct(
            *(text(c[k]).alias(k) for k in ("comment", "default", "extra")),
            c["name"].alias("name"),
            c["nullable"].alias("nullable"),
            F.when(c["primary"], True).alias("primary"),
            text(c["sql_type"]).alias("sql_type"),
            c["type"].alias("type"),
        )

    def edge(e: Column) -> Column:
        own = F.struct(
            text(e["foreign_key"]).alias("foreign_key"),
            text(e["name"]).alias("name"),
            F.when(e["polymorphic"], True).alias("polymorphic"),
            e["provenance"].alias("provenance"),
            _sources(e["sources"]).alias("sources"),
            e["target"].alias("target"),
            text(e["through"]).alias("through"),
            e["type"].alias("type"),
        )
        order = F.struct(
            *(none(e[k]).alias(k) for k in ("type", "name", "foreign_key", "target", "through")),
            F.coalesce(e["polymorphic"], F.lit(False)).alias("polymorphic"),
            none(e["provenance"]).alias("provenance"),
            F.to_json(own).alias("json"),
        )
        return F.struct(order.alias("o"), own.alias("v"))

    def index(i: Column) -> Column:
        own = F.struct(i["columns"].alias("columns"), text(i["name"]).alias("name"), i["unique"].alias("unique"))
        return F.struct(F.struct(none(i["name"]).alias("name"), i["columns"].alias("columns"), i["unique"].alias("unique")).alias("o"), own.alias("v"))

    def listed(items: Column, f, ordered: bool) -> Column:
        found = F.transform(F.coalesce(items, F.array()), f)
        return F.transform(F.array_sort(found), lambda x: x["v"]) if ordered else found

    def table(e: Column) -> Column:
        t = e["value"]
        doc = F.struct(
            listed(t["associations"], edge, True).alias("associations"),
            listed(t["columns"], column, False).alias("columns"),
            text(t["comment"]).alias("comment"),
            listed(t["indexes"], index, True).alias("indexes"),
        )
        return F.struct(e["key"].alias("k"), F.to_json(doc).alias("json"))

    return F.array_sort(F.transform(F.map_entries(d["schema"]["tables"]), table))


def _document_items(d: Column, name: str) -> Column:
    """(k, json) of each note or group of a parsed snapshot."""
    text = {"notes": note_text, "groups": group_text}[name]
    return F.array_sort(F.transform(d["schema"][name], lambda x: F.struct(x["id"].alias("k"), text(x).alias("json"))))


def document_leaves(d: Column) -> Column:
    """(kind, item, hash) of each table, note and group of a parsed snapshot: hashes of their canonical JSON."""
    parts = [("table", _document_tables(d)), ("note", _document_items(d, "notes")), ("group", _document_items(d, "groups"))]
    leaf = lambda kind: lambda e: F.struct(F.lit(kind).alias("kind"), e["k"].alias("item"), F.sha2(lower_escapes(e["json"]), 256).alias("hash"))
    none = F.array().cast("array<struct<kind:string,item:string,hash:string>>")
    return F.concat(*(F.coalesce(F.transform(x, leaf(kind)), none) for kind, x in parts))


def document_json(d: Column) -> Column:
    """The canonical JSON of a parsed snapshot's schema (``d`` in the form SNAPSHOT), whatever way it was written; null where it
    has no tables."""

    def items(name: str) -> Column:
        own = _document_items(d, name)
        return F.when(F.size(own) > 0, F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(own, lambda e: e["json"]), ","), F.lit("]")))

    tables = F.transform(_document_tables(d), lambda e: F.concat(_key_json(e["k"]), F.lit(":"), e["json"]))
    in_tables = F.concat(F.lit('"tables":{'), F.array_join(tables, ","), F.lit("}"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", items("groups"), items("notes"), in_tables), F.lit("}"))
    return F.when(in_tables.isNotNull(), lower_escapes(whole))


def snapshot(doc: Column) -> Column:
    return F.concat(F.lit('{"fingerprint":"'), fingerprint(doc), F.lit('","format":1,"schema":'), doc, F.lit("}"))


def unknown_provenance(associations: DataFrame) -> DataFrame:
    return associations.where(~F.col("provenance").isin(*PROVENANCES) | F.col("provenance").isNull()).select(*TABLE, "name", "provenance")


#: Spark schema of a snapshot document.
_EDGE_STRUCT = "STRUCT<foreign_key: STRING, name: STRING, polymorphic: BOOLEAN, provenance: STRING, sources: ARRAY<STRUCT<kind: STRING, provider: STRING>>, target: STRING, through: STRING, type: STRING>"
_COLUMN_STRUCT = "STRUCT<comment: STRING, default: STRING, extra: STRING, name: STRING, nullable: BOOLEAN, primary: BOOLEAN, sql_type: STRING, type: STRING>"
_NOTE_STRUCT = "STRUCT<foreign_key: STRING, id: STRING, links: ARRAY<STRUCT<label: STRING, url: STRING>>, name: STRING, polymorphic: BOOLEAN, scope: STRING, source_table: STRING, table: STRING, target: STRING, text: STRING, through: STRING, title: STRING, type: STRING>"
_GROUP_STRUCT = "STRUCT<color: STRING, id: STRING, tables: ARRAY<STRING>, title: STRING>"
SNAPSHOT = f"format INT, fingerprint STRING, schema STRUCT<groups: ARRAY<{_GROUP_STRUCT}>, notes: ARRAY<{_NOTE_STRUCT}>, tables: MAP<STRING, STRUCT<associations: ARRAY<{_EDGE_STRUCT}>, columns: ARRAY<{_COLUMN_STRUCT}>, comment: STRING, indexes: ARRAY<STRUCT<columns: ARRAY<STRING>, name: STRING, unique: BOOLEAN>>>>>"


def exploded(docs: DataFrame) -> dict[str, DataFrame]:
    """Parsed documents (schema_id, d in the form SNAPSHOT) as relations: tables, columns, indexes, associations, notes, groups."""
    t = docs.select("schema_id", F.explode("d.schema.tables").alias("table_name", "t"))
    item = lambda c: t.select(*TABLE, F.posexplode(f"t.{c}").alias("pos", "x")).select(*TABLE, "pos", "x.*")
    tables = t.select(*TABLE, F.col("t.comment").alias("comment"))
    return {
        "tables": tables,
        "columns": item("columns").withColumn("primary", F.coalesce("primary", F.lit(False))),
        "indexes": item("indexes"),
        "associations": item("associations").withColumn("polymorphic", F.coalesce("polymorphic", F.lit(False))),
        "notes": docs.select("schema_id", F.explode("d.schema.notes").alias("x")).select("schema_id", "x.*").withColumnsRenamed({"id": "note_id", "table": "table_name"}),
        "groups": docs.select("schema_id", F.explode("d.schema.groups").alias("x")).select("schema_id", "x.*").withColumnRenamed("id", "group_id"),
    }
