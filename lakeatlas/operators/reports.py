"""Report tables, and schemas as text: digest, DBML, Mermaid and PlantUML.

Texts are put together per table first and per schema last, so that a schema's task holds one string for each table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeatlas.functions.names import blank_to_null, dbml_default, dbml_name, one_line
from lakeatlas.operators.merge import TABLE

IDENTIFIER = "^[A-Za-z0-9_]+$"


def numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("schema_id").orderBy(*order)))


def key_label(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """Add key: PK, else FK where an edge uses the column, else ''. The keys of a table are gathered first, so that columns that
    are dealt by table stay where they are."""
    fks = edges.where("foreign_key IS NOT NULL").groupBy(*TABLE).agg(F.collect_set("foreign_key").alias("_fks"))
    key = F.when(F.col("primary"), "PK").when(F.array_contains("_fks", F.col("name")), "FK").otherwise("")
    return columns.join(fks, TABLE, "left").withColumn("key", key).drop("_fks")


def dictionary(columns: DataFrame, edges: DataFrame) -> DataFrame:
    """(schema_id, table_name, pos, column_name, type, nullable YES/NO, default, key, extra, comment)."""
    c = key_label(columns, edges)
    text = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x) if x in c.columns else F.lit("").alias(x)
    kind = F.coalesce(blank_to_null(F.col("sql_type")), F.col("type")) if "sql_type" in c.columns else F.col("type")
    return c.select(
        *TABLE,
        "pos",
        F.col("name").alias("column_name"),
        kind.alias("type"),
        F.when(F.col("nullable"), "YES").otherwise("NO").alias("nullable"),
        text("default"),
        "key",
        text("extra"),
        text("comment"),
    )


def group_labels(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(schema_id, table_name, label): title of a table's group, else its id."""
    label = F.coalesce(blank_to_null(F.col("title")), F.col("group_id"))
    return members.join(groups, ["schema_id", "group_id"]).select(*TABLE, label.alias("label"))


def table_overview(tables: DataFrame, columns: DataFrame, indexes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(schema_id, n, table_name, comment, n_columns, n_indexes, schema_missing[, group_label])."""
    count = lambda df, c: df.groupBy(*TABLE).agg(F.count("*").alias(c))
    out = tables.select(*TABLE, "comment").join(count(columns, "n_columns"), TABLE, "left").join(count(indexes, "n_indexes"), TABLE, "left")
    out = out.na.fill(0, ["n_columns", "n_indexes"]).withColumn(
        "comment",
        F.coalesce("comment", F.lit("")),
    ).withColumn("schema_missing", F.col("n_columns") == 0)
    if labels is not None:
        out = out.join(labels.withColumnRenamed("label", "group_label"), TABLE, "left").na.fill("", ["group_label"])
    return numbered(out, "table_name")


def index_list(indexes: DataFrame) -> DataFrame:
    return indexes.select(
        *TABLE,
        F.coalesce("name", F.lit("")).alias("name"),
        F.array_join("columns", ", ").alias("columns"),
        F.when(F.col("unique"), "UNIQUE").otherwise("").alias("unique"),
    )


def via(provenance: Column) -> Column:
    return F.when(provenance == "db_fk", "DB FK").when(
        provenance == "schema_fk",
        "schema FK",
    ).when(provenance == "inferred", "inferred").when(provenance == "manual", "manual").otherwise("code")


def association_list(edges: DataFrame) -> DataFrame:
    return edges.select(*TABLE, "type", "name", "target", via(F.col("provenance")).alias("via"))


def note_list(notes: DataFrame) -> DataFrame:
    """(schema_id, note_id, target, title, text, links) in id order; links are an array of (label, url)."""
    target = F.when(F.col("scope") == "global", "global").when(
        F.col("scope") == "table",
        F.col("table_name"),
    ).otherwise(F.concat_ws(" → ", "source_table", "target"))
    links = F.array_join(
        F.transform("links", lambda x: F.when(F.coalesce(x["label"], F.lit("")) != "", F.concat(x["label"], F.lit(": "), x["url"])).otherwise(x["url"])),
        "; ",
    )
    return notes.select(
        "schema_id",
        "note_id",
        target.alias("target"),
        F.coalesce("title", F.lit("")).alias("title"),
        "text",
        F.coalesce(links, F.lit("")).alias("links"),
    )


def group_list(groups: DataFrame, members: DataFrame) -> DataFrame:
    by = members.groupBy("schema_id", "group_id").agg(F.array_join(F.array_sort(F.collect_list("table_name")), ", ").alias("tables"))
    return groups.join(by, ["schema_id", "group_id"], "left").select(
        "schema_id",
        "group_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("color", F.lit("")).alias("color"),
        F.coalesce("tables", F.lit("")).alias("tables"),
    )


def _lines(df: DataFrame, order: Column, line: Column, name: str, sep: str = "\n") -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("v"))))
    return df.groupBy(*TABLE).agg(F.array_join(pairs.getField("v"), sep).alias(name))


def _per_schema(blocks: DataFrame, sep: str) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.struct("table_name", "block"))).getField("block"), sep)


def edge_token(edges: DataFrame) -> Column:
    through = blank_to_null(F.col("through")) if "through" in edges.columns else F.lit(None).cast("string")
    poly = F.col("polymorphic") if "polymorphic" in edges.columns else F.lit(False)
    name = F.when(F.coalesce(F.col("name"), F.lit("")).isin("") | (F.col("name") == F.col("target")), None).otherwise(F.concat(F.lit("as "), F.col("name")))
    return F.concat_ws(
        " ",
        "type",
        "target",
        name,
        F.when(F.coalesce(F.col("foreign_key"), F.lit("")) != "", F.concat(F.lit("fk="), F.col("foreign_key"))),
        F.concat(F.lit("through "), through),
        F.when(poly, "(poly)"),
    )


def edge_order(edges: DataFrame) -> Column:
    return F.struct(
        *(
            F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
                "type",
                "name",
                "foreign_key",
                "target",
                "through",
                "polymorphic",
                "provenance",
            ) if c in edges.columns
        )
    )


def note_text(notes: DataFrame) -> Column:
    """A note in one line, after its title where it has one."""
    return F.concat(F.coalesce(F.concat(blank_to_null(F.col("title")), F.lit(": ")), F.lit("")), one_line(F.col("text")))


RELATION = ["type", "name", "foreign_key", "through", "polymorphic"]


def _with_relation_notes(edges: DataFrame, notes: DataFrame | None) -> tuple[DataFrame, Column]:
    """Edges with the notes that are on them, and what a digest adds to an edge's token."""
    if notes is None:
        return edges, F.lit("")
    own = notes.where("scope = 'relation'").withColumn("polymorphic", F.coalesce("polymorphic", F.lit(False)))
    by = own.groupBy("schema_id", F.col("source_table").alias("table_name"), *RELATION).agg(
        F.array_sort(F.collect_list(F.struct("note_id", note_text(own).alias("t")))).alias("_notes")
    )
    same = [F.col(f"e.{c}") == F.col(f"n.{c}") for c in TABLE] + [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in RELATION]
    held = edges.withColumn("polymorphic", F.coalesce("polymorphic", F.lit(False)))
    out = held.alias("e").join(by.alias("n"), same, "left").select("e.*", "n._notes")
    quoted = F.array_join(F.transform("_notes", lambda x: F.concat(F.lit('"'), x["t"], F.lit('"'))), "; ")
    return out, F.coalesce(F.concat(F.lit(" — "), quoted), F.lit(""))


def digest(
    tables: DataFrame,
    columns: DataFrame,
    edges: DataFrame,
    verbose: bool = False,
    title: str | None = None,
    notes: DataFrame | None = None,
) -> DataFrame:
    """(schema_id, text): Markdown with a line for each column and one for the relations of each table.

    ``notes``: resolved ones (schema_id, note_id, scope, title, text, table_name, source_table and the edge's keys). Global
    notes stand before the tables, a table's under its heading, a relation's after its edge.
    """
    targets = edges.where("foreign_key IS NOT NULL").groupBy(*TABLE, F.col("foreign_key").alias("name")).agg(F.max_by("target", edge_order(edges)).alias("_fk"))
    c = columns.join(targets, [*TABLE, "name"], "left")
    more = []
    if verbose:
        sql = blank_to_null(F.col("sql_type")) if "sql_type" in columns.columns else F.lit(None).cast("string")
        more = [F.when(F.col("nullable"), "null"), F.concat(F.lit("default="), blank_to_null(F.col("default"))), sql]
    comment = F.when(F.coalesce(F.col("comment"), F.lit("")) != "", F.concat(F.lit('"'), one_line(F.col("comment")), F.lit('"')))
    line = F.concat(
        F.lit("- "),
        F.col("name"),
        F.lit(": "),
        F.concat_ws(", ", "type", F.when(F.col("primary"), "pk"), F.concat(F.lit("fk→"), F.col("_fk")), *more, comment),
    )
    cols = _lines(c, F.col("pos"), line, "cols")
    own, noted = _with_relation_notes(edges, notes)
    rels = _lines(own, edge_order(own), F.concat(edge_token(own), noted), "rels", ", ")
    head = F.concat(F.lit("### "), F.col("table_name"), F.coalesce(F.concat(F.lit("  — "), one_line(blank_to_null(F.col("comment")))), F.lit("")))
    joined = tables.select(*TABLE, "comment").join(cols, TABLE, "left").join(rels, TABLE, "left")
    if notes is None:
        joined = joined.withColumn("said", F.lit(None).cast("string"))
    else:
        of_table = notes.where("scope = 'table'")
        joined = joined.join(_lines(of_table, F.col("note_id"), F.concat(F.lit("_"), note_text(of_table), F.lit("_")), "said"), TABLE, "left")
    blocks = joined.select(*TABLE, F.concat_ws("\n", head, "said", "cols", F.concat(F.lit("Rel: "), F.col("rels"))).alias("block"))
    by = blocks.groupBy("schema_id").agg(F.count("*").cast("string").alias("n"), _per_schema(blocks, "\n\n").alias("body"))
    top = F.lit(f"# {title} — schema digest" if title else "# Schema digest")
    if notes is not None:
        everywhere = notes.where("scope = 'global'")
        by = by.join(
            everywhere.groupBy("schema_id").agg(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(F.struct("note_id", note_text(everywhere).alias("t")))), lambda x: x["t"]),
                    "\n\n",
                ).alias("_global")
            ),
            "schema_id",
            "left",
        )
        top = F.concat(top, F.coalesce(F.concat(F.lit("\n\n"), F.col("_global")), F.lit("")))
    return by.select("schema_id", F.concat(top, F.lit("\n\n## Tables ("), F.col("n"), F.lit(")\n\n"), F.col("body"), F.lit("\n")).alias("text"))


def config_note() -> Column:
    """A resolved note in the form of a config document. A relation's target has all keys that narrow it, null where the edge
    has none, so that it means this edge only."""
    kind = F.when(
        F.col("scope") == "relation",
        F.to_json(
            F.struct(
                F.col("type").alias("assoc_type"),
                "foreign_key",
                "name",
                F.coalesce("polymorphic", F.lit(False)).alias("polymorphic"),
                "source_table",
                F.col("target").alias("target_table"),
                "through",
                F.lit("relation").alias("type"),
            ),
            {"ignoreNullFields": "false"},
        ),
    )
    target = kind.when(
        F.col("scope") == "table",
        F.to_json(F.struct(F.col("table_name").alias("table"), F.lit("table").alias("type"))),
    ).otherwise(F.lit('{"type":"global"}'))
    part = lambda c: F.substr(F.to_json(F.struct(c)), F.lit(2), F.length(F.to_json(F.struct(c))) - 2)
    links = F.when(F.size("links") > 0, part(F.col("links")))
    fields = F.concat_ws(
        ",",
        part(F.col("note_id").alias("id")),
        links,
        F.concat(F.lit('"target":'), target),
        part(F.col("text")),
        F.when(F.coalesce("title", F.lit("")) != "", part(F.col("title"))),
    )
    return F.concat(F.lit("{"), fields, F.lit("}"))


def config_notes(notes: DataFrame) -> DataFrame:
    """(schema_id, note_id, json) of resolved notes."""
    return notes.select("schema_id", "note_id", config_note().alias("json"))


def config_document(
    tables: DataFrame,
    columns: DataFrame,
    indexes: DataFrame,
    edges: DataFrame,
    notes: DataFrame | None = None,
    groups: DataFrame | None = None,
    edge_note: Column | None = None,
) -> DataFrame:
    """(schema_id, doc): merged schemas as config documents to author from, keys sorted at every level.

    Provenance and sources are left out, for a config layer has none of its own; two or more primary columns, in column
    order, become the table's primary_key. ``edges`` are pruned ones; ``groups(schema_id, group_id, tables, title, color)``.
    ``edge_note``: a note on each edge, as a struct (note_id, title, text, links) of the edge's columns, in which blanks are null.

    Rows are dealt by schema once, as they are, and all JSON is made where they arrive.
    """
    from lakeatlas.operators import canonical as c

    edge = F.struct(
        c.blank("foreign_key").alias("foreign_key"),
        c.blank("name").alias("name"),
        F.when(F.col("polymorphic"), True).alias("polymorphic"),
        "target",
        c.blank("through").alias("through"),
        "type",
    )
    pieces = [
        tables.select(*TABLE, F.struct(c.blank("comment").alias("comment")).alias("_table")),
        columns.select(*TABLE, F.struct("pos", c.column_struct(columns.columns).alias("v")).alias("_column")),
        indexes.select(*TABLE, c.index_struct().alias("_index")),
        edges.select(*TABLE, edge.alias("_edge")),
    ]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces).repartition("schema_id")
    entry = F.struct("note_id", "json").alias("_note")
    if edge_note is None:
        every = every.withColumn("_note", F.lit(None).cast("struct<note_id:string,json:string>"))
    else:
        noted = every.select("*", "_edge.*", F.col("table_name").alias("source_table")).withColumn("n", F.when(F.col("_edge").isNotNull(), edge_note))
        noted = noted.withColumns({f: F.col(f"n.{f}") for f in ("note_id", "title", "text", "links")} | {"scope": F.lit("relation")})
        every = noted.select(*every.columns, F.when(F.col("n").isNotNull(), F.struct("note_id", config_note().alias("json"))).alias("_note"))
    by = every.groupBy(*TABLE).agg(F.max("_table").alias("_table"), *(F.collect_list(x).alias(x) for x in ("_column", "_index", "_edge", "_note")))

    text = lambda x: F.coalesce(x, F.lit(""))
    values = lambda pairs: F.transform(F.sort_array(pairs), lambda x: x["v"])
    by_name = lambda x: F.struct(F.struct(text(x["name"]).alias("name"), x["columns"].alias("columns"), x["unique"].alias("unique")).alias("o"), x.alias("v"))
    by_kind = lambda x: F.struct(F.struct(*(text(x[k]).alias(k) for k in ("type", "name", "foreign_key", "target", "through")), F.coalesce(x["polymorphic"], F.lit(False)).alias("polymorphic")).alias("o"), x.alias("v"))
    keys = F.array_sort(F.transform(F.filter("_column", lambda x: x["v"]["primary"]), lambda x: F.struct(x["pos"].alias("pos"), x["v"]["name"].alias("name"))))
    doc = F.struct(
        values(F.transform("_edge", by_kind)).alias("associations"),
        values(F.col("_column")).alias("columns"),
        F.col("_table.comment").alias("comment"),
        values(F.transform("_index", by_name)).alias("indexes"),
        F.when(F.size(keys) >= 2, F.transform(keys, lambda x: x["name"])).alias("primary_key"),
    )
    there = F.col("_table").isNotNull()
    pair = F.when(there, F.struct("table_name", F.concat(c._key_json(F.col("table_name")), F.lit(":"), c.lower_escapes(F.to_json(doc))).alias("pair")))
    out = by.select("schema_id", pair.alias("_pair"), "_note").groupBy("schema_id").agg(
        F.sort_array(F.collect_list("_pair")).getField("pair").alias("_pairs"),
        F.flatten(F.collect_list("_note")).alias("_noted"),
    ).where(F.size("_pairs") > 0)
    listed = lambda items, name: F.when(F.size(items) > 0, F.concat(F.lit(f'"{name}":['), F.array_join(F.transform(F.array_sort(items), lambda x: x["json"]), ","), F.lit("]")))
    said = F.col("_noted")
    if notes is not None:
        own = config_notes(notes.repartition("schema_id")).groupBy("schema_id").agg(F.collect_list(entry).alias("_own"))
        out = out.join(own, "schema_id", "left")
        said = F.concat("_noted", F.coalesce("_own", F.array().cast("array<struct<note_id:string,json:string>>")))
    grouped = F.lit(None).cast("string")
    if groups is not None:
        g = F.to_json(
            F.struct(
                blank_to_null(F.col("color")).alias("color"),
                F.col("group_id").alias("id"),
                F.array_sort("tables").alias("tables"),
                blank_to_null(F.col("title")).alias("title"),
            )
        )
        out = out.join(groups.groupBy("schema_id").agg(F.collect_list(F.struct("group_id", g.alias("json"))).alias("_groups")), "schema_id", "left")
        grouped = listed(F.col("_groups"), "groups")
    in_tables = F.concat(F.lit('"tables":{'), F.array_join("_pairs", ","), F.lit("}"))
    return out.select("schema_id", F.concat(F.lit("{"), F.concat_ws(",", grouped, listed(said, "notes"), in_tables, F.lit('"version":1')), F.lit("}")).alias("doc"))


def write_dictionary(rows: DataFrame, path: str, sep: str = "\t") -> None:
    """A data dictionary as files of separated values with a header; quotes are doubled, and blanks at the ends stay."""
    rows.write.option("sep", sep).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace",
        False,
    ).csv(path)


def read_dictionary(spark, path: str, schema: str, sep: str = "\t") -> DataFrame:
    """What ``write_dictionary`` wrote; line ends inside values too."""
    found = spark.read.schema(schema).option("sep", sep).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\0").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return found.na.fill("")


def dbml(tables: DataFrame, columns: DataFrame, indexes: DataFrame, refs: DataFrame) -> DataFrame:
    """(schema_id, text). ``refs`` as edges.dbml_refs gives them."""
    single = indexes.where(
        F.col("unique") & (F.size("columns") == 1)
    ).groupBy(*TABLE).agg(F.collect_set(F.col("columns")[0]).alias("_uniques"))
    has = lambda x: F.coalesce(F.col(x), F.lit("")) if x in columns.columns else F.lit("")
    kind = F.coalesce(blank_to_null(has("sql_type")), F.col("type"))
    item = F.struct(
        "pos",
        "name",
        "primary",
        F.concat(F.lit("  "), dbml_name(F.col("name")), F.lit(" "), kind).alias("said"),
        F.when(F.lower(has("extra")).contains("auto_increment"), "increment").alias("increment"),
        F.when(~F.col("nullable"), "not null").alias("not_null"),
        F.when(has("default") != "", F.concat(F.lit("default: "), dbml_default(one_line(has("default"))))).alias("default"),
    )
    # a table's columns are gathered once: keys and lines are told from them, with no join for each column
    own = columns.groupBy(*TABLE).agg(F.array_sort(F.collect_list(item)).alias("_cols"))
    keys = F.transform(F.filter("_cols", lambda c: c["primary"]), lambda c: c["name"])

    def line(c: Column) -> Column:
        unique = F.when(F.coalesce(F.array_contains("_uniques", c["name"]), F.lit(False)), "unique")
        attrs = F.concat_ws(", ", F.when((F.size("_keys") == 1) & c["primary"], "pk"), c["increment"], c["not_null"], unique, c["default"])
        return F.concat(c["said"], F.when(attrs != "", F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise(""))

    quote = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
    attrs = F.concat_ws(", ", F.when(F.col("unique"), "unique"), F.concat(F.lit("name: "), quote(blank_to_null(F.col("name")))))
    ix_line = F.concat(
        F.lit("    ("),
        F.array_join(F.transform("columns", dbml_name), ", "),
        F.lit(")"),
        F.when(attrs != "", F.concat(F.lit(" ["), attrs, F.lit("]"))).otherwise(""),
    )
    ixs = _lines(indexes, F.struct(F.coalesce("name", F.lit("")), "columns", "unique"), ix_line, "ixs")
    joined = tables.select(*TABLE, "comment").join(own, TABLE, "left").join(single, TABLE, "left").join(ixs, TABLE, "left")
    joined = joined.withColumn("_keys", keys).withColumn("cols", F.array_join(F.transform("_cols", line), "\n"))
    composite = F.when(F.size("_keys") >= 2, F.concat(F.lit("    ("), F.array_join(F.transform("_keys", dbml_name), ", "), F.lit(") [pk]")))
    inside = F.concat_ws("\n", composite, "ixs")
    block = F.when(inside != "", F.concat(F.lit("\n  indexes {\n"), inside, F.lit("\n  }")))
    comment = blank_to_null(F.col("comment"))
    note = F.when(
        comment.isNotNull(),
        F.concat(F.lit("\n  Note: "), F.when(comment.contains("\n"), F.concat(F.lit("'''"), comment, F.lit("'''"))).otherwise(quote(comment))),
    )
    blocks = joined.select(
        *TABLE,
        F.concat(F.concat_ws("\n", F.concat(F.lit("Table "), dbml_name(F.col("table_name")), F.lit(" {")), "cols", block, note), F.lit("\n}")).alias("block"),
    )
    ref = F.concat(
        F.lit("Ref: "),
        dbml_name(F.col("table_name")),
        F.lit("."),
        dbml_name(F.col("foreign_key")),
        F.lit(" > "),
        dbml_name(F.col("target")),
        F.lit("."),
        dbml_name(F.col("target_column")),
    )
    by = refs.groupBy("schema_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("table_name", "foreign_key", "target", "target_column", ref.alias("v")))), lambda r: r["v"]),
            "\n",
        ).alias("refs")
    )
    text = blocks.groupBy("schema_id").agg(_per_schema(blocks, "\n\n").alias("t")).join(by, "schema_id", "left")
    return text.select("schema_id", F.concat(F.concat_ws("\n\n", "t", "refs"), F.lit("\n")).alias("text"))


def _relation_lines(display: DataFrame, alias, label: Column) -> DataFrame:
    swap = (F.col("kind") == "1n") & (F.col("many") == F.col("source"))
    left, right = F.when(swap, F.col("target")).otherwise(F.col("source")), F.when(swap, F.col("source")).otherwise(F.col("target"))
    arrow = F.when(F.col("kind") == "nn", "}o--o{").when(F.col("kind") == "11", "||--||").otherwise("||--o{")
    line = F.concat(alias(left), F.lit(" "), arrow, F.lit(" "), alias(right), label)
    return display.groupBy("schema_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", line.alias("v")))), lambda r: r["v"]).alias("edges"))


def mermaid(tables: DataFrame, columns: DataFrame, edges: DataFrame, display: DataFrame) -> DataFrame:
    """(schema_id, text). ``edges`` are pruned ones, ``display`` their display edges."""
    c = key_label(columns.where(F.col("name").rlike(IDENTIFIER)), edges)
    line = F.concat(
        F.lit("        "),
        F.coalesce(blank_to_null(F.col("type")), F.lit("string")),
        F.lit(" "),
        F.col("name"),
        F.when(F.col("key") != "", F.concat(F.lit(" "), F.col("key"))).otherwise(""),
    )
    cols = _lines(c, F.col("pos"), line, "cols")
    blocks = tables.select(*TABLE).join(cols, TABLE, "left").select(
        *TABLE,
        F.concat_ws("\n", F.concat(F.lit("    "), F.col("table_name"), F.lit(" {")), "cols", F.lit("    }")).alias("block"),
    )
    rel = _relation_lines(display, lambda x: x, F.concat(F.lit(' : "'), F.replace(F.col("label"), F.lit('"'), F.lit("'")), F.lit('"')))
    text = blocks.groupBy("schema_id").agg(_per_schema(blocks, "\n").alias("t")).join(rel, "schema_id", "left")
    return text.select(
        "schema_id",
        F.concat(F.concat_ws("\n", F.lit("erDiagram"), F.transform("edges", lambda e: F.concat(F.lit("    "), e)), "t"), F.lit("\n")).alias("text"),
    )


def plantuml_alias(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"))


def plantuml(tables: DataFrame, columns: DataFrame, edges: DataFrame, display: DataFrame) -> DataFrame:
    """(schema_id, text) as entity-relationship diagram."""
    c = key_label(columns.where(F.col("name").rlike(IDENTIFIER)), edges)
    kind = F.coalesce(blank_to_null(F.col("type")), F.lit("string"))
    rest = F.concat(
        F.lit("  "),
        F.when(F.col("nullable"), "").otherwise("* "),
        F.col("name"),
        F.lit(" : "),
        kind,
        F.when(F.col("key") == "FK", " <<FK>>").otherwise(""),
    )
    line = F.when(F.col("primary"), F.concat(F.lit("  * "), F.col("name"), F.lit(" : "), kind, F.lit(" <<PK>>"))).otherwise(rest)
    pk = _lines(c.where("primary"), F.col("pos"), line, "pk")
    others = _lines(c.where("NOT primary"), F.col("pos"), line, "others")
    alias = plantuml_alias(F.col("table_name"))
    comment = blank_to_null(F.col("comment"))
    shown = F.concat(
        F.replace(F.col("table_name"), F.lit('"'), F.lit("'")),
        F.coalesce(F.replace(F.concat(F.lit("（"), comment, F.lit("）")), F.lit('"'), F.lit("'")), F.lit("")),
    )
    head = F.when(
        comment.isNotNull() | (alias != F.col("table_name")),
        F.concat(F.lit('entity "'), shown, F.lit('" as '), alias, F.lit(" {")),
    ).otherwise(F.concat(F.lit("entity "), alias, F.lit(" {")))
    rule = F.when(F.col("pk").isNotNull() & F.col("others").isNotNull(), "  --")
    joined = tables.select(*TABLE, "comment").join(pk, TABLE, "left").join(others, TABLE, "left")
    blocks = joined.select(*TABLE, F.concat(F.concat_ws("\n", head, "pk", rule, "others"), F.lit("\n}\n")).alias("block"))
    rel = _relation_lines(
        display,
        plantuml_alias,
        F.when(F.col("label") != "", F.concat(F.lit(" : "), F.replace(F.col("label"), F.lit('"'), F.lit("'")))).otherwise(""),
    )
    text = blocks.groupBy("schema_id").agg(_per_schema(blocks, "\n").alias("t")).join(rel, "schema_id", "left")
    return text.select(
        "schema_id",
        F.concat(F.concat_ws("\n", F.lit("@startuml\nhide circle\nskinparam linetype ortho\n"), "t", "edges", F.lit("@enduml")), F.lit("\n")).alias("text"),
    )
