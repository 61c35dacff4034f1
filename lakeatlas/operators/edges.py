"""Relationships: from catalogue rows, reconciled with declared ones, inferred from names, and shown as a diagram's edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeatlas.functions.names import fk_stem, join_table, pluralize
from lakeatlas.operators.merge import TABLE

PAIR = ["schema_id", "a", "b"]


def ends(edges: DataFrame) -> DataFrame:
    """Add the unordered pair of tables."""
    return edges.withColumn("a", F.least("table_name", "target")).withColumn("b", F.greatest("table_name", "target"))


def unique_columns(indexes: DataFrame, of: list[str] = TABLE) -> DataFrame:
    """Columns which alone form a unique index."""
    return indexes.where(F.col("unique") & (F.size("columns") == 1)).select(*of, F.col("columns")[0].alias("foreign_key")).distinct()


def key_edges(keys: DataFrame, indexes: DataFrame, flag: str, of: list[str] = TABLE) -> DataFrame:
    """Keys (..., foreign_key, target) as edges: has_one where the column alone is unique, else belongs_to; the name is the
    column without _id."""
    single = unique_columns(indexes, of).withColumn("_one", F.lit(True))
    return keys.join(single, [*of, "foreign_key"], "left").select(
        *of,
        F.when(F.col("_one"), "has_one").otherwise("belongs_to").alias("type"),
        fk_stem(F.col("foreign_key")).alias("name"),
        "target",
        "foreign_key",
        F.lit(flag).alias("provenance"),
    )


def fk_associations(fk_rows: DataFrame, tables: DataFrame, indexes: DataFrame, flag: str = "db_fk") -> DataFrame:
    """Foreign-key rows (schema_id, table_name, column_name, ref_table) between known tables, as edges (``key_edges``)."""
    known = tables.select(*TABLE).distinct()
    both = fk_rows.join(known, TABLE, "left_semi").join(
        known.select("schema_id", F.col("table_name").alias("ref_table")),
        ["schema_id", "ref_table"],
        "left_semi",
    )
    return key_edges(both.select(*TABLE, F.col("column_name").alias("foreign_key"), F.col("ref_table").alias("target")), indexes, flag)


def config_relations(relations: DataFrame, indexes: DataFrame) -> DataFrame:
    """Config relations (schema_id, table_name, column_name, target, one_to_one[, name]) as manual edges; one without a name has
    that of its column."""
    named = F.nullif("name", F.lit("")) if "name" in relations.columns else F.lit(None).cast("string")
    single = unique_columns(indexes).withColumn("_one", F.lit(True))
    joined = relations.withColumnRenamed("column_name", "foreign_key").join(single, [*TABLE, "foreign_key"], "left")
    one = F.coalesce("one_to_one", F.lit(False)) | F.coalesce("_one", F.lit(False))
    return joined.select(
        *TABLE,
        F.when(one, "has_one").otherwise("belongs_to").alias("type"),
        F.coalesce(named, fk_stem(F.col("foreign_key"))).alias("name"),
        "target",
        "foreign_key",
        F.lit("manual").alias("provenance"),
    )


def reconcile(edges: DataFrame) -> DataFrame:
    """Drop database and schema-file keys which an explicit edge covers: same pair, and no or the same foreign key.

    Where a dropped key is has_one and no covering edge tells a cardinality, the covering belongs_to edges of its own table
    become has_one. All upgrades are seen from the state before any (SURVEY 2.13, note 4). One shuffle by table pair; the
    edges of a pair are those between two tables of one schema.
    """
    pair = Window.partitionBy(*PAIR)
    explicit = F.col("provenance").isin("declared", "manual")
    both = ends(edges).withColumn(
        "_covers",
        F.collect_set(F.when(explicit, F.struct(F.col("foreign_key").alias("fk"), F.col("type").alias("type")))).over(pair),
    )
    covering = F.filter("_covers", lambda c: c["fk"].isNull() | c["fk"].eqNullSafe(F.col("foreign_key")))
    is_fk = F.col("provenance").isin("db_fk", "schema_fk")
    dropped = is_fk & (F.size(covering) > 0)
    told = F.exists(covering, lambda c: F.coalesce(c["type"].isin("has_one", "has_many"), F.lit(False)))
    marked = both.withColumn("_dropped", dropped).withColumn(
        "_up",
        F.when(dropped & (F.col("type") == "has_one") & ~told, F.struct("table_name", "foreign_key")),
    )
    marked = marked.withColumn("_ups", F.collect_set("_up").over(pair))
    upgraded = F.exists(
        "_ups",
        lambda u: (u["table_name"] == F.col("table_name")) & (
            F.col("foreign_key").isNull() | F.coalesce(F.col("foreign_key") == u["foreign_key"], F.lit(False))
        ),
    )
    kind = F.when(explicit & (F.col("type") == "belongs_to") & upgraded, "has_one").otherwise(F.col("type"))
    kept = marked.where(~F.col("_dropped") & (is_fk | explicit | (F.col("provenance") == "inferred")))
    return kept.withColumn("type", kind).select(*edges.columns)


def infer_fks(tables: DataFrame, columns: DataFrame, indexes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges guessed from column names: ``<stem>_id`` to the table named by the plural of the stem, else by the stem.

    Not from primary columns, not to the own table, not where an edge exists in either direction. Of several columns to
    one target the first counts. Edges found here do not stand in each other's way but for that.
    """
    stems = columns.where(F.col("name").endswith("_id") & ~F.col("primary")).select(
        *TABLE,
        "pos",
        F.col("name").alias("foreign_key"),
        fk_stem(F.col("name")).alias("stem"),
    )
    candidates = stems.select("*", F.posexplode(F.array(pluralize(F.col("stem")), F.col("stem"))).alias("choice", "target"))
    known = tables.select("schema_id", F.col("table_name").alias("target")).distinct()
    hits = candidates.join(known, ["schema_id", "target"], "left_semi").groupBy(*TABLE, "pos", "foreign_key", "stem").agg(
        F.min_by("target", "choice").alias("target")
    ).where("target <> table_name")
    there = edges.select(*TABLE, "target").union(edges.select("schema_id", F.col("target").alias("table_name"), F.col("table_name").alias("target"))).distinct()
    free = hits.join(there, [*TABLE, "target"], "left_anti")
    first = free.groupBy(*TABLE, "target").agg(F.min_by(F.struct("foreign_key", "stem"), F.struct("pos", "foreign_key")).alias("c"))
    single = unique_columns(indexes).withColumn("_one", F.lit(True))
    out = first.select(
        *TABLE,
        "target",
        F.col("c.foreign_key").alias("foreign_key"),
        F.col("c.stem").alias("name"),
    ).join(single, [*TABLE, "foreign_key"], "left")
    return out.select(
        *TABLE,
        F.when(F.col("_one"), "has_one").otherwise("belongs_to").alias("type"),
        "name",
        "target",
        "foreign_key",
        F.lit("inferred").alias("provenance"),
    )


def prune_dangling(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """Edges whose target is known, and polymorphic ones, whose target is made up."""
    known = tables.select("schema_id", F.col("table_name").alias("target")).distinct().withColumn("_known", F.lit(True))
    return edges.join(known, ["schema_id", "target"], "left").where(F.coalesce("polymorphic", F.lit(False)) | F.col("_known")).drop("_known")


def display_edges(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """(schema_id, a, b, source, target, kind, many, label): one line for each pair of tables that a diagram shows.

    ``edges`` need pos, their order within a table. Kinds: nn, 11, 1n with the table on the many side.
    """
    known = tables.select("schema_id", "table_name").distinct()
    named = lambda c: known.select("schema_id", F.col("table_name").alias(c))
    shown = edges.where(~F.coalesce("polymorphic", F.lit(False))).join(named("target"), ["schema_id", "target"], "left_semi")
    habtm = F.col("type") == "has_and_belongs_to_many"
    shown = shown.withColumn("_join", F.when(habtm, join_table(F.col("table_name"), F.col("target"))))
    shown = shown.join(named("through"), ["schema_id", "through"], "left_anti").join(named("_join"), ["schema_id", "_join"], "left_anti")
    direct = F.col("through").isNull() & ~habtm
    order = F.struct("table_name", "pos")
    first = lambda cond: F.min_by("table_name", F.when(cond, order))
    by = ends(shown).groupBy(*PAIR).agg(
        F.min_by(F.struct("table_name", "target", "name"), order).alias("f"),
        F.count_if(direct).alias("n_direct"),
        first(direct & (F.col("type") == "has_many")).alias("many_from"),
        F.coalesce(F.bool_or(direct & (F.col("type") == "has_one")), F.lit(False)).alias("one"),
        first(direct & (F.col("type") == "belongs_to")).alias("belongs_from"),
    )
    source, target = F.col("f.table_name"), F.col("f.target")
    kind = F.when(F.col("n_direct") == 0, "nn").when(F.col("many_from").isNotNull(), "1n").when(F.col("one"), "11").otherwise("1n")
    many = F.when(F.col("many_from").isNotNull(), F.when(F.col("many_from") == source, target).otherwise(source)).otherwise(F.coalesce("belongs_from", target))
    return by.select(
        *PAIR,
        source.alias("source"),
        target.alias("target"),
        kind.alias("kind"),
        F.when(kind == "1n", many).alias("many"),
        F.coalesce("f.name", F.lit("")).alias("label"),
    )


def dbml_refs(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema_id, table_name, foreign_key, target, target_column): belongs_to keys to tables with one primary column."""
    keys = columns.where("primary").groupBy("schema_id", F.col("table_name").alias("target")).agg(
        F.count("*").alias("n"),
        F.min("name").alias("target_column"),
    ).where("n = 1").drop("n")
    own = edges.where((F.col("type") == "belongs_to") & F.col("foreign_key").isNotNull() & ~F.coalesce("polymorphic", F.lit(False)))
    return own.select(*TABLE, "foreign_key", "target").distinct().join(keys, ["schema_id", "target"]).select(*TABLE, "foreign_key", "target", "target_column")


def resolve_notes(notes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relation notes with the one edge they mean, and (schema_id, note_id, n) of those that mean none or several.

    ``notes``: schema_id, note_id, table_name, target, present and the narrowing keys; a key that is not present matches
    anything, a present null only an edge without it.
    """
    keys = ["foreign_key", "name", "through", "type", "polymorphic"]
    pair = [*TABLE, "target"]
    own = edges.withColumn("polymorphic", F.coalesce("polymorphic", F.lit(False)))  # an edge without it is not
    there = own.groupBy(*pair).agg(F.collect_list(F.struct("table_name", "target", *keys)).alias("_edges"))

    def fits(e: Column) -> Column:
        return reduce(Column.__and__, (~F.array_contains("present", k) | F.col(k).eqNullSafe(e[k]) for k in keys))

    # Files hold what many notes share once: their size says little of what a broadcast would take.
    both = notes.join(there.hint("merge"), pair, "left")
    found = F.coalesce(F.when(F.col("note_id").isNotNull(), F.filter("_edges", fits)), F.array().cast(there.schema["_edges"].dataType))
    by = both.select("schema_id", "note_id", found.alias("f")).groupBy("schema_id", "note_id").agg(F.collect_list("f").alias("each"))
    by = by.withColumn("f", F.flatten("each"))
    good = by.where(F.size("f") == 1).select("schema_id", "note_id", F.col("f")[0].alias("e")).select("schema_id", "note_id", "e.*")
    bad = by.where(F.size("f") != 1).select("schema_id", "note_id", F.size("f").cast("long").alias("n"), F.explode("each")).drop("col")
    return good, bad


def drop_matches(edges: DataFrame, drops: DataFrame) -> DataFrame:
    """``edges`` without those that a config drop means: role and target equal, other keys only where the drop has them."""
    from lakeatlas.operators.merge import role

    e = edges.withColumn("_role", role(F.col("type"), F.col("foreign_key"))).alias("e")
    d = drops.withColumn("_role", role(F.col("type"), F.col("foreign_key"))).alias("d")
    cond = [F.col(f"e.{c}") == F.col(f"d.{c}") for c in (*TABLE, "_role", "target")]
    fk_same = F.col("e._role") != "owner_fk"
    cond.append(fk_same | (F.col("e.foreign_key") == F.col("d.foreign_key")))
    cond.append((F.col("d.name").isNull() & ~fk_same) | F.col("e.name").eqNullSafe(F.col("d.name")))
    cond += [F.col(f"d.{k}").isNull() | (F.col(f"d.{k}") == F.col(f"e.{k}")) for k in ("through", "polymorphic")]
    return e.join(d, cond, "left_anti").drop("_role")


def pair_many_to_many(fields: DataFrame) -> DataFrame:
    """List fields (schema_id, table_name, field, target, relation): many-to-many where the other side has one for it."""
    back = fields.select(
        "schema_id",
        F.col("target").alias("table_name"),
        F.col("table_name").alias("target"),
        F.col("relation").alias("_relation"),
        F.col("field").alias("_field"),
        F.col("table_name").alias("_from"),
    )
    same = [
        F.col("f.schema_id") == F.col("b.schema_id"),
        F.col("f.table_name") == F.col("b.table_name"),
        F.col("f.target") == F.col("b.target"),
        F.col("f.relation").eqNullSafe(F.col("b._relation")),
        (F.col("f.field") != F.col("b._field")) | (F.col("f.table_name") != F.col("b._from")),
    ]
    both = fields.alias("f").join(back.alias("b"), same, "left_semi").withColumn("type", F.lit("has_and_belongs_to_many"))
    alone = fields.alias("f").join(back.alias("b"), same, "left_anti").withColumn("type", F.lit("has_many"))
    return both.unionByName(alone)


def redirect_targets(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Rewrite targets by ``names`` (schema_id, naive, real): tables whose model sets another name than the usual one."""
    real = names.select("schema_id", F.col("naive").alias("target"), "real")
    return edges.join(real, ["schema_id", "target"], "left").withColumn("target", F.coalesce("real", "target")).drop("real")


def pending_fks(pending: DataFrame, tables: DataFrame, columns: DataFrame, indexes: DataFrame, schema: list[str] = ["schema_id"]) -> tuple[DataFrame, DataFrame]:
    """Foreign keys of schema files: edges of those whose tables and column exist, and warnings with the reason for others.
    ``schema``: the columns that tell schemas apart."""
    own = [*schema, "table_name"]
    known = tables.select(*own).distinct()
    cols = columns.select(*own, F.col("name").alias("column_name"), F.lit(True).alias("_col"))
    # keys and columns said twice are made one after the join, in the same shuffle
    asked = pending.select(*own, "column_name", "ref_table").join(cols, [*own, "column_name"], "left").dropDuplicates([*own, "column_name", "ref_table"])
    dst = known.select(*schema, F.col("table_name").alias("ref_table"), F.lit(True).alias("_dst"))
    joined = asked.join(known.withColumn("_src", F.lit(True)), own, "left").join(dst, [*schema, "ref_table"], "left")
    reason = F.when(F.col("_src").isNull(), "unknown table").when(F.col("_dst").isNull(), "unknown target").when(F.col("_col").isNull(), "unknown column")
    marked = joined.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select(*own, F.col("column_name").alias("foreign_key"), F.col("ref_table").alias("target"))
    return key_edges(good, indexes, "schema_fk", own), marked.where("reason IS NOT NULL").select(*own, "column_name", "ref_table", "reason")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the others (a duplicate definition is ignored with a warning)."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n")
