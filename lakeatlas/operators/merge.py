"""Merging layers of fragments field by field under an authority ladder.

Every fragment row has ``schema_id, layer_seq, kind, table_name`` and a ``present`` array: only what a fragment has an opinion
on takes part, and a present NULL of the strongest layer wins. Of equal kinds the later layer wins. Each merge is one
aggregation with partial sums; no window and no sort is needed to find a winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeatlas.functions.names import blank_to_null, lookup

#: Ranks of layer kinds, for physical facts and for logical ones.
PHYSICAL = {"config": 4, "db": 3, "schema": 2, "framework": 1, "sketch": 0}
LOGICAL = {"config": 4, "framework": 3, "schema": 2, "db": 1, "sketch": 0}
PRECEDENCE = {"manual": 4, "declared": 3, "db_fk": 2, "schema_fk": 1, "inferred": 0}
COLUMN_FACTS = {"type": PHYSICAL, "sql_type": PHYSICAL, "nullable": PHYSICAL, "primary": PHYSICAL, "default": PHYSICAL, "extra": PHYSICAL, "comment": LOGICAL}
TABLE = ["schema_id", "table_name"]


def rank(kind: Column, ladder: dict[str, int]) -> Column:
    chain = F.lit(-1)
    for k, r in ladder.items():
        chain = F.when(kind == k, r).otherwise(chain)
    return chain


def strength(ladder: dict[str, int], fact: str | None = None) -> Column:
    """What max_by orders by; NULL where the fragment has no opinion on ``fact``."""
    order = F.struct(rank(F.col("kind"), ladder), F.col("layer_seq"))
    return order if fact is None else F.when(F.array_contains("present", fact), order)


def merge_columns(frags: DataFrame, always: tuple[str, ...] = ()) -> DataFrame:
    """(schema_id, table_name, name, pos, facts...): pos is the column's place by first sight across layers. The physical facts
    that every fragment has an opinion on (``always``) have one winner, and are taken from it together."""
    facts = [f for f in COLUMN_FACTS if f in frags.columns]
    together = [f for f in facts if f in always and COLUMN_FACTS[f] is PHYSICAL]
    alone = [f for f in facts if f not in together]
    merged = frags.groupBy(*TABLE, "name").agg(
        F.min(F.struct("layer_seq", "pos")).alias("_first"),
        *([F.max_by(F.struct(*together), strength(PHYSICAL)).alias("_won")] if together else []),
        *(F.max_by(f, strength(COLUMN_FACTS[f], f)).alias(f) for f in alone),
    )
    defaults = {"type": F.lit(""), "nullable": F.lit(False), "primary": F.lit(False)}
    own = {f: F.col(f"_won.{f}") if f in together else F.col(f) for f in facts}
    seen = F.struct("_first.layer_seq", "_first.pos", "name").alias("seen")
    return merged.select(*TABLE, "name", seen, *((F.coalesce(c, defaults[f]) if f in defaults else c).alias(f) for f, c in own.items()))


def place_columns(merged: DataFrame) -> DataFrame:
    """Replace ``seen`` by pos 1, 2, ... within the table."""
    from pyspark.sql import Window

    return merged.withColumn("pos", F.row_number().over(Window.partitionBy(*TABLE).orderBy("seen"))).drop("seen")


def fact_conflicts(frags: DataFrame, fact: str) -> DataFrame:
    """Columns on whose ``fact`` layers of the winner's kind disagree: (schema, table, name, winner, kind_rank, values)."""
    ladder = COLUMN_FACTS[fact]
    own = frags.where(F.array_contains("present", fact)).withColumn("_rank", rank(F.col("kind"), ladder))
    by_kind = own.groupBy(*TABLE, "name", "_rank").agg(
        F.max_by(fact, "layer_seq").alias("winner"),
        F.count_distinct(F.coalesce(F.col(fact).cast("string"), F.lit("\0"))).alias("n_values"),
    )
    top = by_kind.groupBy(*TABLE, "name").agg(F.max(F.struct("_rank", "winner", "n_values")).alias("top"))
    return top.where("top.n_values > 1").select(
        *TABLE,
        "name",
        F.col("top.winner").alias("winner"),
        F.col("top._rank").alias("kind_rank"),
        F.col("top.n_values").alias("n_values"),
    )


def merge_tables(frags: DataFrame) -> DataFrame:
    """(schema_id, table_name, pos, comment[, primary_key, config_pk]): '' deletes a comment."""
    out = [F.min("layer_seq").alias("pos"), blank_to_null(F.max_by("comment", strength(LOGICAL, "comment"))).alias("comment")]
    if "primary_key" in frags.columns:
        best = strength(PHYSICAL, "primary_key")
        out += [F.max_by("primary_key", best).alias("primary_key"), F.coalesce(F.max_by(F.col("kind") == "config", best), F.lit(False)).alias("config_pk")]
    return frags.groupBy(*TABLE).agg(*out)


def merge_indexes(frags: DataFrame) -> DataFrame:
    """(schema_id, table_name, name, columns, unique, pos): identity is the name, else the columns; the whole index wins."""
    key = F.coalesce("name", F.concat(F.lit("\0"), F.to_json("columns")))
    won = frags.groupBy(*TABLE, key.alias("key")).agg(
        F.max_by(F.struct("name", "columns", "unique"), strength(PHYSICAL)).alias("ix"),
        F.min(F.struct("layer_seq", "pos")).alias("seen"),
    )
    return won.select(*TABLE, "ix.name", "ix.columns", F.coalesce("ix.unique", F.lit(False)).alias("unique"), "seen")


def role(type_: Column, foreign_key: Column) -> Column:
    return F.when(foreign_key.isNotNull(), "owner_fk").when(
        type_.isin("has_many", "has_and_belongs_to_many"),
        "collection",
    ).when(type_ == "has_one", "inverse_one").otherwise("named")


def provenance_of(manual: Column, db_fk: Column, schema_fk: Column, inferred: Column) -> Column:
    return F.when(manual, "manual").when(db_fk, "db_fk").when(schema_fk, "schema_fk").when(inferred, "inferred").otherwise("declared")


def legacy_flags(provenance: Column) -> list[Column]:
    return [(provenance == p).alias(p) for p in ("manual", "db_fk", "schema_fk", "inferred")]


IDENTITY = [*TABLE, "target", "foreign_key", "role", "name"]


def merge_associations(frags: DataFrame) -> DataFrame:
    """One edge for each identity (source, target, foreign key, role, name; through and polymorphic for named ones)."""
    own = frags.withColumn("role", role(F.col("type"), F.col("foreign_key")))
    named = F.col("role") != "owner_fk"
    own = own.withColumn("_through", F.when(named, F.col("through"))).withColumn("_poly", F.when(named, F.coalesce("polymorphic", F.lit(False))))
    shown = F.when(F.col("kind") == "config", F.lit("manual")).otherwise(F.col("provenance"))
    own = own.withColumn("_prov", rank(shown, PRECEDENCE))
    provider = F.col("provider") if "provider" in frags.columns else F.lit(None).cast("string")
    merged = own.groupBy(*IDENTITY, "_through", "_poly").agg(
        F.when((F.col("role") == "owner_fk") & F.bool_or(F.col("type") == "has_one"), F.lit("has_one")).otherwise(F.max_by("type", "layer_seq")).alias("type"),
        F.max_by("through", F.when(F.col("through").isNotNull(), F.col("layer_seq"))).alias("through"),
        F.bool_or(F.coalesce("polymorphic", F.lit(False))).alias("polymorphic"),
        F.max("_prov").alias("_prov"),
        F.array_sort(F.collect_set(F.struct("kind", provider.alias("provider")))).alias("sources"),
        F.min(F.struct("layer_seq", "pos")).alias("seen"),
    )
    back = lookup(F.col("_prov").cast("string"), {str(v): k for k, v in PRECEDENCE.items()})
    return merged.select(*TABLE, "type", "name", "target", "foreign_key", "through", "polymorphic", back.alias("provenance"), "sources", "seen")


def override_warnings(frags: DataFrame) -> DataFrame:
    """Edges on which the last config layer differs from some layer that is none, or the last framework layer from an earlier
    one, in type, through or polymorphic: (identity, warning, n_differing, new)."""
    own = frags.withColumn("role", role(F.col("type"), F.col("foreign_key")))
    named = F.col("role") != "owner_fk"
    own = own.withColumn("_through", F.when(named, F.col("through"))).withColumn("_poly", F.when(named, F.coalesce("polymorphic", F.lit(False))))
    content = F.struct("type", F.coalesce("through", F.lit("")).alias("through"), F.coalesce("polymorphic", F.lit(False)).alias("polymorphic"))
    is_config, is_framework = F.col("kind") == "config", F.col("kind") == "framework"
    by = own.groupBy(*IDENTITY, "_through", "_poly").agg(
        F.max_by(content, F.when(is_config, F.col("layer_seq"))).alias("config"),
        F.collect_set(F.when(~is_config, content)).alias("lower"),
        F.max_by(content, F.when(is_framework, F.col("layer_seq"))).alias("framework"),
        F.collect_set(F.when(is_framework, content)).alias("frameworks"),
    )
    warned = lambda last, others, text: by.withColumn("n_differing", F.size(F.filter(others, lambda x: x != F.col(last)))).where(F.col(last).isNotNull() & (F.col("n_differing") > 0)).select(*IDENTITY, F.lit(text).alias("warning"), "n_differing", F.col(f"{last}.type").alias("new"))
    return warned("config", "lower", "config overrides").union(warned("framework", "frameworks", "later model overrides"))


def normalize_primary_key(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Set ``primary`` from the tables' primary_key; one that a config layer gave resets all other flags."""
    keys = tables.select(*TABLE, "primary_key", "config_pk")
    joined = columns.join(keys, TABLE, "left")
    listed = F.coalesce(F.array_contains("primary_key", F.col("name")), F.lit(False))
    return joined.withColumn("primary", listed | (~F.coalesce("config_pk", F.lit(False)) & F.col("primary"))).drop("primary_key", "config_pk")


def missing_key_columns(columns: DataFrame, tables: DataFrame) -> DataFrame:
    names = columns.groupBy(*TABLE).agg(F.collect_set("name").alias("names"))
    joined = tables.where("primary_key IS NOT NULL").join(names, TABLE, "left")
    return joined.select(*TABLE, F.explode(F.array_except("primary_key", F.coalesce("names", F.array().cast("array<string>")))).alias("missing"))


def apply_composites(frags: DataFrame, base_identity: list[str], mode: str) -> DataFrame:
    """Drop and replace marks of config fragments: where a table has a ``mode`` of replace, lower layers go; then drops."""
    replaced = frags.where((F.col("kind") == "config") & (F.col(mode) == "replace")).select(*TABLE).distinct()
    lower = frags.where(F.col("kind") != "config").join(replaced, TABLE, "left_anti")
    drops = frags.where((F.col("kind") == "config") & F.coalesce("drop", F.lit(False))).select(*TABLE, *base_identity).distinct()
    kept = lower.unionByName(frags.where((F.col("kind") == "config") & ~F.coalesce("drop", F.lit(False))))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in (*TABLE, *base_identity)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return kept.alias("k").join(drops.alias("d"), cond, "left_anti")


def fk_columns(associations: DataFrame) -> DataFrame:
    """Sorted distinct foreign-key columns of each table's edges; never guessed from names."""
    return associations.where("foreign_key IS NOT NULL").groupBy(*TABLE).agg(F.array_sort(F.collect_set("foreign_key")).alias("fk_columns"))


def schema_counts(tables: DataFrame, columns: DataFrame, indexes: DataFrame) -> DataFrame:
    """(schema_id, n_tables, n_columns, n_indexes)."""
    count = lambda df, c: df.groupBy("schema_id").agg(F.count("*").alias(c))
    out = count(tables, "n_tables").join(count(columns, "n_columns"), "schema_id", "left").join(count(indexes, "n_indexes"), "schema_id", "left")
    return out.na.fill(0, ["n_columns", "n_indexes"])


def covered_fks(frags: DataFrame, merged: DataFrame) -> DataFrame:
    """(schema_id, n_covered): database keys of the raw layers that are none in the merged edges, other edges covering them."""
    raw = frags.where("provenance = 'db_fk'").select("schema_id", F.lit(1).alias("n"))
    left = merged.where("provenance = 'db_fk'").select("schema_id", F.lit(-1).alias("n"))
    return raw.union(left).groupBy("schema_id").agg(F.sum("n").alias("n_covered")).where("n_covered > 0")


def schema_missing(tables: DataFrame, columns: DataFrame) -> DataFrame:
    counts = columns.groupBy(*TABLE).agg(F.count("*").alias("n_columns"))
    return tables.select(*TABLE).join(counts, TABLE, "left").select(
        *TABLE,
        F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
        F.isnull("n_columns").alias("schema_missing"),
    )


def composite_keys(columns: DataFrame) -> DataFrame:
    """Tables whose columns flagged primary are two or more, in column order."""
    keys = columns.where("primary").groupBy(*TABLE).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda c: c["name"]).alias("primary_key")
    )
    return keys.where("size(primary_key) >= 2")
