"""Differences between two states of schemas: left is current, right is the base.

Every level is one full outer join, and its result long rows (schema_id, level, table_name, item, change, field, old, new).
Absent, empty and false facts are equal. Column order and index names say nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

TABLE = ["schema_id", "table_name"]
FACTS = ["type", "sql_type", "nullable", "primary", "default", "extra", "comment"]
OUT = ["schema_id", "level", "table_name", "item", "change", "field", "old", "new"]


def _text(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes).get(c)
    if kind is None:
        return F.lit("")
    if kind == "boolean":
        return F.when(F.col(c), "true").otherwise("")
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, F.to_json(c)).otherwise("")
    return F.coalesce(F.to_json(c) if kind.startswith("struct") else F.col(c).cast("string"), F.lit(""))


def _compare(left: DataFrame, right: DataFrame, level: str, keys: list[str], fields: list[str]) -> DataFrame:
    """added, removed, and a changed row for each field that differs."""
    side = lambda df, n: df.select(*keys, F.struct(*(_text(df, f).alias(f) for f in fields), F.lit(1).alias("_")).alias(n))
    r = side(right, "r").select(*(F.col(k).alias(f"_r_{k}") for k in keys), "r")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    both = side(left, "l").join(r, same, "full_outer").select(*(F.coalesce(k, f"_r_{k}").alias(k) for k in keys), "l", "r")
    whole = F.struct(
        F.when(F.col("l").isNull(), "removed").otherwise("added").alias("change"),
        F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("old"),
        F.lit(None).cast("string").alias("new"),
    )
    by_field = F.filter(
        F.array(
            *(F.struct(F.lit("changed").alias("change"), F.lit(f).alias("field"), F.col(f"r.{f}").alias("old"), F.col(f"l.{f}").alias("new")) for f in fields)
        ),
        lambda x: x["old"] != x["new"],
    ) if fields else F.array().cast("array<struct<change:string,field:string,old:string,new:string>>")
    parts = F.when(F.col("l").isNull() | F.col("r").isNull(), F.array(whole)).otherwise(by_field)
    table = F.col("table_name") if "table_name" in keys else F.lit(None).cast("string")
    item = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys if k not in ("schema_id", "table_name")))
    return both.select(
        "schema_id",
        F.lit(level).alias("level"),
        table.alias("table_name"),
        item.alias("item"),
        F.explode(parts).alias("x"),
    ).select("schema_id", "level", "table_name", "item", "x.*").select(*OUT)


def _flat_indexes(ix: DataFrame) -> DataFrame:
    return ix.select(*TABLE, F.array_join("columns", ",").alias("columns"), F.coalesce("unique", F.lit(False)).alias("unique")).distinct()


def schema_diff(left: dict[str, DataFrame], right: dict[str, DataFrame], include_provenance: bool = False) -> DataFrame:
    """All levels of ``tables, columns, indexes, associations`` and, where given, ``notes`` and ``groups``.

    Items inside added or removed tables are left out: the table says it.
    """
    edge = ["type", "target", "name", "foreign_key", "through", "polymorphic"]
    tables = _compare(left["tables"], right["tables"], "table", TABLE, ["comment"])
    parts = [_compare(left["columns"], right["columns"], "column", [*TABLE, "name"], FACTS)]
    if "indexes" in left:
        parts.append(_compare(_flat_indexes(left["indexes"]), _flat_indexes(right["indexes"]), "index", [*TABLE, "columns", "unique"], []))
    if "associations" in left:
        keys = [c for c in edge if c in left["associations"].columns] + (["provenance", "sources"] if include_provenance else [])
        flat = lambda df: df.select(*TABLE, *(_text(df, c).alias(c) for c in keys)).distinct()
        parts.append(_compare(flat(left["associations"]), flat(right["associations"]), "association", [*TABLE, *keys], []))
    whole = tables.where("change <> 'changed'").select(*TABLE).distinct()
    inner = reduce(DataFrame.unionByName, parts).join(whole, TABLE, "left_anti").select(*OUT)
    out = tables.unionByName(inner)
    if "notes" in left:
        fields = [c for c in left["notes"].columns if c not in ("schema_id", "note_id")]
        out = out.unionByName(_compare(left["notes"], right["notes"], "note", ["schema_id", "note_id"], fields))
    if "groups" in left:
        flat = lambda g: g.withColumn("tables", F.array_join(F.array_sort(F.array_distinct("tables")), ","))
        out = out.unionByName(_compare(flat(left["groups"]), flat(right["groups"]), "group", ["schema_id", "group_id"], ["tables", "title", "color"]))
    return out


def gate(left: dict[str, DataFrame], right: dict[str, DataFrame], left_leaves: DataFrame | None = None, right_leaves: DataFrame | None = None) -> DataFrame:
    """(schema_id, changed, n_leaves, n_items) for every schema of either side: whether the gate stops it, how many tables, notes
    and groups differ in their canonical form, and how many items the comparison finds in those.

    Leaves (``hashtree.leaves``) are made from the relations where they are not given. Schemas with equal roots are not looked
    into, and of the others only what stands under leaves that differ is compared. Where only what the comparison ignores
    differs (order of columns, index names) nothing has changed.
    """
    from . import hashtree

    l = hashtree.leaves(left) if left_leaves is None else left_leaves
    r = hashtree.leaves(right) if right_leaves is None else right_leaves
    moved = written(hashtree.changed_leaves(l, r), "changed_leaves")
    items = summary(schema_diff(hashtree.of_leaves(left, moved), hashtree.of_leaves(right, moved))).groupBy("schema_id").agg(F.sum("n").alias("n_items"))
    counts = moved.groupBy("schema_id").agg(F.count("*").alias("n_leaves")).join(items, "schema_id", "left")
    every = l.select("schema_id").union(r.select("schema_id")).distinct()
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(counts, "schema_id", "left").select("schema_id", (F.coalesce("n_items", F.lit(0)) > 0).alias("changed"), n("n_leaves"), n("n_items"))


def summary(diff: DataFrame) -> DataFrame:
    """(schema_id, level, change, n): counts of changed items, a changed item once."""
    return diff.select("schema_id", "level", "table_name", "item", "change").distinct().groupBy("schema_id", "level", "change").agg(F.count("*").alias("n"))


def as_text(diff: DataFrame) -> DataFrame:
    """(schema_id, text): one line for each row of the difference, in order."""
    sign = F.when(F.col("change") == "added", "+ ").when(F.col("change") == "removed", "- ").otherwise("~ ")
    tail = F.when(F.col("field").isNotNull(), F.concat(F.lit(" "), F.col("field"), F.lit(": "), F.col("old"), F.lit(" -> "), F.col("new"))).otherwise("")
    name = F.concat_ws(".", "table_name", F.nullif(F.col("item"), F.lit("")))
    line = F.concat(sign, F.col("level"), F.lit(" "), name, tail)
    return diff.groupBy("schema_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))


def as_json(diff: DataFrame) -> DataFrame:
    item = F.to_json(F.struct(*sorted(c for c in OUT if c != "schema_id")))
    return diff.groupBy("schema_id").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")).alias("json"))
