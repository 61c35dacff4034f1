"""A hash tree over snapshots: a leaf for each table, note and group, a root for each schema.

Two states are compared from the top: roots first, leaves of those schemas only whose roots differ, and rows of those leaves
only whose hashes differ. Leaves are small rows (schema_id, kind, item, hash) that can be kept beside a snapshot, so that a
comparison with an old state reads its leaves and not its contents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import canonical

LEAF = ["schema_id", "kind", "item"]


def _leaves(rows: DataFrame, kind: str, item: str) -> DataFrame:
    return rows.select("schema_id", F.lit(kind).alias("kind"), F.col(item).alias("item"), F.sha2("json", 256).alias("hash"))


def leaves(state: dict[str, DataFrame]) -> DataFrame:
    """Leaves of merged relations: tables, columns, and where given indexes, associations, notes and groups."""
    none = lambda ddl: canonical.nothing(state["tables"], ddl)
    indexes = state.get("indexes")
    edges = state.get("associations")
    indexes = none(canonical.INDEX_ROWS) if indexes is None else indexes
    edges = none(canonical.EDGE_ROWS) if edges is None else edges
    out = _leaves(canonical.table_json(state["tables"], state["columns"], indexes, edges), "table", "table_name")
    if state.get("notes") is not None:
        out = out.unionByName(_leaves(canonical.note_json(state["notes"]), "note", "note_id"))
    if state.get("groups") is not None:
        out = out.unionByName(_leaves(canonical.group_json(state["groups"]), "group", "group_id"))
    return out


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of parsed snapshots (schema_id, d in the form SNAPSHOT), whatever way they were written."""
    return docs.select("schema_id", F.explode(canonical.document_leaves(F.col("d"))).alias("x")).select("schema_id", "x.*")


def roots(leaves_: DataFrame) -> DataFrame:
    """(schema_id, root): one hash over the leaves of a schema in order; equal exactly where all leaves are."""
    entries = F.array_sort(F.collect_list(F.struct("kind", "item", "hash")))
    return leaves_.groupBy("schema_id").agg(F.sha2(F.to_json(entries), 256).alias("root"))


def changed_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """(schema_id, kind, item, change): leaves that differ or that one side alone has, as added (left has it), removed, changed.

    Only schemas whose roots differ are looked into.
    """
    l, r = roots(left), roots(right).withColumnRenamed("root", "_right")
    moved = l.join(r, "schema_id", "full_outer").where(~F.col("root").eqNullSafe(F.col("_right"))).select("schema_id")
    own = lambda side: side.join(moved, "schema_id", "left_semi")
    both = own(left).join(own(right).withColumnRenamed("hash", "_right"), LEAF, "full_outer").where(~F.col("hash").eqNullSafe(F.col("_right")))
    change = F.when(F.col("_right").isNull(), "added").when(F.col("hash").isNull(), "removed").otherwise("changed")
    return both.select(*LEAF, change.alias("change"))


def of_leaves(state: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """The rows of a state that stand under leaves in ``changed``."""
    key = {"notes": ("note", "note_id"), "groups": ("group", "group_id")}
    out = {}
    for name, df in state.items():
        kind, item = key.get(name, ("table", "table_name"))
        out[name] = df.join(changed.where(F.col("kind") == kind).select("schema_id", F.col("item").alias(item)), ["schema_id", item], "left_semi")
    return out
