"""Filters on tables, and on what hangs on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeatlas.functions.names import glob_to_regex

TABLE = ["schema_id", "table_name"]


def matches_any(name: Column, globs: list[str]) -> Column:
    """Whether a name matches one of the (comma-separated) patterns; case-sensitive."""
    single = [g.strip() for text in globs for g in text.split(",") if g.strip()]
    return reduce(lambda a, b: a | b, (name.rlike(glob_to_regex(g)) for g in single), F.lit(False))


def keep_tables(tables: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    if only:
        tables = tables.where(matches_any(F.col("table_name"), only))
    if exclude:
        tables = tables.where(~matches_any(F.col("table_name"), exclude))
    return tables


def emptied_schemas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Schemas that a filter left without tables: an error for the caller."""
    return before.select("schema_id").distinct().join(after.select("schema_id").distinct(), "schema_id", "left_anti")


def base_tables_only(rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Catalogue rows of base tables, without those of views."""
    return rows.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")


def keep_notes(notes: DataFrame, tables: DataFrame) -> DataFrame:
    """Global notes, table notes whose table is left, relation notes whose ends are (a polymorphic target needn't be)."""
    t = tables.select("schema_id", F.col("table_name").alias("_t")).distinct()
    src = t.withColumn("_src", F.lit(True))
    dst = t.withColumnRenamed("_t", "_u").withColumn("_dst", F.lit(True))
    own = F.when(F.col("scope") == "relation", F.col("source_table")).otherwise(F.col("table_name"))
    joined = notes.withColumn("_t", own).withColumn("_u", F.col("target")).join(src, ["schema_id", "_t"], "left").join(dst, ["schema_id", "_u"], "left")
    keep = (F.col("scope") == "global") | (F.col("_src") & ((F.col("scope") == "table") | F.coalesce("polymorphic", F.lit(False)) | F.col("_dst")))
    return joined.where(keep).select(*notes.columns)


def keep_groups(groups: DataFrame, members: DataFrame, tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members (schema_id, group_id, table_name) of the tables left; groups without any go."""
    left = members.join(tables.select(*TABLE).distinct(), TABLE, "left_semi")
    return groups.join(left.select("schema_id", "group_id").distinct(), ["schema_id", "group_id"], "left_semi"), left


def real_columns(columns: DataFrame) -> DataFrame:
    """Without pseudo-columns, whose names are no identifiers."""
    return columns.where(F.col("name").rlike("^[A-Za-z0-9_]+$"))


def search(
    dictionary: DataFrame,
    text: str,
    scope: str = "table_name",
    exact: bool = False,
    regex: bool = False,
    case: bool = False,
    notes: DataFrame | None = None,
) -> DataFrame:
    """Rows of a dictionary (schema_id, table_name, column_name, comment, ...) which the text is found in.

    scope: table_name, column_name or all_fields, which looks into comments too, and into the titles and texts of a table's
    ``notes(schema_id, note_id, scope, table_name, title, text)``, all taken together.
    """
    columns = dictionary.columns
    if notes is not None and scope == "all_fields":
        words = F.struct("note_id", F.concat_ws(" ", "title", "text").alias("t"))
        of_table = notes.where("scope = 'table'").groupBy(*TABLE).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(words)), lambda x: x["t"]), "\n").alias("_notes")
        )
        dictionary = dictionary.join(of_table, TABLE, "left")
    fields = {"table_name": ["table_name"], "column_name": ["column_name"], "all_fields": [c for c, t in dictionary.dtypes if t == "string"]}[scope]

    def hit(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(""))
        if regex:
            return value.rlike(text if case else f"(?i){text}")
        value, want = (value, text) if case else (F.lower(value), text.lower())
        return (value == want) if exact else value.contains(want)

    return dictionary.where(reduce(lambda a, b: a | b, map(hit, fields))).select(*columns)


def first_columns(columns: DataFrame, n: int) -> DataFrame:
    """At most the first n columns of each table, as a viewer shows them."""
    return columns.where(F.col("pos") <= n)
