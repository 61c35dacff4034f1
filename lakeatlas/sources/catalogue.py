"""Catalogue rows of databases and of the lake, as the four merged-form relations or as fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeatlas.functions.names import SPARK_TYPES, coarse_type, lookup
from lakeatlas.operators.edges import fk_associations
from lakeatlas.operators.filters import base_tables_only

TABLE = ["schema_id", "table_name"]
#: Input contract of the catalogue rows; '' stands for NULL in the column rows.
TABLE_ROWS = "schema_id STRING, table_name STRING, table_comment STRING"
COLUMN_ROWS = "schema_id STRING, table_name STRING, ordinal INT, column_name STRING, data_type STRING, column_type STRING, is_nullable STRING, column_key STRING, column_default STRING, extra STRING, column_comment STRING"
FK_ROWS = "schema_id STRING, table_name STRING, column_name STRING, ref_table STRING"
INDEX_ROWS = "schema_id STRING, table_name STRING, index_name STRING, non_unique INT, seq INT, column_name STRING"

_MYSQL = {
    "tables": "SELECT table_schema AS schema_id, table_name, table_comment FROM information_schema.tables WHERE table_type = 'BASE TABLE' AND table_schema = '{schema}'",
    "columns": "SELECT table_schema AS schema_id, table_name, ordinal_position AS ordinal, column_name, data_type, column_type, is_nullable, column_key, coalesce(column_default, '') AS column_default, extra, column_comment FROM information_schema.columns WHERE table_schema = '{schema}'",
    "fks": "SELECT table_schema AS schema_id, table_name, column_name, referenced_table_name AS ref_table FROM information_schema.key_column_usage WHERE table_schema = '{schema}' AND referenced_table_name IS NOT NULL",
    "indexes": "SELECT table_schema AS schema_id, table_name, index_name, non_unique, seq_in_index AS seq, column_name FROM information_schema.statistics WHERE table_schema = '{schema}' AND index_name <> 'PRIMARY'",
}


def read_mysql(spark: SparkSession, url: str, schema: str, **options: str) -> dict[str, DataFrame]:
    """The four row sets of a MySQL database by JDBC; filters run in the database."""
    if not schema.replace("_", "").replace("-", "").isalnum():
        raise ValueError("unexpected schema name")
    return {k: spark.read.format("jdbc").options(url=url, query=q.format(schema=schema), **options).load() for k, q in _MYSQL.items()}


def read_postgres(extracts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four row sets from pg_catalog extracts (by JDBC or landed): pg_class, pg_namespace, pg_attribute, pg_attrdef,
    pg_constraint and pg_index, with conkey and indkey as arrays. Plain and partitioned tables, without partitions.
    """
    ns = extracts["pg_namespace"].select(F.col("oid").alias("relnamespace"), F.col("nspname").alias("schema_id"))
    cls = extracts["pg_class"].where(F.col("relkind").isin("r", "p") & ~F.col("relispartition")).join(ns, "relnamespace")
    rel = cls.select(F.col("oid").alias("attrelid"), "schema_id", F.col("relname").alias("table_name"))
    att = extracts["pg_attribute"].where("attnum > 0 AND NOT attisdropped").join(rel, "attrelid")
    dflt = extracts["pg_attrdef"].select(F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), F.col("adsrc").alias("default_text"))
    con = extracts["pg_constraint"]
    pk = con.where("contype = 'p'").select(F.col("conrelid").alias("attrelid"), F.explode("conkey").alias("attnum")).distinct().withColumn("_pk", F.lit("PRI"))
    full = att.join(dflt, ["attrelid", "attnum"], "left").join(pk, ["attrelid", "attnum"], "left")
    serial = F.col("default_text").startswith("nextval(")
    columns = full.select(
        "schema_id",
        "table_name",
        F.col("attnum").cast("int").alias("ordinal"),
        F.col("attname").alias("column_name"),
        F.regexp_replace("typname", r"\(.*\)", "").alias("data_type"),
        F.col("typname").alias("column_type"),
        F.when(F.col("attnotnull"), "NO").otherwise("YES").alias("is_nullable"),
        F.coalesce("_pk", F.lit("")).alias("column_key"),
        F.when(serial, "").otherwise(F.coalesce("default_text", F.lit(""))).alias("column_default"),
        F.when(serial, "serial").when(F.coalesce("attidentity", F.lit("")) != "", "identity").otherwise("").alias("extra"),
        F.lit("").alias("column_comment"),
    )
    names = att.select("attrelid", "attnum", "attname")
    ref = rel.select(F.col("attrelid").alias("confrelid"), F.col("table_name").alias("ref_table"))
    fk = con.where("contype = 'f' AND size(conkey) = 1").select(F.col("conrelid").alias("attrelid"), "confrelid", F.col("conkey")[0].alias("attnum"))
    fks = fk.join(rel, "attrelid").join(ref, "confrelid").join(names, ["attrelid", "attnum"]).select(
        "schema_id",
        "table_name",
        F.col("attname").alias("column_name"),
        "ref_table",
    )
    ix = extracts["pg_index"].where("NOT indisprimary").select(
        F.col("indrelid").alias("attrelid"),
        F.col("indexname").alias("index_name"),
        F.when(F.col("indisunique"), 0).otherwise(1).alias("non_unique"),
        F.posexplode("indkey").alias("seq", "attnum"),
    )
    indexes = ix.join(rel, "attrelid").join(names, ["attrelid", "attnum"]).select(
        "schema_id",
        "table_name",
        "index_name",
        "non_unique",
        (F.col("seq") + 1).alias("seq"),
        F.col("attname").alias("column_name"),
    )
    return {"tables": rel.select("schema_id", "table_name", F.lit("").alias("table_comment")), "columns": columns, "fks": fks, "indexes": indexes}


def catalogue_from_rows(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables (with primary_key, the first primary column), columns, indexes and associations of the four row sets."""
    tables = rows["tables"]
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    raw = base_tables_only(rows["columns"], tables)
    columns = raw.select(
        *TABLE,
        F.col("ordinal").alias("pos"),
        F.col("column_name").alias("name"),
        coarse_type(F.col("data_type")).alias("type"),
        F.col("column_type").alias("sql_type"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        (F.col("column_key") == "PRI").alias("primary"),
        blank("column_default").alias("default"),
        blank("extra").alias("extra"),
        blank("column_comment").alias("comment"),
    )
    keys = columns.where("primary").groupBy(*TABLE).agg(F.array(F.min_by("name", "pos")).alias("primary_key"))
    by = base_tables_only(rows["indexes"], tables).groupBy(*TABLE, F.col("index_name").alias("name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "column_name"))), lambda x: x["column_name"]).alias("columns"),
        (F.max("non_unique") == 0).alias("unique"),
    )
    return {
        "tables": tables.select(*TABLE, blank("table_comment").alias("comment")).join(keys, TABLE, "left"),
        "columns": columns,
        "indexes": by,
        "associations": fk_associations(rows["fks"], tables, by),
    }


def lake_columns(spark: SparkSession, datasets: dict[str, DataFrame], schema_id: str, layer_seq: int = 0) -> DataFrame:
    """Column fragments (kind db) of DataFrames by name: what is deployed in the lake. Only schemas are looked at."""
    rows = [(schema_id, layer_seq, "db", name, i, f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment")) for name, df in datasets.items() for i, f in enumerate(df.schema.fields, 1)]
    df = spark.createDataFrame(
        rows,
        "schema_id STRING, layer_seq INT, kind STRING, table_name STRING, pos INT, name STRING, sql_type STRING, nullable BOOLEAN, comment STRING",
    )
    base = F.regexp_replace("sql_type", r"\(.*$", "")
    kind = F.when(base == "decimal", "decimal").when(base.startswith("interval"), "interval").otherwise(
        F.coalesce(lookup(base, SPARK_TYPES), F.lower("sql_type"))
    )
    present = F.array_compact(F.array(F.lit("type"), F.lit("sql_type"), F.lit("nullable"), F.when(F.col("comment").isNotNull(), "comment")))
    return df.select(
        "schema_id",
        "layer_seq",
        "kind",
        "table_name",
        "pos",
        "name",
        present.alias("present"),
        kind.alias("type"),
        "sql_type",
        "nullable",
        F.lit(False).alias("primary"),
        F.lit(None).cast("string").alias("default"),
        F.lit(None).cast("string").alias("extra"),
        "comment",
    )


def lake_tables(spark: SparkSession, database: str) -> dict[str, DataFrame]:
    """The tables of a database of Spark's catalogue, by name."""
    return {t.name: spark.table(f"`{database}`.`{t.name}`") for t in spark.catalog.listTables(database) if t.tableType != "TEMPORARY"}


Adapter = Callable[[SparkSession, str], dict[str, DataFrame]]
_ADAPTERS: dict[str, Adapter] = {}


def register_adapter(scheme: str, adapter: Adapter) -> None:
    """Read catalogues at ``scheme://...`` by ``adapter``; a later registration wins."""
    _ADAPTERS[scheme.lower()] = adapter


def fetch(spark: SparkSession, url: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The relations of a registered adapter, and the violations of the complete contract in them."""
    from lakeatlas.operators.validate import fragments

    scheme = url.partition("://")[0].lower()
    if scheme not in _ADAPTERS:
        raise ValueError(f"no adapter for {scheme}")
    got = _ADAPTERS[scheme](spark, url)
    return got, fragments(got["tables"], got["columns"], got["indexes"], got["associations"], complete=True)
