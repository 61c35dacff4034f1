"""Catalogue rows of many databases, derived from the given tables, landed as files by server and read by the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeatlas.functions.names import SQL_TYPES
from lakeatlas.operators import validate
from lakeatlas.operators.store import shared_folder, written
from lakeatlas.sources import catalogue, fleet

from .derived import frames, with_ctes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

ROWS = {
    "tables": """
SELECT CAST(schema_id AS STRING) AS schema_id, table_name, max(coalesce(comment, '')) AS table_comment,
  CASE WHEN max(layer_seq) % 7 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type
FROM table_frag GROUP BY schema_id, table_name""",
    "columns": """
SELECT schema_id, table_name, CAST(row_number() OVER (PARTITION BY schema_id, table_name ORDER BY pos, name) AS INT) AS ordinal, name AS column_name,
  data_type, column_type, is_nullable, column_key, column_default, extra, column_comment
FROM (
  SELECT CAST(schema_id AS STRING) AS schema_id, table_name, pos, name, CASE WHEN layer_seq % 11 = 0 THEN '' ELSE lower(type) END AS data_type,
    concat(lower(type), '(20)') AS column_type, CASE WHEN nullable THEN 'YES' ELSE 'NO' END AS is_nullable, CASE WHEN is_primary THEN 'PRI' ELSE '' END AS column_key,
    coalesce(default_value, '') AS column_default, CASE WHEN is_primary THEN 'auto_increment' ELSE '' END AS extra, coalesce(comment, '') AS column_comment,
    row_number() OVER (PARTITION BY schema_id, table_name, name ORDER BY layer_seq DESC) AS nth
  FROM column_frag) x
WHERE nth = 1""",
    "fks": """
SELECT DISTINCT CAST(schema_id AS STRING) AS schema_id, table_name, foreign_key AS column_name, CASE WHEN layer_seq % 5 = 0 THEN 'gone' ELSE target END AS ref_table
FROM assoc_frag""",
    "indexes": """
SELECT schema_id, table_name, concat('ix', CAST(ordinal % 3 AS STRING)) AS index_name, CASE WHEN ordinal % 3 = 1 THEN 0 ELSE 1 END AS non_unique,
  CAST(row_number() OVER (PARTITION BY schema_id, table_name, ordinal % 3 ORDER BY column_name DESC) AS INT) AS seq,
  CASE WHEN ordinal % 9 = 0 THEN '' ELSE column_name END AS column_name
FROM cat_columns""",
}
#: Relations that others are derived from.
_NEEDS = {"tables": ["table_frag"], "columns": ["column_frag"], "fks": ["assoc_frag"], "indexes": ["cat_columns"]}
_TYPE = "coalesce(CASE lower(data_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SQL_TYPES.items()) + " END, lower(data_type))"
_MORE = {
    **{f"cat_{k}": v for k, v in ROWS.items()},
    "base_": "SELECT schema_id, table_name, table_comment FROM cat_tables WHERE table_type = 'BASE TABLE'",
    "columns_": f"SELECT c.*, {_TYPE} AS type FROM cat_columns c SEMI JOIN base_ b ON b.schema_id = c.schema_id AND b.table_name = c.table_name",
    "indexes_": """SELECT i.schema_id, i.table_name, index_name, list(column_name ORDER BY seq) AS names, max(non_unique) = 0 AS is_unique
  FROM cat_indexes i SEMI JOIN base_ b ON b.schema_id = i.schema_id AND b.table_name = i.table_name GROUP BY i.schema_id, i.table_name, index_name""",
}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = with_ctes(sql, **_MORE)
        return f

    return add


def landed(spark, sf_dir, *names: str, keep: bool = False) -> dict:
    """The row sets ``names``, landed in the shared folder and read back by the data source; relations that need others are not
    to be used. With ``keep`` landed files are read once, for several relations."""
    made = frames(spark, sf_dir, keep=True)
    rows: dict = {}
    for name, sql in ROWS.items():
        if name not in names and not (name == "columns" and "indexes" in names):
            continue
        source = _NEEDS[name][0]
        rows[name] = spark.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: made[source]})
        if name == "columns" and {"columns", "indexes"} <= set(names):
            rows[name] = written(rows[name], "cat_columns")  # indexes are derived from them
        made[f"cat_{name}"] = rows[name]
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    fleet.land({name: rows[name] for name in names}, path)
    back = fleet.row_sets(spark, path=path)
    return catalogue.catalogue_from_rows({k: written(df, k) for k, df in back.items()} if keep else back)


@query(
    "fleet_tables",
    "SELECT schema_id, table_name, nullif(table_comment, '') AS comment, (SELECT min_by(column_name, ordinal) FROM columns_ c WHERE c.schema_id = b.schema_id AND c.table_name = b.table_name AND column_key = 'PRI') AS primary_key FROM base_ b",
)
def fleet_tables(spark, sf_dir):
    return landed(spark, sf_dir, "tables", "columns")["tables"].withColumn("primary_key", F.get("primary_key", F.lit(0)))


@query(
    "fleet_columns",
    "SELECT schema_id, table_name, ordinal AS pos, column_name AS name, type, column_type AS sql_type, is_nullable = 'YES' AS nullable, column_key = 'PRI' AS is_primary, nullif(column_default, '') AS default_value, nullif(extra, '') AS extra, nullif(column_comment, '') AS comment FROM columns_",
)
def fleet_columns(spark, sf_dir):
    return landed(spark, sf_dir, "tables", "columns")["columns"].withColumnsRenamed({"primary": "is_primary", "default": "default_value"})


@query("fleet_indexes", "SELECT schema_id, table_name, index_name AS name, array_to_string(names, ',') AS columns, is_unique FROM indexes_")
def fleet_indexes(spark, sf_dir):
    return landed(spark, sf_dir, "tables", "indexes")["indexes"].select("schema_id", "table_name", "name", F.array_join("columns", ",").alias("columns"), F.col("unique").alias("is_unique"))


@query(
    "fleet_fks",
    """SELECT k.schema_id, k.table_name, CASE WHEN EXISTS (SELECT 1 FROM indexes_ i WHERE i.schema_id = k.schema_id AND i.table_name = k.table_name AND i.is_unique AND i.names = [k.column_name]) THEN 'has_one' ELSE 'belongs_to' END AS type,
      regexp_replace(k.column_name, '_id$', '') AS name, k.ref_table AS target, k.column_name AS foreign_key
    FROM cat_fks k JOIN base_ b ON b.schema_id = k.schema_id AND b.table_name = k.table_name JOIN base_ r ON r.schema_id = k.schema_id AND r.table_name = k.ref_table""",
)
def fleet_fks(spark, sf_dir):
    return landed(spark, sf_dir, "tables", "fks", "indexes")["associations"].drop("provenance")


@query(
    "fleet_violations",
    """SELECT schema_id, concat(table_name, '.', column_name) AS path, 'column without a type' AS rule FROM columns_ WHERE type = ''
    UNION ALL SELECT schema_id, concat(table_name, '.indexes'), 'index column without a name' FROM indexes_ WHERE list_contains(names, '')""",
)
def fleet_violations(spark, sf_dir):
    c = {k: written(df, k) for k, df in landed(spark, sf_dir, *ROWS, keep=True).items()}
    return validate.fragments(c["tables"], c["columns"], c["indexes"], c["associations"], complete=True).drop("layer_seq")
