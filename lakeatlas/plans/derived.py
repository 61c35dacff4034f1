"""A catalogue of a whole fleet derived from ``orders`` (table fragments) and ``lineitem`` (column fragments).

The text is SQL that Spark and DuckDB both run, so that queries over it have an oracle on the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeatlas.operators.store import written

STEMS = ["user", "order", "category", "box", "address", "product", "tag", "day"]
PLURALS = ["users", "orders", "categories", "boxes", "addresses", "products", "tags", "days"]
KINDS = ["config", "db", "schema", "framework", "sketch"]
#: Ranks of the layer kinds for physical facts (types, keys, defaults) and for logical ones (comments).
PHYSICAL = {"config": 4, "db": 3, "schema": 2, "framework": 1, "sketch": 0}
LOGICAL = {"config": 4, "framework": 3, "schema": 2, "db": 1, "sketch": 0}
#: Facts that every column fragment has an opinion on.
ALWAYS = ("type", "nullable", "primary")


def pick(value: str, names: list[str], start: int = 0) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {i + start} THEN '{n}'" for i, n in enumerate(names)) + " END"


def rank_sql(kind: str, ranks: dict[str, int]) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in ranks.items()) + " END"


TABLE_FRAG = f"""
SELECT o_custkey AS schema_id, o_orderkey AS layer_seq, {pick("CAST(substr(o_orderpriority, 1, 1) AS INT)", KINDS, 1)} AS kind,
  CASE WHEN o_orderkey % 3 = 0 THEN {pick("o_orderkey % 8", STEMS)} ELSE {pick("o_orderkey % 8", PLURALS)} END AS table_name,
  o_orderstatus <> 'P' AS has_comment,
  CASE o_orderstatus WHEN 'O' THEN '' WHEN 'F' THEN concat('c', CAST(o_orderkey AS STRING)) END AS comment,
  o_orderstatus AS status, o_orderdate AS seen_on
FROM orders"""

COLUMN_FRAG = f"""
SELECT schema_id, layer_seq, kind, table_name, pos, name, type, nullable, is_primary, has_default, default_value, has_comment, comment, status, seen_on, edge FROM (
  SELECT t.schema_id, t.layer_seq, t.kind, t.table_name, CAST(l_linenumber AS INT) AS pos,
    CASE WHEN l_linenumber <= 4 THEN concat({pick("l_partkey % 8", STEMS)}, '_id') ELSE concat('c', CAST(l_suppkey % 10 AS STRING)) END AS name,
    CASE l_returnflag WHEN 'A' THEN 'bigint' WHEN 'N' THEN 'VARCHAR' ELSE 'timestamp' END AS type,
    l_linestatus = 'O' AS nullable, l_linenumber = 1 AND l_quantity < 10 AS is_primary,
    CAST(l_quantity AS INT) % 2 = 0 AS has_default, CASE WHEN CAST(l_quantity AS INT) % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS STRING) END AS default_value,
    l_tax > 0.04 AS has_comment, CASE WHEN l_discount <> 0 THEN concat('d', CAST(l_partkey AS STRING)) END AS comment,
    t.status, t.seen_on, l_suppkey % 4 = 0 AS edge,
    row_number() OVER (PARTITION BY t.layer_seq, CASE WHEN l_linenumber <= 4 THEN concat({pick("l_partkey % 8", STEMS)}, '_id') ELSE concat('c', CAST(l_suppkey % 10 AS STRING)) END ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth
  FROM lineitem JOIN table_frag t ON l_orderkey = t.layer_seq) x
WHERE nth = 1"""

INDEX_FRAG = """
SELECT schema_id, layer_seq, kind, table_name, name AS column_name FROM (
  SELECT schema_id, layer_seq, kind, table_name, name, row_number() OVER (PARTITION BY layer_seq ORDER BY pos, name) AS nth FROM column_frag WHERE status = 'F') x
WHERE nth = 1"""

ASSOC_FRAG = f"""
SELECT schema_id, layer_seq, kind, table_name, pos, 'belongs_to' AS type, substr(name, 1, length(name) - 3) AS name,
  CASE substr(name, 1, length(name) - 3) {" ".join(f"WHEN '{s}' THEN '{p}'" for s, p in zip(STEMS, PLURALS))} END AS target, name AS foreign_key,
  CASE kind WHEN 'config' THEN 'manual' WHEN 'db' THEN 'db_fk' WHEN 'schema' THEN 'schema_fk' ELSE 'declared' END AS provenance
FROM column_frag WHERE name LIKE '%\\_id' ESCAPE '\\' AND edge"""

CTES = {"table_frag": TABLE_FRAG, "column_frag": COLUMN_FRAG, "index_frag": INDEX_FRAG, "assoc_frag": ASSOC_FRAG}


def with_ctes(body: str, **more: str) -> str:
    """DuckDB SQL over the derived catalogue; ``more`` are further common table expressions."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in {**CTES, **more}.items()) + "\n" + body


def frames(spark: SparkSession, sf_dir: str, keep: bool = False) -> dict[str, DataFrame]:
    """The four fragment relations as DataFrames; with ``keep`` those of columns, from which others follow, are written once."""
    # backslashes are doubled in Spark's string literals
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem")}
    made: dict[str, DataFrame] = {}
    for name, sql in CTES.items():
        source = {**read, **made}
        text = sql.replace("ESCAPE '\\'", "ESCAPE '\\\\'").replace("%\\_id", "%\\\\_id")
        used = [k for k in source if f"FROM {k}" in text or f"JOIN {k}" in text]
        for k in used:
            text = text.replace(f"FROM {k}", f"FROM {{{k}}}").replace(f"JOIN {k}", f"JOIN {{{k}}}")
        made[name] = spark.sql(text, **{k: source[k] for k in used})
        if keep and name == "column_frag":
            made[name] = written(made[name], name)
    return made


def fragments(spark: SparkSession, sf_dir: str, keep: bool = False) -> dict[str, DataFrame]:
    """The same in the operators' form: ``present`` arrays say which facts a fragment has an opinion on."""
    return in_form(frames(spark, sf_dir, keep))


def in_form(f: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The relations of ``frames`` in the operators' form."""
    from pyspark.sql import functions as F

    has = lambda cond, name: F.when(cond, F.lit(name))
    always = [F.lit(x) for x in ALWAYS]
    columns = f["column_frag"].select(
        "schema_id",
        "layer_seq",
        "kind",
        "table_name",
        "pos",
        "name",
        F.array_compact(F.array(*always, has(F.col("has_default"), "default"), has(F.col("has_comment"), "comment"))).alias("present"),
        "type",
        "nullable",
        F.col("is_primary").alias("primary"),
        F.col("default_value").alias("default"),
        "comment",
        "seen_on",
    )
    tables = f["table_frag"].select(
        "schema_id",
        "layer_seq",
        "kind",
        "table_name",
        F.array_compact(F.array(has(F.col("has_comment"), "comment"))).alias("present"),
        "comment",
        "seen_on",
    )
    indexes = f["index_frag"].select(
        "schema_id",
        "layer_seq",
        "kind",
        "table_name",
        F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("name"),
        F.array("column_name").alias("columns"),
        F.lit(True).alias("unique"),
    )
    assocs = f["assoc_frag"].select(
        "schema_id",
        "layer_seq",
        "kind",
        "table_name",
        "pos",
        "type",
        "name",
        "target",
        "foreign_key",
        F.lit(None).cast("string").alias("through"),
        F.lit(False).alias("polymorphic"),
        "provenance",
    )
    return {"tables": tables, "columns": columns, "indexes": indexes, "associations": assocs}
