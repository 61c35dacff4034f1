"""Data-grounded checks on the star schema."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeatlas.operators import edges, profile

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
EDGES = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]
#: Columns of the tables, for the SQL; the queries take them from the tables themselves.
COLUMNS = {
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "bigint", "c_acctbal": "double", "c_mktsegment": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "embeddings": {"vec_id": "bigint", "embedding": "array", "label": "bigint"},
    "events": {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "labels": {"doc_id": "bigint", "quality": "bigint", "toxic": "bigint"},
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "bigint",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp",
    },
    "nation": {"n_nationkey": "bigint", "n_name": "string", "n_regionkey": "bigint"},
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp",
        "o_orderpriority": "string",
    },
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "bigint", "p_retailprice": "double"},
    "region": {"r_regionkey": "bigint", "r_name": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "bigint", "s_acctbal": "double"},
}
TABLES = list(COLUMNS)


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in TABLES}


def column_profile(spark, sf_dir):
    """Every column of every table."""
    return profile.column_profiles(_tables(spark, sf_dir))


def key_discovery(spark, sf_dir):
    """Among all columns of every table."""
    return profile.discover_all_keys(_tables(spark, sf_dir))


def key_violations(spark, sf_dir):
    return profile.key_violations(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def fk_integrity(spark, sf_dir):
    return reduce(DataFrame.union, (profile.integrity(read(spark, sf_dir, t), c, read(spark, sf_dir, p), k, f"{t}.{c}->{p}.{k}") for t, c, p, k in EDGES))


def fk_cardinality(spark, sf_dir):
    return reduce(DataFrame.union, (profile.cardinality(read(spark, sf_dir, t), c, f"{t}.{c}->{p}.{k}") for t, c, p, k in EDGES))


def inclusion_deps(spark, sf_dir):
    """Among all columns of the same type."""
    return profile.inclusion_dependencies(_tables(spark, sf_dir))


def likely_parents(spark, sf_dir):
    return profile.likely_parents(profile.inclusion_scores(_tables(spark, sf_dir)))


def fk_coverage(spark, sf_dir):
    """Every declared edge, over every column."""
    declared = spark.createDataFrame([(f"{t}.{c}", f"{p}.{k}") for t, c, p, k in EDGES], "child string, parent string")
    return profile.coverage(_by_name(spark, _tables(spark, sf_dir)), inclusion_deps(spark, sf_dir), declared)


def _by_name(spark, tables):
    """(child, parent) of the edges that the catalogue's own inference finds. Columns ``x_<stem>key`` are read as ``<stem>_id``;
    the parent is the column that has that name in the target."""
    rows = [("lake", t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns, 1)]
    columns = spark.createDataFrame(rows, "schema_id string, table_name string, pos int, full string").withColumns(
        {"name": F.regexp_replace("full", "^[a-z]+_([a-z]+)key$", "$1_id"), "primary": F.lit(False)}
    )
    found = columns.select("schema_id", "table_name").distinct()
    none = columns.where("false").withColumns({"columns": F.array("name"), "unique": F.lit(True), "target": F.lit("")})
    edge = edges.infer_fks(found, columns, none, none).select("schema_id", "table_name", "target", F.col("foreign_key").alias("name"))
    child = edge.join(columns, ["schema_id", "table_name", "name"]).select("schema_id", "target", "name", F.concat_ws(".", "table_name", "full").alias("child"))
    parent = columns.select("schema_id", F.col("table_name").alias("target"), "name", F.concat_ws(".", "table_name", "full").alias("parent"))
    return child.join(parent, ["schema_id", "target", "name"]).select("child", "parent")


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


QUERIES = {
    "column_profile": column_profile,
    "key_discovery": key_discovery,
    "key_violations": key_violations,
    "fk_integrity": fk_integrity,
    "fk_cardinality": fk_cardinality,
    "inclusion_deps": inclusion_deps,
    "fk_coverage": fk_coverage,
}
QUERIES |= {"likely_parents": likely_parents}
_ALL = [(t, c, kind) for t, cs in COLUMNS.items() for c, kind in cs.items()]
_VALUES = _union(f"SELECT DISTINCT '{kind}' AS kind, '{t}.{c}' AS name, CAST({c} AS VARCHAR) AS v FROM {t} WHERE {c} IS NOT NULL" for t, c, kind in _ALL)
_SCORES = f"""WITH vals AS MATERIALIZED ({_VALUES}), sizes AS (SELECT name, count(*) AS n FROM vals GROUP BY name),
  both_ AS (SELECT a.name AS child, b.name AS parent, count(*) AS n FROM vals a JOIN vals b ON a.kind = b.kind AND a.v = b.v AND a.name <> b.name GROUP BY 1, 2)
  SELECT child, parent, sizes.n AS n_values, both_.n AS n_both FROM both_ JOIN sizes ON name = child"""
_DEPS = f"SELECT child, parent, n_values FROM ({_SCORES}) s WHERE n_both = n_values"
#: Edges by name: key columns of one stem, of which the parent's table is called by the stem or its plural.
_NAMED = [
    ("customer.c_nationkey", "nation.n_nationkey"),
    ("supplier.s_nationkey", "nation.n_nationkey"),
    ("nation.n_regionkey", "region.r_regionkey"),
    ("lineitem.l_orderkey", "orders.o_orderkey"),
    ("lineitem.l_partkey", "part.p_partkey"),
]
_pairs = lambda pairs: "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") AS p(child, parent)"
ORACLES = {
    "column_profile": _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, count(*) > count({c}) AS nullable, count(DISTINCT {c}) = count(*) AND count(*) > 0 AS is_unique FROM {t}" for t, c, _ in _ALL
    ),
    "key_discovery": _union(
        [f"SELECT '{t}' AS table_name, '{c}' AS key_columns FROM {t} HAVING count(DISTINCT {c}) = count(*)" for t, c, _ in _ALL]
        + [
            f"SELECT '{t}', '{a},{b}' FROM {t} HAVING count(DISTINCT ({a}, {b})) = count(*) AND count({a}) = count(*) AND count({b}) = count(*) AND count(DISTINCT {a}) < count(*) AND count(DISTINCT {b}) < count(*)"
            for t, cs in COLUMNS.items() for a, b in combinations(cs, 2)
        ]
    ),
    "key_violations": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "fk_integrity": _union(
        f"SELECT '{t}.{c}->{p}.{k}' AS edge, count(*) AS n_rows, count(*) - count({c}) AS n_null, count_if({c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p} WHERE {k} IS NOT NULL)) AS n_orphans, (count(*) - count({c})) / count(*) AS null_share FROM {t}" for t, c, p, k in EDGES
    ),
    "fk_cardinality": _union(
        f"SELECT '{t}.{c}->{p}.{k}' AS edge, CASE WHEN max(n) = 1 THEN 'has_one' ELSE 'belongs_to' END AS type, min(n) AS min_fan, sum(n) / count(*) AS avg_fan, max(n) AS max_fan, count(*) AS n_parents, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1) x" for t, c, p, k in EDGES
    ),
    "inclusion_deps": _DEPS,
    "likely_parents": f"""SELECT child, parent, containment, same_name FROM (
      SELECT *, row_number() OVER (PARTITION BY child ORDER BY containment DESC, same_name DESC, parent) AS nth FROM (
        SELECT child, parent, n_both / n_values AS containment, regexp_replace(split_part(child, '.', 2), '^[a-z]_', '') = regexp_replace(split_part(parent, '.', 2), '^[a-z]_', '') AS same_name FROM ({_SCORES}) s) x
      WHERE containment >= 0.9) y WHERE nth = 1""",
    "fk_coverage": f"SELECT child, parent, bool_or(w = 1) AS named, bool_or(w = 2) AS confirmed, bool_or(w = 3) AS declared FROM (SELECT child, parent, 1 AS w FROM {_pairs(_NAMED)} UNION ALL SELECT child, parent, 2 FROM ({_DEPS}) d UNION ALL SELECT child, parent, 3 FROM {_pairs([(f'{t}.{c}', f'{p}.{k}') for t, c, p, k in EDGES])}) z GROUP BY child, parent",
}
