"""Validation rules and renderings of differences over derived rows that break them, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeatlas.operators import diff, validate

from .derived import frames, with_ctes
from .details import _indexes, edge_sql, rich, rich_sql
from .documents import DRIFT_SQL, drift

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _made(spark, sql: str, **source):
    """``sql`` over DataFrames by name."""
    for k in source:
        sql = sql.replace(f"FROM {k}", f"FROM {{{k}}}")
    return spark.sql(sql, **source)


_LAYERS = """SELECT schema_id, layer_seq, CASE layer_seq % 9 WHEN 0 THEN '' WHEN 1 THEN 'ghost' ELSE kind END AS kind,
  CASE WHEN layer_seq % 10 = 0 THEN '  ' ELSE concat('p', CAST(layer_seq % 4 AS STRING)) END AS provider, layer_seq % 2 = 0 AS allow_empty FROM table_frag"""


@query(
    "layer_violations",
    with_ctes(
        """SELECT schema_id, layer_seq, 'kind' AS path, 'layer without a kind' AS rule FROM layers WHERE kind = ''
        UNION ALL SELECT schema_id, layer_seq, 'kind', 'unknown kind' FROM layers WHERE kind = 'ghost'
        UNION ALL SELECT schema_id, layer_seq, 'provider', 'layer without a provider' FROM layers WHERE provider = '  '
        UNION ALL SELECT schema_id, layer_seq, provider, 'source yields no table' FROM layers WHERE NOT allow_empty AND layer_seq % 3 = 0""",
        layers=_LAYERS,
    ),
)
def layer_violations(spark, sf_dir):
    """Layers of no or an unknown kind, without a provider, and without tables where that is not allowed."""
    t = frames(spark, sf_dir)["table_frag"]
    layers = _made(spark, _LAYERS, table_frag=t)
    return validate.layers(layers).unionByName(validate.empty_layers(layers, t.where("layer_seq % 3 <> 0")))


_DROPPED = "SELECT DISTINCT schema_id, table_name, name FROM column_frag WHERE kind = 'config'"
_BASE = "SELECT DISTINCT schema_id, table_name, name FROM column_frag WHERE kind <> 'config'"


@query("drop_violations", with_ctes(f"SELECT schema_id, concat(table_name, '.', name) AS path, 'drop of what is not there' AS rule FROM ({_DROPPED} EXCEPT {_BASE}) d"))
def drop_violations(spark, sf_dir):
    """Columns that a config drops and that no other layer has."""
    c = frames(spark, sf_dir, keep=True)["column_frag"]
    return validate.drops(_made(spark, _DROPPED, column_frag=c), _made(spark, _BASE, column_frag=c), ["table_name", "name"]).drop("layer_seq")


_RELATIONS = """SELECT schema_id, CASE WHEN layer_seq % 7 = 0 THEN '' WHEN layer_seq % 8 = 0 THEN 'ghost' ELSE table_name END AS table_name,
  CASE WHEN layer_seq % 6 = 0 THEN 'lost' ELSE foreign_key END AS column_name, CASE WHEN layer_seq % 5 = 0 THEN 'nowhere' ELSE target END AS target
FROM rich WHERE kind = 'config'"""
_T = "EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = f.schema_id AND t.table_name = f.{0})"


@query(
    "relation_violations",
    rich_sql(
        f"""SELECT schema_id, concat('relations.', table_name) AS path, 'lacks table_name' AS rule FROM relations WHERE table_name = ''
        UNION ALL SELECT schema_id, concat('relations.', table_name), 'lacks column_name' FROM relations WHERE column_name IS NULL
        UNION ALL SELECT schema_id, table_name, 'unknown table' FROM complete f WHERE NOT {_T.format('table_name')}
        UNION ALL SELECT schema_id, target, 'unknown target' FROM complete f WHERE NOT {_T.format('target')}
        UNION ALL SELECT schema_id, concat(table_name, '.', column_name), 'unknown column' FROM complete f WHERE {_T.format('table_name')} AND NOT EXISTS (SELECT 1 FROM column_frag c WHERE c.schema_id = f.schema_id AND c.table_name = f.table_name AND c.name = f.column_name)""",
        relations=_RELATIONS,
        complete="SELECT * FROM relations WHERE table_name <> '' AND column_name IS NOT NULL",
    ),
)
def relation_violations(spark, sf_dir):
    """Config relations that lack a key, or whose table, target or column is not there."""
    r = rich(spark, sf_dir)
    return validate.relations(_made(spark, _RELATIONS, rich=r["rich"]), r["tables"], r["column_frag"]).drop("layer_seq")


_KEY_NAMES = "SELECT schema_id, table_name, min(name) AS first_name, max(layer_seq) % 4 = 0 AS broken, max(layer_seq) % 6 = 0 AS schema_missing FROM column_frag GROUP BY schema_id, table_name"
_FK = "CASE WHEN length(target) % 2 = 0 THEN concat(foreign_key, '_x') ELSE foreign_key END"


@query(
    "reference_violations",
    edge_sql(
        f"""SELECT schema_id, concat(table_name, '.lost') AS path, 'primary key column does not exist' AS rule FROM key_names WHERE broken
        UNION ALL SELECT schema_id, concat(table_name, '.', name), 'target does not exist' FROM rich_edges f WHERE NOT polymorphic AND NOT {_T.format('target')}
        UNION ALL SELECT e.schema_id, concat(e.table_name, '.', {_FK}), 'foreign key column does not exist' FROM rich_edges e JOIN key_names k ON k.schema_id = e.schema_id AND k.table_name = e.table_name AND NOT k.schema_missing
          WHERE foreign_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM column_frag c WHERE c.schema_id = e.schema_id AND c.table_name = e.table_name AND c.name = {_FK})""",
        key_names=_KEY_NAMES,
    ),
)
def reference_violations(spark, sf_dir):
    """Keys, targets and foreign keys that the final schema does not have; tables without columns are not asked for theirs."""
    r = rich(spark, sf_dir)
    k = _made(spark, _KEY_NAMES, column_frag=r["column_frag"])
    keys = k.select("schema_id", "table_name", F.when(F.col("broken"), F.array(F.lit("lost"), "first_name")).otherwise(F.array("first_name")).alias("primary_key"))
    return validate.references(r["tables"], r["column_frag"], keys, r["edges"].withColumn("foreign_key", F.expr(_FK)), k).drop("layer_seq")


_DOCUMENT = """SELECT layer_seq AS schema_id, table_name, layer_seq % 2 = 0 AS old_version, layer_seq % 3 = 0 AS number_for_boolean, layer_seq % 4 = 0 AS other_mode, layer_seq % 5 = 0 AS no_name,
  layer_seq % 6 = 0 AS strange, layer_seq % 7 = 0 AS two_keys, layer_seq % 8 = 0 AS no_target, layer_seq % 9 = 0 AS other_type, layer_seq % 10 = 0 AS no_columns, layer_seq % 11 = 0 AS no_object FROM table_frag"""
_CONTENT = """CASE WHEN no_object THEN '[1]' ELSE concat('{"version": ', CASE WHEN old_version THEN '0' ELSE '1' END, ', "infer_fk": ', CASE WHEN number_for_boolean THEN '1' ELSE 'true' END,
  ', "only": []', CASE WHEN strange THEN ', "strange": null' ELSE '' END, ', "tables": {"', table_name, '": {"columns_mode": "', CASE WHEN other_mode THEN 'append' ELSE 'merge' END,
  '", "comment": null, "columns": [{"name": "id"}, {', CASE WHEN no_name THEN '"type": null' ELSE '"name": "x"' END, '}], "indexes": [{"columns": [', CASE WHEN no_columns THEN '' ELSE '"id"' END,
  ']}], "associations": [{"type": "', CASE WHEN other_type THEN 'owns' ELSE 'has_one' END, '", "name": "a", "foreign_key": ', CASE WHEN two_keys THEN '["x", "y"]' ELSE '"x"' END,
  CASE WHEN no_target THEN ', "drop": true' ELSE ', "target": "t"' END, '}]}}}') END"""


@query(
    "config_violations",
    with_ctes(
        """SELECT schema_id, '' AS path, 'not a JSON object' AS rule FROM docs WHERE no_object
        UNION ALL SELECT schema_id, 'version', 'is not 1' FROM docs WHERE NOT no_object AND old_version
        UNION ALL SELECT schema_id, 'infer_fk', 'is not boolean' FROM docs WHERE NOT no_object AND number_for_boolean
        UNION ALL SELECT schema_id, 'strange', 'unknown key' FROM docs WHERE NOT no_object AND strange
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.columns_mode'), 'is not merge or replace' FROM docs WHERE NOT no_object AND other_mode
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.columns[1]'), 'lacks name' FROM docs WHERE NOT no_object AND no_name
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.indexes[0]'), 'lacks columns' FROM docs WHERE NOT no_object AND no_columns
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.associations[0]'), 'foreign key of several columns' FROM docs WHERE NOT no_object AND two_keys
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.associations[0].foreign_key'), 'is not string' FROM docs WHERE NOT no_object AND two_keys
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.associations[0]'), 'unknown association type' FROM docs WHERE NOT no_object AND other_type
        UNION ALL SELECT schema_id, concat('tables.', table_name, '.associations[0]'), 'lacks target' FROM docs WHERE NOT no_object AND no_target""",
        docs=_DOCUMENT,
    ),
)
def config_violations(spark, sf_dir):
    """Syntax of a config document for each layer: keys, types, modes and required fields."""
    docs = _made(spark, _DOCUMENT, table_frag=frames(spark, sf_dir)["table_frag"])
    dealt = docs.repartition("schema_id")  # reading a document costs more than the row that it is made from
    return validate.config_documents(dealt.select("schema_id", F.expr(_CONTENT).alias("content"))).drop("layer_seq")


_ITEM = "concat_ws('|', type, target, name{0}, coalesce(foreign_key, ''), coalesce(through, ''), CASE WHEN polymorphic THEN 'true' ELSE '' END)"


@query(
    "structure_drift",
    edge_sql(
        f"""SELECT DISTINCT schema_id, 'index' AS level, table_name, concat(column_name, '|true') AS item, 'added' AS change FROM index_frag WHERE column_name LIKE '%id' OR column_name = 'c1'
        UNION ALL SELECT DISTINCT schema_id, 'index', table_name, 'c1|false', 'removed' FROM index_frag WHERE column_name = 'c1'
        UNION ALL SELECT DISTINCT schema_id, 'association', table_name, {_ITEM.format('')}, 'added' FROM rich_edges WHERE type IN ('has_one', 'has_and_belongs_to_many')
        UNION ALL SELECT DISTINCT schema_id, 'association', table_name, {_ITEM.format(" || '2'")}, 'removed' FROM rich_edges WHERE type = 'has_one'"""
    ),
)
def structure_drift(spark, sf_dir):
    """Indexes and edges of two states: the earlier had no index on keys, another uniqueness, other names and fewer edges."""
    r, now = rich(spark, sf_dir), _indexes(frames(spark, sf_dir))
    then = now.where("columns[0] NOT LIKE '%id'").withColumn("unique", F.expr("columns[0] <> 'c1'"))
    named = r["edges"].withColumn("name", F.when(F.col("type") == "has_one", F.concat("name", F.lit("2"))).otherwise(F.col("name")))
    both = {"tables": r["tables"], "columns": _final(r["column_frag"])}
    left = {**both, "indexes": now, "associations": r["edges"]}
    right = {**both, "indexes": then, "associations": named.where("type <> 'has_and_belongs_to_many'")}
    return diff.schema_diff(left, right).select("schema_id", "level", "table_name", "item", "change")


def _final(columns):
    """A row for each column, the last layer's."""
    last = F.max_by(F.struct("type", "nullable", F.col("is_primary").alias("primary"), F.col("default_value").alias("default"), "comment"), "layer_seq")
    return columns.groupBy("schema_id", "table_name", "name").agg(last.alias("x")).select("schema_id", "table_name", "name", "x.*")


_LINE = "concat(CASE change WHEN 'added' THEN '+ ' WHEN 'removed' THEN '- ' ELSE '~ ' END, level, ' ', table_name, CASE WHEN item <> '' THEN concat('.', item) ELSE '' END, CASE WHEN field IS NOT NULL THEN concat(' ', field, ': ', old, ' -> ', new) ELSE '' END)"
_JSON = "CAST(json_merge_patch('{}', json_object('change', change, 'field', field, 'item', item, 'level', level, 'new', new, 'old', old, 'table_name', table_name)) AS VARCHAR)"


@query("drift_as_text", f"SELECT schema_id, string_agg({_LINE}, chr(10) ORDER BY {_LINE}) AS text FROM ({DRIFT_SQL}) d GROUP BY schema_id")
def drift_as_text(spark, sf_dir):
    return diff.as_text(drift(spark, sf_dir))


@query("drift_as_json", f"SELECT schema_id, concat('[', string_agg({_JSON}, ',' ORDER BY {_JSON}), ']') AS json FROM ({DRIFT_SQL}) d GROUP BY schema_id")
def drift_as_json(spark, sf_dir):
    return diff.as_json(drift(spark, sf_dir))
