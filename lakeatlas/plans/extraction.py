"""Sources over texts that Spark derives from the catalogue: schemas are written as text and extracted again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeatlas.operators import canonical, validate
from lakeatlas.sources import corpus, documents as sources

from .catalogue import KEY, merged
from .derived import fragments, with_ctes
from .documents import _ON, dbml_text, documents, final, final_sql, mermaid_text

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def as_files(texts, name: str):
    return texts.select(F.col("schema_id").cast("string").alias("project"), F.lit(name).alias("path"), F.col("text").alias("content"))


@query(
    "dbml_extract",
    final_sql(
        f"""SELECT CAST(c.schema_id AS VARCHAR) AS project, c.table_name, c.pos, c.name, c.type, c.nullable AND NOT (c.is_primary AND coalesce(k.n, 0) = 1) AS nullable, c.is_primary AND coalesce(k.n, 0) = 1 AS is_primary
      FROM columns_ c LEFT JOIN (SELECT {KEY}, count(*) AS n FROM columns_ WHERE is_primary GROUP BY {KEY}) k ON {_ON.format("k", "c")}"""
    ),
)
def dbml_extract(spark, sf_dir):
    c = corpus.dbml(as_files(dbml_text(spark, sf_dir), "schema.dbml"))["columns"]
    return c.select("project", "table_name", "pos", "name", "type", "nullable", F.col("primary").alias("is_primary"))


@query("mermaid_extract", final_sql("SELECT CAST(schema_id AS VARCHAR) AS project, table_name, pos, name, type, is_primary FROM columns_"))
def mermaid_extract(spark, sf_dir):
    c = corpus.mermaid(as_files(mermaid_text(spark, sf_dir), "schema.mmd"))["columns"]
    return c.select("project", "table_name", "pos", "name", "type", F.col("primary").alias("is_primary"))


@query("snapshot_columns", final_sql(f"SELECT {KEY}, pos, name, type, nullable, is_primary FROM columns_"))
def snapshot_columns(spark, sf_dir):
    docs = documents(final(spark, sf_dir)).select("schema_id", canonical.snapshot(F.col("doc")).alias("doc"))
    c = canonical.exploded(sources.read_snapshots(docs)[0])["columns"]
    return c.select("schema_id", "table_name", (F.col("pos") + 1).alias("pos"), "name", "type", "nullable", F.col("primary").alias("is_primary"))


@query(
    "dangling_targets",
    final_sql(
        "SELECT e.schema_id, concat(e.table_name, '.', e.name) AS path, 'target does not exist' AS rule FROM edges_ e WHERE NOT EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = e.schema_id AND t.table_name = e.target)"
    ),
)
def dangling_targets(spark, sf_dir):
    m = merged(spark, sf_dir)
    missing = m["tables"].select("schema_id", "table_name", F.lit(False).alias("schema_missing"))
    keys = m["tables"].select("schema_id", "table_name", F.array().cast("array<string>").alias("primary_key"))
    return validate.references(m["tables"], m["columns"], keys, m["edges"], missing).where("rule = 'target does not exist'").select("schema_id", "path", "rule")


@query("duplicate_tables", with_ctes("SELECT schema_id, table_name AS path, count(*) AS n FROM table_frag GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_tables(spark, sf_dir):
    t = fragments(spark, sf_dir)["tables"]
    again = validate.duplicates(t.drop("layer_seq"), ["table_name"], "table defined twice")
    return again.join(
        t.groupBy("schema_id", F.col("table_name").alias("path")).agg(F.count("*").alias("n")),
        ["schema_id", "path"],
    ).select("schema_id", "path", "n")


@query("dbml_refs_extract", final_sql(f"SELECT DISTINCT CAST(e.schema_id AS VARCHAR) AS project, e.table_name, e.foreign_key AS column_name, e.target AS ref_table FROM final_ e JOIN (SELECT {KEY} FROM columns_ WHERE is_primary GROUP BY {KEY} HAVING count(*) = 1) k ON k.schema_id = e.schema_id AND k.table_name = e.target JOIN columns_ c ON {_ON.format('c', 'e')} AND c.name = e.foreign_key"))
def dbml_refs_extract(spark, sf_dir):
    """References read back from the DBML text: those between tables and columns that it defines."""
    refs = corpus.dbml(as_files(dbml_text(spark, sf_dir), "schema.dbml"))["refs"]
    return refs.select("project", "table_name", "column_name", "ref_table")


def _gathered(rows, order, item, name: str):
    """(schema_id, table_name, lines of its rows in order)."""
    lines = F.sort_array(F.collect_list(F.struct(order.alias("o"), item.alias("t")))).getField("t")
    return rows.groupBy("schema_id", "table_name").agg(F.array_join(lines, "\n").alias(name))


def _blocks_of(m, header, inner, names: list[str], closing: str):
    """(schema_id, text): a block for each table of ``m``: its header, the lines that ``inner`` has for it under ``names``, and the
    closing line."""
    own = m["tables"].select("schema_id", "table_name")
    for rows in inner:
        own = own.join(rows, ["schema_id", "table_name"], "left")
    block = F.concat_ws("\n", header, *names, F.lit(closing))
    return own.groupBy("schema_id").agg(F.array_join(F.sort_array(F.collect_list(block)), "\n").alias("text"))


def schema_rb_text(m):
    """(schema_id, text): merged schemas as Rails schema files, unique indexes and foreign keys included."""
    column = F.format_string('    t.%s "%s"%s', "type", "name", F.when(F.col("nullable"), "").otherwise(", null: false"))
    index = F.format_string('    t.index ["%s"], unique: true', F.array_join("columns", '", "'))
    inner = [_gathered(m.once("ordered"), F.col("pos"), column, "cols"), _gathered(m["indexes"], F.lit(0), index, "ixs")]
    body = _blocks_of(m, F.format_string('  create_table "%s", id: false do |t|', "table_name"), inner, ["cols", "ixs"], "  end")
    key = F.format_string('  add_foreign_key "%s", "%s", column: "%s"', "table_name", "target", "foreign_key")
    keys = m["edges"].select("schema_id", key.alias("k")).groupBy("schema_id").agg(F.array_join(F.sort_array(F.collect_set("k")), "\n").alias("keys"))
    whole = F.concat_ws("\n", F.lit("ActiveRecord::Schema.define do"), "text", "keys", F.lit("end"), F.lit(""))
    return body.join(keys, "schema_id", "left").select("schema_id", whole.alias("text"))


@query(
    "schema_rb_extract",
    final_sql(
        f"""SELECT DISTINCT CAST(e.schema_id AS VARCHAR) AS project, e.table_name, CASE WHEN i.column_name IS NOT NULL THEN 'has_one' ELSE 'belongs_to' END AS type, regexp_replace(e.foreign_key, '_id$', '') AS name, e.target, e.foreign_key
      FROM final_ e JOIN columns_ c ON {_ON.format("c", "e")} AND c.name = e.foreign_key LEFT JOIN indexes_ i ON {_ON.format("i", "e")} AND i.column_name = e.foreign_key"""
    ),
)
def schema_rb_extract(spark, sf_dir):
    """Edges of schema files rendered from the catalogue, their pending keys resolved by the job."""
    e = corpus.schema_rb(as_files(schema_rb_text(final(spark, sf_dir)), "db/schema.rb"))["edges"]
    return e.select("project", "table_name", "type", "name", "target", "foreign_key")


def _model(name):
    return F.concat(F.lit("M"), name, F.length(name))


def laravel_text(m):
    """(schema_id, text): a model class for each table, with a method for each of its edges."""
    call = F.concat(F.lit("  // function no() { }\n  public function "), "name", F.lit("() {\n    return $this->belongsTo(\n      "), _model(F.col("target")), F.lit("::class, '"), "foreign_key", F.lit("');\n  }"))
    header = F.concat(F.lit("class "), _model(F.col("table_name")), F.lit(" extends Model {\n  protected $table = '"), "table_name", F.lit("';"))
    body = _blocks_of(m, header, [_gathered(m["edges"], F.struct("foreign_key", "target", "name"), call, "lines")], ["lines"], "}")
    return body.select("schema_id", F.concat(F.lit("<?php\nclass Home extends Controller { function users() { $this->hasMany(X::class); } }\n"), "text", F.lit("\n")).alias("text"))


@query("laravel_extract", final_sql("SELECT CAST(schema_id AS VARCHAR) AS project, table_name, 'belongs_to' AS type, name, target, foreign_key FROM final_"))
def laravel_extract(spark, sf_dir):
    """Edges of Eloquent models rendered from the catalogue: calls over several lines, comments and a controller between them."""
    e = corpus.laravel_models(as_files(laravel_text(final(spark, sf_dir)), "app/Models/all.php"))["edges"]
    return e.select(F.col("schema_id").alias("project"), "table_name", "type", "name", "target", "foreign_key")
