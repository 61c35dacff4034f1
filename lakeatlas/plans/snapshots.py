"""Snapshots with notes and groups: fingerprints, and the gate by leaves of the hash tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeatlas.operators import canonical, diff, hashtree
from lakeatlas.operators.store import written

from .catalogue import KEY, merged, merged_sql
from .details import EXTRA, note_rows, rich
from .documents import _FKS, _JSON_COLUMN, _JSON_EDGE, _ON, _Q, FINAL_SQL, final

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def snapshot_sql(body: str, **more: str) -> str:
    return merged_sql(body, **{k: v.replace("AS STRING", "AS VARCHAR") for k, v in EXTRA.items()}, final_=FINAL_SQL, fks=_FKS, **more)


def groups_of(r) -> DataFrame:
    members = r["members"].groupBy("schema_id", "group_id").agg(F.collect_list("table_name").alias("tables"))
    return r["groups_"].join(members, ["schema_id", "group_id"])


def notes_of(r, edges: DataFrame | None = None) -> DataFrame:
    """Resolved notes: those on tables and schemas, and with ``edges`` one on each of them."""
    own = note_rows(r).where("scope <> 'relation'")
    none = [c for c in ("type", "name", "foreign_key", "through") if c not in own.columns]
    own = own.withColumns({c: F.lit(None).cast("string") for c in none}).withColumn("polymorphic", F.lit(None).cast("boolean")).drop("url")
    if edges is None:
        return own
    on_edges = edges.select(
        "schema_id",
        F.concat_ws("/", F.lit("e"), "table_name", "target", "foreign_key").alias("note_id"),
        F.lit("relation").alias("scope"),
        F.lit("on an edge").alias("text"),
        F.col("table_name").alias("source_table"),
        *("target", "type", "name", "foreign_key"),
        F.lit(False).alias("polymorphic"),
    )
    return own.unionByName(on_edges, allowMissingColumns=True)


_NOTE_JSON = f"""CASE scope WHEN 'relation' THEN concat('{{"foreign_key":', {_Q("foreign_key")}, ',"id":', {_Q("note_id")}, ',"name":', {_Q("name")}, ',"polymorphic":false,"scope":"relation","source_table":', {_Q("source_table")},
    ',"target":', {_Q("target")}, ',"text":"on an edge","through":null,"type":', {_Q("type")}, '}}')
  ELSE concat('{{"id":', {_Q("note_id")}, ',"links":[{{"url":', {_Q("url")}, '}}],"scope":', {_Q("scope")}, CASE WHEN scope = 'table' THEN concat(',"table":', {_Q("table_name")}) ELSE '' END, ',"text":', {_Q("text")},
    CASE WHEN title IS NOT NULL THEN concat(',"title":', {_Q("title")}) ELSE '' END, '}}') END"""
_GROUP_JSON = f"""concat('{{', CASE WHEN color IS NOT NULL THEN concat('"color":', {_Q("color")}, ',') ELSE '' END, '"id":', {_Q("group_id")}, ',"tables":[', tables, ']', CASE WHEN title <> '' THEN concat(',"title":', {_Q("title")}) ELSE '' END, '}}')"""
_ALL_NOTES = """SELECT schema_id, note_id, scope, title, text, table_name, NULL AS source_table, NULL AS target, NULL AS type, NULL AS name, NULL AS foreign_key, url FROM notes WHERE scope <> 'relation'
  UNION ALL SELECT schema_id, concat_ws('/', 'e', table_name, target, foreign_key), 'relation', NULL, NULL, NULL, table_name, target, type, name, foreign_key, NULL FROM final_"""
_ALL_GROUPS = "SELECT g.schema_id, g.group_id, title, color, string_agg(concat('\"', table_name, '\"'), ',' ORDER BY table_name) AS tables FROM groups_ g JOIN members m ON m.schema_id = g.schema_id AND m.group_id = g.group_id GROUP BY ALL"


@query(
    "fingerprint_with_notes",
    snapshot_sql(
        f"""SELECT x.schema_id, any_value(n.c) AS n_notes, concat('sha256:', sha256(concat('{{"format":1,"schema":{{', any_value(coalesce(concat('"groups":[', g.js, '],'), '')), any_value(coalesce(concat('"notes":[', n.js, '],'), '')), '"tables":{{', string_agg(concat('"', x.table_name, '":', doc), ',' ORDER BY x.table_name), '}}}}}}'))) AS fingerprint FROM (
      SELECT t.schema_id, t.table_name, concat('{{"associations":[', coalesce(e.js, ''), '],"columns":[', coalesce(c.js, ''), ']', CASE WHEN t.comment IS NOT NULL THEN concat(',"comment":', {_Q("t.comment")}) ELSE '' END, ',"indexes":[', coalesce(i.js, ''), ']}}') AS doc
      FROM tables_ t LEFT JOIN (SELECT {KEY}, string_agg({_JSON_COLUMN}, ',' ORDER BY pos) AS js FROM columns_ GROUP BY {KEY}) c ON {_ON.format("c", "t")}
      LEFT JOIN (SELECT {KEY}, string_agg({_JSON_EDGE}, ',' ORDER BY type, name, foreign_key, target, provenance) AS js FROM final_ GROUP BY {KEY}) e ON {_ON.format("e", "t")}
      LEFT JOIN (SELECT {KEY}, string_agg(concat('{{"columns":["', column_name, '"],"unique":true}}'), ',' ORDER BY column_name) AS js FROM indexes_ GROUP BY {KEY}) i ON {_ON.format("i", "t")}) x
      LEFT JOIN (SELECT schema_id, count(*) AS c, string_agg({_NOTE_JSON}, ',' ORDER BY note_id) AS js FROM all_notes GROUP BY 1) n ON n.schema_id = x.schema_id
      LEFT JOIN (SELECT schema_id, string_agg({_GROUP_JSON}, ',' ORDER BY group_id) AS js FROM all_groups GROUP BY 1) g ON g.schema_id = x.schema_id GROUP BY x.schema_id""",
        all_notes=_ALL_NOTES,
        all_groups=_ALL_GROUPS,
    ),
)
def fingerprint_with_notes(spark, sf_dir):
    m, r = final(spark, sf_dir), rich(spark, sf_dir)
    notes = notes_of(r, m["edges"])
    docs = canonical.schema_json(canonical.table_json(m["tables"], m["columns"], m["indexes"], m["edges"]), canonical.note_json(notes), canonical.group_json(groups_of(r)))
    counts = notes.groupBy("schema_id").agg(F.count("*").alias("n_notes"))
    return docs.join(counts, "schema_id", "left").select("schema_id", "n_notes", canonical.fingerprint(F.col("doc")).alias("fingerprint"))


def edited_states(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The fleet with notes and groups as it is, and before: each sixth of the schemas differs in one kind of thing only."""
    m, r = merged(spark, sf_dir), rich(spark, sf_dir)
    now = {"tables": m["tables"], "columns": m["columns"], "notes": written(notes_of(r), "notes"), "groups": written(groups_of(r), "groups")}
    sixth = F.col("schema_id") % 6
    text = F.when((sixth == 0) & (F.col("scope") == "table"), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    color = F.when((sixth == 1) & (F.col("group_id") == "g0"), "#000").otherwise(F.col("color"))
    comment = F.when((sixth == 2) & (F.col("table_name") == "users"), "edited").otherwise(F.col("comment"))
    base = {
        "tables": now["tables"].withColumn("comment", comment),
        "columns": now["columns"],
        "notes": now["notes"].withColumn("text", text).where(~((sixth == 3) & (F.col("scope") == "global"))),
        "groups": now["groups"].withColumn("color", color).where(~((sixth == 4) & (F.col("group_id") == "g3"))),
    }
    return now, base


_EDITED = """SELECT schema_id, 'note' AS kind, note_id AS item, CASE schema_id % 6 WHEN 0 THEN 'changed' ELSE 'added' END AS change FROM notes WHERE schema_id % 6 = 0 AND scope = 'table' OR schema_id % 6 = 3 AND scope = 'global'
  UNION ALL SELECT schema_id, 'group', group_id, CASE schema_id % 6 WHEN 1 THEN 'changed' ELSE 'added' END FROM groups_ WHERE schema_id % 6 = 1 AND group_id = 'g0' OR schema_id % 6 = 4 AND group_id = 'g3'
  UNION ALL SELECT schema_id, 'table', table_name, 'changed' FROM tables_ WHERE schema_id % 6 = 2 AND table_name = 'users'"""


@query("changed_leaves", snapshot_sql("SELECT * FROM edited", edited=_EDITED))
def changed_leaves(spark, sf_dir):
    """What differs between two states, from their hash trees alone."""
    now, base = edited_states(spark, sf_dir)
    return hashtree.changed_leaves(written(hashtree.leaves(now), "leaves"), written(hashtree.leaves(base), "leaves"))


@query(
    "drift_gate_by_leaf",
    snapshot_sql("SELECT t.schema_id, coalesce(e.n, 0) > 0 AS changed, coalesce(e.n, 0) AS n_leaves, coalesce(e.n, 0) AS n_items FROM (SELECT DISTINCT schema_id FROM tables_) t LEFT JOIN (SELECT schema_id, count(*) AS n FROM edited GROUP BY 1) e ON e.schema_id = t.schema_id", edited=_EDITED),
)
def drift_gate_by_leaf(spark, sf_dir):
    """The gate where of some schemas one note, one group or one table differs only."""
    now, base = edited_states(spark, sf_dir)
    return diff.gate(now, base, written(hashtree.leaves(now), "leaves"), written(hashtree.leaves(base), "leaves"))


@query(
    "drift_of_notes_and_groups",
    snapshot_sql(
        """SELECT e.schema_id, e.kind AS level, CASE WHEN e.kind = 'table' THEN e.item END AS table_name, CASE WHEN e.kind = 'table' THEN '' ELSE e.item END AS item, e.change,
        CASE WHEN e.change = 'changed' THEN CASE e.kind WHEN 'note' THEN 'text' WHEN 'group' THEN 'color' ELSE 'comment' END END AS field,
        CASE WHEN e.change = 'changed' THEN CASE e.kind WHEN 'note' THEN concat(n.text, '!') WHEN 'group' THEN '#000' ELSE 'edited' END END AS old,
        CASE WHEN e.change = 'changed' THEN CASE e.kind WHEN 'note' THEN n.text WHEN 'group' THEN coalesce(g.color, '') ELSE coalesce(t.comment, '') END END AS new
      FROM edited e LEFT JOIN notes n ON e.kind = 'note' AND n.schema_id = e.schema_id AND n.note_id = e.item LEFT JOIN groups_ g ON e.kind = 'group' AND g.schema_id = e.schema_id AND g.group_id = e.item
      LEFT JOIN tables_ t ON e.kind = 'table' AND t.schema_id = e.schema_id AND t.table_name = e.item""",
        edited=_EDITED,
    ),
)
def drift_of_notes_and_groups(spark, sf_dir):
    """Differences of all kinds, read from what stands under leaves that differ."""
    now, base = edited_states(spark, sf_dir)
    moved = written(hashtree.changed_leaves(written(hashtree.leaves(now), "leaves"), written(hashtree.leaves(base), "leaves")), "changed_leaves")
    return diff.schema_diff(hashtree.of_leaves(now, moved), hashtree.of_leaves(base, moved))
