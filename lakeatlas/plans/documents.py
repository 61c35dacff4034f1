"""Reports, texts, fingerprints and drift over the derived catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeatlas.operators import canonical, diff, edges, merge, reports
from lakeatlas.operators.store import Relations, written

from .catalogue import COLUMNS_SQL, KEY, PLACED_SQL, RECONCILED_SQL, TABLES_SQL, merged, merged_columns, merged_sql
from .derived import CTES, fragments

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def final(spark, sf_dir) -> Relations:
    """Merged, reconciled and pruned: what reports and texts show."""
    m = merged(spark, sf_dir)
    m["edges"] = written(edges.prune_dangling(edges.reconcile(m["edges"]), m["tables"]), "final")
    return m


FINAL_SQL = f"SELECT e.* FROM ({RECONCILED_SQL}) e JOIN tables_ t ON t.schema_id = e.schema_id AND t.table_name = e.target"
_FKS = f"SELECT DISTINCT {KEY}, foreign_key FROM final_"


def final_sql(body: str, **more: str) -> str:
    return merged_sql(body, final_=FINAL_SQL, fks=_FKS, **more)


_ON = "{0}.schema_id = {1}.schema_id AND {0}.table_name = {1}.table_name"


@query(
    "dictionary",
    final_sql(
        f"""SELECT c.schema_id, c.table_name, c.pos, c.name AS column_name, c.type, CASE WHEN c.nullable THEN 'YES' ELSE 'NO' END AS nullable, coalesce(c.default_value, '') AS "default",
      CASE WHEN c.is_primary THEN 'PK' WHEN f.foreign_key IS NOT NULL THEN 'FK' ELSE '' END AS key, '' AS extra, coalesce(c.comment, '') AS comment
      FROM columns_ c LEFT JOIN fks f ON {_ON.format("c", "f")} AND f.foreign_key = c.name"""
    ),
)
def dictionary(spark, sf_dir):
    m = final(spark, sf_dir)
    return reports.dictionary(m["columns"], m["edges"])


@query(
    "dictionary_search",
    final_sql(
        f"SELECT schema_id, table_name, pos, name AS column_name FROM columns_ c WHERE contains(lower(name), 'tag') OR contains(lower(coalesce(comment, '')), 'd1') OR contains(table_name, 'tag')"
    ),
)
def dictionary_search(spark, sf_dir):
    from lakeatlas.operators.filters import search

    c = merged_columns(fragments(spark, sf_dir)).select("schema_id", "table_name", "pos", F.col("name").alias("column_name"), "comment")
    found = search(c, "Tag", "column_name").unionByName(search(c, "d1", "all_fields")).unionByName(search(c, "tag", "table_name"))
    return found.select("schema_id", "table_name", "pos", "column_name").distinct()


@query(
    "table_overview",
    final_sql(
        f"""SELECT t.schema_id, row_number() OVER (PARTITION BY t.schema_id ORDER BY t.table_name) AS n, t.table_name, coalesce(t.comment, '') AS comment, coalesce(c.k, 0) AS n_columns, coalesce(i.k, 0) AS n_indexes, c.k IS NULL AS schema_missing
      FROM tables_ t LEFT JOIN (SELECT {KEY}, count(*) AS k FROM columns_ GROUP BY {KEY}) c ON {_ON.format("c", "t")} LEFT JOIN (SELECT {KEY}, count(*) AS k FROM indexes_ GROUP BY {KEY}) i ON {_ON.format("i", "t")}"""
    ),
)
def table_overview(spark, sf_dir):
    m = merged(spark, sf_dir)
    return reports.table_overview(m["tables"], m["columns"], m["indexes"])


@query("index_report", final_sql(f"SELECT {KEY}, '' AS name, column_name AS columns, 'UNIQUE' AS \"unique\" FROM indexes_"))
def index_report(spark, sf_dir):
    return reports.index_list(merge.merge_indexes(fragments(spark, sf_dir)["indexes"]))


@query(
    "associations_report",
    final_sql(
        f"SELECT {KEY}, type, name, target, CASE provenance WHEN 'db_fk' THEN 'DB FK' WHEN 'schema_fk' THEN 'schema FK' WHEN 'manual' THEN 'manual' ELSE 'code' END AS via FROM final_"
    ),
)
def associations_report(spark, sf_dir):
    return reports.association_list(final(spark, sf_dir)["edges"])


_ORDER = "type, name, foreign_key, target, provenance"
_TOKEN = "concat(type, ' ', target, CASE WHEN name <> target THEN concat(' as ', name) ELSE '' END, ' fk=', foreign_key)"


@query(
    "digest",
    final_sql(
        f"""SELECT schema_id, concat('# Schema digest', chr(10), chr(10), '## Tables (', count(*), ')', chr(10), chr(10), string_agg(block, concat(chr(10), chr(10)) ORDER BY table_name), chr(10)) AS text FROM (
      SELECT t.schema_id, t.table_name, concat('### ', t.table_name, CASE WHEN t.comment IS NOT NULL THEN concat('  — ', t.comment) ELSE '' END,
        CASE WHEN c.lines IS NOT NULL THEN concat(chr(10), c.lines) ELSE '' END, CASE WHEN r.rels IS NOT NULL THEN concat(chr(10), 'Rel: ', r.rels) ELSE '' END) AS block
      FROM tables_ t LEFT JOIN (SELECT c.schema_id, c.table_name, string_agg(concat('- ', c.name, ': ', c.type, CASE WHEN is_primary THEN ', pk' ELSE '' END, CASE WHEN f.target IS NOT NULL THEN concat(', fk→', f.target) ELSE '' END,
          CASE WHEN c.comment IS NOT NULL THEN concat(', "', c.comment, '"') ELSE '' END), chr(10) ORDER BY c.pos) AS lines
        FROM columns_ c LEFT JOIN (SELECT schema_id, table_name, foreign_key, arg_max(target, {{'a': type, 'b': name, 'c': foreign_key, 'd': target, 'e': provenance}}) AS target FROM final_ GROUP BY 1, 2, 3) f
          ON {_ON.format("c", "f")} AND f.foreign_key = c.name GROUP BY 1, 2) c ON {_ON.format("c", "t")}
      LEFT JOIN (SELECT {KEY}, string_agg({_TOKEN}, ', ' ORDER BY {_ORDER}) AS rels FROM final_ GROUP BY {KEY}) r ON {_ON.format("r", "t")}) x GROUP BY schema_id"""
    ),
)
def digest(spark, sf_dir):
    m = final(spark, sf_dir)
    return reports.digest(m["tables"], m["columns"], m["edges"])


def _display(m):
    return edges.display_edges(m["tables"], m["edges"].withColumn("pos", F.struct("seen", "foreign_key", "name")))


_ARROWS = """SELECT schema_id, string_agg(concat('    ', CASE WHEN s = first_from THEN g ELSE s END, ' ||--o{ ', CASE WHEN s = first_from THEN s ELSE g END, ' : "', n, '"'), chr(10) ORDER BY a, b) AS arrows FROM (
  SELECT schema_id, a, b, f.t AS s, f.g AS g, f.n AS n, f.t AS first_from FROM (
    SELECT schema_id, least(table_name, target) AS a, greatest(table_name, target) AS b, arg_min({'t': table_name, 'g': target, 'n': name}, {'t': table_name, 'l': seen, 'k': foreign_key, 'n': name}) AS f FROM final_ GROUP BY ALL) y) z GROUP BY schema_id"""


@query(
    "mermaid_text",
    final_sql(
        f"""SELECT b.schema_id, concat('erDiagram', chr(10), CASE WHEN arrows IS NOT NULL THEN concat(arrows, chr(10)) ELSE '' END, blocks, chr(10)) AS text FROM (
      SELECT schema_id, string_agg(concat('    ', table_name, ' {{', chr(10), CASE WHEN lines IS NULL THEN '' ELSE concat(lines, chr(10)) END, '    }}'), chr(10) ORDER BY table_name) AS blocks FROM (
        SELECT t.schema_id, t.table_name, string_agg(concat('        ', c.type, ' ', c.name, CASE WHEN is_primary THEN ' PK' WHEN f.foreign_key IS NOT NULL THEN ' FK' ELSE '' END), chr(10) ORDER BY c.pos) FILTER (WHERE c.name IS NOT NULL) AS lines
        FROM tables_ t LEFT JOIN columns_ c ON {_ON.format("c", "t")} LEFT JOIN fks f ON {_ON.format("f", "c")} AND f.foreign_key = c.name GROUP BY 1, 2) x GROUP BY schema_id) b
      LEFT JOIN arrows_ a ON a.schema_id = b.schema_id""",
        arrows_=_ARROWS,
    ),
)
def mermaid_text(spark, sf_dir):
    m = final(spark, sf_dir)
    return reports.mermaid(m["tables"], m.once("columns"), m["edges"], _display(m))


_PLANT_ARROWS = _ARROWS.replace("concat('    ', CASE", "concat(CASE").replace("""' : "', n, '"')""", "CASE WHEN n <> '' THEN concat(' : ', n) ELSE '' END)")
_KEYED = f"SELECT c.*, f.foreign_key IS NOT NULL AS is_fk FROM columns_ c LEFT JOIN fks f ON {_ON.format('f', 'c')} AND f.foreign_key = c.name"


@query(
    "plantuml_text",
    final_sql(
        f"""SELECT b.schema_id, concat('@startuml', chr(10), 'hide circle', chr(10), 'skinparam linetype ortho', chr(10), chr(10), blocks, chr(10), CASE WHEN arrows IS NOT NULL THEN concat(arrows, chr(10)) ELSE '' END, '@enduml', chr(10)) AS text FROM (
      SELECT schema_id, string_agg(concat(concat_ws(chr(10), CASE WHEN comment IS NOT NULL THEN concat('entity "', table_name, '（', comment, '）" as ', table_name, ' {{') ELSE concat('entity ', table_name, ' {{') END, pk, CASE WHEN pk IS NOT NULL AND others IS NOT NULL THEN '  --' END, others), chr(10), '}}', chr(10)), chr(10) ORDER BY table_name) AS blocks FROM (
        SELECT t.schema_id, t.table_name, t.comment, string_agg(concat('  * ', c.name, ' : ', c.type, ' <<PK>>'), chr(10) ORDER BY c.pos) FILTER (WHERE is_primary) AS pk,
          string_agg(concat('  ', CASE WHEN nullable THEN '' ELSE '* ' END, c.name, ' : ', c.type, CASE WHEN is_fk THEN ' <<FK>>' ELSE '' END), chr(10) ORDER BY c.pos) FILTER (WHERE NOT is_primary) AS others
        FROM tables_ t LEFT JOIN keyed c ON {_ON.format("c", "t")} GROUP BY 1, 2, 3) x GROUP BY schema_id) b LEFT JOIN arrows_ a ON a.schema_id = b.schema_id""",
        arrows_=_PLANT_ARROWS,
        keyed=_KEYED,
    ),
)
def plantuml_text(spark, sf_dir):
    m = final(spark, sf_dir)
    return reports.plantuml(m["tables"], m["columns"], m["edges"], _display(m))


_DBML_REFS = f"SELECT DISTINCT e.schema_id, e.table_name, e.foreign_key, e.target, k.target_column FROM final_ e JOIN (SELECT {KEY}, min(name) AS target_column FROM columns_ WHERE is_primary GROUP BY {KEY} HAVING count(*) = 1) k ON k.schema_id = e.schema_id AND k.table_name = e.target"


@query(
    "dbml_text",
    final_sql(
        f"""SELECT b.schema_id, concat(concat_ws(concat(chr(10), chr(10)), t, refs), chr(10)) AS text FROM (
      SELECT schema_id, string_agg(block, concat(chr(10), chr(10)) ORDER BY table_name) AS t FROM (
        SELECT t.schema_id, t.table_name, concat(concat_ws(chr(10), concat('Table ', t.table_name, ' {{'), c.cols, CASE WHEN c.composite IS NOT NULL OR i.ixs IS NOT NULL THEN concat(chr(10), '  indexes {{', chr(10), concat_ws(chr(10), c.composite, i.ixs), chr(10), '  }}') END,
          CASE WHEN t.comment IS NOT NULL THEN concat(chr(10), '  Note: ', chr(39), t.comment, chr(39)) END), chr(10), '}}') AS block
        FROM tables_ t LEFT JOIN (SELECT {KEY}, string_agg(concat('  ', name, ' ', type, CASE WHEN attrs <> '' THEN concat(' [', attrs, ']') ELSE '' END), chr(10) ORDER BY pos) AS cols,
            CASE WHEN max(n_keys) >= 2 THEN concat('    (', string_agg(name, ', ' ORDER BY pos) FILTER (WHERE is_primary), ') [pk]') END AS composite FROM (
          SELECT c.*, concat_ws(', ', CASE WHEN is_primary AND n_keys = 1 THEN 'pk' END, CASE WHEN NOT nullable THEN 'not null' END, CASE WHEN i.column_name IS NOT NULL THEN 'unique' END, CASE WHEN coalesce(default_value, '') <> '' THEN concat('default: ', default_value) END) AS attrs
          FROM (SELECT *, count_if(is_primary) OVER (PARTITION BY {KEY}) AS n_keys FROM columns_) c LEFT JOIN indexes_ i ON {_ON.format("i", "c")} AND i.column_name = c.name) x GROUP BY {KEY}) c ON {_ON.format("c", "t")}
        LEFT JOIN (SELECT {KEY}, string_agg(concat('    (', column_name, ') [unique]'), chr(10) ORDER BY column_name) AS ixs FROM indexes_ GROUP BY {KEY}) i ON {_ON.format("i", "t")}) y GROUP BY schema_id) b
      LEFT JOIN (SELECT schema_id, string_agg(concat('Ref: ', table_name, '.', foreign_key, ' > ', target, '.', target_column), chr(10) ORDER BY table_name, foreign_key, target, target_column) AS refs FROM ({_DBML_REFS}) r GROUP BY schema_id) r ON r.schema_id = b.schema_id"""
    ),
)
def dbml_text(spark, sf_dir):
    m = final(spark, sf_dir)
    return reports.dbml(m["tables"], m["columns"], m["indexes"], edges.dbml_refs(m["edges"], m["columns"]))


@query(
    "dbml_refs",
    final_sql(
        f"SELECT DISTINCT e.schema_id, e.table_name, e.foreign_key, e.target, k.target_column FROM final_ e JOIN (SELECT {KEY}, min(name) AS target_column FROM columns_ WHERE is_primary GROUP BY {KEY} HAVING count(*) = 1) k ON k.schema_id = e.schema_id AND k.table_name = e.target"
    ),
)
def dbml_refs(spark, sf_dir):
    m = final(spark, sf_dir)
    return edges.dbml_refs(m["edges"], m["columns"])


def documents(m: dict[str, DataFrame]) -> DataFrame:
    columns = m.once("ordered") if isinstance(m, Relations) and "columns" not in m else m["columns"]
    return canonical.schema_json(canonical.table_json(m["tables"], columns, m["indexes"], m["edges"]))


_Q = lambda x: f"concat('\"', {x}, '\"')"
_JSON_COLUMN = f"""concat('{{', CASE WHEN coalesce(comment, '') <> '' THEN concat('"comment":', {_Q("comment")}, ',') ELSE '' END, CASE WHEN coalesce(default_value, '') <> '' THEN concat('"default":', {_Q("default_value")}, ',') ELSE '' END,
  '"name":', {_Q("name")}, ',"nullable":', CASE WHEN nullable THEN 'true' ELSE 'false' END, CASE WHEN is_primary THEN ',"primary":true' ELSE '' END, ',"type":', {_Q("type")}, '}}')"""
_JSON_EDGE = f"""concat('{{"foreign_key":', {_Q("foreign_key")}, ',"name":', {_Q("name")}, ',"provenance":', {_Q("provenance")}, ',"sources":[{{"kind":"', replace(sources, ',', '"}},{{"kind":"'), '"}}],"target":', {_Q("target")}, ',"type":', {_Q("type")}, '}}')"""


@query(
    "fingerprint",
    final_sql(
        f"""SELECT schema_id, concat('sha256:', sha256(concat('{{"format":1,"schema":{{"tables":{{', string_agg(concat('"', table_name, '":', doc), ',' ORDER BY table_name), '}}}}}}'))) AS fingerprint FROM (
      SELECT t.schema_id, t.table_name, concat('{{"associations":[', coalesce(e.js, ''), '],"columns":[', coalesce(c.js, ''), ']', CASE WHEN t.comment IS NOT NULL THEN concat(',"comment":', {_Q("t.comment")}) ELSE '' END, ',"indexes":[', coalesce(i.js, ''), ']}}') AS doc
      FROM tables_ t LEFT JOIN (SELECT {KEY}, string_agg({_JSON_COLUMN}, ',' ORDER BY pos) AS js FROM columns_ GROUP BY {KEY}) c ON {_ON.format("c", "t")}
      LEFT JOIN (SELECT {KEY}, string_agg({_JSON_EDGE}, ',' ORDER BY type, name, foreign_key, target, provenance) AS js FROM final_ GROUP BY {KEY}) e ON {_ON.format("e", "t")}
      LEFT JOIN (SELECT {KEY}, string_agg(concat('{{"columns":["', column_name, '"],"unique":true}}'), ',' ORDER BY column_name) AS js FROM indexes_ GROUP BY {KEY}) i ON {_ON.format("i", "t")}) x GROUP BY schema_id"""
    ),
)
def fingerprint(spark, sf_dir):
    return documents(final(spark, sf_dir)).select("schema_id", canonical.fingerprint(F.col("doc")).alias("fingerprint"))


def halves(spark, sf_dir) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Two overlapping states of the fleet: the layers seen since 1997, and those before 2000 as the base."""
    f = fragments(spark, sf_dir, keep=True)

    def state(cond: str) -> dict[str, DataFrame]:
        part = {k: f[k].where(cond) for k in ("tables", "columns")}
        return {"tables": written(merge.merge_tables(part["tables"]), "tables"), "columns": merged_columns(part)}

    return state("seen_on >= DATE '1997-01-01'"), state("seen_on < DATE '2000-01-01'")


def _half(cond: str) -> dict[str, str]:
    return {k: v.replace("FROM table_frag", f"FROM table_frag WHERE {cond}") if k == "tables_" else v.replace("FROM column_frag", f"FROM column_frag WHERE {cond}") for k, v in _STATE.items()}


_STATE = {"tables_": TABLES_SQL, "columns_": COLUMNS_SQL}
_NOW, _BASE = _half("seen_on >= DATE '1997-01-01'"), _half("seen_on < DATE '2000-01-01'")
_TXT = {
    "type": "coalesce({0}.type, '')",
    "nullable": "CASE WHEN {0}.nullable THEN 'true' ELSE '' END",
    "primary": "CASE WHEN {0}.is_primary THEN 'true' ELSE '' END",
    "default": "coalesce({0}.default_value, '')",
    "comment": "coalesce({0}.comment, '')",
}
DRIFT_SQL = f"""
WITH {", ".join(f"{k} AS ({v})" for k, v in CTES.items())}, lt AS ({_NOW["tables_"]}), rt AS ({_BASE["tables_"]}), lc AS ({_NOW["columns_"]}), rc AS ({_BASE["columns_"]}),
both_t AS (SELECT lt.schema_id, lt.table_name FROM lt JOIN rt ON lt.schema_id = rt.schema_id AND lt.table_name = rt.table_name)
SELECT l.schema_id, 'table' AS level, l.table_name, '' AS item, 'added' AS change, NULL AS field, NULL AS old, NULL AS new FROM lt l WHERE (l.schema_id, l.table_name) NOT IN (SELECT schema_id, table_name FROM rt)
UNION ALL SELECT r.schema_id, 'table', r.table_name, '', 'removed', NULL, NULL, NULL FROM rt r WHERE (r.schema_id, r.table_name) NOT IN (SELECT schema_id, table_name FROM lt)
UNION ALL SELECT l.schema_id, 'table', l.table_name, '', 'changed', 'comment', coalesce(r.comment, ''), coalesce(l.comment, '') FROM lt l JOIN rt r ON {_ON.format("l", "r")} WHERE coalesce(l.comment, '') <> coalesce(r.comment, '')
UNION ALL SELECT l.schema_id, 'column', l.table_name, l.name, 'added', NULL, NULL, NULL FROM lc l JOIN both_t b ON {_ON.format("l", "b")} WHERE (l.schema_id, l.table_name, l.name) NOT IN (SELECT schema_id, table_name, name FROM rc)
UNION ALL SELECT r.schema_id, 'column', r.table_name, r.name, 'removed', NULL, NULL, NULL FROM rc r JOIN both_t b ON {_ON.format("r", "b")} WHERE (r.schema_id, r.table_name, r.name) NOT IN (SELECT schema_id, table_name, name FROM lc)
""" + "".join(f"UNION ALL SELECT l.schema_id, 'column', l.table_name, l.name, 'changed', '{f}', {t.format('r')}, {t.format('l')} FROM lc l JOIN rc r ON {_ON.format('l', 'r')} AND l.name = r.name WHERE {t.format('l')} <> {t.format('r')}\n" for f, t in _TXT.items())


@query("drift", DRIFT_SQL)
def drift(spark, sf_dir):
    left, right = halves(spark, sf_dir)
    return diff.schema_diff(left, right)


@query("drift_summary", f"SELECT schema_id, level, change, count(DISTINCT (table_name, item)) AS n FROM ({DRIFT_SQL}) d GROUP BY 1, 2, 3")
def drift_summary(spark, sf_dir):
    return diff.summary(drift(spark, sf_dir))


def _plain_documents(m: dict[str, DataFrame]) -> DataFrame:
    """Canonical documents of tables and columns alone."""
    none = lambda ddl: canonical.nothing(m["tables"], ddl)
    indexes, edges_ = none(canonical.INDEX_ROWS), none(canonical.EDGE_ROWS)
    return canonical.schema_json(canonical.table_json(m["tables"], m["columns"], indexes, edges_))


@query("drift_gate", f"""WITH d AS (SELECT schema_id, count(DISTINCT (level, table_name, item, change)) AS n FROM ({DRIFT_SQL}) d GROUP BY 1),
  t AS ({CTES["table_frag"]}) SELECT DISTINCT t.schema_id, d.n IS NOT NULL AS changed, coalesce(d.n, 0) AS n_items FROM t LEFT JOIN d ON d.schema_id = t.schema_id""")
def drift_gate(spark, sf_dir):
    """Which schemas the gate stops: roots first, then leaves, and the comparison of what stands under leaves that differ only."""
    left, right = halves(spark, sf_dir)
    return diff.gate({k: written(df, k) for k, df in left.items()}, {k: written(df, k) for k, df in right.items()}).drop("n_leaves")


_BY_DAY = "concat(CAST(o_custkey AS STRING), '@', CAST(CAST(o_orderdate AS DATE) AS STRING))"
_DAY_CTES = {"table_frag": CTES["table_frag"].replace("o_custkey AS schema_id", f"{_BY_DAY} AS schema_id"), "column_frag": CTES["column_frag"]}


@query(
    "snapshot_history",
    f"""WITH {", ".join(f"{k} AS ({v})" for k, v in _DAY_CTES.items())}, tables_ AS ({TABLES_SQL}), columns_seen AS ({COLUMNS_SQL}), columns_ AS ({PLACED_SQL}),
    h AS (SELECT schema_id, concat('sha256:', sha256(concat('{{"format":1,"schema":{{"tables":{{', string_agg(concat('"', table_name, '":', doc), ',' ORDER BY table_name), '}}}}}}'))) AS fingerprint FROM (
      SELECT t.schema_id, t.table_name, concat('{{"associations":[],"columns":[', coalesce(c.js, ''), ']', CASE WHEN t.comment IS NOT NULL THEN concat(',"comment":', {_Q("t.comment")}) ELSE '' END, ',"indexes":[]}}') AS doc
      FROM tables_ t LEFT JOIN (SELECT {KEY}, string_agg({_JSON_COLUMN}, ',' ORDER BY pos) AS js FROM columns_ GROUP BY {KEY}) c ON {_ON.format("c", "t")}) x GROUP BY schema_id),
    d AS (SELECT CAST(split_part(schema_id, '@', 1) AS BIGINT) AS schema_id, split_part(schema_id, '@', 2) AS day, fingerprint FROM h)
    SELECT schema_id, day, fingerprint FROM (SELECT *, lag(fingerprint) OVER (PARTITION BY schema_id ORDER BY day) AS before FROM d) x WHERE before IS NULL OR before <> fingerprint""",
)
def snapshot_history(spark, sf_dir):
    """A snapshot for each day on which a schema was seen; those whose fingerprint differs from that of the day before."""
    from pyspark.sql import Window

    own = daily_documents(spark, sf_dir).select("schema_id", "day", canonical.fingerprint(F.col("doc")).alias("fingerprint"))
    before = F.lag("fingerprint").over(Window.partitionBy("schema_id").orderBy("day"))
    return own.withColumn("before", before).where("before IS NULL OR before <> fingerprint").drop("before")


def daily_documents(spark, sf_dir) -> DataFrame:
    """(schema_id, day, doc): the canonical schema of each day on which a schema was seen."""
    f = fragments(spark, sf_dir, keep=True)
    day = F.concat(F.col("schema_id").cast("string"), F.lit("@"), F.col("seen_on").cast("date").cast("string"))
    part = {k: f[k].withColumn("schema_id", day) for k in ("tables", "columns")}
    docs = _plain_documents({"tables": merge.merge_tables(part["tables"]), "columns": merged_columns(part)})
    own = docs.select(F.split("schema_id", "@").alias("k"), "doc")
    return own.select(F.col("k")[0].cast("long").alias("schema_id"), F.col("k")[1].alias("day"), "doc")


_RUN = "CASE WHEN schema_id % 10 = 0 AND CAST(substr(day, 9, 2) AS INT) % 9 = 0 THEN 2 WHEN CAST(day AS DATE) + CAST(schema_id % 3 AS INT) < DATE '1995-06-17' THEN 1 ELSE 2 END"
_HISTORY = ORACLES["snapshot_history"]


@query(
    "drift_stream",
    _HISTORY[: _HISTORY.index("SELECT schema_id, day, fingerprint FROM (SELECT *, lag")].rstrip()
    + f""",
    e AS (SELECT *, {_RUN} AS run FROM d), w AS (SELECT max(CAST(day AS DATE)) - 7 AS mark FROM e WHERE run = 1),
    s AS (SELECT schema_id, max(day) AS settled FROM e, w WHERE run = 1 AND CAST(day AS DATE) <= mark GROUP BY 1),
    l AS (SELECT e.*, run = 2 AND coalesce(day <= settled, false) AS late FROM e LEFT JOIN s ON s.schema_id = e.schema_id)
    SELECT schema_id, day, CASE WHEN before IS NULL THEN 'first' ELSE 'change' END AS kind, before, fingerprint FROM (
      SELECT *, lag(fingerprint) OVER (PARTITION BY schema_id ORDER BY day) AS before FROM l WHERE NOT late) x WHERE before IS NULL OR before <> fingerprint
    UNION ALL SELECT schema_id, day, 'late', NULL, fingerprint FROM l WHERE late""",
)
def drift_stream(spark, sf_dir):
    """The daily snapshots as a stream in two runs on one checkpoint, out of order by up to two days, with stragglers that come
    after their schema has gone on; what the state makes of them."""
    from lakeatlas.operators.store import shared_folder
    from lakeatlas.streaming.history import follow_fleet, read_history

    folder = f"{shared_folder(spark)}/drift-stream-{uuid.uuid4().hex}"
    d = daily_documents(spark, sf_dir)
    run = F.expr(_RUN)
    events = written(d.select(F.col("schema_id").cast("string").alias("schema_id"), F.col("day").alias("snapshot_id"), F.to_timestamp("day").alias("ts"), canonical.snapshot(F.col("doc")).alias("doc"), run.alias("run")), "events")
    for n in (1, 2):
        events.where(F.col("run") == n).drop("run").write.mode("append").parquet(f"{folder}/in")
        follow_fleet(spark, f"{folder}/in", folder).awaitTermination()
    beyond = events.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    none = F.lit(None).cast("string")
    beyond.select(none.alias("schema_id"), none.alias("snapshot_id"), "ts", none.alias("doc")).write.mode("append").parquet(f"{folder}/in")
    follow_fleet(spark, f"{folder}/in", folder).awaitTermination()
    return read_history(spark, folder).select(F.col("schema_id").cast("long").alias("schema_id"), F.col("snapshot_id").alias("day"), "kind", "before", "fingerprint")
