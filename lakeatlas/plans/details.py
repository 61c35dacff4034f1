"""Queries over a richer derived catalogue: edges of all types, with through and polymorphic ones, notes, groups, config
operations and primary keys; each with its DuckDB SQL on the same derived rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeatlas.functions import names
from lakeatlas.operators import diff, edges, filters, merge, reports, validate
from lakeatlas.operators.store import Relations, shared_folder, written

from .catalogue import KEY, MERGED
from .derived import PLURALS, STEMS, frames, with_ctes
from .documents import ORACLES as DOCUMENT_SQL
from .documents import dictionary

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- the derived rows, as SQL that Spark and DuckDB both run

_K = "(layer_seq + pos) % 10"
_STEM = "substr(name, 1, length(name) - 3)"
RICH = f"""
SELECT schema_id, layer_seq, kind, table_name, pos,
  CASE WHEN {_K} IN (0, 5) THEN 'has_many' WHEN {_K} IN (1, 4) THEN 'has_one' WHEN {_K} = 2 THEN 'has_and_belongs_to_many' ELSE 'belongs_to' END AS type, {_STEM} AS name,
  CASE {_STEM} {" ".join(f"WHEN '{s}' THEN '{p}'" for s, p in zip(STEMS, PLURALS))} END AS target,
  CASE WHEN {_K} IN (3, 4, 6, 7, 8) THEN name END AS foreign_key, CASE WHEN {_K} = 5 THEN 'tags' END AS through, {_K} = 9 AS polymorphic,
  CASE kind WHEN 'config' THEN 'manual' WHEN 'db' THEN 'db_fk' WHEN 'schema' THEN 'schema_fk' ELSE 'declared' END AS provenance
FROM column_frag WHERE substr(name, length(name) - 2, 3) = '_id'"""
NOTES = """
SELECT schema_id, concat('n', CAST(layer_seq AS STRING)) AS note_id, CASE layer_seq % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'table' ELSE 'relation' END AS scope,
  CASE WHEN layer_seq % 2 = 0 THEN status END AS title, concat('about  ', table_name, ' on ', status) AS text, CASE WHEN layer_seq % 3 = 1 THEN table_name END AS table_name,
  CASE WHEN layer_seq % 3 = 2 THEN table_name END AS source_table, CASE WHEN layer_seq % 3 = 2 THEN CASE layer_seq % 4 WHEN 0 THEN 'users' WHEN 1 THEN 'tags' WHEN 2 THEN 'orders' ELSE 'days' END END AS target,
  concat(CASE WHEN layer_seq % 7 = 0 THEN 'ftp' ELSE 'https' END, '://x/', CAST(layer_seq AS STRING)) AS url
FROM table_frag"""
MEMBERS = "SELECT DISTINCT schema_id, concat('g', CAST(layer_seq % 4 AS STRING)) AS group_id, table_name FROM table_frag"
GROUPS = "SELECT schema_id, group_id, CASE WHEN group_id <> 'g1' THEN concat('Group ', group_id) ELSE '' END AS title, CASE group_id WHEN 'g0' THEN '#12ab' WHEN 'g2' THEN 'red' END AS color FROM members GROUP BY schema_id, group_id"
EXTRA = {"rich": RICH, "notes": NOTES, "members": MEMBERS, "groups_": GROUPS}


def rich_sql(body: str, **more: str) -> str:
    return with_ctes(body, **MERGED, **EXTRA, **more)


def rich(spark: SparkSession, sf_dir: str, kept: dict[str, DataFrame] | None = None) -> Relations:
    """The fragments (column_frag, table_frag) and the extra relations, each written when it is first asked for; ``kept`` are
    ``frames`` of which column_frag is written."""
    f = kept or frames(spark, sf_dir)
    out = Relations({"column_frag": lambda: f["column_frag"]})
    if kept:
        out["column_frag"] = kept["column_frag"]
    of = {"rich": "column_frag", "notes": "table_frag", "members": "table_frag", "groups_": "members"}

    def make(name: str) -> DataFrame:
        source = of[name]
        return spark.sql(EXTRA[name].replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: out[source]})

    out.makers |= {name: lambda n=name: make(n) for name in EXTRA}
    out.makers["tables"] = lambda: merge.merge_tables(
        f["table_frag"].withColumn("present", F.when(F.col("has_comment"), F.array(F.lit("comment"))).otherwise(F.array().cast("array<string>")))
    )
    out.makers["edges"] = lambda: merge.merge_associations(out["rich"])
    out["table_frag"] = f["table_frag"]
    return out


def note_rows(r: Relations) -> DataFrame:
    return r["notes"].withColumn("links", F.array(F.struct(F.lit(None).cast("string").alias("label"), F.col("url"))))


# -- edges

_ROLE = "CASE WHEN foreign_key IS NOT NULL THEN 'owner_fk' WHEN type IN ('has_many', 'has_and_belongs_to_many') THEN 'collection' WHEN type = 'has_one' THEN 'inverse_one' ELSE 'named' END"
_RANKED = "CASE WHEN kind = 'config' OR provenance = 'manual' THEN 4 WHEN provenance = 'declared' THEN 3 WHEN provenance = 'db_fk' THEN 2 ELSE 1 END"
RICH_EDGES = f"""
SELECT {KEY}, target, foreign_key, name, CASE WHEN role = 'owner_fk' AND bool_or(type = 'has_one') THEN 'has_one' ELSE arg_max(type, layer_seq) END AS type, max(t_) AS through, bool_or(polymorphic) AS polymorphic,
  CASE max({_RANKED}) WHEN 4 THEN 'manual' WHEN 3 THEN 'declared' WHEN 2 THEN 'db_fk' ELSE 'schema_fk' END AS provenance, min({{'l': layer_seq, 'p': pos}}) AS seen
FROM (SELECT *, {_ROLE} AS role, CASE WHEN foreign_key IS NULL THEN through END AS t_, CASE WHEN foreign_key IS NULL THEN polymorphic END AS p_ FROM rich) x GROUP BY {KEY}, target, foreign_key, name, role, t_, p_"""
_EDGE = f"{KEY}, type, name, target, foreign_key, through, polymorphic, provenance"


def edge_sql(body: str, **more: str) -> str:
    return rich_sql(body, rich_edges=RICH_EDGES, **more)


def _edge(df: DataFrame) -> DataFrame:
    return df.select("schema_id", "table_name", "type", "name", "target", "foreign_key", "through", "polymorphic", "provenance")


@query("association_merge_all_types", edge_sql(f"SELECT {_EDGE} FROM rich_edges"))
def association_merge_all_types(spark, sf_dir):
    return _edge(rich(spark, sf_dir)["edges"])


_PAIR = "least({0}.table_name, {0}.target) = least({1}.table_name, {1}.target) AND greatest({0}.table_name, {0}.target) = greatest({1}.table_name, {1}.target) AND {0}.schema_id = {1}.schema_id"
_COVERS = f"c.provenance IN ('declared', 'manual') AND {_PAIR.format('c', 'f')} AND (c.foreign_key IS NULL OR c.foreign_key IS NOT DISTINCT FROM f.foreign_key)"
RICH_RECONCILED = f"""
SELECT {_EDGE.replace(' type,', ' CASE WHEN provenance IN (' + "'declared', 'manual'" + ") AND type = 'belongs_to' AND EXISTS (SELECT 1 FROM ups u WHERE u.schema_id = e.schema_id AND u.a = least(e.table_name, e.target) AND u.b = greatest(e.table_name, e.target) AND u.table_name = e.table_name AND (e.foreign_key IS NULL OR e.foreign_key = u.foreign_key)) THEN 'has_one' ELSE type END AS type,")}, seen
FROM rich_edges e WHERE provenance IN ('declared', 'manual') OR NOT EXISTS (SELECT 1 FROM rich_edges c WHERE {_COVERS.replace('f.', 'e.')})"""
_UPS = f"""
SELECT f.schema_id, least(f.table_name, f.target) AS a, greatest(f.table_name, f.target) AS b, f.table_name, f.foreign_key FROM rich_edges f
WHERE f.provenance IN ('db_fk', 'schema_fk') AND f.type = 'has_one' AND EXISTS (SELECT 1 FROM rich_edges c WHERE {_COVERS}) AND NOT EXISTS (SELECT 1 FROM rich_edges c WHERE {_COVERS} AND c.type IN ('has_one', 'has_many'))"""


@query("reconcile_upgrades", edge_sql(f"SELECT {_EDGE} FROM reconciled", ups=_UPS, reconciled=RICH_RECONCILED))
def reconcile_upgrades(spark, sf_dir):
    """Reconciliation where covered one-to-one keys raise the edges that cover them."""
    return _edge(edges.reconcile(rich(spark, sf_dir)["edges"]))


_JOIN = "concat(least(table_name, target), '_', greatest(table_name, target))"
RICH_DISPLAY = f"""
SELECT schema_id, a, b, f.t AS source, f.g AS target, CASE WHEN n_direct = 0 THEN 'nn' WHEN many_from IS NOT NULL THEN '1n' WHEN one THEN '11' ELSE '1n' END AS kind,
  CASE WHEN n_direct = 0 OR (many_from IS NULL AND one) THEN NULL WHEN many_from IS NOT NULL THEN CASE WHEN many_from = f.t THEN f.g ELSE f.t END ELSE coalesce(belongs_from, f.g) END AS many, coalesce(f.n, '') AS label
FROM (SELECT schema_id, least(table_name, target) AS a, greatest(table_name, target) AS b, arg_min({{'t': table_name, 'g': target, 'n': name}}, o) AS f, count_if(direct) AS n_direct,
    arg_min(table_name, o) FILTER (WHERE direct AND type = 'has_many') AS many_from, coalesce(bool_or(direct AND type = 'has_one'), false) AS one, arg_min(table_name, o) FILTER (WHERE direct AND type = 'belongs_to') AS belongs_from
  FROM (SELECT *, through IS NULL AND type <> 'has_and_belongs_to_many' AS direct, {{'t': table_name, 'l': seen, 'k': coalesce(foreign_key, ''), 'n': name, 'y': type, 'h': coalesce(through, '')}} AS o FROM rich_edges e WHERE NOT polymorphic
      AND EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = e.schema_id AND t.table_name = e.target) AND NOT EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = e.schema_id AND t.table_name = e.through)
      AND NOT (type = 'has_and_belongs_to_many' AND EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = e.schema_id AND t.table_name = {_JOIN}))) x GROUP BY 1, 2, 3) y"""


@query("display_edges_all_kinds", edge_sql(RICH_DISPLAY))
def display_edges_all_kinds(spark, sf_dir):
    r = rich(spark, sf_dir)
    e = r["edges"].withColumn(
        "pos",
        F.struct("seen", F.coalesce("foreign_key", F.lit("")).alias("k"), "name", "type", F.coalesce("through", F.lit("")).alias("h")),
    )
    return edges.display_edges(r["tables"], e)


@query(
    "prune_keeps_polymorphic",
    edge_sql(
        f"SELECT {_EDGE} FROM rich_edges e WHERE polymorphic OR EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = e.schema_id AND t.table_name = e.target)"
    ),
)
def prune_keeps_polymorphic(spark, sf_dir):
    r = rich(spark, sf_dir)
    return _edge(edges.prune_dangling(r["edges"], r["tables"]))


@query(
    "associations_report_all_types",
    edge_sql(
        f"SELECT {KEY}, type, name, target, CASE provenance WHEN 'db_fk' THEN 'DB FK' WHEN 'schema_fk' THEN 'schema FK' WHEN 'manual' THEN 'manual' ELSE 'code' END AS via FROM rich_edges"
    ),
)
def associations_report_all_types(spark, sf_dir):
    return reports.association_list(rich(spark, sf_dir)["edges"])


_CONTENT = "{'t': type, 'h': coalesce(through, ''), 'p': polymorphic}"
_BY_ID = f"{KEY}, target, foreign_key, role, name, t_, p_"
_LAST = f"SELECT {_BY_ID}, arg_max({_CONTENT}, layer_seq) AS c FROM ids WHERE kind = '{{0}}' GROUP BY {_BY_ID}"
_SAME_ID = " AND ".join(f"x.{c.strip()} IS NOT DISTINCT FROM l.{c.strip()}" for c in _BY_ID.split(","))
_WARN = f"SELECT l.schema_id, l.table_name, l.target, l.foreign_key, l.role, l.name, '{{0}}' AS warning, count(DISTINCT x.v) AS n_differing, any_value(l.c.t) AS new FROM ({_LAST}) l JOIN (SELECT *, {_CONTENT} AS v FROM ids) x ON {_SAME_ID} AND {{2}} AND x.v <> l.c GROUP BY l.schema_id, l.table_name, l.target, l.foreign_key, l.role, l.name, l.t_, l.p_"


@query(
    "override_warnings",
    rich_sql(
        _WARN.replace("'{0}' AS warning", "'config overrides' AS warning").replace("kind = '{0}'", "kind = 'config'").replace("{2}", "x.kind <> 'config'")
        + " UNION ALL " + _WARN.replace(
            "'{0}' AS warning",
            "'later model overrides' AS warning",
        ).replace("kind = '{0}'", "kind = 'framework'").replace("{2}", "x.kind = 'framework'"),
        ids=f"SELECT *, {_ROLE} AS role, CASE WHEN foreign_key IS NULL THEN through END AS t_, CASE WHEN foreign_key IS NULL THEN polymorphic END AS p_ FROM rich",
    ),
)
def override_warnings(spark, sf_dir):
    return merge.override_warnings(rich(spark, sf_dir)["rich"])


_DROPS = "SELECT DISTINCT schema_id, table_name, 'belongs_to' AS type, CASE WHEN layer_seq % 2 = 0 THEN name END AS name, target, foreign_key, CAST(NULL AS STRING) AS through, CAST(NULL AS BOOLEAN) AS polymorphic FROM rich WHERE kind = 'config' AND foreign_key IS NOT NULL AND layer_seq % 3 = 0"


@query(
    "config_drops",
    edge_sql(
        f"SELECT {_EDGE} FROM rich_edges e WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.schema_id = e.schema_id AND d.table_name = e.table_name AND d.target = e.target AND d.foreign_key = e.foreign_key AND (d.name IS NULL OR d.name = e.name))",
        drops=_DROPS,
    ),
)
def config_drops(spark, sf_dir):
    r = rich(spark, sf_dir)
    return _edge(edges.drop_matches(r["edges"], spark.sql(_DROPS.replace("FROM rich", "FROM {rich}"), rich=r["rich"])))


@query(
    "covered_fks",
    edge_sql(
        "SELECT schema_id, CAST(sum(n) AS BIGINT) AS n_covered FROM (SELECT schema_id, 1 AS n FROM rich WHERE provenance = 'db_fk' UNION ALL SELECT schema_id, -1 FROM reconciled WHERE provenance = 'db_fk') x GROUP BY 1 HAVING sum(n) > 0",
        ups=_UPS,
        reconciled=RICH_RECONCILED,
    ),
)
def covered_fks(spark, sf_dir):
    r = rich(spark, sf_dir)
    return merge.covered_fks(r["rich"], edges.reconcile(r["edges"]))


_FK_ROWS = "SELECT DISTINCT schema_id, table_name, name AS column_name, CASE WHEN layer_seq % 5 = 0 THEN 'nowhere' ELSE target END AS ref_table FROM rich WHERE foreign_key IS NOT NULL"
_ONE = "SELECT DISTINCT schema_id, table_name, column_name AS foreign_key FROM index_frag"


def _indexes(f) -> DataFrame:
    return f["index_frag"].select(
        "schema_id",
        "table_name",
        F.lit(None).cast("string").alias("name"),
        F.array("column_name").alias("columns"),
        F.lit(True).alias("unique"),
    )


@query(
    "database_fks",
    rich_sql(
        f"SELECT k.schema_id, k.table_name, CASE WHEN o.foreign_key IS NOT NULL THEN 'has_one' ELSE 'belongs_to' END AS type, regexp_replace(column_name, '_id$', '') AS name, ref_table AS target, column_name AS foreign_key FROM ({_FK_ROWS.replace('name AS column_name', 'foreign_key AS column_name')}) k JOIN tables_ t ON t.schema_id = k.schema_id AND t.table_name = k.ref_table LEFT JOIN ({_ONE}) o ON o.schema_id = k.schema_id AND o.table_name = k.table_name AND o.foreign_key = k.column_name"
    ),
)
def database_fks(spark, sf_dir):
    """Foreign-key rows as edges: unknown tables left out, one to one where the column alone is unique."""
    r, f = rich(spark, sf_dir), frames(spark, sf_dir)
    rows = spark.sql(_FK_ROWS.replace("name AS column_name", "foreign_key AS column_name").replace("FROM rich", "FROM {rich}"), rich=r["rich"])
    return edges.fk_associations(rows, r["tables"], _indexes(f)).drop("provenance")


@query(
    "pending_fk_warnings",
    rich_sql(
        f"SELECT k.schema_id, k.table_name, k.column_name, k.ref_table, CASE WHEN t.table_name IS NULL THEN 'unknown target' ELSE 'unknown column' END AS reason FROM ({_FK_ROWS}) k LEFT JOIN tables_ t ON t.schema_id = k.schema_id AND t.table_name = k.ref_table LEFT JOIN columns_ c ON c.schema_id = k.schema_id AND c.table_name = k.table_name AND c.name = k.column_name WHERE t.table_name IS NULL OR c.name IS NULL"
    ),
)
def pending_fk_warnings(spark, sf_dir):
    r, f = rich(spark, sf_dir), frames(spark, sf_dir)
    rows = spark.sql(_FK_ROWS.replace("FROM rich", "FROM {rich}"), rich=r["rich"])  # by the edge's name, which is no column
    columns = r["column_frag"].select("schema_id", "table_name", "name").distinct()
    return edges.pending_fks(rows, r["tables"], columns, _indexes(f))[1]


_RELATIONS = "SELECT DISTINCT schema_id, table_name, foreign_key AS column_name, target, layer_seq % 4 = 0 AS one_to_one FROM rich WHERE foreign_key IS NOT NULL AND kind = 'config'"


@query(
    "config_relations",
    rich_sql(
        f"SELECT k.schema_id, k.table_name, CASE WHEN one_to_one OR o.foreign_key IS NOT NULL THEN 'has_one' ELSE 'belongs_to' END AS type, regexp_replace(column_name, '_id$', '') AS name, target, column_name AS foreign_key FROM ({_RELATIONS}) k LEFT JOIN ({_ONE}) o ON o.schema_id = k.schema_id AND o.table_name = k.table_name AND o.foreign_key = k.column_name"
    ),
)
def config_relations(spark, sf_dir):
    r, f = rich(spark, sf_dir), frames(spark, sf_dir)
    return edges.config_relations(spark.sql(_RELATIONS.replace("FROM rich", "FROM {rich}"), rich=r["rich"]), _indexes(f)).drop("provenance")


# -- notes and groups


@query(
    "note_report",
    rich_sql(
        "SELECT schema_id, note_id, CASE scope WHEN 'global' THEN 'global' WHEN 'table' THEN table_name ELSE concat(source_table, ' → ', target) END AS target, coalesce(title, '') AS title, text, url AS links FROM notes"
    ),
)
def note_report(spark, sf_dir):
    return reports.note_list(note_rows(rich(spark, sf_dir)))


@query(
    "group_report",
    rich_sql(
        "SELECT g.schema_id, g.group_id, title, coalesce(color, '') AS color, string_agg(table_name, ', ' ORDER BY table_name) AS tables FROM groups_ g JOIN members m ON m.schema_id = g.schema_id AND m.group_id = g.group_id GROUP BY ALL"
    ),
)
def group_report(spark, sf_dir):
    r = rich(spark, sf_dir)
    return reports.group_list(r["groups_"], r["members"])


@query(
    "group_labels",
    rich_sql(
        "SELECT m.schema_id, m.table_name, CASE WHEN title <> '' THEN title ELSE g.group_id END AS label FROM groups_ g JOIN members m ON m.schema_id = g.schema_id AND m.group_id = g.group_id"
    ),
)
def group_labels(spark, sf_dir):
    r = rich(spark, sf_dir)
    return reports.group_labels(r["groups_"], r["members"])


@query(
    "notes_of_kept_tables",
    rich_sql(
        "SELECT schema_id, note_id, scope FROM notes n WHERE scope = 'global' OR (coalesce(table_name, source_table) NOT LIKE 'b%' AND EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = n.schema_id AND t.table_name = coalesce(n.table_name, n.source_table)) AND (scope = 'table' OR (target NOT LIKE 'b%' AND EXISTS (SELECT 1 FROM tables_ t WHERE t.schema_id = n.schema_id AND t.table_name = n.target))))"
    ),
)
def notes_of_kept_tables(spark, sf_dir):
    r = rich(spark, sf_dir)
    left = filters.keep_tables(r["tables"], exclude=["b*"])
    return filters.keep_notes(note_rows(r).withColumn("polymorphic", F.lit(False)), left).select("schema_id", "note_id", "scope")


@query("groups_of_kept_tables", rich_sql("SELECT schema_id, group_id, count(*) AS n_tables FROM members WHERE table_name NOT LIKE '%s' GROUP BY 1, 2"))
def groups_of_kept_tables(spark, sf_dir):
    r = rich(spark, sf_dir)
    _, members = filters.keep_groups(r["groups_"], r["members"], filters.keep_tables(r["tables"], exclude=["*s"]))
    return members.groupBy("schema_id", "group_id").agg(F.count("*").alias("n_tables"))


@query(
    "violations_of_notes_and_groups",
    rich_sql(
        "SELECT schema_id, concat('groups.', group_id) AS path, 'colour is not a hex colour' AS rule FROM groups_ WHERE color = 'red' UNION ALL SELECT schema_id, concat('notes.', note_id), 'link is not http or https' FROM notes WHERE url LIKE 'ftp%' UNION ALL SELECT schema_id, table_name, 'table in two groups' FROM members GROUP BY 1, 2 HAVING count(*) > 1"
    ),
)
def violations_of_notes_and_groups(spark, sf_dir):
    r = rich(spark, sf_dir)
    found = validate.colours(r["groups_"]).unionByName(validate.links(note_rows(r))).unionByName(validate.group_overlap(r["members"]))
    return found.select("schema_id", "path", "rule")


_WANTED = "SELECT schema_id, note_id, source_table AS table_name, target FROM notes WHERE scope = 'relation'"


@query(
    "note_targets",
    edge_sql(
        f"SELECT n.schema_id, n.note_id, count(e.name) AS n FROM ({_WANTED}) n LEFT JOIN rich_edges e ON e.schema_id = n.schema_id AND e.table_name = n.table_name AND e.target = n.target AND e.type = 'has_many' AND e.foreign_key IS NULL GROUP BY 1, 2 HAVING count(e.name) <> 1"
    ),
)
def note_targets(spark, sf_dir):
    """Relation notes that mean none or several edges; they narrow by type and by the absence of a foreign key."""
    r = rich(spark, sf_dir)
    n = r["notes"].where("scope = 'relation'").select(
        "schema_id",
        "note_id",
        F.col("source_table").alias("table_name"),
        "target",
        F.array(F.lit("type"), F.lit("foreign_key")).alias("present"),
        F.lit("has_many").alias("type"),
        *(F.lit(None).cast(t).alias(c) for c, t in (("foreign_key", "string"), ("name", "string"), ("through", "string"), ("polymorphic", "boolean"))),
    )
    return edges.resolve_notes(n, r["edges"])[1]


_NOW, _THEN = "CAST(substr(note_id, 2) AS BIGINT) % 5 <> 0", "CAST(substr(note_id, 2) AS BIGINT) % 5 <> 1"


@query(
    "sidecar_diff",
    rich_sql(
        f"""SELECT schema_id, 'note' AS level, note_id AS item, 'removed' AS change FROM notes WHERE {_THEN} AND NOT ({_NOW}) UNION ALL SELECT schema_id, 'note', note_id, 'added' FROM notes WHERE {_NOW} AND NOT ({_THEN})
    UNION ALL SELECT schema_id, 'note', note_id, 'changed' FROM notes WHERE {_NOW} AND {_THEN} AND title = 'O' UNION ALL SELECT g.schema_id, 'group', g.group_id, 'changed' FROM groups_ g WHERE EXISTS (SELECT 1 FROM members m WHERE m.schema_id = g.schema_id AND m.group_id = g.group_id AND m.table_name = 'tags') AND EXISTS (SELECT 1 FROM members m WHERE m.schema_id = g.schema_id AND m.group_id = g.group_id AND m.table_name <> 'tags')
    UNION ALL SELECT g.schema_id, 'group', g.group_id, 'added' FROM groups_ g WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.schema_id = g.schema_id AND m.group_id = g.group_id AND m.table_name <> 'tags')"""
    ),
)
def sidecar_diff(spark, sf_dir):
    """Notes and groups of two states: other notes and titles, and groups without the table tags."""
    r = rich(spark, sf_dir)
    n = r["notes"].select("schema_id", "note_id", "scope", "title", "text")
    notes = (n.where(_NOW), n.where(_THEN).withColumn("title", F.when(F.col("title") == "O", "other").otherwise(F.col("title"))))

    def groups(members: DataFrame) -> DataFrame:
        by = members.groupBy("schema_id", "group_id").agg(F.collect_set("table_name").alias("tables"))
        return r["groups_"].join(by, ["schema_id", "group_id"])

    empty = {"tables": r["tables"].limit(0), "columns": r["column_frag"].limit(0)}
    sides = [{**empty, "notes": notes[i], "groups": groups(r["members"] if i == 0 else r["members"].where("table_name <> 'tags'"))} for i in (0, 1)]
    return diff.schema_diff(*sides).select("schema_id", "level", "item", "change").distinct()


# -- keys, composites and names

_PKS = "SELECT schema_id, table_name, bool_or(kind = 'config') AS config_pk, min(name) AS key_column FROM column_frag WHERE pos <= 2 GROUP BY 1, 2"


@query(
    "normalized_primary_keys",
    with_ctes(
        f"SELECT c.schema_id, c.table_name, c.name, c.name = k.key_column OR (NOT k.config_pk AND c.p) AS is_primary FROM (SELECT {KEY}, name, bool_or(is_primary) AS p FROM column_frag GROUP BY ALL) c JOIN ({_PKS}) k ON k.schema_id = c.schema_id AND k.table_name = c.table_name"
    ),
)
def normalized_primary_keys(spark, sf_dir):
    f = frames(spark, sf_dir, keep=True)
    keys = spark.sql(_PKS.replace("FROM column_frag", "FROM {c}"), c=f["column_frag"]).select(
        "schema_id",
        "table_name",
        "config_pk",
        F.array("key_column").alias("primary_key"),
    )
    columns = f["column_frag"].groupBy("schema_id", "table_name", "name").agg(F.bool_or("is_primary").alias("primary"))
    out = merge.normalize_primary_key(columns.join(keys.select("schema_id", "table_name"), ["schema_id", "table_name"], "left_semi"), keys)
    return out.select("schema_id", "table_name", "name", F.col("primary").alias("is_primary"))


_OPS = f"SELECT {KEY}, kind, layer_seq, name, CASE WHEN kind = 'config' AND layer_seq % 6 = 0 THEN 'replace' ELSE 'merge' END AS mode, kind = 'config' AND pos = 2 AS dropped FROM column_frag"


@query(
    "config_composites",
    with_ctes(
        f"""SELECT o.schema_id, o.table_name, o.kind, o.layer_seq, o.name FROM ops o WHERE NOT o.dropped AND (o.kind = 'config' OR NOT EXISTS (SELECT 1 FROM ops r WHERE r.kind = 'config' AND r.mode = 'replace' AND r.schema_id = o.schema_id AND r.table_name = o.table_name))
      AND NOT EXISTS (SELECT 1 FROM ops d WHERE d.dropped AND d.schema_id = o.schema_id AND d.table_name = o.table_name AND d.name = o.name)""",
        ops=_OPS,
    ),
)
def config_composites(spark, sf_dir):
    """Replace and drop marks of config fragments."""
    f = frames(spark, sf_dir, keep=True)
    ops = spark.sql(_OPS.replace("FROM column_frag", "FROM {c}"), c=f["column_frag"]).withColumnRenamed("dropped", "drop")
    return merge.apply_composites(ops, ["name"], "mode").select("schema_id", "table_name", "kind", "layer_seq", "name")


@query(
    "schema_counts",
    rich_sql(
        "SELECT t.schema_id, t.n AS n_tables, coalesce(c.n, 0) AS n_columns, coalesce(i.n, 0) AS n_indexes FROM (SELECT schema_id, count(*) AS n FROM tables_ GROUP BY 1) t LEFT JOIN (SELECT schema_id, count(*) AS n FROM columns_ GROUP BY 1) c ON c.schema_id = t.schema_id LEFT JOIN (SELECT schema_id, count(*) AS n FROM indexes_ GROUP BY 1) i ON i.schema_id = t.schema_id"
    ),
)
def schema_counts(spark, sf_dir):
    from .catalogue import merged

    m = merged(spark, sf_dir)
    return merge.schema_counts(m["tables"], m["columns"], m["indexes"])


@query("dictionary_export", DOCUMENT_SQL["dictionary"])
def dictionary_export(spark, sf_dir):
    """The data dictionary, written as tab-separated files and read back."""
    import uuid

    rows = dictionary(spark, sf_dir)
    path = f"{shared_folder(spark)}/dictionary-{uuid.uuid4().hex}"
    reports.write_dictionary(rows, path)
    return reports.read_dictionary(spark, path, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


_WORD = "lower(word)"
_PLURAL = f"CASE WHEN {_WORD} = 'medium' THEN 'media' WHEN {_WORD} = 'leaf' THEN 'leaves' WHEN regexp_matches({_WORD}, '[^aeiou]y$') THEN concat(regexp_replace({_WORD}, 'y$', ''), 'ies') WHEN regexp_matches({_WORD}, '(s|x|z|ch|sh)$') THEN concat({_WORD}, 'es') ELSE concat({_WORD}, 's') END"
_SINGULAR = f"CASE WHEN regexp_matches({_WORD}, 'ies$') THEN regexp_replace({_WORD}, 'ies$', 'y') WHEN regexp_matches({_WORD}, '(s|x|z|ch|sh)es$') THEN regexp_replace({_WORD}, 'es$', '') ELSE regexp_replace({_WORD}, 's$', '') END"


@query(
    "name_functions",
    f"""SELECT word, {_PLURAL} AS plural, {_SINGULAR} AS singular, lower(regexp_replace(regexp_replace(word, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, concat('index_', word, '_on_', word, '_x') AS index_name, concat(least(word, 'm'), '_', greatest(word, 'm')) AS join_table,
      CASE WHEN regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]*$') THEN word ELSE concat('"', word, '"') END AS dbml FROM (
      SELECT DISTINCT unnest(string_split(concat_ws(' ', p_name, p_type, p_brand), ' ')) AS word FROM part UNION SELECT concat(upper(substr(n_name, 1, 1)), lower(substr(n_name, 2)), 'Key') FROM nation) x WHERE word <> ''""",
)
def name_functions(spark, sf_dir):
    """Names of the catalogue made from the words of part and nation."""
    part, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "nation"))
    words = part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")).alias("word")).union(
        nation.select(F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")), F.lit("Key")))
    ).where("word <> ''").distinct()
    w = F.col("word")
    return words.select(
        "word",
        names.pluralize(F.lower(w)).alias("plural"),
        names.singularize(F.lower(w)).alias("singular"),
        names.to_snake(w).alias("snake"),
        names.index_name(w, F.array(w, F.lit("x"))).alias("index_name"),
        names.join_table(w, F.lit("m")).alias("join_table"),
        names.dbml_name(w).alias("dbml"),
    )


@query(
    "dictionary_search_notes",
    rich_sql(
        "SELECT c.schema_id, c.table_name, c.name AS column_name FROM columns_ c WHERE contains(lower(c.name), 'on f') OR contains(lower(coalesce(c.comment, '')), 'on f') OR contains(c.table_name, 'on f') OR EXISTS (SELECT 1 FROM notes n WHERE n.scope = 'table' AND n.schema_id = c.schema_id AND n.table_name = c.table_name AND contains(lower(concat_ws(' ', n.title, n.text)), 'on f'))"
    ),
)
def dictionary_search_notes(spark, sf_dir):
    from .catalogue import merged

    r, m = rich(spark, sf_dir), merged(spark, sf_dir)
    rows = m["columns"].select("schema_id", "table_name", F.col("name").alias("column_name"), "comment")
    return filters.search(rows, "On F", "all_fields", notes=r["notes"]).select("schema_id", "table_name", "column_name")


_ORDER = ["type", "name", "foreign_key", "target", "through", "polymorphic", "provenance"]
_TOKEN = "concat_ws(' ', type, target, CASE WHEN coalesce(name, '') <> '' AND name <> target THEN concat('as ', name) END, CASE WHEN coalesce(foreign_key, '') <> '' THEN concat('fk=', foreign_key) END, CASE WHEN through IS NOT NULL THEN concat('through ', through) END, CASE WHEN polymorphic THEN '(poly)' END)"
_NOTE = "concat(CASE WHEN coalesce({0}.title, '') <> '' THEN concat({0}.title, ': ') ELSE '' END, trim(regexp_replace({0}.text, '\\s+', ' ', 'g')))"
_HANGING = "SELECT n.*, e.type, e.name, e.foreign_key, e.through, e.polymorphic FROM notes n LEFT JOIN (SELECT schema_id, table_name, target, arg_min({'type': type, 'name': name, 'foreign_key': foreign_key, 'through': through, 'polymorphic': polymorphic}, {'a': type, 'b': name, 'c': coalesce(foreign_key, ''), 'd': coalesce(through, ''), 'e': polymorphic}) AS m FROM rich_edges GROUP BY 1, 2, 3) g ON g.schema_id = n.schema_id AND g.table_name = n.source_table AND g.target = n.target LEFT JOIN LATERAL (SELECT g.m.type AS type, g.m.name AS name, g.m.foreign_key AS foreign_key, g.m.through AS through, g.m.polymorphic AS polymorphic) e ON true"


@query(
    "digest_with_notes",
    edge_sql(
        f"""SELECT b.schema_id, concat('# Schema digest', CASE WHEN g.t IS NOT NULL THEN concat(chr(10), chr(10), g.t) ELSE '' END, chr(10), chr(10), '## Tables (', n, ')', chr(10), chr(10), body, chr(10)) AS text FROM (
      SELECT schema_id, count(*) AS n, string_agg(block, concat(chr(10), chr(10)) ORDER BY table_name) AS body FROM (
        SELECT t.schema_id, t.table_name, concat_ws(chr(10), concat('### ', t.table_name, CASE WHEN t.comment IS NOT NULL THEN concat('  — ', t.comment) ELSE '' END), s.said, 'Rel: ' || r.rels) AS block FROM tables_ t
        LEFT JOIN (SELECT schema_id, table_name, string_agg(concat('_', {_NOTE.format("h")}, '_'), chr(10) ORDER BY note_id) AS said FROM hanging h WHERE scope = 'table' GROUP BY 1, 2) s ON s.schema_id = t.schema_id AND s.table_name = t.table_name
        LEFT JOIN (SELECT e.schema_id, e.table_name, string_agg(concat({_TOKEN}, coalesce(' — ' || q.quoted, '')), ', ' ORDER BY type, coalesce(name, ''), coalesce(foreign_key, ''), target, coalesce(through, ''), polymorphic, provenance) AS rels FROM rich_edges e
          LEFT JOIN (SELECT schema_id AS s_, source_table AS t_, type AS y_, name AS n_, foreign_key AS f_, through AS h_, polymorphic AS p_, string_agg(concat('"', {_NOTE.format("h")}, '"'), '; ' ORDER BY note_id) AS quoted FROM hanging h WHERE scope = 'relation' AND type IS NOT NULL GROUP BY ALL) q
            ON q.s_ = e.schema_id AND q.t_ = e.table_name AND q.y_ = e.type AND q.n_ IS NOT DISTINCT FROM e.name AND q.f_ IS NOT DISTINCT FROM e.foreign_key AND q.h_ IS NOT DISTINCT FROM e.through AND q.p_ = e.polymorphic GROUP BY 1, 2) r ON r.schema_id = t.schema_id AND r.table_name = t.table_name) x GROUP BY schema_id) b
      LEFT JOIN (SELECT schema_id, string_agg({_NOTE.format("h")}, concat(chr(10), chr(10)) ORDER BY note_id) AS t FROM hanging h WHERE scope = 'global' GROUP BY 1) g ON g.schema_id = b.schema_id""",
        hanging=_HANGING,
    ),
)
def digest_with_notes(spark, sf_dir):
    """The digest of tables and edges with global, table and relation notes; a relation note hangs on the first edge to its target."""
    r = rich(spark, sf_dir)
    keys = F.struct("type", "name", "foreign_key", "through", "polymorphic")
    order = F.struct("type", "name", F.coalesce("foreign_key", F.lit("")), F.coalesce("through", F.lit("")), "polymorphic")
    first = r["edges"].groupBy("schema_id", F.col("table_name").alias("source_table"), "target").agg(F.min_by(keys, order).alias("m"))
    notes = written(
        r["notes"].join(first, ["schema_id", "source_table", "target"], "left").select(
            "schema_id",
            "note_id",
            "scope",
            "title",
            "text",
            "table_name",
            "source_table",
            "target",
            "m.*",
        ),
        "hanging",
    )
    notes = notes.where("scope <> 'relation' OR type IS NOT NULL")
    columns = spark.createDataFrame(
        [],
        f"schema_id {r['tables'].schema['schema_id'].dataType.simpleString()}, table_name string, pos int, name string, type string, primary boolean, comment string",
    )
    return reports.digest(r["tables"], columns, r["edges"].drop("seen"), notes=notes)
