"""Extraction jobs over corpora of source files ``(project, path, content)``: rows of columns, indexes, keys and edges.

Formats with a statement a line are split into numbered lines, a window carries the block's header to the lines inside, and
regular expressions read each statement. What is not understood is a warning row, never silent. Only Python models need a
parser per file (``ast``); all that follows is joins.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeatlas.functions.names import SQL_TYPES, class_to_table, fk_stem, index_name, lookup, pluralize, sized_type, to_snake, token_type
from lakeatlas.operators.store import written

FILE = ["project", "path"]


def lines(corpus: DataFrame) -> DataFrame:
    """Numbered lines. Whole files are dealt out first, so that windows over a file need no shuffle of its lines."""
    return corpus.repartition(*FILE).select(*FILE, F.posexplode(F.split("content", "\r?\n")).alias("line", "text"))


def blocks(numbered: DataFrame, header: str, closing: str = r"^\s*\}", step: Column | None = None) -> DataFrame:
    """Add ``head`` and ``head_line``, the header line that a line is inside of and its number (null outside); header and closing
    lines themselves stay. With ``step`` also ``depth``, its sum over the lines since the header.

    The lines are written once: each kind of statement reads them from there, and the files are split one time only.
    """
    w = Window.partitionBy(*FILE).orderBy("line")
    own = numbered.withColumn("opens", F.col("text").rlike(header))
    own = own.withColumn("_sum", F.lit(0) if step is None else F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    opened = F.struct(F.col("text").alias("head"), F.col("line").alias("head_line"), F.col("_sum").alias("sum"))
    closed = F.struct(F.lit(None).cast("string").alias("head"), F.lit(None).cast("int").alias("head_line"), F.lit(None).cast(own.schema["_sum"].dataType).alias("sum"))
    event = F.when(F.col("opens"), opened).when(F.col("text").rlike(closing), closed)
    own = own.withColumn("_at", F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    depth = [] if step is None else [(F.col("_sum") - F.col("_at.sum")).alias("depth")]
    return written(own.select(*numbered.columns, "_at.head", "_at.head_line", "opens", *depth), "lines")


def first_definitions(heads: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    """Of header lines (project, path, line, table_name) the first of each name, and warnings for the others, which are ignored."""
    from lakeatlas.operators.edges import first_by

    first, others = first_by(heads, [*FILE, "table_name"], ["line"])
    doubled = others.select(*FILE, "line", F.concat(F.lit(f"duplicate {what}, later definition ignored: "), "table_name").alias("message"))
    return first, written(doubled, "doubled")


def of_first(inside: DataFrame, doubled: DataFrame) -> DataFrame:
    """Lines inside blocks without those of ``doubled`` headers, which are few, where there are any."""
    return inside.join(doubled.select(*FILE, F.col("line").alias("head_line")), [*FILE, "head_line"], "left_anti")


def unread(rows: DataFrame, known: str) -> DataFrame:
    """A warning for each line that is none of the ``known`` statements."""
    return rows.where(~F.col("text").rlike(known)).select(*FILE, "line", F.concat(F.lit("unknown statement: "), F.trim("text")).alias("message"))


def group(pattern: str, i: int = 1, c: str = "text") -> Column:
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def unquoted(name: Column) -> Column:
    return F.regexp_replace(name, '^"|"$', "")


# -- DBML

_NAME = r'("(?:[^"\\]|\\.)+"|[\w.]+)'


_SIDE = r'("[^"]+"|\w+(?:\.\w+)?)\.("[^"]+"|\w+)'
_PAIR = rf"{_SIDE}\s*(<>|[<>-])\s*{_SIDE}"
#: Settings of columns, and blocks that hold no facts about tables.
_SETTINGS = r"^(pk|primary key|not null|null|unique|increment|auto_?increment|default\s*:.*|note\s*:.*|ref\s*:\s*(<>|[<>-])\s*.*)$"
_APART = r"^\s*(Enum|Project|TableGroup|Note)\b[^:]*\{"


def _bare(side: Column) -> Column:
    """A name without quotes and without its schema."""
    return F.regexp_replace(unquoted(side), r"^\w+\.(?=\w+$)", "")


def dbml(corpus: DataFrame) -> dict[str, DataFrame]:
    """columns(project, path, table_name, pos, name, type, sql_type, primary, nullable, unique, increment, default), indexes, refs
    (from ``Ref:`` lines, ``Ref { }`` blocks and inline settings), pairs (many to many) and warnings.

    Of tables of one name the first counts. A line inside a table, an index list or a Ref block and one outside belongs to a
    statement or is a warning; so is a setting that is not known, and a Ref to a table or column that is not there.
    """
    header = rf"^\s*Table\s+{_NAME}"
    step = F.when(F.col("text").rlike(r"\{\s*$"), 1).when(F.col("text").rlike(r"^\s+\}"), -1).otherwise(0)
    b = blocks(lines(corpus), rf"{header}|^\s*Ref\b[^:{{]*\{{\s*$|{_APART}", r"^\}", step)
    of_table = F.col("head").rlike(header)
    heads = b.where(F.col("opens") & F.col("text").rlike(header)).select(*FILE, "line", unquoted(group(header, 1)).alias("table_name"))
    first, doubled = first_definitions(heads, "table")
    every = b.where(of_table & ~F.col("opens")).withColumn("table_name", unquoted(F.regexp_extract("head", header, 1)))
    flat = of_first(every, doubled)
    column = rf"^\s*{_NAME}\s+([^\[\s][^\[]*?)\s*(\[.*\])?\s*(?://.*)?$"
    other = r"^\s*(Note\b[:\s{]|indexes\b\s*\{|\}|//|$)"
    is_row = (F.col("depth") == 0) & F.col("text").rlike(column) & ~F.col("text").rlike(other)
    rows = flat.where(is_row)
    attrs = F.coalesce(group(column, 3), F.lit(""))
    pk = attrs.rlike(r"[\[,]\s*(pk|primary key)\s*[\],]")
    kind = group(column, 2)
    columns = rows.select(
        *FILE, "table_name", "line", unquoted(group(column, 1)).alias("name"), token_type(kind, SQL_TYPES).alias("type"), kind.alias("sql_type"), pk.alias("primary"), (
            ~(pk | attrs.rlike(r"[\[,]\s*not null\s*[\],]"))
        ).alias("nullable"),
        attrs.rlike(r"[\[,]\s*unique\s*[\],]").alias("unique"), attrs.rlike(r"[\[,]\s*increment\s*[\],]").alias("increment"), F.nullif(
            F.regexp_replace(F.regexp_extract(attrs, r"default:\s*('(?:[^'\\]|\\.)*'|[^,\]]+)", 1), "^'|'$", ""),
            F.lit(""),
        ).alias("default"),
    )
    columns = columns.withColumn("pos", F.row_number().over(Window.partitionBy(*FILE, "table_name").orderBy("line"))).drop("line")
    apart = lambda text, of: [_bare(group(of, 1, text)).alias("l"), unquoted(group(of, 2, text)).alias("lc"), group(of, 3, text).alias("op"), _bare(group(of, 4, text)).alias("r"), unquoted(group(of, 5, text)).alias("rc")]
    line = rf"^\s*Ref[^:{{]*:\s*{_PAIR}|^\s*Ref\b[^:{{]*\{{\s*{_PAIR}"
    of_line = rf"[:{{]\s*{_PAIR}"
    in_block = F.col("head").rlike(r"^\s*Ref\b") & ~F.col("opens")
    said = b.where(F.col("text").contains("Ref") & F.col("text").rlike(line) & ~F.coalesce(of_table, F.lit(False))).select(*FILE, "line", *apart("text", of_line)).union(
        b.where(in_block & F.col("text").rlike(rf"^\s*{_PAIR}")).select(*FILE, "line", *apart("text", _PAIR))
    )
    # settings apart from commas in quotes and parentheses
    setting = F.filter(F.transform(F.split(F.substr(attrs, F.lit(2), F.greatest(F.length(attrs) - 2, F.lit(0))), r""",(?=(?:[^'`"]*['`"][^'`"]*['`"])*[^'`"]*$)"""), lambda x: F.trim(x)), lambda x: x != "")
    set_in = lambda df: df.select(*FILE, "table_name", "line", unquoted(group(column, 1)).alias("column_name"), F.explode(setting).alias("s"))
    settings, of_ref = set_in(rows), set_in(flat.where(F.lower("text").contains("ref") & is_row))
    own = rf"(?i)^ref\s*:\s*(<>|[<>-])\s*{_SIDE}"
    inline = of_ref.where(F.col("s").rlike(own)).select(
        *FILE, "line", F.col("table_name").alias("l"), F.col("column_name").alias("lc"), group(own, 1, "s").alias("op"), _bare(group(own, 2, "s")).alias("r"), unquoted(group(own, 3, "s")).alias("rc")
    )
    found = written(said.union(inline), "refs")
    asked = found.select(*FILE, F.col("l").alias("table_name"), F.col("lc").alias("name")).union(found.select(*FILE, "r", "rc"))
    cols = columns.select(*FILE, "table_name", "name").join(asked.distinct(), [*FILE, "table_name", "name"], "left_semi").distinct()
    known = first.select(*FILE, "table_name").distinct()
    side = lambda df, t, c, mark: df.join(cols.select(*FILE, F.col("table_name").alias(t), F.col("name").alias(c), F.lit(True).alias(mark)), [*FILE, t, c], "left")
    there = lambda df, t, mark: df.join(known.select(*FILE, F.col("table_name").alias(t), F.lit(True).alias(mark)), [*FILE, t], "left")
    marked = side(side(there(there(found, "l", "_lt"), "r", "_rt"), "l", "lc", "_lcol"), "r", "rc", "_rcol")
    text = lambda a, c: F.concat_ws(".", a, c)
    reason = (
        F.when(F.col("_lt").isNull(), F.concat(F.lit("Ref to unknown table: "), "l"))
        .when(F.col("_rt").isNull(), F.concat(F.lit("Ref to unknown table: "), "r"))
        .when(F.col("_lcol").isNull(), F.concat(F.lit("Ref to unknown column: "), text("l", "lc")))
        .when(F.col("_rcol").isNull(), F.concat(F.lit("Ref to unknown column: "), text("r", "rc")))
    )
    marked = marked.withColumn("message", reason)
    swap = F.col("op") == "<"
    good = marked.where("message IS NULL")
    refs = good.where("op <> '<>'").select(
        *FILE,
        F.when(swap, F.col("r")).otherwise(F.col("l")).alias("table_name"),
        F.when(swap, F.col("rc")).otherwise(F.col("lc")).alias("column_name"),
        F.when(swap, F.col("l")).otherwise(F.col("r")).alias("ref_table"),
        (F.col("op") == "-").alias("one_to_one"),
    )
    pairs = good.where("op = '<>'").select(*FILE, F.col("l").alias("table_name"), F.col("r").alias("target"))
    entry = r"^\s+(?:\(([^)]*)\)|(\w+)\s*(?:\[|$))"
    listed = flat.where((F.col("depth") >= 1) & ~F.col("text").rlike(r"^\s*(indexes\b\s*\{|Note\b|//|$)"))
    indexes = listed.where(F.col("text").rlike(entry)).select(
        *FILE,
        "table_name",
        F.transform(F.split(F.coalesce(group(entry, 1), group(entry, 2)), r"\s*,\s*"), unquoted).alias("columns"),
        F.col("text").rlike(r"[\[,]\s*unique\b").alias("unique"),
        F.col("text").rlike(r"\[pk\]").alias("primary"),
        group(r"name:\s*'([^']*)'").alias("name"),
    )
    composite = b.where(F.col("text").rlike(r"^\s*Ref[^:]*:.*\.\(") | (in_block & F.col("text").rlike(r"\.\("))).select(*FILE, "line", F.lit("composite Ref").alias("message"))
    skipped = b.where(
        F.col("text").rlike(r"^\s*(TableGroup|Note)\b.*\{\s*$") & F.col("head").isNull()
    ).select(*FILE, "line", F.lit("ignored block").alias("message"))
    odd = settings.where(~F.lower("s").rlike(_SETTINGS)).select(*FILE, "line", F.concat(F.lit("unknown setting: "), "s").alias("message"))
    bad_ref = of_ref.where(F.lower("s").rlike(r"^ref\s*:") & ~F.col("s").rlike(own)).select(*FILE, "line", F.concat(F.lit("unknown setting: "), "s").alias("message"))
    warnings = [
        composite,
        skipped,
        doubled,
        odd,
        bad_ref,
        marked.where("message IS NOT NULL").select(*FILE, "line", "message"),
        unread(flat.where((F.col("depth") == 0)), rf"{column}|{other}"),
        unread(listed, rf"{entry}|^\s*\}}|^\s*(Note|').*"),
        unread(b.where(in_block), rf"^\s*{_PAIR}|\.\(|^\s*(\}}|//|$)"),
        unread(b.where(F.col("head").isNull()), rf"{header}|{_APART}|{line}|^\s*Ref\b[^:{{]*\{{|^\s*Ref[^:]*:.*\.\(|^\s*(\}}|//|$)"),
    ]
    return {"columns": columns, "indexes": indexes, "refs": refs, "pairs": pairs, "warnings": reduce(DataFrame.union, warnings)}


# -- Mermaid

_ENTITY = r"([A-Za-z_][\w-]*)"
_RELATION = rf'^\s*{_ENTITY}\s+(\|o|\|\||}}o|}}\|)(?:--|\.\.)(o\||\|\||o\{{|\|\{{)\s+{_ENTITY}\s*(?::\s*"?([^"]*)"?)?\s*$'


def mermaid(corpus: DataFrame) -> dict[str, DataFrame]:
    """columns(…, table_name, pos, name, type, primary), edges by crow's feet (no foreign keys), tables; of kind sketch. Of entities
    of one name the first counts; a line that is no statement is a warning."""
    header = rf"^\s*{_ENTITY}\s*\{{\s*$"
    b = blocks(lines(corpus), header)
    column = r"^\s+(\S+)\s+([\w.-]+)(?:\s+([A-Z, ]+))?(?:\s+\".*\")?\s*$"
    heads = b.where("opens").select(*FILE, "line", group(header).alias("table_name"))
    first, doubled = first_definitions(heads, "entity")
    inside = of_first(b.where("head IS NOT NULL AND NOT opens"), doubled)
    rows = inside.where(F.col("text").rlike(column)).withColumn("table_name", F.regexp_extract("head", header, 1))
    columns = rows.select(
        *FILE,
        "table_name",
        F.row_number().over(Window.partitionBy(*FILE, "table_name").orderBy("line")).alias("pos"),
        group(column, 2).alias("name"),
        group(column, 1).alias("type"),
        F.coalesce(group(column, 3), F.lit("")).contains("PK").alias("primary"),
    )
    r = b.where(F.col("head").isNull() & F.col("text").rlike(_RELATION)).select(
        *FILE,
        "line",
        group(_RELATION, 1).alias("l"),
        group(_RELATION, 2).alias("ls"),
        group(_RELATION, 3).alias("rs"),
        group(_RELATION, 4).alias("r"),
        group(_RELATION, 5).alias("label"),
    )
    many_l, many_r = F.col("ls").startswith("}"), F.col("rs").endswith("{")
    kind = F.when(many_l & many_r, "has_and_belongs_to_many").when(~many_l & ~many_r, "has_one").otherwise("belongs_to")
    on_right = many_r & ~many_l
    edges = r.select(
        *FILE,
        F.when(on_right, F.col("r")).otherwise(F.col("l")).alias("table_name"),
        kind.alias("type"),
        F.coalesce("label", F.when(on_right, F.col("l")).otherwise(F.col("r"))).alias("name"),
        F.when(on_right, F.col("l")).otherwise(F.col("r")).alias("target"),
    )
    named = b.where("opens").select(*FILE, group(header).alias("table_name"))
    tables = named.union(edges.select(*FILE, "table_name")).union(edges.select(*FILE, "target")).distinct()
    blank = r"^\s*(%%.*|\}|)\s*$"
    outside = rf"{header}|{_RELATION}|{blank}|^\s*(erDiagram|title\b.*|direction\b.*|accTitle\b.*|accDescr\b.*|---)\s*$"
    warnings = doubled.union(unread(inside, rf"{column}|{blank}")).union(unread(b.where(F.col("head").isNull()), outside))
    return {"columns": columns, "edges": edges, "tables": tables, "warnings": warnings}


# -- schema.rb

_STRING = r"""["':]([\w.]+)["']?"""
#: Column types of schema files.
_TYPES = "string text integer bigint float decimal boolean datetime timestamp date time json jsonb uuid inet binary".split()


def schema_rb(corpus: DataFrame) -> dict[str, DataFrame]:
    """columns, indexes, fks (foreign keys as they are written), edges (those between tables and columns of the file) and warnings
    of Rails schema files."""
    header = rf"^\s*create_table\s+{_STRING}"
    b = blocks(lines(corpus), header, r"^\s*end\b")
    inside = b.where("head IS NOT NULL AND NOT opens").withColumn("table_name", F.regexp_extract("head", header, 1))
    plain = rf"^\s*t\.({'|'.join(_TYPES)})\s+{_STRING}"
    option = lambda n: group(rf"\b{n}:\s*([^,\s]+)")
    default = F.regexp_replace(group(r"""default:\s*("[^"]*"|[^,]+)"""), '^"|"$', "")
    listing = group(rf"^\s*t\.\w+\s+({_STRING}(?:\s*,\s*{_STRING}(?!\w*\s*(?:=>|:[^:])))*)")
    several = F.col("text").rlike(r""",\s*["':]""")  # few lines name more than one column
    each = F.when(several, F.regexp_extract_all(listing, F.lit(_STRING), F.lit(1))).otherwise(F.array(group(plain, 2)))
    # plain searches stand before patterns, which cost more
    said = lambda word, pattern: F.col("text").contains(word) & F.col("text").rlike(pattern)
    is_ref = lambda pattern: said("t.references", pattern) | said("t.belongs_to", pattern)
    a_ref = rf"^\s*t\.(references|belongs_to)\s+{_STRING}"
    ref = group(a_ref, 2)
    poly = F.col("text").contains("polymorphic: true")
    refs = inside.where(is_ref(a_ref)).withColumn("ref", ref)
    # one pass over the lines: what kind of statement each is, and the columns that it makes
    kind = (
        F.when(F.col("opens"), F.when(~F.col("text").rlike(r"\bid:\s*false"), "id"))
        .when(F.col("text").rlike(plain), "own")
        .when(is_ref(a_ref), "ref")
        .when(said("t.timestamps", r"^\s*t\.timestamps\b"), "stamps")
    )
    made = (
        F.when(F.col("kind") == "id", F.array(F.coalesce(group(rf"primary_key:\s*{_STRING}"), F.lit("id"))))
        .when(F.col("kind") == "own", each)
        .when(F.col("kind") == "ref", F.array_compact(F.array(F.concat(ref, F.lit("_id")), F.when(poly, F.concat(ref, F.lit("_type"))))))
        .when(F.col("kind") == "stamps", F.array(F.lit("created_at"), F.lit("updated_at")))
    )
    told = b.where("opens OR head IS NOT NULL").withColumn("kind", kind)
    of = lambda id_, own, ref_, stamps: F.when(F.col("kind") == "id", id_).when(F.col("kind") == "own", own).when(F.col("kind") == "ref", ref_).otherwise(stamps)
    id_type, datetime, nothing = F.coalesce(group(r"\bid:\s*:(\w+)"), F.lit("bigint")), F.lit("datetime"), F.lit(None).cast("string")
    ref_type = F.when(F.col("sub") == 0, F.coalesce(group(r"\btype:\s*:(\w+)"), F.lit("bigint"))).otherwise("string")
    allowed = F.coalesce(option("null") != "false", F.lit(True))
    columns = told.select("*", F.posexplode(made).alias("sub", "name")).select(
        *FILE,
        F.when(F.col("opens"), group(header)).otherwise(F.regexp_extract("head", header, 1)).alias("table_name"),
        F.when(F.col("opens"), -1).otherwise(F.col("line")).alias("line"),
        "sub",
        "name",
        of(id_type, group(plain, 1), ref_type, datetime).alias("type"),
        of(id_type, sized_type(group(plain, 1), option("limit"), option("precision"), option("scale")), ref_type, datetime).alias("sql_type"),
        of(F.lit(False), allowed, allowed, F.lit(False)).alias("nullable"),
        of(nothing, default, nothing, nothing).alias("default"),
        (F.col("kind") == "id").alias("primary"),
    )
    heads = b.where("opens").withColumn("table_name", group(header))
    columns = columns.withColumn("pos", F.row_number().over(Window.partitionBy(*FILE, "table_name").orderBy("line", "sub"))).drop("line", "sub")
    listed = r"\[([^\]]*)\]"
    names = lambda c: F.transform(F.split(c, r"\s*,\s*"), lambda x: F.regexp_replace(x, "[\"':]", ""))
    cols = F.coalesce(names(group(listed)), F.array(group(rf"(?:t\.index|add_index\s+\S+,)\s+{_STRING}")))
    t_index = inside.where(said("t.index", r"^\s*t\.index\b")).select(
        *FILE,
        "table_name",
        cols.alias("columns"),
        F.col("text").contains("unique: true").alias("unique"),
        group(rf"name:\s*{_STRING}").alias("name"),
    )
    a_index = b.where(said("add_index", r"^\s*add_index\b")).select(
        *FILE,
        "line",
        group(rf"add_index\s+{_STRING}").alias("table_name"),
        cols.alias("columns"),
        F.col("text").contains("unique: true").alias("unique"),
        group(rf"name:\s*{_STRING}").alias("name"),
    )
    r_index = refs.where(~F.col("text").contains("index: false")).select(
        *FILE,
        "table_name",
        F.when(
            poly,
            F.array(F.concat("ref", F.lit("_type")), F.concat("ref", F.lit("_id"))),
        ).otherwise(F.array(F.concat("ref", F.lit("_id")))).alias("columns"),
        F.col("text").rlike(r"index:\s*\{[^}]*unique:\s*true").alias("unique"),
        F.lit(None).cast("string").alias("name"),
    )
    indexes = t_index.unionByName(
        a_index.drop("line").join(heads.select(*FILE, "table_name").distinct(), [*FILE, "table_name"], "left_semi")
    ).unionByName(r_index).withColumn("name", F.coalesce("name", index_name(F.col("table_name"), F.col("columns"))))
    fk = rf"^\s*add_foreign_key\s+{_STRING},\s*{_STRING}"
    from lakeatlas.functions.names import singularize

    added = b.where(said("add_foreign_key", fk)).select(
        *FILE,
        group(fk, 1).alias("table_name"),
        F.coalesce(group(rf"column:\s*{_STRING}"), F.concat(singularize(group(fk, 2)), F.lit("_id"))).alias("column_name"),
        group(fk, 2).alias("ref_table"),
    )
    inline = refs.where(F.col("text").rlike(r"foreign_key:\s*(true|\{)") & ~poly).select(
        *FILE,
        "table_name",
        F.concat("ref", F.lit("_id")).alias("column_name"),
        F.coalesce(group(rf"to_table:\s*{_STRING}"), pluralize(F.col("ref"))).alias("ref_table"),
    )
    known = rf"^\s*(t\.({'|'.join(_TYPES)}|references|belongs_to|timestamps|index)\b|end\b|#|$)"
    unknown = inside.where(~F.col("text").rlike(known)).select(*FILE, "line", F.concat(F.lit("unknown statement: "), F.trim("text")).alias("message"))
    outside = r"^\s*(create_table|add_index|add_foreign_key|ActiveRecord::Schema\S*|end|enable_extension)\b|^\s*(#|$)"
    stray = b.where(F.col("head").isNull() & ~F.col("text").rlike(outside)).select(
        *FILE,
        "line",
        F.concat(F.lit("unknown statement: "), F.trim("text")).alias("message"),
    )
    lost = a_index.join(heads.select(*FILE, "table_name").distinct(), [*FILE, "table_name"], "left_anti").select(
        *FILE,
        "line",
        F.concat(F.lit("index on unknown table: "), "table_name").alias("message"),
    )
    fks = added.union(inline)
    from lakeatlas.operators.edges import pending_fks

    edges, bad = pending_fks(fks, heads, columns, indexes, FILE)
    pending = bad.select(*FILE, F.lit(None).cast("int").alias("line"), F.concat(F.lit("foreign key, "), "reason", F.lit(": "), F.concat_ws(".", "table_name", "column_name"), F.lit(" -> "), "ref_table").alias("message"))
    warnings = unknown.union(stray).union(lost).union(pending)
    return {"columns": columns, "indexes": indexes, "fks": fks, "edges": edges, "warnings": warnings}


# -- Prisma

#: Display types of Prisma types.
_PRISMA = {
    "String": "string",
    "Int": "integer",
    "BigInt": "bigint",
    "Float": "float",
    "Decimal": "decimal",
    "Boolean": "boolean",
    "DateTime": "datetime",
    "Json": "json",
    "Bytes": "binary",
}


def prisma(corpus: DataFrame) -> dict[str, DataFrame]:
    """fields, list_fields (for edges.pair_many_to_many), edges, indexes and warnings of Prisma schemas; @map and @@map rename.

    ``@@id`` makes its fields primary, a ``@@unique`` of one field makes it unique. A single relation field without fields of its
    own is the other side of a one-to-one.
    """
    header = r"^\s*model\s+(\w+)\s*\{"
    b = blocks(lines(corpus), header)
    inside = b.where("head IS NOT NULL AND NOT opens").withColumn("model", F.regexp_extract("head", header, 1))
    names = b.where("opens").select(*FILE, group(header).alias("model")).join(
        inside.where(F.col("text").rlike(r"^\s*@@map\(")).select(*FILE, "model", group(r'@@map\(\s*(?:name:\s*)?"([^"]+)"').alias("mapped")),
        [*FILE, "model"],
        "left",
    ).select(*FILE, "model", F.coalesce("mapped", "model").alias("table_name"))
    field = r"^\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)$"
    f = inside.where(F.col("text").rlike(field) & ~F.col("text").rlike(r"^\s*(@@|//)")).select(
        *FILE,
        "model",
        "line",
        group(field, 1).alias("field"),
        group(field, 2).alias("kind"),
        (F.regexp_extract("text", field, 3) != "").alias("is_list"),
        (F.regexp_extract("text", field, 4) != "").alias("nullable"),
        "text",
    ).join(names, [*FILE, "model"])
    targets = names.select(*FILE, F.col("model").alias("kind"), F.col("table_name").alias("target"))
    related = f.join(targets, [*FILE, "kind"])
    plain = f.join(targets, [*FILE, "kind"], "left_anti")
    ids = r"^\s*@@id\([^)\[]*\[([^\]]*)\]"
    in_id = inside.where(F.col("text").rlike(ids)).select(*FILE, "model", F.explode(F.split(F.trim(group(ids)), r"\s*,\s*")).alias("field"), F.lit(True).alias("_id"))
    alone = r"^\s*@@unique\([^)\[]*\[\s*(\w+)\s*\]"
    one = inside.where(F.col("text").rlike(alone)).select(*FILE, "model", group(alone).alias("field"), F.lit(True).alias("_alone"))
    plain = plain.join(in_id.distinct(), [*FILE, "model", "field"], "left").join(one.distinct(), [*FILE, "model", "field"], "left")
    key = F.col("text").rlike(r"@id\b") | F.coalesce("_id", F.lit(False))
    fields = plain.select(
        *FILE,
        "model",
        "field",
        "table_name",
        F.row_number().over(Window.partitionBy(*FILE, "table_name").orderBy("line")).alias("pos"),
        F.coalesce(group(r'@map\("([^"]+)"\)'), F.col("field")).alias("name"),
        F.coalesce(lookup(F.col("kind"), _PRISMA), F.col("kind")).alias("type"),
        (F.col("nullable") & ~key).alias("nullable"),
        key.alias("primary"),
        (F.col("text").rlike(r"@unique\b") | F.coalesce("_alone", F.lit(False))).alias("unique"),
    )
    relation = group(r'@relation\(\s*(?:name:\s*)?"([^"]+)"')
    fk = group(r"fields:\s*\[\s*(\w+)")  # of a key over several fields, the first
    keys = fields.withColumn("_n", F.sum(F.col("primary").cast("int")).over(Window.partitionBy(*FILE, "model")))
    named = keys.select(*FILE, "model", F.col("field").alias("fk"), F.col("name").alias("column"), (F.col("unique") | (F.col("primary") & (F.col("_n") == 1))).alias("_one"))
    owned = related.where("NOT is_list").withColumn("fk", fk).join(named, [*FILE, "model", "fk"], "left")
    edges = owned.select(
        *FILE,
        "table_name",
        F.when(F.col("_one") | F.col("fk").isNull(), "has_one").otherwise("belongs_to").alias("type"),
        F.col("field").alias("name"),
        "target",
        F.coalesce("column", "fk").alias("foreign_key"),
    )
    lists = related.where("is_list").select(F.concat_ws("/", *FILE).alias("schema_id"), "table_name", "field", "target", relation.alias("relation"))
    indexes = inside.where(F.col("text").rlike(r"^\s*@@(unique|index|id)\(")).join(names, [*FILE, "model"]).select(
        *FILE,
        "table_name",
        F.split(group(r"\[([^\]]*)\]"), r"\s*,\s*").alias("columns"),
        F.col("text").rlike("@@(unique|id)").alias("unique"),
        F.col("text").rlike("@@id").alias("primary"),
    )
    inner = rf"{field}|^\s*(@@(map|unique|index|id|schema|ignore|fulltext)\b|//|\}}|$)"
    several = owned.where(F.col("text").rlike(r"fields:\s*\[\s*\w+\s*,")).select(*FILE, "line", F.concat(F.lit("key over several fields, the first stands for it: "), "field").alias("message"))
    skip = blocks(lines(corpus), r"^\s*(model|enum|datasource|generator|type|view)\b[^{]*\{")
    outer = unread(skip.where(F.col("head").isNull()), r"^\s*((model|enum|datasource|generator|type|view)\b[^{]*\{|//|\}|$)")
    warnings = unread(inside, inner).union(several).union(outer)
    return {"fields": fields.drop("model", "field"), "list_fields": lists, "edges": edges, "indexes": indexes, "warnings": warnings}


# -- Ruby and PHP models


_CLASS = r"^\s*class\s+([\w:]+)\s*(?:<\s*([\w:]+))?"
RAILS_ROOTS = ["ApplicationRecord", "ActiveRecord::Base"]


def _carried(numbered: DataFrame, pattern: str, name: str) -> DataFrame:
    """Add the first group of the last line so far that fits ``pattern``."""
    w = Window.partitionBy(*FILE).orderBy("line")
    return numbered.withColumn(name, F.last(group(pattern), ignorenulls=True).over(w))


def rails_models(corpus: DataFrame, table_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """bases(schema_id, src, dst), tables (class to table name, of concrete models) and edges of Rails models.

    A model reaches one of RAILS_ROOTS. Its table is what ``table_map(schema_id, cls, table_name)`` says, else that of its
    STI root (the farthest ancestor through concrete classes): by its own table_name, else by that of the first module it
    includes which sets one, else by its name. Targets named after a model that has another table are sent there.
    """
    from lakeatlas.operators.edges import redirect_targets
    from lakeatlas.operators.graph import descendants, inheritance_roots

    clean = corpus.withColumn("content", F.regexp_replace("content", r"#[^\n{]*", ""))
    named = r"""self\.table_name\s*=\s*["']([^"']+)"""
    own = _carried(_carried(lines(clean), _CLASS, "cls"), r"^\s*module\s+(\w+)", "module").withColumn("schema_id", F.col("project"))
    modules = own.where("module IS NOT NULL").groupBy("schema_id", F.element_at(F.split("module", "::"), -1).alias("module")).agg(
        F.min_by(group(named), F.when(group(named).isNotNull(), F.struct("path", "line"))).alias("by_module")
    ).where("by_module IS NOT NULL")
    cls = own.where(F.col("cls").isNotNull() & ~F.col("path").rlike("(^|/)concerns/"))
    by = cls.groupBy("schema_id", "cls").agg(
        F.min_by(group(_CLASS, 2), F.when(group(_CLASS, 2).isNotNull(), F.struct("path", "line"))).alias("base"),
        F.coalesce(F.bool_or(F.col("text").rlike(r"self\.abstract_class\s*=\s*true")), F.lit(False)).alias("abstract"),
        F.min_by(group(named), F.when(group(named).isNotNull(), F.struct("path", "line"))).alias("by_name"),
    ).withColumn("abstract", F.col("abstract") | F.col("cls").isin(RAILS_ROOTS))
    included = cls.where(group(r"^\s*include\s+([\w:]+)").isNotNull()).select(
        "schema_id",
        "cls",
        F.struct("path", "line").alias("at"),
        F.element_at(F.split(group(r"^\s*include\s+([\w:]+)"), "::"), -1).alias("module"),
    )
    mixed = included.join(modules, ["schema_id", "module"]).groupBy("schema_id", "cls").agg(F.min_by("by_module", "at").alias("by_module"))
    bases = by.where("base IS NOT NULL").select("schema_id", F.col("cls").alias("src"), F.col("base").alias("dst"))
    roots = bases.where(F.col("dst").isin(RAILS_ROOTS)).select("schema_id", F.col("src").alias("node"))
    concrete = by.where("NOT abstract").join(descendants(bases, roots).withColumnRenamed("node", "cls"), ["schema_id", "cls"], "left_semi")
    if table_map is None:
        table_map = concrete.select("schema_id", "cls", F.lit(None).cast("string").alias("table_name")).limit(0)
    mapped = table_map.select("schema_id", "cls", F.col("table_name").alias("by_map"))
    resolved = concrete.join(mixed, ["schema_id", "cls"], "left").join(mapped, ["schema_id", "cls"], "left")
    resolved = resolved.select(
        "schema_id",
        "cls",
        "by_map",
        class_to_table(F.col("cls")).alias("naive"),
        F.coalesce("by_map", "by_name", "by_module", class_to_table(F.col("cls"))).alias("own"),
    )
    sti = inheritance_roots(bases, concrete.select("schema_id", "cls")).select("schema_id", F.col("src").alias("cls"), "root")
    of_root = resolved.select("schema_id", F.col("cls").alias("root"), F.col("own").alias("of_root"))
    tables = resolved.join(sti, ["schema_id", "cls"], "left").join(of_root, ["schema_id", "root"], "left").select(
        "schema_id",
        "cls",
        "naive",
        F.coalesce("by_map", "of_root", "own").alias("real"),
    )
    macro = r"^\s*(has_many|has_one|belongs_to|has_and_belongs_to_many)\s+:(\w+)(.*)$"
    rows = cls.where(F.col("text").rlike(macro)).select(
        "schema_id",
        "cls",
        group(macro, 1).alias("type"),
        group(macro, 2).alias("name"),
        F.regexp_extract("text", macro, 3).alias("text"),
    )
    option = lambda n: group(rf"""\b{n}:\s*["':]([\w:]+)""")
    poly = F.col("text").contains("polymorphic: true")
    target = F.when(poly, F.col("name")).when(option("class_name").isNotNull(), class_to_table(option("class_name"))).when(
        F.col("type").isin("has_many", "has_and_belongs_to_many"),
        F.col("name"),
    ).otherwise(pluralize(F.col("name")))
    fk = F.coalesce(option("foreign_key"), F.when(F.col("type") == "belongs_to", F.concat("name", F.lit("_id"))))
    edges = rows.join(tables, ["schema_id", "cls"]).select(
        "schema_id",
        F.col("real").alias("table_name"),
        "type",
        "name",
        target.alias("target"),
        fk.alias("foreign_key"),
        option("through").alias("through"),
        poly.alias("polymorphic"),
    )
    moved = tables.where("naive <> real").groupBy("schema_id", "naive").agg(F.min("real").alias("real"))
    return {"bases": bases, "tables": tables, "edges": redirect_targets(edges, moved)}


#: Base classes of Eloquent models, and types of their relation methods.
_ELOQUENT = r"^(\w*Model|Authenticatable|Pivot)$"
_RELATIONS = {
    "hasMany": "has_many",
    "hasOne": "has_one",
    "belongsTo": "belongs_to",
    "belongsToMany": "has_and_belongs_to_many",
    "morphTo": "belongs_to",
    "morphMany": "has_many",
    "morphOne": "has_one",
    "morphToMany": "has_and_belongs_to_many",
}


def _without_php_comments(content: Column) -> Column:
    """Comments taken out, their line ends kept."""
    parts = F.split(F.regexp_replace(content, r"//[^\n]*", ""), r"/\*")
    rest = F.transform(
        F.slice(parts, F.lit(2), F.size(parts)),
        lambda x: F.concat(F.regexp_replace(F.substring_index(x, "*/", 1), r"[^\n]", ""), F.regexp_replace(x, r"(?s)^.*?(\*/|$)", "")),
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def laravel_models(corpus: DataFrame, table_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """tables and edges of Eloquent models, and warnings for relations whose class is not told.

    A class is a model where its base, without its namespace, is one of Eloquent's or ends in Model. Sources are cut at classes
    and methods after comments are taken out, so that a call may run over several lines. A table's name is that of
    ``table_map(schema_id, model, table_name)``, else the class's ``$table``, else made of the class's name; edges follow it.
    morphTo has a made-up target. Files in ``vendor`` are left out.
    """
    from lakeatlas.operators.edges import redirect_targets

    header, method = r"\bclass\s+(\w+)\s+extends\s+([\w\\]+)", r"\bfunction\s+(\w+)\s*\("
    own = corpus.where(~F.col("path").rlike(r"(^|/)vendor/"))
    pieces = own.select(*FILE, F.posexplode(F.split(_without_php_comments(F.col("content")), r"(?=\bclass\s+\w+\s+extends\b)|(?=\bfunction\s+\w+\s*\()")).alias("pos", "text"))
    w = Window.partitionBy(*FILE).orderBy("pos")
    ends = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    so_far = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = pieces.select("*", F.last(F.when(F.col("text").rlike(header), F.struct(group(header, 1).alias("cls"), group(header, 2).alias("base"))), ignorenulls=True).over(w).alias("c"), so_far.alias("above"))
    base = F.element_at(F.split(F.col("c.base"), r"\\"), -1)
    models = cut.where(F.col("c").isNotNull() & base.rlike(_ELOQUENT)).select(F.col("project").alias("schema_id"), "path", "text", "above", F.col("c.cls").alias("cls"))
    override = group(r"""\$table\s*=\s*["']([^"']+)""")
    tables = models.select("schema_id", "cls", override.alias("own")).groupBy("schema_id", "cls").agg(F.min("own").alias("own"))
    naive = class_to_table(F.col("cls"))
    if table_map is None:
        tables = tables.withColumn("_mapped", F.lit(None).cast("string"))
    else:
        tables = tables.join(table_map.select("schema_id", F.col("model").alias("cls"), F.col("table_name").alias("_mapped")), ["schema_id", "cls"], "left")
    tables = tables.select("schema_id", "cls", naive.alias("naive"), F.coalesce("_mapped", "own", naive).alias("real"))
    call = rf"\$this->({'|'.join(_RELATIONS)})\s*\(([^)]*)\)"
    calls = models.where(F.col("text").rlike(rf"^{method}")).select(
        "schema_id",
        "path",
        (F.col("above") + 1).cast("int").alias("line"),
        "cls",
        group(method).alias("fn"),
        F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(call), F.lit(1)).alias("call"), F.regexp_extract_all("text", F.lit(call), F.lit(2)).alias("args"))).alias("x"),
    ).select("*", "x.call", "x.args").drop("x")
    args = F.transform(F.split("args", ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    quoted = r"""^["']([^"']*)["']$"""
    target = F.coalesce(F.nullif(F.regexp_extract(args[0], r"^\\?([\w\\]+)::class$", 1), F.lit("")), F.nullif(F.regexp_extract(args[0], quoted, 1), F.lit("")))
    second = F.nullif(F.regexp_extract(F.get(args, F.lit(1)), quoted, 1), F.lit(""))
    rows = calls.select("*", F.element_at(F.split(target, r"\\"), -1).alias("ref"), second.alias("arg"))
    morph_to = F.col("call") == "morphTo"
    good = rows.where(morph_to | F.col("ref").isNotNull()).join(tables.select("schema_id", "cls", F.col("real").alias("table_name")), ["schema_id", "cls"])
    moved = tables.where("naive <> real").groupBy("schema_id", "naive").agg(F.min("real").alias("real"))
    snake = F.concat(to_snake(F.col("fn")), F.lit("_id"))
    guessed = class_to_table(F.col("ref"))
    edges = good.select(
        "schema_id",
        "table_name",
        lookup(F.col("call"), _RELATIONS).alias("type"),
        F.col("fn").alias("name"),
        F.when(morph_to, pluralize(to_snake(F.col("fn")))).otherwise(guessed).alias("target"),
        F.when(morph_to, snake).when(F.col("call") == "belongsTo", F.coalesce("arg", snake)).alias("foreign_key"),
        F.when(F.col("call") == "belongsToMany", F.col("arg")).alias("through"),
        F.col("call").startswith("morph").alias("polymorphic"),
        morph_to.alias("_free"),
    )
    edges = edges.where("_free").unionByName(redirect_targets(edges.where("NOT _free"), moved)).drop("_free")
    lost = F.concat(F.lit("relation without a class: "), "fn", F.lit(" "), "call", F.lit("("), F.trim("args"), F.lit(")"))
    return {"tables": tables.drop("naive"), "edges": edges, "warnings": rows.where(~morph_to & F.col("ref").isNull()).select("schema_id", "path", "line", lost.alias("message"))}


# -- Python models

_FACTS = "schema_id string, path string, cls string, bases array<string>, table_name string, pos int, field string, call string, target string, options map<string,string>"


def _name(node) -> str:
    while isinstance(node, ast.Attribute | ast.Subscript | ast.Call):
        if isinstance(node, ast.Attribute):
            return node.attr
        node = node.value if isinstance(node, ast.Subscript) else node.func
    return node.id if isinstance(node, ast.Name) else str(node.value) if isinstance(node, ast.Constant) else ""


def _assigned(node) -> tuple[str | None, ast.expr | None]:
    """Name and value of an assignment to one name."""
    target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) else None
    return (target.id, node.value) if isinstance(target, ast.Name) and node.value is not None else (None, None)


def _call_facts(value: ast.Call, annotation: ast.expr | None) -> tuple[str, str, dict[str, str]]:
    """Name of the call, of its first argument, and its options: keywords, the calls inside it with their first argument,
    second (name of the second argument), literal (the first one is a string) and annotation."""
    options = {k.arg: ast.unparse(k.value).strip("'\"") for k in value.keywords if k.arg}
    first = next(iter(value.args), None)
    if first is None and "to" in options:
        first = next(k.value for k in value.keywords if k.arg == "to")
    for inner in value.args:
        if isinstance(inner, ast.Call) and inner.args:
            options.setdefault(_name(inner), _name(inner.args[0]))
    if isinstance(first, ast.Constant) and isinstance(first.value, str):
        options["literal"] = "True"
    if len(value.args) > 1:
        options["second"] = _name(value.args[1])
    if annotation is not None:
        options["annotation"] = ast.unparse(annotation)
    return _name(value), _name(first) if first is not None else "", options


def class_facts(source: str) -> list[tuple]:
    """(class, bases, table name, place, field, call, first argument, options) of each class of a module (place 0, options
    abstract, proxy and line) and each field made by a call; without a class, those of the module's own variables.

    A source that does not parse gives one row of place -1, with the reason as its call.
    """
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(None, [], None, -1, None, type(e).__name__, None, {})]
    out = []
    for node in tree.body:
        name, value = _assigned(node)
        if name and isinstance(value, ast.Call):
            out.append((None, [], None, -2, name, *_call_facts(value, None)))
        if not isinstance(node, ast.ClassDef):
            continue
        said = {}
        for item in node.body:
            for x in item.body if isinstance(item, ast.ClassDef) and item.name == "Meta" else [item]:
                name, value = _assigned(x)
                if name and isinstance(value, ast.Constant):
                    said[name] = str(value.value)
        table = said.get("db_table") or said.get("__tablename__")
        bases = [_name(b) for b in node.bases]
        marks = {"abstract": said.get("abstract") or said.get("__abstract__") or "False", "proxy": said.get("proxy", "False"), "line": str(node.lineno)}
        out.append((node.name, bases, table, 0, None, None, None, marks))
        for i, item in enumerate(node.body, 1):
            name, value = _assigned(item)
            if name and isinstance(value, ast.Call):
                out.append((node.name, bases, table, i, name, *_call_facts(value, getattr(item, "annotation", None))))
    return out


def python_models(corpus: DataFrame) -> DataFrame:
    """Facts of Python classes (see class_facts), a parser run for each file; what follows is joins."""

    def run(batches):
        for b in batches:
            rows = [(p, path, *f) for p, path, c in zip(b["project"], b["path"], b["content"]) for f in class_facts(c or "")]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _FACTS.split(", ")])

    return corpus.select("project", "path", "content").mapInPandas(run, _FACTS)


#: Display types of Django fields, and the association types of its relations.
_DJANGO = {
    "CharField": "string",
    "TextField": "text",
    "SlugField": "string",
    "EmailField": "string",
    "URLField": "string",
    "IntegerField": "integer",
    "PositiveIntegerField": "integer",
    "BigIntegerField": "bigint",
    "BigAutoField": "bigint",
    "AutoField": "integer",
    "FloatField": "float",
    "DecimalField": "decimal",
    "BooleanField": "boolean",
    "DateTimeField": "datetime",
    "DateField": "date",
    "TimeField": "time",
    "DurationField": "interval",
    "JSONField": "json",
    "UUIDField": "uuid",
    "BinaryField": "binary",
}
_LINKS = {"ForeignKey": "belongs_to", "OneToOneField": "has_one", "ManyToManyField": "has_and_belongs_to_many"}


def _class_heads(facts: DataFrame, key: list[str]) -> DataFrame:
    """One row for each class: (schema_id, *key, bases, table_name, abstract, proxy, path, line); the last file's where several define it."""
    own = facts.where("pos = 0").groupBy("schema_id", *key).agg(F.max_by(F.struct("bases", "table_name", "options", "path"), "path").alias("h"))
    flag = lambda n: (F.col("h.options")[n] == "True").alias(n)
    return own.select("schema_id", *key, "h.bases", "h.table_name", flag("abstract"), flag("proxy"), "h.path", F.col("h.options")["line"].alias("line"))


def django(facts: DataFrame) -> dict[str, DataFrame]:
    """tables, columns and edges. Models are classes that reach Model; a class is known by its app and name.

    A base is a class of the same app first, else of the first other app. Models that are neither abstract nor proxies
    have tables, with the fields of all their bases before their own. A target is a class of the same app first, else of
    the only other app that has one; a foreign key keeps its column where its target is not known.
    """
    from lakeatlas.operators.graph import descendants, inheritance_order

    own = facts.withColumn("app", F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit("")))
    key = F.concat_ws(".", "app", "cls")
    heads = _class_heads(own, ["app", "cls"]).withColumn("key", key)
    wanted = heads.select("schema_id", F.col("key").alias("src"), "app", F.posexplode("bases").alias("pos", "base"))
    there = heads.select("schema_id", F.col("cls").alias("base"), F.col("app").alias("base_app"), F.col("key").alias("dst"))
    bases = wanted.join(there, ["schema_id", "base"]).groupBy("schema_id", "src", "pos").agg(
        F.min_by("dst", F.struct(F.col("app") != F.col("base_app"), "base_app")).alias("dst")
    )
    model = descendants(bases, heads.where(F.array_contains("bases", "Model")).select("schema_id", F.col("key").alias("node")))
    bases = bases.join(model.withColumnRenamed("node", "dst"), ["schema_id", "dst"], "left_semi")
    concrete = heads.where("NOT abstract AND NOT proxy").join(model.withColumnRenamed("node", "key"), ["schema_id", "key"], "left_semi")
    tables = concrete.select("schema_id", "app", "cls", "key", F.coalesce("table_name", F.concat_ws("_", "app", F.lower("cls"))).alias("table"))

    mine = own.where("pos > 0").select("schema_id", key.alias("owner"), F.col("pos").alias("own_pos"), "field", "call", "target", "options", "path")
    last = heads.select("schema_id", F.col("key").alias("owner"), "path")  # fields of the definition that counts
    order = inheritance_order(bases, tables.select("schema_id", F.col("key").alias("cls"))).withColumnRenamed("cls", "key")
    fields = order.join(mine.join(last, ["schema_id", "owner", "path"], "left_semi"), ["schema_id", "owner"]).join(tables, ["schema_id", "key"])
    fields = fields.where(F.col("call").isin(*_DJANGO, *_LINKS, "GenericForeignKey") | F.col("call").endswith("Field"))
    fields = fields.withColumn(
        "pos",
        F.row_number().over(Window.partitionBy("schema_id", "key").orderBy("place", "own_pos")),
    ).withColumnRenamed("table", "of_table")
    opt = F.col("options")
    pk = F.coalesce(opt["primary_key"] == "True", F.lit(False))
    null = F.coalesce(opt["null"] == "True", F.lit(False))
    head = ["schema_id", F.col("of_table").alias("table_name"), "pos"]
    is_key = F.col("call").isin("ForeignKey", "OneToOneField")
    column = F.coalesce(opt["db_column"], F.when(is_key, F.concat("field", F.lit("_id"))).otherwise(F.col("field")))
    plain = fields.where(~F.col("call").isin(*_LINKS, "GenericForeignKey")).select(
        *head,
        column.alias("name"),
        F.coalesce(lookup(F.col("call"), _DJANGO), F.col("call")).alias("type"),
        (null & ~pk).alias("nullable"),
        pk.alias("primary"),
    )
    keys = fields.where(is_key).select(*head, column.alias("name"), F.lit("bigint").alias("type"), null.alias("nullable"), F.lit(False).alias("primary"))
    with_pk = plain.where("primary").select("schema_id", "table_name").distinct()
    ids = tables.select("schema_id", F.col("table").alias("table_name")).join(with_pk, ["schema_id", "table_name"], "left_anti").select(
        "*",
        F.lit(0).alias("pos"),
        F.lit("id").alias("name"),
        F.lit("bigint").alias("type"),
        F.lit(False).alias("nullable"),
        F.lit(True).alias("primary"),
    )

    links = fields.where(F.col("call").isin(*_LINKS)).select(
        "schema_id",
        "key",
        "app",
        "of_table",
        "pos",
        "field",
        "call",
        column.alias("column"),
        F.array(
            F.struct(F.col("target").alias("ref"), F.coalesce(opt["literal"] == "True", F.lit(False)).alias("literal")),
            F.struct(opt["through"].alias("ref"), F.lit(True).alias("literal")),
        ).alias("refs"),
    )
    refs = links.select("*", F.posexplode("refs").alias("which", "r")).where("r.ref IS NOT NULL").select(
        "schema_id",
        "key",
        "app",
        "of_table",
        "pos",
        "which",
        "r.ref",
        "r.literal",
    )
    parts = F.split("ref", r"\.")
    refs = refs.withColumn("ref_cls", F.element_at(parts, -1)).withColumn("ref_app", F.when(F.col("literal") & (F.size(parts) > 1), parts[0]))
    targets = tables.select("schema_id", F.col("cls").alias("ref_cls"), F.col("app").alias("to_app"), F.col("table").alias("to_table"))
    found = refs.join(targets, ["schema_id", "ref_cls"], "left").groupBy("schema_id", "key", "app", "of_table", "pos", "which", "ref", "literal", "ref_cls", "ref_app").agg(
        F.max(
            F.when(F.col("to_app") == F.coalesce("ref_app", "app"), F.col("to_table"))
        ).alias("same"), F.when(F.count_distinct("to_app") == 1, F.max("to_table")).alias("only")
    )
    guess = F.when(F.col("literal"), F.concat(F.lower(F.coalesce("ref_app", "app")), F.lit("_"), F.lower("ref_cls")))
    table = F.when(F.col("literal") & (F.col("ref") == "self"), F.col("of_table")).otherwise(
        F.coalesce("same", F.when(F.col("ref_app").isNull(), F.col("only")), guess)
    )
    found = found.groupBy("schema_id", "key", "pos").agg(
        F.max(F.when(F.col("which") == 0, table)).alias("target"),
        F.max(F.when(F.col("which") == 1, table)).alias("through"),
    )
    edges = links.drop("refs").join(found, ["schema_id", "key", "pos"]).where("target IS NOT NULL")
    edges = edges.select(
        "schema_id",
        F.col("of_table").alias("table_name"),
        lookup(F.col("call"), _LINKS).alias("type"),
        F.col("field").alias("name"),
        "target",
        F.when(F.col("call") != "ManyToManyField", F.col("column")).alias("foreign_key"),
        F.when(F.col("call") == "ManyToManyField", F.col("through")).alias("through"),
        F.lit(False).alias("polymorphic"),
    )
    generic = fields.where("call = 'GenericForeignKey'").select(
        "schema_id",
        F.col("of_table").alias("table_name"),
        F.lit("belongs_to").alias("type"),
        F.col("field").alias("name"),
        pluralize(to_snake(F.col("field"))).alias("target"),
        F.lit(None).cast("string").alias("foreign_key"),
        F.lit(None).cast("string").alias("through"),
        F.lit(True).alias("polymorphic"),
    )
    return {
        "tables": tables.select("schema_id", F.col("table").alias("table_name"), "cls"),
        "columns": ids.unionByName(plain).unionByName(keys),
        "edges": edges.unionByName(generic),
        "warnings": python_warnings(facts),
    }


#: Display types of Python annotations in mapped classes.
_ANNOTATED = {
    "int": "integer",
    "str": "string",
    "float": "float",
    "bool": "boolean",
    "datetime": "datetime",
    "date": "date",
    "time": "time",
    "bytes": "binary",
    "Decimal": "decimal",
    "UUID": "uuid",
    "dict": "json",
}


def sqlalchemy(facts: DataFrame) -> dict[str, DataFrame]:
    """tables, columns, edges and warnings of declarative models.

    Bases are DeclarativeBase, what declarative_base() gives, and classes of theirs without table and fields. What reaches
    one is a model; it has the fields of all its bases, mixins too, before its own. A model without ``__tablename__`` goes by
    its name, with a warning; abstract ones have no table. A relationship to a table that a foreign key leads to already
    is no edge of its own.
    """
    from lakeatlas.operators.graph import descendants, inheritance_order

    heads = _class_heads(facts, ["cls"])
    own = facts.where("pos > 0 AND call IN ('Column', 'mapped_column', 'relationship')").select(
        "schema_id",
        "path",
        F.col("cls").alias("owner"),
        F.col("pos").alias("own_pos"),
        "field",
        "call",
        "target",
        "options",
    )
    own = own.join(heads.select("schema_id", F.col("cls").alias("owner"), "path"), ["schema_id", "owner", "path"], "left_semi")
    bases = heads.select("schema_id", F.col("cls").alias("src"), F.posexplode("bases").alias("pos", "dst"))
    roots = facts.where("pos = -2 AND call = 'declarative_base'").select("schema_id", F.col("field").alias("node")).union(
        facts.select("schema_id").distinct().withColumn("node", F.lit("DeclarativeBase"))
    )
    bare = heads.where("table_name IS NULL").select("schema_id", F.col("cls").alias("src")).join(
        own.select("schema_id", F.col("owner").alias("src")).distinct(),
        ["schema_id", "src"],
        "left_anti",
    )
    roots = descendants(bases.join(bare, ["schema_id", "src"], "left_semi"), roots)
    model = descendants(bases, roots).join(roots, ["schema_id", "node"], "left_anti").select(
        "schema_id",
        F.col("node").alias("cls"),
        F.lit(True).alias("model"),
    )
    known = heads.where("NOT abstract").join(model, ["schema_id", "cls"], "left").where("table_name IS NOT NULL OR model")
    tables = known.select(
        "schema_id",
        "cls",
        F.coalesce("table_name", to_snake(F.col("cls"))).alias("table"),
        "path",
        "line",
        F.col("table_name").isNull().alias("guessed"),
    )
    guessed = tables.where("guessed").select(
        "schema_id",
        "path",
        F.concat(F.lit("line "), "line", F.lit(": no __tablename__, taken as "), "table").alias("message"),
    )

    inside = bases.join(heads.select("schema_id", F.col("cls").alias("dst")), ["schema_id", "dst"], "left_semi")
    order = inheritance_order(inside, tables.select("schema_id", "cls"))
    fields = order.join(own, ["schema_id", "owner"]).join(tables.select("schema_id", "cls", "table"), ["schema_id", "cls"])
    fields = fields.withColumn(
        "pos",
        F.row_number().over(Window.partitionBy("schema_id", "cls").orderBy("place", "own_pos")),
    ).withColumnRenamed("table", "table_name")
    opt, note = F.col("options"), F.coalesce(F.col("options")["annotation"], F.lit(""))
    inner = F.nullif(F.regexp_extract(note, r"""(\w+)["']?(?:\s*\|\s*None)?\]*$""", 1), F.lit(""))
    many = note.rlike(r"(?i)\b(list|set|sequence|collection|iterable)\[")
    optional = note.rlike(r"\bOptional\[|\|\s*None")
    cols = fields.where("call <> 'relationship'")
    named = F.coalesce(opt["literal"] == "True", F.lit(False))
    kind = F.when(named, opt["second"]).otherwise(F.nullif(F.col("target"), F.lit("")))
    kind = F.when(kind != "ForeignKey", kind)
    primary, fk = F.coalesce(opt["primary_key"] == "True", F.lit(False)), opt["ForeignKey"]
    type_ = F.when(kind.isNotNull(), F.lower(kind)).when(
        (note != "") & ~many,
        F.coalesce(lookup(inner, _ANNOTATED), F.lower(inner)),
    ).when(fk.isNotNull(), "bigint").otherwise("")
    nullable = F.when(opt["nullable"].isNotNull(), opt["nullable"] == "True").when(note != "", optional).otherwise(~primary)
    cols = cols.select(
        "schema_id",
        "cls",
        "table_name",
        "pos",
        F.when(named, F.col("target")).otherwise(F.col("field")).alias("name"),
        "field",
        type_.alias("type"),
        nullable.alias("nullable"),
        primary.alias("primary"),
        F.split(fk, r"\.").alias("fk"),
        F.coalesce(opt["unique"] == "True", F.lit(False)).alias("unique"),
    )
    with_pk = cols.where("primary").select("schema_id", "table_name").distinct()
    ids = tables.select("schema_id", F.col("table").alias("table_name")).join(with_pk, ["schema_id", "table_name"], "left_anti").select(
        "*",
        F.lit(0).alias("pos"),
        F.lit("id").alias("name"),
        F.lit("bigint").alias("type"),
        F.lit(False).alias("nullable"),
        F.lit(True).alias("primary"),
    )
    columns = ids.unionByName(cols.select(*ids.columns))
    none = F.lit(None).cast("string")
    keys = cols.where("fk IS NOT NULL").select(
        "schema_id",
        "table_name",
        F.when(F.col("unique"), "has_one").otherwise("belongs_to").alias("type"),
        fk_stem(F.col("field")).alias("name"),
        F.when(F.size("fk") > 1, F.element_at("fk", -2)).otherwise(F.col("fk")[0]).alias("target"),
        F.col("name").alias("foreign_key"),
        none.alias("through"),
    )
    rel = fields.where((F.col("call") == "relationship") & opt["remote_side"].isNull())
    rel = rel.withColumn("ref", F.coalesce(F.nullif(F.col("target"), F.lit("")), inner)).join(
        tables.select("schema_id", F.col("cls").alias("ref"), F.col("table").alias("ref_table")),
        ["schema_id", "ref"],
    )
    vars_ = facts.where("pos = -2 AND call = 'Table'").select("schema_id", F.col("field").alias("_var"), F.col("target").alias("_table"))
    rel = rel.withColumn("_var", opt["secondary"]).join(vars_, ["schema_id", "_var"], "left")
    single = F.when(opt["uselist"].isNotNull(), opt["uselist"] == "False").otherwise((note != "") & ~many)
    rel = rel.select(
        "schema_id",
        "table_name",
        F.when(F.col("_var").isNotNull(), "has_and_belongs_to_many").when(single, "has_one").otherwise("has_many").alias("type"),
        F.col("field").alias("name"),
        F.col("ref_table").alias("target"),
        none.alias("foreign_key"),
        F.when(F.col("_var").isNotNull(), F.coalesce("_table", "_var")).alias("through"),
    )
    there = keys.where("table_name <> target").select("schema_id", "table_name", "target").distinct()
    side = rel.where("type <> 'has_and_belongs_to_many'").join(there, ["schema_id", "table_name", "target"], "left_anti")
    edges = keys.unionByName(side).unionByName(rel.where("type = 'has_and_belongs_to_many'"))
    return {
        "tables": tables.select("schema_id", F.col("table").alias("table_name"), "cls"),
        "columns": columns,
        "edges": edges,
        "warnings": python_warnings(facts).unionByName(guessed),
    }


def python_warnings(facts: DataFrame) -> DataFrame:
    return facts.where("pos = -1").select("schema_id", "path", F.concat(F.lit("does not parse: "), "call").alias("message"))


Job = Callable[[DataFrame], dict[str, DataFrame]]
JOBS: dict[str, tuple[int, Job]] = {
    "rails": (10, rails_models),
    "rails_schema": (20, schema_rb),
    "prisma": (30, prisma),
    "laravel": (40, laravel_models),
    "django": (50, lambda c: django(python_models(c))),
    "sqlalchemy": (60, lambda c: sqlalchemy(python_models(c))),
    "dbml": (70, dbml),
    "mermaid_er": (80, mermaid),
}


def register_job(kind: str, priority: int, job: Job) -> None:
    """Add an extraction job; a later registration of a kind wins."""
    JOBS[kind] = (priority, job)
