"""Names and types of the catalogue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Irregular plurals.
IRREGULAR = {
    "person": "people", "child": "children", "mouse": "mice", "datum": "data", "medium": "media", "analysis": "analyses", "criterion": "criteria",
    "tooth": "teeth", "foot": "feet", "goose": "geese", "ox": "oxen", "leaf": "leaves", "life": "lives", "knife": "knives", "wife": "wives",
}
#: Display types of SQL types; other names stand for themselves in lower case.
SQL_TYPES = {
    "varchar": "string", "char": "string", "character varying": "string", "text": "text", "longtext": "text", "mediumtext": "text",
    "int": "integer", "integer": "integer", "serial": "integer", "smallint": "integer", "tinyint": "integer", "mediumint": "integer",
    "bigint": "bigint", "bigserial": "bigint", "float": "float", "real": "float", "double precision": "float", "numeric": "decimal", "decimal": "decimal",
    "boolean": "boolean", "timestamp": "datetime", "timestamp without time zone": "datetime", "timestamp with time zone": "datetime", "datetime": "datetime",
    "date": "date", "time": "time", "time without time zone": "time", "json": "json", "jsonb": "jsonb", "uuid": "uuid", "inet": "inet", "bytea": "binary", "blob": "binary", "longblob": "binary",
}
#: Display types of Spark types.
SPARK_TYPES = {
    "string": "string", "int": "integer", "smallint": "integer", "tinyint": "integer", "bigint": "bigint", "float": "float", "double": "float",
    "boolean": "boolean", "timestamp": "datetime", "timestamp_ntz": "datetime", "date": "date", "binary": "binary",
}


def lookup(key: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def coarse_type(dtype: Column) -> Column:
    """Display type of a declared type: by table, else its lower-case name."""
    low = F.lower(dtype)
    return F.coalesce(lookup(low, SQL_TYPES), low)


def token_type(token: Column, values: dict[str, str]) -> Column:
    """Type of a source token by its base before the parenthesis; unknown tokens stay as written."""
    base = F.lower(F.trim(F.regexp_replace(token, r"\(.*\)\s*$", "")))
    return F.coalesce(lookup(base, values), token)


def pluralize(word: Column) -> Column:
    return (
        F.when(word.isin(*IRREGULAR), lookup(word, IRREGULAR))
        .when(word.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies")))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def singularize(word: Column) -> Column:
    back = {v: k for k, v in IRREGULAR.items()}
    return (
        F.when(word.isin(*back), lookup(word, back))
        .when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", ""))
        .otherwise(F.regexp_replace(word, "s$", ""))
    )


def to_snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2"))


def class_to_table(name: Column) -> Column:
    return pluralize(to_snake(F.element_at(F.split(name, "::"), -1)))


def fk_stem(column: Column) -> Column:
    return F.regexp_replace(column, "_id$", "")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def index_name(table: Column, columns: Column) -> Column:
    return F.concat(F.lit("index_"), table, F.lit("_on_"), F.array_join(columns, "_"))


def join_table(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def dbml_name(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('\\"')), F.lit('"')))


def dbml_string(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(text.contains("\n"), F.concat(F.lit("'''"), escaped, F.lit("'''"))).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def dbml_default(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value).otherwise(dbml_string(value))


def sized_type(name: Column, limit: Column, precision: Column, scale: Column) -> Column:
    """Declared type with its limit, or precision and scale."""
    return (
        F.when(limit.isNotNull(), F.format_string("%s(%s)", name, limit))
        .when(precision.isNotNull() & scale.isNotNull(), F.format_string("%s(%s,%s)", name, precision, scale))
        .when(precision.isNotNull(), F.format_string("%s(%s)", name, precision))
        .otherwise(name)
    )


def password_free(url: Column) -> Column:
    """A location without its password."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/@:]*):[^@/]*@", "$1@")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def glob_to_regex(glob: str) -> str:
    """A case-sensitive file-name pattern as a regular expression for whole names."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&&", "&\\&")
            out.append(f"[{'^' + inner[1:] if inner.startswith('!') else inner}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c == "_" else "\\" + c))
        i += 1
    return "(?s)^" + "".join(out) + "$"
