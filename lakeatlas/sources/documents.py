"""JSON documents as sources: config files (see ``configs``), snapshots, the order of layers, and project detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeatlas.functions.names import password_free
from lakeatlas.operators.canonical import SNAPSHOT

from .configs import config_fragments  # noqa: F401


def whole_files(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("content"),
    )


def read_snapshots(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sound snapshot documents (schema_id, doc, ...) with d in place of doc, and the others as they are with a message."""
    parsed = docs.withColumn("d", F.from_json("doc", SNAPSHOT))
    ok = is_snapshot(F.col("d"))
    return parsed.where(ok).drop("doc"), parsed.where(~ok).drop("d").withColumn("message", F.lit("not a snapshot of format 1"))


def is_snapshot(d):
    return F.coalesce((d["format"] == 1) & d["schema"]["tables"].isNotNull(), F.lit(False))


#: The order of the classes of layers.
LAYER_CLASSES = ["db", "sources", "models", "config tables", "relations"]


def order_layers(specs: DataFrame) -> DataFrame:
    """Number input specs (schema_id, class, declared INT, provider, location, halves ARRAY<STRING>) as layers.

    A spec with halves (schema and models of one project) stands for a layer each, in this order. Locations lose passwords.
    """
    rank = F.array_position(F.array(*(F.lit(c) for c in LAYER_CLASSES)), F.col("class"))
    each = specs.select(
        "schema_id",
        rank.alias("_rank"),
        "declared",
        "provider",
        "location",
        F.posexplode_outer(F.when(F.size("halves") > 0, F.col("halves"))).alias("_half", "half"),
    )
    seq = F.row_number().over(Window.partitionBy("schema_id").orderBy("_rank", "declared", F.coalesce("_half", F.lit(0)))) - 1
    return each.select("schema_id", seq.alias("layer_seq"), "provider", F.concat_ws("/", password_free(F.col("location")), "half").alias("location"))


#: What marks a project's kind, by priority.
MARKERS = [
    ("rails", r"(^|/)app/models/.*\.rb$|\.rb$"),
    ("prisma", r"(^|/)schema\.prisma$"),
    ("django", r"(^|/)manage\.py$"),
    ("laravel", r"(^|/)artisan$|(^|/)app/Models/.*\.php$"),
    ("sqlalchemy", r"(^|/)models?(\.py|/.*\.py)$"),
]
SKIPPED = ["vendor", "node_modules", "venv", ".venv", "env", "site-packages", "migrations", "tests", "test", "__pycache__", ".git", "build", "dist"]


def source_files(files: DataFrame, suffix: str, skip: list[str] | None = None) -> DataFrame:
    """Of (project, path, ...), the files with a suffix, outside skipped directories."""
    skipped = F.array(*(F.lit(s) for s in (skip or SKIPPED)))
    return files.where(F.col("path").endswith(suffix) & ~F.arrays_overlap(F.split("path", "/"), skipped))


def read_corpus(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, content) of a corpus's files, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


#: What in a source file marks its project's kind, by the suffix of its path.
CONTENT = {
    "laravel": (".php", r"extends\s+\\?(\w+\\)*(Model|Pivot|Authenticatable)\b|Illuminate\\Database\\Eloquent"),
    "sqlalchemy": (
        ".py",
        r"(?s)\bdeclarative_base\(|\(\s*(\w+\.)?DeclarativeBase\b|__tablename__\s*(:[^=]*)?=.*\b(Column|mapped_column)\(|\b(Column|mapped_column)\(.*__tablename__",
    ),
}


def detect_projects(files: DataFrame) -> DataFrame:
    """(project, kind, others): the winner by priority, and what else matches, of a path inventory (project, path[, content]).

    With contents, base classes and declarative bases mark a project too, wherever the file lies.
    """

    def mark(kind: str, pattern: str):
        found = F.col("path").rlike(pattern)
        if kind in CONTENT and "content" in files.columns:
            suffix, text = CONTENT[kind]
            found = found | (F.col("path").endswith(suffix) & F.coalesce(F.col("content").rlike(text), F.lit(False)))
        return F.bool_or(found).alias(kind)

    found = F.array_compact(F.array(*(F.when(F.col(k), k) for k, _ in MARKERS)))
    by = files.groupBy("project").agg(*(mark(k, p) for k, p in MARKERS)).select("project", found.alias("kinds")).where("size(kinds) > 0")
    return by.select("project", F.col("kinds")[0].alias("kind"), F.slice("kinds", 2, len(MARKERS)).alias("others"))


def ambiguous(projects: DataFrame) -> DataFrame:
    return projects.where("size(others) > 0")
