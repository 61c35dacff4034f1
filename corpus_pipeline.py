"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

quality classifier, n-gram Jaccard join (near duplicates: five words, 0.8), benchmark decontamination, secret scan with
redaction, temperature mixing. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeatlas.llm import decontamination, ngram_join, quality, secret_scan, temperature_mixing
from lakeatlas.llm._common import new_folder, stage, table

#: Intermediate tables of the stage that ran last in this process; the next one of its chain deletes them.
_WRITTEN: list[str] = []


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents which the classifier, fitted on ``labels``, does not reject. Null and empty texts go; null ids, repeated
    rows and nulls in other columns stay as they are, whatever their names. An empty table gives no rows; without labels
    of both classes only texts without words go."""
    with stage(spark, _WRITTEN, first=True):
        return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least doc_id, and of the least hash of text in a tie.
    Texts without words stay, each once for a doc_id; of equal rows one stays. Very long texts are compared whole."""
    with stage(spark, _WRITTEN):
        return ngram_join.keep_one(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ``benchmark`` item is found. Null and empty texts and null ids stay; without items all stay."""
    with stage(spark, _WRITTEN):
        return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; null and empty texts, repeated rows and other columns stay as they are."""
    with stage(spark, _WRITTEN):
        return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them: doc_id, source, tokens, block, place, weight. A null source is a
    source of its own; an empty table gives no rows."""
    with stage(spark, _WRITTEN):
        return temperature_mixing.mix_sources(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("temperature_mixing", mix_sources),
]

#: The classifier and the near-duplicate groups can't be expressed in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The result is lazy and reads tables in the shared folder, which stay there; results of
    several runs can be held at once. Empty tables give no rows."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(path := new_folder(spark, name))
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
