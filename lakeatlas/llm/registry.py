"""The queries of this subpackage, by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontamination, interpolated_lm, license_scan, metric_tree, ngram_join, periodic_runs, pii, piecewise_hash, quality, secret_scan, temperature_mixing, warc, whitening
from ._common import table
from .oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op6_ngram_jaccard_join")
def op6(spark, sf_dir):
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), width=3, percent=90).drop("node", "component")


@query("op5_interpolated_lm")
def op5(spark, sf_dir):
    return interpolated_lm.score(table(spark, sf_dir, "documents"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["no"] < len(secret_scan.BASE))
    counts = {f"n_{r.kind}": secret_scan.of_kind(r.kind) for r in secret_scan.BASE}
    return found.select(
        "doc_id",
        *(c.alias(n) for n, c in counts.items()),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row")


@query("op3_temperature_mixing")
def op3(spark, sf_dir):
    """Two epochs, in which no source comes more than two and a half times."""
    mixed = temperature_mixing.mix_sources(table(spark, sf_dir, "documents"), entropy=None, max_repeats=2.5, epochs=2)
    return mixed.withColumn("weight", F.round("weight", 6))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    """The documents that it keeps; the others are those it rejects."""
    return quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).where("keep")


@query("op1_warc_zstd")
def op1(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op7_piecewise_hash")
def op7(spark, sf_dir):
    return piecewise_hash.fingerprint_with_edits(table(spark, sf_dir, "documents"))


@query("op8_pii_surrogates")
def op8(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_license_scan")
def op9(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    docs = periodic_runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.find_runs(docs))


@query("op12_embedding_whitening")
def op12(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit_whitening(vectors))


@query("op13_metric_tree_top_k")
def op13(spark, sf_dir):
    return metric_tree.search_embeddings(table(spark, sf_dir, "embeddings"))
