import math
from collections import Counter, defaultdict

import pytest

from lakeatlas.llm._common import table
from lakeatlas.llm.registry import QUERIES
from lakeatlas.llm.temperature_mixing import mix_sources, source_weights, token_count
from pyspark.sql import functions as F


def spread(weights):
    live = [w for w in weights if w > 0]
    return -sum(w * math.log(w) for w in live) / math.log(len(live))


def test_weights_meet_the_targets(spark):
    sizes = {"a": 100_000, "b": 10_000, "c": 1_000, "d": 100, None: 50, "none": 0}
    tokens = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, tokens long")
    w = {r.source: r.weight for r in source_weights(tokens, entropy=0.7, max_repeats=None).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["none"] == 0
    assert spread(w.values()) == pytest.approx(0.7, abs=1e-9)
    w = {r.source: r for r in source_weights(tokens, entropy=None, max_repeats=3).collect()}
    assert max(r.quota / r.n_tokens for r in w.values() if r.n_tokens) == pytest.approx(3, rel=0.01)
    logs = {s: math.log(w[s].weight / w["a"].weight) / math.log(sizes[s] / sizes["a"]) for s in ("b", "c", "d")}
    assert logs["b"] == pytest.approx(logs["c"]) == pytest.approx(logs["d"])


def test_targets_that_cannot_be_met_are_told(spark):
    even = spark.createDataFrame([(s, 100) for s in "abcd"], "source string, tokens long")
    assert {r.met for r in source_weights(even, entropy=0.5, max_repeats=None).collect()} == {False}
    assert {(r.met, r.weight) for r in source_weights(even, entropy=1.0, max_repeats=None).collect()} == {(True, 0.25)}


def test_blocks_are_permutations_within_quota(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    tokens = docs.select("source", token_count(F.col("text")).alias("tokens"))
    quota = {r.source: r for r in source_weights(tokens, entropy=0.999, max_repeats=None).collect()}
    rows = mix_sources(docs, entropy=0.999, max_repeats=None, head_docs=10).collect()
    again = mix_sources(docs.repartition(5), entropy=0.999, max_repeats=None, head_docs=1000).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(tuple(r)[:5] for r in again)
    n_docs = Counter(r.source for r in docs.select("source").collect())
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source, r.block].append(r)
    for s, q in quota.items():
        whole = q.quota // q.n_tokens
        for b in range(whole):
            assert len({r.doc_id for r in blocks[s, b]}) == len(blocks[s, b]) == n_docs[s]
        last = blocks.get((s, whole), [])
        used = sum(r.tokens for r in last)
        assert used <= q.quota % q.n_tokens and len({r.doc_id for r in last}) == len(last)
        assert q.quota % q.n_tokens - used <= 6000
    total = sum(r.n_tokens for r in quota.values())
    assert abs(sum(q.quota for q in quota.values()) - total) <= len(quota)


def test_query_mixes(spark):
    """Two epochs of uneven sources: the limit of two and a half repeats decides the exponent, and small sources come oftener."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = QUERIES["op3_temperature_mixing"](spark, "/root/testdata/sf0.01").collect()
    own = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(token_count(F.coalesce("text", F.lit("")))).alias("n")).collect()}
    used = Counter()
    for r in rows:
        used[r.source] += r.tokens
    repeats = {s: used[s] / own[s] for s in own}
    small, large = min(own, key=own.get), max(own, key=own.get)
    assert {r.met for r in rows} == {True}
    assert max(repeats.values()) <= 2.5 and repeats[small] > 2.3 and repeats[large] < 1.9


def test_edges(spark):
    schema = "doc_id long, text string, source string, tokens string, weight int, block int"
    rows = [(1, None, "e"), (2, "", "e"), (3, "a b c", None), (3, "a b c", None), (None, "x", "s"), (5, "w " * 100_000, "s"), (6, " ", "s")]
    got = mix_sources(spark.createDataFrame([(*r, "t", 1, 1) for r in rows], schema), entropy=None, max_repeats=None).collect()
    assert Counter(r.source for r in got) == {None: 2, "s": 3}
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, "", "e", "t", 1, 1)], schema)).count() == 0
