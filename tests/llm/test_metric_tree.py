import random

import numpy as np
import pytest

from lakeatlas.llm.metric_tree import LEAF, Block, _pack, _unpack, build_pages, search_embeddings, search_pages


def expected(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) and abs(np.floor(64 * c)) < 2**62 for c in v):
            whole.setdefault((i, tuple(int(np.floor(64 * float(c))) for c in v)))
    out = []
    for i, q in whole:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d))
    return [(i, (centres[rng.integers(9)] + rng.normal(size=d) * 0.2).tolist()) for i in range(n)]


def test_pages():
    for arrays in ([np.arange(6, dtype="<i2").reshape(3, 2), np.array([0.5, 1.5])], [np.zeros((0, 4), "<i1"), np.array([1], "<i8")]):
        for a, b in zip(arrays, _unpack(_pack(arrays)), strict=True):
            assert a.dtype == b.dtype and a.shape == b.shape and (a == b).all()


def test_bounds_spare_computations():
    rng = np.random.default_rng(0)
    x = np.floor(64 * np.array([v for _, v in clustered(4000, 6, 1)])).astype(np.int64)
    ids = rng.permutation(len(x)).astype(np.int64)
    longest = float((x**2).sum(1).max())
    pages, radius = build_pages(x, ids, x[0], longest)
    assert len(pages) > len(x) / LEAF
    q = x[::100]
    block = Block(q, np.full(len(q), -(1 << 63)), 5, longest)
    who = np.arange(len(q))
    search_pages(block, who, block.distances(who, q @ x[:1].T)[:, 0], radius, pages)
    for i in range(len(q)):
        want = sorted(zip((-(x @ q[i])).tolist(), ids.tolist(), strict=True))[:5]
        assert list(zip((-block.scores[i]).tolist(), block.ids[i].tolist(), strict=True)) == want
    assert block.computed < 0.7 * x.shape[0] * len(q)


@pytest.mark.parametrize("d, rows", [(3, 70), (24, 150)])
def test_many_subtrees(spark, d, rows):
    data = clustered(900, d, d)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    assert rows_of(search_embeddings(df, k=7, every=10, rows=rows)) == expected(data, 7, 10)


def test_hot_vector_and_ties(spark):
    rng = random.Random(1)
    data = [(i, [0.5, 0.5] if i % 3 else [rng.randrange(3) / 4, rng.randrange(3) / 4]) for i in range(600)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(6)
    assert rows_of(search_embeddings(df, k=4, every=5, pivots=3, rows=20)) == expected(data, 4, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [-1.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [None, 1.0]), (100, [inf, 0.0]), (None, [1.0, 1.0]), (3, [9.0, 9.0]), (-20, [0.0, 0.0]), (5, [1e12, -1e12])]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "vec_id long, embedding array<double>, rank int, key string")
    got = rows_of(search_embeddings(df, k=3))
    assert got == expected(data, 3, 20) and {r[0] for r in got} == {0, 20, -20}
    for empty in (df.limit(0), df.where("vec_id = 40")):
        assert search_embeddings(empty).count() == 0
    one = df.where("vec_id = 20")
    assert search_embeddings(one).count() == 0
    short = [(0, [1.0]), (1, [2.0, 5.0]), (2, []), (20, [])]
    assert rows_of(search_embeddings(spark.createDataFrame(short, "vec_id long, embedding array<double>"))) == expected([(i, (v + [0.0, 0.0])[:2]) for i, v in short], 20, 20)
    huge = [(0, [1e13, 1e13]), (1, [1e13, 1.0]), (2, [-1e13, -1e13])]
    assert [(r[2], r[3]) for r in rows_of(search_embeddings(spark.createDataFrame(huge, "vec_id long, embedding array<double>")))] == [(1, (1 << 63) - 1), (2, -(1 << 63) + 1)]


def test_routed_queries_do_not_pass_the_driver(spark):
    data = clustered(700, 8, 5)
    df = search_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>"), k=3, every=5, rows=40)
    assert rows_of(df) == expected(data, 3, 5)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [subtree" in plan and "BroadcastHashJoin [subtree" not in plan
