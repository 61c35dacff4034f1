import numpy as np
import pytest

from lakeatlas.llm.whitening import fit_whitening, one_sided_jacobi, pivoted_cholesky, principal_components, whiten

SF = "/root/testdata/sf0.01"


def plain(rows, k=16):
    """n, deviations and whitened coordinates (up to the sign) with numpy's own eigenvalues, in extended precision where it can."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - t for c, t in zip(v, s, strict=True)] for v in fit], object)
    cov = np.array([[float(c) for c in r] for r in (y.T @ y)]) / n**3
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, v in x.items():
        off = [n * c - t for c, t in zip(v, s, strict=True)]
        out[i] = (n, sum(o * o for o in off), (np.array([float(o) for o in off]) / n) @ u / np.sqrt(e))
    return out, e / np.trace(cov)


def check(got, rows, tolerance=1e-7):
    want, shares = plain(rows)
    found = {}
    for r in got:
        found.setdefault(r.vec_id, {})[r.component] = r
    assert set(found) == set(want)
    k = len(shares)
    w = np.array([[found[i][c + 1].whitened for c in range(k)] for i in sorted(want)])
    p = np.array([want[i][2] for i in sorted(want)])
    sign = np.sign((w * p).sum(0))
    assert np.abs(w * sign - p).max() < tolerance
    for i, (n, deviation, _) in want.items():
        assert {(r.n, r.deviation) for r in found[i].values()} == {(n, deviation)}
    assert np.allclose([found[min(want)][c + 1].explained for c in range(k)], shares, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whiten(df.repartition(7), fit_whitening(df.repartition(5))).collect()
    assert len(got) == 16 * df.count()
    check(got, [(r.vec_id, r.embedding) for r in df.collect()])


def test_factors():
    rng = np.random.default_rng(1)
    for d, rank in [(1, 1), (5, 5), (8, 3), (31, 31), (12, 0)]:
        x = rng.integers(-99, 100, size=(d, rank)).astype(float)
        v = x @ x.T  # exact, so that its rank is that of x
        low, order = pivoted_cholesky(v)
        assert low.shape == (d, rank) and np.allclose(low @ low.T, v[np.ix_(order, order)], atol=1e-9)
        turned = one_sided_jacobi(low)
        assert np.allclose(turned @ turned.T, low @ low.T, atol=1e-9)
        u, e = principal_components(v)
        assert u.shape == (d, rank) and np.allclose(u.T @ u, np.eye(rank), atol=1e-12) and (np.diff(e) <= 0).all()
        assert np.allclose(u * e @ u.T, v, atol=1e-9)


def test_graded_columns():
    """Eigenvalues keep their relative accuracy far below the largest one's rounding error."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0].astype(np.longdouble)
    scale = np.longdouble(10) ** -np.arange(9)
    v = (scale[:, None] * (q * np.linspace(1, 2, 9).astype(np.longdouble)) @ q.T) * scale
    e = principal_components(v)[1]
    low = np.linalg.cholesky((scale[:, None] ** -1 * v * scale**-1).astype(float)) * scale.astype(float)[:, None]
    assert np.allclose(e, np.linalg.svd(low)[1] ** 2, rtol=1e-6)


def test_small_variance_beside_a_large_mean(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1e9 + float(a), float(b) * 1e-2, -3e12, float(c)]) for i, (a, b, c) in enumerate(rng.normal(size=(90, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df)
    assert len(model.values) == 3 and model.identity_error < 1e-9


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 1.0]), (2, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [0.51, 0.25]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [2.0, 2.0]), (10, [-1.0, 1e30])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, component string, key int")
    got = whiten(df, fit_whitening(df)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 1, 2, 2, 3) for c in (1, 2))
    assert {r.n for r in got} == {3 if int(64 * 0.51) == 32 else 4}
    one = df.where("vec_id = 2")
    assert whiten(one, fit_whitening(one)).count() == 0
    for empty in (df.limit(0), df.where("vec_id = 4"), df.where("vec_id = 8")):
        assert whiten(empty, fit_whitening(empty)).count() == 0
    large = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 5.0]), (3, [7.0, 1e9])], "vec_id long, embedding array<double>")
    got = whiten(large, fit_whitening(large)).collect()
    assert all(r.deviation is None for r in got) and got[0].identity_error < 1e-9


def test_hot_vector(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.5), F.lit(1.0))).otherwise(F.array(F.sin("id"), F.cos(F.col("id") * 3))).alias("embedding"))
    check(whiten(df, fit_whitening(df)).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("d", [17, 40])
def test_fewer_vectors_than_dimensions(spark, d):
    rng = np.random.default_rng(d)
    df = spark.createDataFrame([(i, rng.normal(size=d).tolist()) for i in range(6)], "vec_id long, embedding array<double>")
    model = fit_whitening(df)
    assert len(model.values) == 5 and model.identity_error < 1e-9
