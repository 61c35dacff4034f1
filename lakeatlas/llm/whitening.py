"""Whitening of embeddings by the principal components of their whole-number form.

The scatter of the distinct vectors is summed in exact integers, a partial sum for each task, around integer centres. Its
Cholesky factor with pivoting is made orthogonal by one-sided Jacobi rotations of its columns: the norms of the rotated
columns are the square roots of the eigenvalues, the columns over their norms are the components.
"""

from __future__ import annotations

import dataclasses
import decimal
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept
from ._vectors import packed_vectors, unpacked, whole_vectors

_LIMB = 60
_REAL = np.longdouble


@dataclasses.dataclass
class Whitening:
    """Of ``n`` distinct vectors of ``dims`` entries with sums ``sums``: components as columns by falling eigenvalue, the
    eigenvalues, the trace of the covariance, and the largest departure from the identity of the whitened covariance."""

    scale: int
    offset: int
    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def centre(self) -> np.ndarray:
        """The whole numbers nearest the means, without the offset."""
        return np.array([(2 * s + self.n) // (2 * self.n) - self.offset for s in self.sums], np.int64)

    @property
    def beside(self) -> list[int]:
        """``n`` times what the means have over the centres."""
        return [s - self.n * (int(c) + self.offset) for s, c in zip(self.sums, self.centre, strict=True)]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of vectors without their offset."""
        rest = np.array([b / self.n for b in self.beside])
        return ((x - self.centre).astype(np.float64) - rest) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) ** 2 over the dimensions, exact; None where it is no 64-bit number."""
        beside = np.array(self.beside, object)
        off = x - self.centre
        most = self.n * int(np.abs(off).max(initial=0)) + max(map(abs, self.beside), default=0)
        if most * most * max(1, self.dims) < 1 << 63:
            y = off * self.n - beside.astype(np.int64)
            return (y * y).sum(1).tolist()
        y = off.astype(object) * self.n - beside
        return [v if v < 1 << 63 else None for v in (y * y).sum(1)]


def _gram(x: np.ndarray) -> np.ndarray:
    """x.T @ x in exact Python integers."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    most = int(np.abs(x).max(initial=0))
    if most and most * most >= 1 << 52:
        return x.T.astype(object) @ x.astype(object)
    step = max(1, (1 << 53) // max(1, most * most))
    for i in range(0, len(x), step):
        f = x[i : i + step].astype(np.float64)
        out += (f.T @ f).astype(np.int64)
    return out


def _summed(df: DataFrame, dims: int, each: Callable[[np.ndarray], list[int]]) -> list[int]:
    """The sums over all vectors of what ``each`` gives for a block of them: one partial sum a task, then by place.

    Numbers go as two decimals, of which the lower has 60 bits, so that sums of any tables keep all their digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for b in batches:
            keys = b.column("key").to_pylist()
            for i in range(0, len(keys), 4096):
                part = each(unpacked(keys[i : i + 4096], dims))
                total = part if total is None else [a + c for a, c in zip(total, part, strict=True)]
        if total is not None:
            halves = [[decimal.Decimal(v >> _LIMB) for v in total], [decimal.Decimal(v & (1 << _LIMB) - 1) for v in total]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), *(pa.array(h, pa.decimal128(38, 0)) for h in halves)], names=["at", "high", "low"])

    parts = df.select("key").mapInArrow(run, "at bigint, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return [(int(r.high) << _LIMB) + int(r.low) for r in sorted(rows, key=lambda r: r["at"])]


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(l, order) with ``v[order][:, order] = l @ l.T``, l lower triangular with as many columns as v has rank."""
    a, d = v.copy(), len(v)
    order, low = np.arange(d), np.zeros((d, d), a.dtype)
    least = 8 * d * np.finfo(a.dtype).eps * a.diagonal().max(initial=0)
    for k in range(d):
        j = k + int(np.argmax(a.diagonal()[k:]))
        if a[j, j] <= least:
            return low[:, :k], order
        for m in (a, low):
            m[[k, j]] = m[[j, k]]
        a[:, [k, j]] = a[:, [j, k]]
        order[[k, j]] = order[[j, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1 :, k] = a[k + 1 :, k] / low[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(low[k + 1 :, k], low[k + 1 :, k])
    return low, order


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated among one another until all are orthogonal. Pairs that share no column are rotated together, as in a
    round-robin tournament, so that a sweep takes as many steps as there are columns."""
    x = columns.copy()
    k = x.shape[1]
    if k < 2:
        return x
    eps = np.finfo(x.dtype).eps
    seats = np.arange(k + k % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[half:][::-1]
            real = (p < k) & (q < k)
            p, q = p[real], q[real]
            a, b = x[:, p], x[:, q]
            na, nb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > eps * len(x) * np.sqrt(na * nb)
            if turn.any():
                turned = True
                p, q, a, b, na, nb, ab = p[turn], q[turn], a[:, turn], b[:, turn], na[turn], nb[turn], ab[turn]
                zeta = (nb - na) / (2 * ab)
                t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                x[:, p], x[:, q] = c * a - s * b, s * a + c * b
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return x


def principal_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, eigenvalues) of a covariance, by falling eigenvalue; those of eigenvalue zero are left out. The
    entry of a component that is largest in magnitude is positive."""
    low, order = pivoted_cholesky(v.astype(_REAL))
    x = one_sided_jacobi(low)
    norms = np.sqrt((x * x).sum(0))
    by = np.argsort(-norms, kind="stable")
    out = np.empty_like(x)
    out[order] = x[:, by] / norms[by]
    top = out[np.abs(out).argmax(0), np.arange(out.shape[1])] if out.size else out[:1].reshape(-1)
    return (out * np.sign(top)).astype(np.float64), (norms[by] ** 2).astype(np.float64)


def fit_whitening(df: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000, vector: str = "embedding") -> Whitening | None:
    """Fit on each distinct vector once; None without vectors.

    Vectors count where they are as long as most distinct ones are (in a tie, the longer). What reaches the driver are the
    sums, one for each pair of dimensions, and never a vector. Entries of 2 ** 62 / ``scale`` and more count as infinite.
    """
    fit = kept(packed_vectors(df, None, vector, scale).select("key", "dims").distinct(), "whitening_fit")
    sizes = [(r["count"], r["dims"]) for r in fit.where("dims > 0").groupBy("dims").count().collect()]
    if not sizes:
        return None
    n, d = max(sizes)
    fit = fit.where(F.col("dims") == d)
    sums = [s + n * offset for s in _summed(fit, d, lambda x: x.astype(object).sum(0).tolist())]
    model = Whitening(scale, offset, d, n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    centre, beside = model.centre, model.beside
    upper = np.triu_indices(d)
    gram = _summed(fit, d, lambda x: _gram(x - centre)[upper].tolist())
    pairs = zip(*(i.tolist() for i in upper), strict=True)
    scatter = [n * g - beside[i] * beside[j] for g, (i, j) in zip(gram, pairs, strict=True)]  # n * n times the covariance, exact
    v = np.zeros((d, d), _REAL)
    v[upper] = v.T[upper] = np.array([_REAL(x) for x in scatter]) / _REAL(n) / _REAL(n)
    vectors, values = principal_components(v)
    trace = float(v.trace())
    model = dataclasses.replace(model, components=vectors[:, :components], values=values[:components], trace=trace)
    return dataclasses.replace(model, identity_error=_identity_error(fit, model))


def _identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """Measured over the fit list: the whitened vectors' sums and products, a partial sum for each task."""
    k = len(model.values)
    if not k:
        return None

    def run(batches):
        total = np.zeros((k + 1, k))
        for b in batches:
            keys = b.column("key").to_pylist()
            for i in range(0, len(keys), 4096):
                w = model.project(unpacked(keys[i : i + 4096], model.dims))
                total += np.concatenate([w.sum(0)[None], w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int64()), pa.array(total.ravel())], names=["at", "part"])

    rows = fit.select("key").mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()
    found = np.array([r.part for r in sorted(rows, key=lambda r: r["at"])]).reshape(k + 1, k) / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening | None, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that counts and each component: id, component (from 1), n, deviation, whitened, explained and
    identity_error. Rows stay as often as they come, those with a null id too. Vectors that are null, hold a null or an entry
    that is not finite, or are of another length than the model's are left out; other columns of ``df`` play no part. Without
    vectors, and where all distinct ones are one, there are no components and no rows. A deviation beyond 64 bits is null."""
    schema = f"`{id_column}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    kept_columns = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        k = len(model.values) if model else 0
        for b in batches:
            for at in range(0, b.num_rows if k else 0, 1024):
                part = b.slice(at, 1024)
                for rows, x in whole_vectors(part.column("v"), model.scale):
                    if x.shape[1] != model.dims:
                        continue
                    m = len(rows)
                    columns = [
                        part.column("id").take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array([d for d in model.deviation(x) for _ in range(k)], pa.int64()),
                        pa.array(model.project(x).ravel()),
                        pa.array(np.tile(model.values / model.trace, m)),
                        pa.array(np.full(m * k, model.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept_columns.mapInArrow(run, schema)
