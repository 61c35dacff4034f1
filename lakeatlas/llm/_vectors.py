"""Vectors of whole numbers: floor(scale * entry) + offset, packed into bytes that are equal where the vectors are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import slices

LIMIT = 2.0**62  # what floor(scale * entry) stays below


def whole_vectors(column: pa.Array, scale: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(scale * entry) as int64 with a row each) for each length of vector. Vectors that are null, hold a
    null, an infinite entry or no number, or one of ``LIMIT`` and more, are in none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64))
    bad = ~(np.abs(values) < LIMIT) | pc.is_null(flat).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[0], np.cumsum(bad)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (sums[starts[1:]] == sums[starts[:-1]])
    out = []
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        out.append((rows, values[starts[rows][:, None] + np.arange(d)].astype(np.int64)))
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, in the least of 1, 2, 4 and 8 bytes an entry, after one byte that tells which."""
    if not x.shape[1]:
        return [b"\1"] * len(x)
    low, high = x.min(1), x.max(1)
    out: list[bytes] = [b""] * len(x)
    width = np.full(len(x), 8)
    for w in (4, 2, 1):
        width[(low >= -(1 << 8 * w - 1)) & (high < 1 << 8 * w - 1)] = w
    for w in (1, 2, 4, 8):
        rows = np.flatnonzero(width == w)
        if len(rows):
            data, size = np.ascontiguousarray(x[rows].astype(f"<i{w}")).tobytes(), w * x.shape[1]
            for k, r in enumerate(rows.tolist()):
                out[r] = bytes([w]) + data[k * size : (k + 1) * size]
    return out


def unpacked(keys: list[bytes], dims: int) -> np.ndarray:
    """int64 with a row for each; shorter vectors are padded by zeros."""
    out = np.zeros((len(keys), dims), np.int64)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, k in enumerate(keys):
        groups.setdefault((k[0], len(k)), []).append(i)
    for (w, n), rows in groups.items():
        d = (n - 1) // w
        out[rows, :d] = np.frombuffer(b"".join(keys[i][1:] for i in rows), f"<i{w}").reshape(len(rows), d)
    return out


def packed_vectors(df: DataFrame, id_column: str | None, vector: str, scale: int) -> DataFrame:
    """(id, key, dims) of the vectors that count; id as long, null without a column for it."""
    kept = df.select((F.col(id_column) if id_column else F.lit(None)).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches):
        for b in batches:
            for part in slices([b], 4096):
                for rows, x in whole_vectors(part.column("v"), scale):
                    ids = part.column("id").take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(packed(x), pa.binary()), pa.array(np.full(len(rows), x.shape[1], np.int32))], names=["id", "key", "dims"])

    return kept.mapInArrow(run, "id bigint, key binary, dims int")


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact: in doubles where the products stay below 2 ** 53, else in Python's integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(object) @ b.T.astype(object)
