"""Context-triggered piecewise hashing.

A rolling hash over the last seven bytes sets the ends of pieces where it is -1 modulo the block size, so that pieces find
themselves again after insertions. Each piece gives one of 64 letters; a fingerprint is ``size:letters:letters`` with the
letters at the block size and at twice that. Fingerprints compare where they have a block size in common: the likeness is
that of their letters by edit distance (insertions and deletions), and nothing without a run of letters in common.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, slices, text_or_empty
from ._words import _BYTE, U, _power_tables, mix

WINDOW, LEAST_BLOCK, LETTERS = 7, 3, 64
RUN = 4
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a hash of it and the six before: their sum, their weighted sum and a shifted exclusive or."""
    wide = np.zeros(len(data) + WINDOW - 1, np.uint32)
    wide[WINDOW - 1 :] = data
    total = np.zeros(len(data), np.uint32)
    shifted = np.zeros(len(data), np.uint32)
    for j in range(WINDOW):
        x = wide[WINDOW - 1 - j : len(wide) - j]
        total += x * np.uint32(1 + WINDOW - j)
        shifted ^= x << np.uint32(5 * j)
    return total + shifted


def _letters(ends: np.ndarray, sums: np.ndarray, inverse: np.ndarray, n: int, most: int) -> str:
    """A letter for each piece; from the ``most``-th on the rest is one piece."""
    ends = ends[: most - 1]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    return _ALPHABET[(h >> U(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    place = _rolling(data).astype(np.int64) + 1
    block = LEAST_BLOCK
    while block * LETTERS < n:
        block *= 2
    at = np.flatnonzero(place % LEAST_BLOCK == 0)
    level = place[at] // LEAST_BLOCK
    level = level & -level  # the largest power of two: an end for each block size up to three times it
    while True:
        ends = at[level >= block // LEAST_BLOCK] + 1
        if len(ends) >= LETTERS // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    double = at[level >= 2 * block // LEAST_BLOCK] + 1
    return f"{block}:{_letters(ends, sums, inverse, n, LETTERS)}:{_letters(double, sums, inverse, n, LETTERS // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where the block sizes are not compatible."""
    if x == y:
        return 1.0
    (m, a, aa), (n, b, bb) = x.split(":"), y.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(_alike(a, b), _alike(aa, bb))
    if m == 2 * n:
        return _alike(a, bb)
    return _alike(aa, b) if n == 2 * m else 0.0


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each text of ``docs(doc_id, text, ...)`` and its edited text, whose last half (rounded down, in code
    points) is replaced by as many first code points of the next document (or by all it has).

    Next is the document after it by descending doc_id, and the first after the last. Rows of one doc_id are ordered by
    text; null doc_ids come last. Null texts are empty: their fingerprint is ``3::``. A lone row is its own next. An
    empty table gives no rows. Other columns are not looked at.

    Ranges of doc_id are sorted each in a task; the first rows of a range also go to the range before it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = 4 * parts(docs)
    bounds = sorted({int(x) for x in src.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n)})
    last = len(bounds) + 1

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        at = len(bounds) - np.searchsorted(np.array(bounds, np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pc.if_else(ids.is_null(), pa.scalar(last, pa.int32()), pa.array(at.astype(np.int32)))

    placed = src.withColumn("range", place("doc_id"))
    # a row for each range, of which there are at most four times the shuffle partitions
    heads = {r.range: r.head for r in placed.groupBy("range").agg(F.max("doc_id").alias("head")).collect()}
    if not heads:
        return src.sparkSession.createDataFrame([], _RESULT)
    order = sorted(heads)
    before = [(r, heads[r], order[i - 1]) for i, r in enumerate(order)]  # the first range follows the last
    lookup = src.sparkSession.createDataFrame(before, "_r int, _h long, _to int")
    extra = placed.join(
        F.broadcast(lookup),
        (F.col("range") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_h")),
    ).select("doc_id", "text", F.col("_to").alias("range"), F.lit(1).alias("peek"))
    rows = placed.select("doc_id", "text", "range", F.lit(0).alias("peek")).union(extra)
    rows = rows.repartition(parts(docs), "range").sortWithinPartitions("range", "peek", F.col("doc_id").desc_nulls_last(), "text")

    def run(batches):
        previous = None  # (range, doc_id, text, fingerprint) that waits for its next
        out = []
        for b in slices(batches):
            for i, text, r, peeked in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "range", "peek"))):
                if previous is not None and previous[0] == r:
                    print_ = fingerprint(text)
                    out.append(_row(previous, text, print_))
                    previous = None if peeked else (r, i, text, print_)
                elif not peeked:
                    previous = (r, i, text, fingerprint(text))
                if len(out) >= 2000:
                    yield _table(out)
                    out = []
        if out:
            yield _table(out)

    return rows.mapInArrow(run, _RESULT)


def _row(own, following: str, next_print: str) -> tuple:
    _, i, text, print_ = own
    k = len(text) // 2
    edited = text[: len(text) - k] + following[:k]
    changed = print_ if edited == text else fingerprint(edited)
    return i, len(text), hashlib.sha256(
        edited.encode("utf-8", "surrogatepass")
    ).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, next_print)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _RESULT.split(", ")])
