"""Runs of words that repeat with a period, from Lyndon arrays by Baier's grouping.

The first phase of Baier's suffix sorter refines groups of suffixes by the words that they share; when it ends, what the
suffixes of a group share is the longest Lyndon word that starts there. Done under an order of the words and under its
reverse, this gives a Lyndon root of every run (Bannai et al., "The runs theorem"); a root that stands twice in a row is
extended to both sides by longest common extensions, which makes it the run.

Texts differ in length and a run lies within one text, so each text is worked on in the task that reads it and nothing is
shuffled. Only stretches in which every gram of a few words comes again can hold a run; the others are never sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, texts_of
from ._words import U, mix

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_SPACES = r"[\x20\x09-\x0D]+"


def lyndon_lengths(letters: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by grouping.

    Groups are kept in order by their neighbours' numbers and taken from the highest down. Each suffix of the group in hand
    looks left for the nearest suffix of a lower group; those found leave their group for a new one right above it, and what
    its suffixes share grows by what the group in hand shares, once for each suffix that looked there.
    """
    n = len(letters)
    order = {x: g for g, x in enumerate(sorted(set(letters)))}
    group = [order[x] for x in letters]
    members: list[list[int]] = [[] for _ in order]
    for i, g in enumerate(group):
        members[g].append(i)
    shared = [1] * len(order)
    below = list(range(-1, len(order) - 1))
    above = list(range(1, len(order) + 1))
    above[-1] = -1
    left = list(range(-1, n - 1))
    done = bytearray(n)
    found = [0] * n
    g = len(order) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        size = shared[g]
        for i in own:
            done[i] = 1
            found[i] = size
        by_count: dict[int, list[int]] = {}
        last, count = -1, 0
        for i in own:
            j = left[i]
            while j >= 0 and done[j]:
                j = left[j]
            left[i] = j
            if j != last:  # places found never decrease along a group
                if last >= 0:
                    by_count.setdefault(count, []).append(last)
                last, count = j, 1
            else:
                count += 1
        if last >= 0:
            by_count.setdefault(count, []).append(last)
        for count in sorted(by_count, reverse=True):
            new: dict[int, int] = {}
            for j in by_count[count]:
                old = group[j]
                to = new.get(old)
                if to is None:
                    to = new[old] = len(members)
                    members.append([])
                    shared.append(shared[old] + count * size)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = to
                    if up >= 0:
                        below[up] = to
                group[j] = to
                members[to].append(j)
        members[g] = []
        g = below[g]
    return found


def _common(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many places from ``i`` and from ``j`` > ``i`` on are equal, forwards (``step`` 1) or backwards (-1)."""
    most = len(x) - j if step > 0 else i + 1
    done, size = 0, 64
    while done < most:
        k = min(size, most - done)
        if step > 0:
            differ = x[i + done : i + done + k] != x[j + done : j + done + k]
        else:
            differ = (x[i - done - k + 1 : i - done + 1] != x[j - done - k + 1 : j - done + 1])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, size = done + k, size * 4
    return most


def _stretches(x: np.ndarray, width: int, least: int) -> Iterator[tuple[int, int]]:
    """Where each gram of ``width`` words comes again within the same stretch, of at least ``least`` words."""
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        v = mix(x[a:b].astype(U) + U(0x9E3779B97F4A7C15))
        h = v[: len(v) - width + 1].copy()
        for k in range(1, width):
            h = h * U(0xD1342543DE82EF95) + v[k : len(v) - width + 1 + k]
        s = np.sort(h)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            continue
        again = np.isin(h, twice)
        if again.all():
            yield a, b
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]])))
        todo += [(a + i, a + j + width - 1) for i, j in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]


def runs_of(words: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of length ``max(least, times * period)`` and more, in order; ``words`` are numbers,
    equal for equal words. ``times`` is 3 at least, so that each run holds a Lyndon root twice in a row."""
    if times < 3:
        raise ValueError("times must be 3 at least")
    if len(words) < least:
        return []
    # A run of length n and period p holds n - width + 1 grams, and each comes again p places on or before as n >= 2 p + width - 1.
    width = max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))
    found = set()
    for a, b in _stretches(words, width, least):
        x = words[a:b]
        m = len(x)
        letters = x.tolist()
        value = mix(x.astype(U) + U(0x2545F4914F6CDD1D))
        power = np.full(m + 1, U(0x9E3779B97F4A7C15))
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.zeros(m + 1, U)
        np.cumsum(value * power[:m], out=sums[1:])
        at = np.arange(m)
        roots = []
        for sign in (1, -1):
            p = np.array(lyndon_lengths(letters if sign > 0 else [-c for c in letters]))
            i = at[at + 2 * p <= m]
            p = p[i]
            same = (sums[i + p] - sums[i]) * power[p] == sums[i + 2 * p] - sums[i + p]  # equal words, or a rare accident
            roots.append(p[same] * (m + 1) + i[same])
        code = np.unique(np.concatenate(roots))
        p, i = np.divmod(code, m + 1)
        first = ~np.isin(code - p, code) | (i < p)  # the root a period before belongs to the same run
        for i, p in zip(i[first].tolist(), p[first].tolist(), strict=True):
            end = i + p + _common(x, i, i + p, 1)
            start = i - (_common(x, i - 1, i - 1 + p, -1) if i else 0)
            if end - start >= max(least, times * p):
                found.add((a + start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([w for w, k in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not k])


def find_runs(docs: DataFrame, least: int = 24, times: int = 3, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start, then period) and ``collapsed``, the text with one period of each run.

    A run is a stretch of words with smallest period q, of at least ``max(least, times * q)`` words, that goes on with that
    period to neither side; ``times`` is 3 at least. Columns of these names in ``docs`` are replaced, others stay. Null and empty texts have no words,
    no runs and an empty collapsed text; rows stay as often as they come. A text is held in one task, with some 300 bytes for
    each word of its periodic stretches. An empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        n, runs, rest = [], [], []
        for data in texts_of(batch, text):
            words = data.split()  # at 0x20 and 0x09 to 0x0D
            number: dict[bytes, int] = {}
            at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            own = runs_of(at, least, times) if len(number) < len(words) else []
            n.append(len(words))
            runs.append([{"start": s, "length": k, "period": p} for s, k, p in own])
            rest.append(collapsed(words, own))
        return [pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(rest, pa.binary()).view(pa.string())]

    return map_arrow(docs, run, f"n_words bigint, runs {RUNS}, collapsed string", drop=("n_words", "runs", "collapsed"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where the words of one in ten texts repeat with a period from some place on.

    With h the crc32 of the decimal doc_id and g = h // 10, this happens to texts of n > 0 words with h % 10 = 0: word i >= a
    becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8). A text without id stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), _SPACES), lambda x: x != "")
    own = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    own = own.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("w")})
    own = own.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    own = own.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    copies = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    tail = F.slice(F.flatten(copies), F.lit(1), rest)
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return own.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text").cast("string")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """``doc_id``, number of runs, the run with the greatest length over period (ties: least start, then period; without runs
    null), and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast(RUNS[6:-1])
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    top = F.aggregate("runs", none, better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
