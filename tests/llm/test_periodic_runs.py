import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from lakeatlas.llm.periodic_runs import find_runs, lyndon_lengths, run_digests, runs_of, with_periodic_tails


def longest_lyndon(x):
    """Longest prefix of each suffix that is less than all its own proper suffixes."""
    return [max(k for k in range(1, len(x) - i + 1) if all(x[i : i + k] < x[i + j : i + k] for j in range(1, k))) for i in range(len(x))]


def plain_runs(x, least, times):
    """Every period in turn: stretches of equal words that far apart, without those that have a smaller period."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items() if n >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def edited(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(rows):
    out = []
    for d, t in rows:
        words = edited(d, (t or "").encode().split())
        runs = plain_runs(words, 24, 3)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        rest = b" ".join(w for i, w in enumerate(words) if i not in drop)
        out.append((d, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def test_lyndon_lengths():
    rng = random.Random(3)
    for _ in range(400):
        x = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(1, 24))]
        assert lyndon_lengths(x) == longest_lyndon(x)


def test_runs_by_brute_force():
    rng = random.Random(5)
    for k in range(300):
        least, times = rng.choice([(3, 3), (6, 3), (24, 3), (20, 4)])
        x = []
        while len(x) < rng.randrange(1, 120):
            root = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.randrange(1, 12))]
            x += (root * 9)[: rng.randrange(1, 60)]
        assert runs_of(np.array(x), least, times) == plain_runs(x, least, times)
    words = [0, 1]
    while len(words) < 400:  # Fibonacci words hold as many runs as almost any
        words = words + words[: len(words) - len(words) // 3]
    assert runs_of(np.array(words), 4, 3) == plain_runs(words, 4, 3)
    thue = [bin(i).count("1") % 2 for i in range(2048)] * 3  # polynomial hashes modulo 2 ** 64 are fooled by these
    assert runs_of(np.array(thue), 3, 3) == plain_runs(thue, 3, 3) == [(0, 3 * 2048, 2048)]


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = run_digests(find_runs(with_periodic_tails(documents.repartition(5))))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert got.where("n_runs > 0").count() > 5


def test_edges(spark):
    line = "to be or not to be\n"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 5000), (4, "a " * 5000), (5, line * 5), (6, line * 3), (None, line * 9), (None, None), (7, "é😀 b\x0bc " * 30), (60, "w " * 23)]
    rows += [(i, " ".join(str(j % (1 + i)) for j in range(200 + i))) for i in range(100, 160)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, runs int, h string")
    got = run_digests(find_runs(with_periodic_tails(df)))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert run_digests(find_runs(with_periodic_tails(df.limit(0)))).count() == 0
    found = find_runs(df)
    assert found.columns == ["doc_id", "text", "h", "n_words", "runs", "collapsed"]
    assert {r.collapsed for r in found.where("doc_id = 5").collect()} == {"to be or not to be"}
    assert [r.n_words for r in found.where("doc_id = 3").collect()] == [0]
    nulls = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert run_digests(find_runs(with_periodic_tails(nulls))).collect()[0].n_runs == 0
