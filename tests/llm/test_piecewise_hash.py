import hashlib
import random

from lakeatlas.llm._words import _BYTE, _P
from lakeatlas.llm.piecewise_hash import _common, _rolling, fingerprint, fingerprint_with_edits, likeness

import numpy as np


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, following = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(t) // 2
        edited = t[: len(t) - k] + following[:k]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(t), fingerprint(edited), likeness(fingerprint(t), fingerprint(edited)), likeness(fingerprint(t), fingerprint(following))))
    return sorted(out, key=str)


def test_documents(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, fingerprint_with_edits(documents.repartition(7)).collect()), key=str)
    assert got == expected(rows)
    long = [r for r in got if r[1] > 500]
    assert np.mean([r[5] for r in long]) > 0.4 and np.mean([r[6] for r in long]) < 0.2


def test_edges(spark):
    rows = [(5, "abc"), (4, None), (3, ""), (3, "é😀é"), (3, "é😀é"), (2, "x"), (None, "last"), (-7, "y " * 400_000), (9, "first")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, range int, peek int")
    assert sorted(map(tuple, fingerprint_with_edits(df).collect()), key=str) == expected(rows)
    one = fingerprint_with_edits(df.where("doc_id = 5")).collect()
    assert [tuple(r) for r in one] == expected([(5, "abc")])
    assert fingerprint_with_edits(df.limit(0)).count() == 0
    nulls = df.where("doc_id is null")
    assert fingerprint_with_edits(nulls).count() == 1


def test_ids_beyond_doubles(spark):
    rows = [(2**53 + i, f"text number {i}") for i in range(1, 40)] + [(None, "none")]
    for n in (1, 6):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert sorted(map(tuple, fingerprint_with_edits(df).collect()), key=str) == expected(rows)


def slow_fingerprint(text):
    """The same format byte by byte, by the definition of each part."""
    data = text.encode()
    if not data:
        return "3::"
    place = []
    for i in range(len(data)):
        total = shifted = 0
        for j in range(min(7, i + 1)):
            total += data[i - j] * (8 - j)
            shifted ^= data[i - j] << 5 * j & 0xFFFFFFFF
        place.append((total + shifted) & 0xFFFFFFFF)

    def letter(piece):
        value, power = 0, 1
        for c in piece:
            value, power = (value + int(_BYTE[c]) * power) % 2**64, power * _P % 2**64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            value = (value ^ value >> shift) * factor % 2**64
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[value >> 58]

    def pieces(block, most):
        out, begin = "", 0
        for i, h in enumerate(place):
            if h % block == block - 1 and len(out) < most - 1:
                out, begin = out + letter(data[begin : i + 1]), i + 1
        return out + (letter(data[begin:]) if begin < len(data) else "")

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == block - 1 for h in place) < 32:
        block //= 2
    return f"{block}:{pieces(block, 64)}:{pieces(2 * block, 32)}"


def test_fingerprints_by_their_definition():
    rnd = random.Random(4)
    for n in (0, 1, 2, 5, 8, 60, 191, 193, 1000, 5000):
        for letters in ("ab", "abcdefghij klmno é", "x"):
            text = "".join(rnd.choice(letters) for _ in range(n))
            assert fingerprint(text) == slow_fingerprint(text)


def test_rolling_hash_sees_seven_bytes():
    rnd = random.Random(1)
    data = bytes(rnd.randrange(256) for _ in range(300))
    whole = _rolling(np.frombuffer(data, np.uint8))
    for i in range(6, 300):
        assert _rolling(np.frombuffer(data[i - 6 : i + 1], np.uint8))[-1] == whole[i]


def test_common_subsequence():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ("".join(rnd.choice("abcd") for _ in range(rnd.randrange(20))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert _common(a, b) == t[-1][-1]


def test_insertions_leave_most_letters():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(1000)]
    text = " ".join(words)
    changed = " ".join(words[:500] + ["inserted", "words"] + words[500:])
    other = " ".join(rnd.sample(words, 1000))
    assert likeness(fingerprint(text), fingerprint(changed)) > 0.9
    assert likeness(fingerprint(text), fingerprint(other)) < 0.3
    assert likeness("3::", "3::") == 1 and likeness("3::", fingerprint(text)) == 0
    block, letters, double = fingerprint(text).split(":")
    assert 32 <= len(letters) <= 64 and len(double) <= 32 and int(block) % 3 == 0
