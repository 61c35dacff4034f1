import random
from collections import defaultdict

import numpy as np
import pytest

from lakeatlas.llm._words import as_bytes, shingle_set, word_hashes
from lakeatlas.llm.ngram_join import Parts, ngram_jaccard_join


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = root(i)
            least[r] = d if least[r] is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_against_brute_force(spark, width, percent):
    rnd = random.Random(width)
    words = [f"w{i}" for i in range(40)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 8, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((n := n + 1, " ".join(w) + rnd.choice(["", "\n"])))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ngram_jaccard_join(df, width, percent, group_size=4)) == brute(rows, width, percent)


def test_documents_against_brute_force(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert got(ngram_jaccard_join(documents)) == brute(rows, 3, 90)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b c d"), (5, "A B C D"), (5, "A B C D"), (7, "a  b c\td"), (8, "a"), (9, "a"), (None, "z y"), (10, "x " * 300_000 + "end"), (11, "x " * 300_000 + "end")]
    df = spark.createDataFrame([(*r, 1, "u", 2) for r in rows], "doc_id long, text string, node int, component_id string, n_shingles int")
    assert got(ngram_jaccard_join(df)) == brute(rows, 3, 90)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard_join(empty).count() == 0


def test_chains_of_near_copies_in_many_groups(spark):
    # neighbours link, ends do not; the second chain is like the first but too far from it
    base = [f"a{i}" for i in range(200)]
    rows = []
    for n in range(60):
        rows.append((n, " ".join(["x"] * 0 + [f"c{n}_{i}" if i < 3 else w for i, w in enumerate(base)])))
    other = [w if i % 25 else f"o{i}" for i, w in enumerate(base)]
    for n in range(60, 120):
        rows.append((n, " ".join(f"d{n}" if i == 100 else w for i, w in enumerate(other))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(ngram_jaccard_join(df, 3, 90, group_size=8)) == brute(rows, 3, 90)


def test_every_linked_pair_has_a_token_in_common():
    rnd = random.Random(5)
    for percent in (60, 80, 90, 100):
        cut = Parts(percent)
        for _ in range(200):
            n = rnd.choice([1, 2, 5, 9, 20, 57, 300])
            x = np.unique(np.array([rnd.getrandbits(64) for _ in range(n)], np.uint64))
            y = set(x.tolist())
            while True:
                z = set(y)
                z.add(rnd.getrandbits(64)) if rnd.random() < 0.5 else z.discard(rnd.choice(sorted(z)))
                if not z or 100 * len(z & set(x.tolist())) < percent * len(z | set(x.tolist())):
                    break
                y = z
                if rnd.random() < 0.02:
                    break
            y = np.array(sorted(y), np.uint64)
            common = set(cut.tokens(x).tolist()) & set(cut.tokens(y).tolist())
            for own in (x, y):
                assert any(len(common & set(found.tolist())) >= need for found, need in cut.cuts(own))


def test_ids_beyond_doubles(spark):
    big = 2**53 + 1
    rows = [(big, "a b c d e"), (big + 2, "A b c d e"), (None, "q r s t"), (big + 4, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(ngram_jaccard_join(df)) == brute(rows, 3, 90)


def test_many_null_ids(spark):
    rnd = random.Random(2)
    texts = [" ".join(f"w{rnd.randrange(9)}" for _ in range(30)) for _ in range(150)]
    rows = [(None if i % 3 else i, t) for i, t in enumerate(texts + texts[:60])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ngram_jaccard_join(df, 3, 90)) == brute(rows, 3, 90)


def test_a_set_far_from_the_hub_of_its_tokens(spark):
    # many versions which share tokens with one another and with the rest, but link with few of them
    rnd = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for n in range(240):
        w = list(base)
        for i in rnd.sample(range(150), rnd.choice([1, 2, 3, 4])):
            w[i] = f"e{n % 40}_{i}"
        rows.append((n, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(rows, 3, 90)
    assert 5 < len({c for _, _, c in want}) < 235
    for size in (1, 16, 512):
        assert got(ngram_jaccard_join(df, 3, 90, group_size=size)) == want


def test_word_hashes_are_those_of_the_words():
    texts = ["Ab cD", None, "", "ab cd", "É é x", "q" * 400_000 + " r " + "s" * 300_000, "\x1f\x0b\x0cx"]
    found = list(word_hashes(map(as_bytes, texts)))
    assert [len(x) for x in found] == [len(as_bytes(t).split()) for t in texts]
    assert (found[0] == found[3]).all() and found[4][0] != found[4][1]
    assert len(shingle_set(found[1], 3)) == 0
