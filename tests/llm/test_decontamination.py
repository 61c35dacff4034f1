import re

from lakeatlas.llm.decontamination import drop_leaks, find_leaks
from lakeatlas.llm._common import table

ITEM = "Yesterday Tom Baker bought 12 red apples for 3 dollars each and then gave 5 of them to Anna before the long train ride home to London."


def leaks(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id long, text string, item_id string, hash int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted(((r.doc_id, r.item_id, r.verbatim) for r in find_leaks(d, b).collect()), key=str)


def test_slots(spark):
    other = ITEM.replace("Tom", "Sam").replace("Anna", "Lucy").replace("12", "40").replace("dollars", "euros").replace("London", "Paris")
    twice = "We saw that Tom had 12 books and later Tom sold 12 of those same books at the market near the river."
    bad = twice.replace("later Tom", "later Jim").replace("sold 12", "sold 13")
    good = twice.replace("Tom", "Jim").replace("12", "13")
    docs = [(1, "Before. " + ITEM + " After."), (2, "x y z. " + other), (3, twice), (4, bad), (5, good), (6, "Nothing of the kind here at all."), (7, ITEM.lower().replace("apples", "pears")), (8, ITEM[:60])]
    assert leaks(spark, docs, [(1, ITEM), (2, twice)]) == [(1, 1, True), (2, 1, False), (3, 2, True), (5, 2, False)]


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (None, ITEM), (4, ITEM), (4, ITEM), (4, "no"), (5, "word " * 200_000 + ". " + ITEM), (6, "Nice words."), (7, "nice words more")]
    items = [(1, ITEM), (1, ITEM), (2, ""), (3, None), (4, "Nice words"), (5, "1 2 3 4 5 6 7 8")]
    got = leaks(spark, docs, items)
    assert {(d, i) for d, i, _ in got} == {(None, 1), (4, 1), (5, 1), (6, 4)}
    assert sum(d == 6 for d, _, _ in got) == 1
    assert leaks(spark, [], items) == [] and leaks(spark, docs, []) == []


def test_against_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    bench = table(spark, "/root/testdata/sf0.01", "benchmark")

    def runs(t):
        w = [x.lower() for x in re.findall(r"\w+(?:[.,'’-]\w+)*", t)]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    items = {r.item_id: runs(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        have = runs(r.text)
        want |= {(r.doc_id, i) for i, x in items.items() if x and len(x & have) >= 0.8 * len(x)}
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, bench).collect()}
    assert got == want and want
    left = drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}


def test_edited_items(spark):
    changed = ITEM.replace("train", "coach")
    two = changed.replace("apples", "pears")
    docs = [(1, "x y z. " + changed), (2, two), (3, ITEM.replace("and then gave", "and gave")), (4, ITEM.replace("long train", "very long train")), (5, " ".join(ITEM.split()[:13]))]
    assert leaks(spark, docs) == [(1, 1, True), (2, 1, True), (3, 1, True), (4, 1, True)]
    swapped = "We went on. gave 5 of them to Anna before the long train ride home to London. Yesterday Tom Baker bought 12 red apples for 3 dollars each and then"
    assert leaks(spark, [(1, swapped)]) == [(1, 1, True)]


def test_items_without_plain_words(spark):
    items = [(5, "1 2 3 4 5 6 7 8"), (6, "12 kg")]
    docs = [(1, "See 0 1 2 3 4 5 6 7 8 here."), (2, "1 2 3 4 5 6 7 9"), (3, "12 kg"), (4, "12 kg of it")]
    assert leaks(spark, docs, items) == [(1, 5, True), (3, 6, True)]


def test_every_shift(spark):
    twice = "We saw that Tom had 12 books and later Tom sold 12 of those same books at the market near the river."
    bad = twice.replace("later Tom", "later Jim").replace("sold 12", "sold 13")
    longer = twice.replace("and later", "and then much later").replace("Tom", "Jim")
    docs = [(1, f"{bad} And so on. {twice}"), (2, f"{bad} And so on. {twice.replace('Tom', 'Jim')}"), (3, f"{bad} Then. {bad}"), (4, longer)]
    assert leaks(spark, docs, [(2, twice)]) == [(1, 2, True), (2, 2, False), (4, 2, False)]
