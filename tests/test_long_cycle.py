"""Closures of any depth."""

from lakeatlas.operators import graph


def test_long_cycle(spark):
    n = 66
    edges = spark.createDataFrame([("s", i, (i + 1) % n) for i in range(n)], "schema_id string, src int, dst int").coalesce(1)
    assert {(r.node, r.length) for r in graph.cycles(edges).collect()} == {(i, n) for i in range(n)}


def reached(edges):
    out = {}
    for src in {a for a, _ in edges}:
        seen, todo = {}, [(src, 0)]
        while todo:
            at, d = todo.pop(0)
            for a, b in edges:
                if a == at and b not in seen:
                    seen[b] = d + 1
                    todo.append((b, d + 1))
        out[src] = seen
    return out


def test_components_and_cycles_by_brute_force(spark):
    import random

    rng = random.Random(4)
    data = []
    for k in range(12):
        n = rng.randrange(2, 12)
        data += [(f"s{k}", a, b) for a, b in {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 2 * n))}]
    df = spark.createDataFrame(data, "schema_id string, src int, dst int")
    want_parts, want_cycles = set(), set()
    for s in {x for x, _, _ in data}:
        far = reached([(a, b) for x, a, b in data if x == s])
        for a in far:
            same = {b for b in far[a] if a in far.get(b, {})} | {a}
            if len(same) > 1:
                want_parts.add((s, a, min(same)))
            if a in far[a]:
                want_cycles.add((s, a, far[a][a]))
    assert {tuple(r) for r in graph.strong_components(df).collect()} == want_parts
    got = [tuple(r) for r in graph.cycles(df).collect()]
    assert set(got) == want_cycles and len(got) == len(want_cycles)
    none = df.limit(0)
    assert graph.strong_components(none).count() == graph.cycles(none).count() == 0


def test_orders_of_many_diamonds(spark):
    data = []
    for i in range(30):
        data += [("s", f"t{i}", f"l{i}", 0), ("s", f"t{i}", f"r{i}", 1), ("s", f"l{i}", f"t{i + 1}", 0), ("s", f"r{i}", f"t{i + 1}", 0)]
    bases = spark.createDataFrame(data, "schema_id string, src string, dst string, pos int")
    classes = spark.createDataFrame([("s", "t0")], "schema_id string, cls string")
    got = [r.owner for r in graph.inheritance_order(bases, classes).orderBy("place").collect()]
    want = []
    for i in range(30, 0, -1):
        want += [f"t{i}", f"l{i - 1}", f"r{i - 1}"]
    assert got == [*want, "t0"]


def test_orders_agree_with_all_ways(spark):
    import random

    rng = random.Random(8)
    data = [("s", f"c{a}", f"c{b}", p) for a in range(9) for p, b in enumerate(rng.sample(range(9), 2)) if b < a or a == 3]
    bases = spark.createDataFrame(data, "schema_id string, src string, dst string, pos int")  # c3 may come back to itself
    classes = bases.select("schema_id", bases.src.alias("cls")).distinct()
    ranked = lambda df: {(c, tuple(r.owner for r in df.where(f"cls = '{c}'").orderBy("place").collect())) for c in ("c3", "c5", "c8")}
    assert ranked(graph.inheritance_order(bases, classes)) == ranked(graph._walked_order(bases, classes))


def test_nodes_between_two_cycles_are_no_component(spark):
    data = []
    for k in range(20):  # a ring, a way of 9 nodes on, and a ring at its end; in each schema other hashes
        ids = [f"{k}-{i}" for i in range(15)]
        ring, way, last = ids[:3], ids[3:12], ids[12:]
        for r in (ring, last):
            data += [(k, r[i], r[(i + 1) % 3]) for i in range(3)]
        line = [ring[0], *way, last[0]]
        data += [(k, a, b) for a, b in zip(line, line[1:])]
    df = spark.createDataFrame(data, "schema_id int, src string, dst string")
    want = {(k, f"{k}-{i}", f"{k}-{c}") for k in range(20) for c, at in ((0, range(3)), (12, range(12, 15))) for i in at}
    assert {tuple(r) for r in graph.strong_components(df).collect()} == want
    assert {(r.schema_id, r.node) for r in graph.cycles(df).collect()} == {(k, n) for k, n, _ in want}
