"""Checks over all tables and columns."""

from itertools import combinations

from lakeatlas.plans import checks
from lakeatlas.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_columns(spark):
    tables = {t: checks.read(spark, SF, t) for t in checks.TABLES}
    values = {}
    for t, df in tables.items():
        for c, kind in df.dtypes:
            kind = "bigint" if kind in ("tinyint", "smallint", "int") else kind
            found = {r[0] for r in df.select(df[c].cast("string")).distinct().collect()} - {None}
            if found:
                values[f"{t}.{c}"] = (kind, found)
    want = {(a, b, len(x)) for a, (k, x) in values.items() for b, (m, y) in values.items() if a != b and k == m and x <= y}
    assert {tuple(r) for r in QUERIES["inclusion_deps"](spark, SF).select("child", "parent", "n_values").collect()} == want
    declared = {(r.child, r.parent) for r in QUERIES["fk_coverage"](spark, SF).where("declared").collect()}
    assert declared == {(f"{t}.{c}", f"{p}.{k}") for t, c, p, k in checks.EDGES}
    profiled = {(r.table_name, r.column_name) for r in QUERIES["column_profile"](spark, SF).collect()}
    assert profiled == {(t, c) for t, df in tables.items() for c in df.columns}


def test_all_keys(spark):
    keys = {r.key_columns for r in QUERIES["key_discovery"](spark, SF).where("table_name = 'orders'").collect()}
    df = checks.read(spark, SF, "orders")
    data = [r.asDict() for r in df.collect()]
    unique = lambda *cs: len({tuple(r[c] for c in cs) for r in data if None not in [r[c] for c in cs]}) == len(data)
    one = {c for c in df.columns if unique(c)}
    usable = [c for c in df.columns if all(r[c] is not None for r in data)]
    two = {f"{a},{b}" for a, b in combinations(usable, 2) if not {a, b} & one and unique(a, b)}
    assert keys == one | two and "o_orderkey" in keys
