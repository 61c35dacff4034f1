"""Keys and relationships established from the data itself, where a lake declares none."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_hash(c: str | Column) -> list[Column]:
    """128 bits, as columns a and b, for a value of any type but maps, so that no text or vector is shuffled; whole numbers of any width hash alike.
    Two of ``n`` different values meet with probability about ``n * n / 2 ** 129``."""
    c = F.col(f"`{c}`") if isinstance(c, str) else c
    return [F.xxhash64(c).alias("a"), F.xxhash64(F.lit(7), c).alias("b")]


def _widened(df: DataFrame) -> DataFrame:
    whole = ("tinyint", "smallint", "int")
    return df.select(*(F.col(f"`{c}`").cast("bigint").alias(c) if kind in whole else F.col(f"`{c}`") for c, kind in df.dtypes))


def column_profiles(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, n_rows, n_null, n_distinct, nullable, is_unique) of every column of the tables, exact.

    A row gives a number and a hash for each of its columns; equal ones are combined before the one shuffle that counts them,
    for all tables at once.
    """
    names = [(t, c) for t, df in tables.items() for c in df.columns]
    spark = next(iter(tables.values())).sparkSession
    parts, at = [], 0
    for df in tables.values():
        own = [F.struct(F.lit(at + i).alias("no"), F.col(f"`{c}`").isNull().alias("missing"), *value_hash(c)) for i, c in enumerate(df.columns)]
        parts.append(_widened(df).select(F.inline(F.array(*own))))
        at += len(own)
    counts = reduce(DataFrame.union, parts).groupBy("no", "missing", "a", "b").agg(F.count("*").alias("n")).select("no", "missing", "n")
    none = spark.createDataFrame([(i, True, 0) for i in range(len(names))], "no int, missing boolean, n bigint")  # columns of empty tables
    n = F.col("n")
    by = counts.union(none).groupBy("no").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("missing"), n).otherwise(0)).alias("n_null"), F.count_if(~F.col("missing")).alias("n_distinct"))
    name = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in names)), F.col("no") + 1)
    return by.select(
        name(0).alias("table_name"),
        name(1).alias("column_name"),
        "n_rows",
        "n_null",
        "n_distinct",
        (F.col("n_null") > 0).alias("nullable"),
        ((F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0)).alias("is_unique"),
    )


def column_profile(df: DataFrame, table: str, exact: bool = True) -> DataFrame:
    """``column_profiles`` of one table; distinct counts are sketched unless ``exact``."""
    if exact:
        return column_profiles({table: df})
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"{c}|null"), F.approx_count_distinct(F.col(c)).alias(f"{c}|distinct"))),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col("n").alias("n_rows"),
                F.col(f"`{c}|null`").alias("n_null"),
                F.col(f"`{c}|distinct`").alias("n_distinct"),
            ) for c in df.columns
        )
    )
    out = stats.select(F.inline(rows))
    return out.withColumn("nullable", F.col("n_null") > 0).withColumn("is_unique", (F.col("n_distinct") == F.col("n_rows")) & (F.col("n_rows") > 0))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def _agreeing(tables: dict[str, DataFrame], sets: list[tuple[str, tuple[str, ...]]], share: int) -> set[int]:
    """Numbers of the sets of columns on which two rows agree, among rows whose hash over the set is divisible by ``share``.

    Rows that agree have one hash, so such a sample holds all copies of what it holds: a set that it finds is no key for
    certain. With a ``share`` of 1 no other is.
    """
    parts = []
    for t, df in tables.items():
        own = [F.struct(F.lit(i).alias("no"), *value_hash(F.struct(*(f"`{c}`" for c in cs)))) for i, (u, cs) in enumerate(sets) if u == t]
        if own:
            parts.append(df.select(F.inline(F.array(*own))).where(F.col("a") % share == 0))
    if not parts:
        return set()
    again = reduce(DataFrame.union, parts).groupBy("no", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    return {r["no"] for r in again.select("no").distinct().collect()}


def discover_all_keys(tables: dict[str, DataFrame], width: int = 2, sample: int = 4096, share: int = 64) -> DataFrame:
    """(table_name, key_columns): minimal sets of at most ``width`` columns that are unique and never null, of every table.

    Candidates are refuted, not estimated. Exact counts of single columns (one pass over each table) say which are keys, and a
    set of others whose counts' product is below the number of rows is none. Of at most ``sample`` rows a table the driver gets
    hashes: sets on which two of these rows agree are none. Those left are looked for in a share of the hashes, and what that
    does not refute in all of them; all tables go at once, so that a width costs two passes at most. Only numbers of sets and
    the hashes of the sample come to the driver.
    """
    spark = next(iter(tables.values())).sparkSession
    facts: dict[str, dict[str, tuple]] = {t: {} for t in tables}
    for r in column_profiles(tables).collect():
        facts[r.table_name][r.column_name] = (r.n_rows, r.n_null, r.n_distinct)
    found = [(t, (c,)) for t, df in tables.items() for c in df.columns if (f := facts[t][c])[0] and not f[1] and f[0] == f[2]]
    hashed = [df.limit(sample).select(F.lit(t).alias("t"), F.array(*(F.xxhash64(f"`{c}`") for c in df.columns)).alias("h")) for t, df in tables.items()]
    rows: dict[str, list] = {t: [] for t in tables}
    for r in reduce(DataFrame.union, hashed).collect() if width > 1 else []:
        rows[r.t].append(r.h)
    for k in range(2, width + 1):
        sets = []
        for t, df in tables.items():
            keys = [set(cs) for u, cs in found if u == t]
            place = {c: i for i, c in enumerate(df.columns)}
            usable = [c for c in df.columns if facts[t][c][0] and not facts[t][c][1]]
            for cs in combinations(usable, k):
                if any(x <= set(cs) for x in keys) or prod(facts[t][c][2] for c in cs) < facts[t][cs[0]][0]:
                    continue
                seen = [tuple(h[place[c]] for c in cs) for h in rows[t]]
                if len(set(seen)) == len(seen):
                    sets.append((t, cs))
        for part in (share, 1):
            refuted = _agreeing(tables, sets, part)
            sets = [x for i, x in enumerate(sets) if i not in refuted]
        found += sets
    return spark.createDataFrame([(t, ",".join(cs)) for t, cs in found], "table_name string, key_columns string")


def discover_keys(df: DataFrame, table: str, columns: list[str], width: int = 2) -> DataFrame:
    """``discover_all_keys`` among some columns of one table."""
    return discover_all_keys({table: df.select(*(f"`{c}`" for c in columns))}, width)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose non-null key has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def integrity(child: DataFrame, column: str, parent: DataFrame, key: str, edge: str) -> DataFrame:
    """(edge, n_rows, n_null, n_orphans, null_share): keys are counted per value before the join, so that hot ones cost no more."""
    counts = child.groupBy(F.col(column).alias("_k")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    joined = counts.join(known, "_k", "left")
    return joined.agg(
        F.lit(edge).alias("edge"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull() & F.col("_there").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans"),
    ).withColumn("null_share", F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows")))


def cardinality(child: DataFrame, column: str, edge: str) -> DataFrame:
    """(edge, type, min_fan, avg_fan, max_fan, n_parents, n_rows): has_one where no key value repeats."""
    fan = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    out = fan.agg(F.min("n").alias("min_fan"), F.max("n").alias("max_fan"), F.count("*").alias("n_parents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return out.select(
        F.lit(edge).alias("edge"),
        F.when(F.col("max_fan") == 1, "has_one").otherwise("belongs_to").alias("type"),
        "min_fan",
        (F.col("n_rows") / F.col("n_parents")).alias("avg_fan"),
        "max_fan",
        "n_parents",
        "n_rows",
    )


_BITS = 62


def inclusion_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, n_values, n_both): for pairs of columns (table.column) with values in common, the child's distinct values
    and those of them that the parent has. Columns of different types have nothing in common; whole numbers are of one type.

    A table is read once. A value is its type and hash; which columns have it is a set of bits, combined before the one shuffle.
    Pairs are counted for each combination of columns, of which there are few, and not for each value.
    """
    names = [f"{t}.{c}" for t, df in tables.items() for c in df.columns]
    number = {n: i for i, n in enumerate(names)}
    kinds: dict[str, int] = {}
    words = (len(names) + _BITS - 1) // _BITS
    parts = []
    for t, df in tables.items():
        own = []
        for c, kind in _widened(df).dtypes:
            kind = kinds.setdefault(kind, len(kinds))
            if (i := number.get(f"{t}.{c}")) is not None:
                bits = [F.lit(1 << i % _BITS if w == i // _BITS else 0).cast("bigint").alias(f"w{w}") for w in range(words)]
                own.append(F.struct(F.lit(kind).alias("kind"), F.col(f"`{c}`").isNotNull().alias("said"), *value_hash(c), *bits))
        if own:
            parts.append(_widened(df).select(F.inline(F.array(*own))).where("said"))
    masks = [f"w{w}" for w in range(words)]
    having = reduce(DataFrame.union, parts).groupBy("kind", "a", "b").agg(*(F.bit_or(m).alias(m) for m in masks))
    combos = having.groupBy(*masks).agg(F.count("*").alias("n"))
    bit = lambda i: F.getbit(F.element_at(F.array(*masks), (i / _BITS).cast("int") + 1), i % _BITS) == 1
    members = F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), bit)
    pairs = combos.select("n", members.alias("m")).select("n", "m", F.explode("m").alias("a")).select("n", "a", F.explode("m").alias("b"))
    both = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_both"))
    sizes = both.where("a = b").select("a", F.col("n_both").alias("n_values"))
    name = lambda c: F.element_at(F.array(*(F.lit(n) for n in names)), F.col(c) + 1)
    return both.where("a <> b").join(F.broadcast(sizes), "a").select(name("a").alias("child"), name("b").alias("parent"), "n_values", "n_both")


def inclusion_dependencies(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, n_values): pairs of columns of which every value of the child is in the parent."""
    return inclusion_scores(tables).where("n_both = n_values").select("child", "parent", "n_values")


def likely_parents(scores: DataFrame, least: float = 0.9) -> DataFrame:
    """(child, parent, containment, same_name): the best parent of each column by the share of its values that it has, at
    least ``least``; of equal shares one of the same name (without its table's prefix), then the first by name."""
    bare = lambda c: F.regexp_replace(F.element_at(F.split(F.col(c), r"\."), -1), "^[a-z]_", "")
    own = scores.withColumn(
        "containment",
        F.col("n_both") / F.col("n_values"),
    ).where(F.col("containment") >= least).withColumn("same_name", bare("child") == bare("parent"))
    first = F.row_number().over(Window.partitionBy("child").orderBy(F.desc("containment"), F.desc("same_name"), "parent"))
    return own.withColumn("_n", first).where("_n = 1").select("child", "parent", "containment", "same_name")


def coverage(by_name: DataFrame, by_data: DataFrame, declared: DataFrame) -> DataFrame:
    """(child, parent, named, confirmed, declared): which way each relationship is known."""
    mark = lambda df, c: df.select("child", "parent", F.lit(True).alias(c)).distinct()
    out = mark(by_name, "named").join(mark(by_data, "confirmed"), ["child", "parent"], "full").join(mark(declared, "declared"), ["child", "parent"], "full")
    return out.na.fill(False, ["named", "confirmed", "declared"])
