"""The schema graph: neighbourhoods, components, cycles, closures over class hierarchies."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeatlas.operators.store import written


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """(schema_id, start, node, depth): what lies within ``depth`` steps of ``starts(schema_id, start)``.

    ``edges(schema_id, src, dst)``. direction out follows keys to what a table depends on, in to its dependents, both does both.
    Each step joins the frontier only, and leaves out what was seen.
    """
    if direction not in ("out", "in", "both"):
        raise ValueError("direction must be out, in or both")
    forward = edges.select("schema_id", "src", "dst")
    back = edges.select("schema_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = {"out": forward, "in": back, "both": forward.union(back)}[direction].distinct()
    seen = starts.select("schema_id", "start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        nearer = frontier.select("schema_id", "start", F.col("node").alias("src"))
        reached = nearer.join(steps, ["schema_id", "src"]).select("schema_id", "start", F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select("schema_id", "start", "node"), ["schema_id", "start", "node"], "left_anti").withColumn("depth", F.lit(d))
        if d < depth:
            frontier = written(frontier)
            if frontier.isEmpty():
                break
        seen = seen.union(frontier)
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(schema_id, node, component): component is the least node that is connected. Labels halve their way each round."""
    both = edges.select("schema_id", "src", "dst").union(edges.select("schema_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    labels = written(nodes.select("schema_id", "node", F.col("node").alias("component")))
    while True:
        near = both.join(
            labels.select("schema_id", F.col("node").alias("dst"), "component"),
            ["schema_id", "dst"],
        ).groupBy("schema_id", F.col("src").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(near, ["schema_id", "node"], "left").select("schema_id", "node", "component", F.least("component", "near").alias("next"))
        # a label's own label saves rounds
        jump = closer.select("schema_id", F.col("node").alias("next"), F.col("next").alias("far"))
        moved = written(closer.join(jump, ["schema_id", "next"], "left").select("schema_id", "node", "component", F.least("next", "far").alias("next")))
        done = moved.where("component <> next").isEmpty()
        labels = moved.select("schema_id", "node", F.col("next").alias("component"))
        if done:
            return labels


def closure(edges: DataFrame) -> DataFrame:
    """(schema_id, src, dst, depth): every pair of which dst is reached from src, with the least number of steps.

    It ends by itself, for a pair is found only once.
    """
    found = edges.select("schema_id", "src", "dst", F.lit(1).alias("depth")).distinct()
    frontier = found
    for d in itertools.count(2):
        longer = frontier.select("schema_id", "src", F.col("dst").alias("mid")).join(
            edges.select("schema_id", F.col("src").alias("mid"), "dst"),
            ["schema_id", "mid"],
        ).select("schema_id", "src", "dst").distinct()
        frontier = written(longer.join(found.select("schema_id", "src", "dst"), ["schema_id", "src", "dst"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        found = written(found.union(frontier))
    return found


def _unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle: one that is sent whole goes by way of the driver, and again in each round."""
    return df.hint("merge")


def _strongest(edges: DataFrame) -> DataFrame:
    """(schema_id, node, best): of the nodes from which a node is reached, itself included, that with the greatest hash.

    A node takes the best of those before it, and the best that its own best has: hashes deal the order, so that ways of any
    length are taken in few rounds.
    """
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    nodes = edges.select("schema_id", F.col("src").alias("node")).union(edges.select("schema_id", F.col("dst").alias("node"))).distinct()
    labels = written(nodes.select("schema_id", "node", key("node").alias("best")))
    while True:
        near = edges.join(_unsent(labels.select("schema_id", F.col("node").alias("src"), "best")), ["schema_id", "src"]).groupBy("schema_id", F.col("dst").alias("node")).agg(F.max("best").alias("near"))
        closer = labels.join(_unsent(near), ["schema_id", "node"], "left").select("schema_id", "node", "best", F.greatest("best", "near").alias("next"))
        jump = closer.select("schema_id", F.col("node").alias("_at"), F.col("next").alias("far"))
        moved = closer.withColumn("_at", F.col("next.n")).join(_unsent(jump), ["schema_id", "_at"], "left")
        moved = written(moved.select("schema_id", "node", "best", F.greatest("next", "far").alias("next")))
        labels = moved.select("schema_id", "node", F.col("next").alias("best"))
        if moved.where("best <> next").isEmpty():
            return labels.select("schema_id", "node", F.col("best.n").alias("best"))


def strong_components(edges: DataFrame, trims: int = 3) -> DataFrame:
    """(schema_id, node, component): nodes that reach one another, for those that reach another and are reached by it again;
    component is the least node of them. Nodes in no such group have no row.

    Nodes that nothing enters or leaves go first (``trims`` rounds). The others are coloured by the strongest node that reaches
    them; within a colour, those that reach that node are a component. What is left is coloured again.
    """
    left = written(edges.select("schema_id", "src", "dst").where("src <> dst").distinct())
    found = []
    while True:
        for _ in range(trims):
            entered = left.select("schema_id", F.col("dst").alias("src")).distinct()
            leaving = left.select("schema_id", F.col("src").alias("dst")).distinct()
            left = left.join(_unsent(entered), ["schema_id", "src"], "left_semi").join(_unsent(leaving), ["schema_id", "dst"], "left_semi").select("schema_id", "src", "dst")
        left = written(left)
        if left.isEmpty():
            break
        color = _strongest(left)
        end = lambda labels, c: _unsent(labels.select("schema_id", F.col("node").alias(c), F.col("best").alias(f"_{c}")))
        within = left.join(end(color, "src"), ["schema_id", "src"]).join(end(color, "dst"), ["schema_id", "dst"]).where("_src = _dst")
        within = written(within.select("schema_id", "src", "dst"))
        back = _strongest(within.select("schema_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        same = color.join(_unsent(back.withColumnRenamed("best", "_back")), ["schema_id", "node"]).where("best = _back")
        named = same.groupBy("schema_id", "best").agg(F.min("node").alias("component"), F.count("*").alias("n"))
        members = written(same.join(_unsent(named), ["schema_id", "best"]).select("schema_id", "node", "component", "n"))
        found.append(members.where("n > 1").select("schema_id", "node", "component"))  # a node between two groups is alone
        gone = members.select("schema_id", F.col("node").alias("src"))
        left = within.join(_unsent(gone), ["schema_id", "src"], "left_anti").join(_unsent(gone.withColumnRenamed("src", "dst")), ["schema_id", "dst"], "left_anti").select("schema_id", "src", "dst")
    none = edges.select("schema_id", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    return reduce(DataFrame.union, found, none)


def cycles(edges: DataFrame) -> DataFrame:
    """Tables that reach themselves: (schema_id, node, length of the shortest cycle).

    Walks go along edges inside strong components only, from all their nodes at once; a walk ends when it comes back, and only
    its last step is kept.
    """
    own = edges.select("schema_id", "src", "dst").distinct()
    selves = own.where("src = dst").select("schema_id", F.col("src").alias("node"), F.lit(1).alias("length"))
    parts = strong_components(own)
    at = lambda c: _unsent(parts.select("schema_id", F.col("node").alias(c), F.col("component").alias(f"_{c}")))
    inside = own.where("src <> dst").join(at("src"), ["schema_id", "src"]).join(at("dst"), ["schema_id", "dst"]).where("_src = _dst")
    inside = written(inside.select("schema_id", "src", "dst"))
    starts = inside.join(_unsent(selves.select("schema_id", F.col("node").alias("src"))), ["schema_id", "src"], "left_anti")
    frontier = written(starts.select("schema_id", F.col("src").alias("start"), F.col("dst").alias("src")).distinct())
    found = [selves]
    length = 1
    while not frontier.isEmpty():
        length += 1
        reached = frontier.join(_unsent(inside), ["schema_id", "src"]).select("schema_id", "start", F.col("dst").alias("src")).distinct()
        reached = written(reached)
        closed = reached.where("start = src").select("schema_id", "start")
        found.append(closed.select("schema_id", F.col("start").alias("node"), F.lit(length).alias("length")))
        frontier = written(reached.join(_unsent(closed), ["schema_id", "start"], "left_anti").select("schema_id", "start", "src"))
    return reduce(DataFrame.union, found)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    used = edges.select("schema_id", F.col("src").alias("node")).union(edges.select("schema_id", F.col("dst").alias("node"))).distinct()
    return nodes.join(used, ["schema_id", "node"], "left_anti")


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(schema_id, node): what reaches one of ``starts(schema_id, node)`` by ``edges(schema_id, src, dst)``, starts included.

    Walks from the starts; each step joins the frontier only, and ends when nothing new is found.
    """
    up = edges.select("schema_id", F.col("dst").alias("node"), "src").distinct()
    found = frontier = written(starts.select("schema_id", "node").distinct())
    while True:
        nearer = frontier.join(up, ["schema_id", "node"]).select("schema_id", F.col("src").alias("node")).distinct()
        frontier = written(nearer.join(found, ["schema_id", "node"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = written(found.union(frontier))


def models(bases: DataFrame, roots: list[str]) -> DataFrame:
    """Classes (schema_id, src) which have one of ``roots`` among their bases (schema_id, src, dst), at any distance."""
    first = bases.where(F.col("dst").isin(roots)).select("schema_id", F.col("src").alias("node"))
    return descendants(bases, first).select("schema_id", F.col("node").alias("src"))


def inheritance_roots(bases: DataFrame, concrete: DataFrame) -> DataFrame:
    """(schema_id, src, root): the farthest ancestor that is a known concrete class and reached through such ones only."""
    known = concrete.select("schema_id", F.col("cls").alias("dst"))
    up = closure(bases.join(known, ["schema_id", "dst"], "left_semi"))
    return up.where("src <> dst").groupBy("schema_id", "src").agg(F.max_by("dst", F.struct("depth", "dst")).alias("root"))


def inheritance_order(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """(schema_id, cls, owner, place): the bases of each of ``classes(schema_id, cls)`` and the class itself, by place in the
    order in which fields are taken: depth first along ``bases(schema_id, src, dst, pos)``, a class after its own bases,
    each once (where it is met first).

    Orders are made once for each class, level by level from those without bases: that of a class is its bases' finished orders
    one after another, each class where it comes first, and itself. Of classes that reach a cycle all ways down are walked, and
    cycles end where they come back.
    """
    down = bases.where("src <> dst").groupBy("schema_id", "src", "dst").agg(F.min("pos").alias("pos"))
    down = written(down.withColumn("n", F.count("*").over(Window.partitionBy("schema_id", "src"))))
    wanted = classes.select("schema_id", "cls").distinct()
    every = wanted.union(down.select("schema_id", "src")).union(down.select("schema_id", "dst")).distinct()
    first = every.join(down.select("schema_id", F.col("src").alias("cls")), ["schema_id", "cls"], "left_anti")
    fresh = written(first.select("schema_id", "cls", F.array("cls").alias("order")))
    finished, got = fresh, None
    while not fresh.isEmpty():
        new = down.join(fresh.withColumnRenamed("cls", "dst"), ["schema_id", "dst"]).select("schema_id", "src", "n", F.struct("pos", "dst", "order").alias("x"))
        got = written(new if got is None else got.union(new))
        ready = got.groupBy("schema_id", "src", "n").agg(F.sort_array(F.collect_list("x")).alias("xs")).where(F.size("xs") == F.col("n"))
        order = F.concat(F.array_distinct(F.flatten(F.transform("xs", lambda x: x["order"]))), F.array("src"))
        fresh = written(ready.select("schema_id", F.col("src").alias("cls"), order.alias("order")))
        got = written(got.join(fresh.select("schema_id", F.col("cls").alias("src")), ["schema_id", "src"], "left_anti").select("schema_id", "src", "n", "x"))
        finished = finished.union(fresh)
    out = finished.join(wanted, ["schema_id", "cls"], "left_semi").select("schema_id", "cls", F.posexplode("order").alias("place", "owner"))
    out = out.select("schema_id", "cls", "owner", F.array("place").alias("place"))
    rest = written(wanted.join(finished, ["schema_id", "cls"], "left_anti"))
    return out if rest.isEmpty() else out.unionByName(_walked_order(bases, rest))


def _walked_order(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """``inheritance_order`` by all ways down from a class: for classes that reach a cycle, which ends where it comes back."""
    down = bases.select("schema_id", F.col("src").alias("owner"), F.col("dst").alias("_next"), F.col("pos").cast("int").alias("_pos"))
    one = classes.select("schema_id", "cls").distinct()
    found = frontier = one.select("schema_id", "cls", F.col("cls").alias("owner"), F.array().cast("array<int>").alias("path"), F.array("cls").alias("chain"))
    while True:
        step = frontier.join(down, ["schema_id", "owner"]).where(~F.array_contains("chain", F.col("_next")))
        frontier = written(
            step.select(
                "schema_id",
                "cls",
                F.col("_next").alias("owner"),
                F.concat("path", F.array("_pos")).alias("path"),
                F.concat("chain", F.array("_next")).alias("chain"),
            )
        )
        if frontier.isEmpty():
            break
        found = found.union(frontier)
    first = found.groupBy("schema_id", "cls", "owner").agg(F.min("path").alias("path"))
    last = F.lit(2**31 - 1)
    return first.select("schema_id", "cls", "owner", F.concat("path", F.array(last)).alias("place"))


def inherited_fields(bases: DataFrame, fields: DataFrame) -> DataFrame:
    """(schema_id, cls, owner, field, pos): fields of all bases before the own ones, in the order of ``inheritance_order``.

    ``bases(schema_id, src, dst, pos)``: pos orders the bases of a class; ``fields(schema_id, cls, field, pos)``.
    """
    classes = fields.select("schema_id", "cls").union(bases.select("schema_id", F.col("src").alias("cls")))
    named = inheritance_order(bases, classes).join(
        fields.select("schema_id", F.col("cls").alias("owner"), "field", F.col("pos").alias("_own")),
        ["schema_id", "owner"],
    )
    ranked = F.row_number().over(Window.partitionBy("schema_id", "cls").orderBy("place", "_own"))
    return named.select("schema_id", "cls", "owner", "field", ranked.alias("pos"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """The k tables with most relations: (schema_id, node, n)."""
    both = edges.select("schema_id", F.col("src").alias("node")).union(edges.select("schema_id", F.col("dst").alias("node")))
    return both.groupBy("schema_id", "node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "schema_id", "node").limit(k)
