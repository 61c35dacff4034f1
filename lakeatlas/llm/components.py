"""Connected components of a graph given as an edge table, by repeated contraction.

Each round every vertex moves to the least vertex among itself and its neighbours, and edges are carried over to the new
vertices; edges inside one vertex vanish. Vertices are hashes, so that the graph shrinks by a constant factor a round.
Minima combine before the shuffle, so a vertex with very many edges costs no task more than its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)`` for every vertex that has an edge to another one.

    Self edges, repeated edges and edges with a null end say nothing and are left out. No edges: no rows. The component
    is the value of one of its vertices.
    """
    edges = edges.select("a", "b").where("a <> b").distinct()
    labels = None
    while True:
        edges = kept(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = kept(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("to")), "moved")
        if labels is None:
            labels = moved.select(F.col("v").alias("node"), F.col("to").alias("component"))
        else:
            labels = labels.join(moved, F.col("component") == F.col("v"), "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = kept(labels, "labels")
        to_a = moved.select(F.col("v").alias("a"), F.col("to").alias("na"))
        to_b = moved.select(F.col("v").alias("b"), F.col("to").alias("nb"))
        edges = edges.join(to_a, "a").join(to_b, "b").where("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
