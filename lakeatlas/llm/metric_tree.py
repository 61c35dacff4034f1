"""Exact search for the greatest inner products in an M-tree.

Vectors of whole numbers get one more coordinate that brings all of them to the norm of the longest, and a query gets none:
then the greatest inner product is the least distance, and distances obey the triangle inequality. The tree is cut at its
top: rows go to the nearest of a bounded number of routing vectors, those of one routing vector are dealt onto as many
subtrees as keep each near ``rows`` rows, and each subtree is built in one task as pages. A page holds entries under one
routing vector: their vectors, their distance to it (the parent distance) and, above the leaves, the covering radius and the
page below each. Subtrees are rows of a table.

Queries search their nearest subtree first, which bounds their k-th score from below. Blocks of queries then meet only those
subtrees whose covering radius lets in some query of the block; in a subtree, the page nearest to any query comes first, and
of its entries the stored parent distances rule out what no query needs before any distance is computed.
"""

from __future__ import annotations

import dataclasses
import heapq
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept
from ._vectors import dot, packed_vectors, unpacked

LEAF, FAN = 64, 16
_SLACK = 1e-6  # of the longest vector's norm: what rounding of distances may add up to
_LEAST = -(1 << 63)


def _pack(arrays: list[np.ndarray]) -> bytes:
    head = [struct.pack("<B", len(arrays))]
    for a in arrays:
        head.append(struct.pack("<3sBqq", a.dtype.str.encode(), a.ndim, a.shape[0], a.shape[1] if a.ndim > 1 else 1))
    return b"".join(head) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    count, at, shapes, out = data[0], 1, [], []
    for _ in range(count):
        shapes.append(struct.unpack_from("<3sBqq", data, at))
        at += 20
    for kind, dims, n, m in shapes:
        a = np.frombuffer(data, kind.decode(), n * m, at)
        at += a.nbytes
        out.append(a.reshape(n, m) if dims > 1 else a)
    return out


def _small(x: np.ndarray) -> np.ndarray:
    """In the least width that holds all entries."""
    for w in (1, 2, 4):
        if not x.size or -(1 << 8 * w - 1) <= x.min() and x.max() < 1 << 8 * w - 1:
            return x.astype(f"<i{w}")
    return x.astype("<i8")


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """With the coordinate that brings each vector to the norm ``longest`` ** 0.5."""
    f = x.astype(np.float64)
    return np.concatenate([f, np.sqrt(np.maximum(0, longest - (f * f).sum(1)))[:, None]], 1)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of lifted vectors."""
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T))


def build_pages(x: np.ndarray, ids: np.ndarray, top: np.ndarray, longest: float) -> tuple[list[bytes], float]:
    """The pages of a subtree over the rows ``x`` under the routing vector ``top``, the root first, and its covering radius."""
    lifted = _lift(x, longest)
    pages: list[bytes] = []

    def add(rows: np.ndarray, routing: np.ndarray) -> tuple[int, float]:
        far = _between(lifted[rows], routing[None])[:, 0]
        place = len(pages)
        pages.append(b"")
        if len(rows) <= LEAF:
            order = np.argsort(far, kind="stable")
            pages[place] = _pack([_small(x[rows[order]]), far[order], ids[rows[order]]])
            return place, float(far.max(initial=0))
        fan = min(FAN, math.ceil(len(rows) / LEAF))
        chosen = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
        near = _between(lifted[rows], lifted[chosen]).argmin(1)
        if np.bincount(near).max() == len(rows):  # the routing vectors tell nothing apart
            near = np.arange(len(rows)) % fan
        below = [(c, *add(rows[near == k], lifted[c])) for k, c in enumerate(chosen) if (near == k).any()]
        picked = np.array([b[0] for b in below])
        radius = np.array([b[2] for b in below])
        pages[place] = _pack([_small(x[picked]), _between(lifted[picked], routing[None])[:, 0], radius, np.array([b[1] for b in below], "<i8")])
        return place, float(far.max(initial=0))

    _, radius = add(np.arange(len(x)), _lift(top[None], longest)[0])
    return pages, radius


class Block:
    """Queries that search together, each with its ``k`` best so far."""

    def __init__(self, x: np.ndarray, least: np.ndarray, k: int, longest: float):
        self.x, self.k, self.longest = x, k, longest
        self.norms = (x.astype(np.float64) ** 2).sum(1)
        self.least = least  # scores below these play no part
        self.scores = np.full((len(x), k), _LEAST, np.int64)
        self.ids = np.full((len(x), k), (1 << 63) - 1, np.int64)
        self.slack = _SLACK * math.sqrt(longest + self.norms.max(initial=0)) + 1e-9
        self.computed = 0

    def reach(self, who: np.ndarray) -> np.ndarray:
        """The distance at which a vector still has the k-th score."""
        score = np.maximum(self.least[who], self.scores[who, -1]).astype(np.float64)
        open_ended = score <= _LEAST
        found = np.sqrt(np.maximum(0, self.norms[who] + self.longest - 2 * np.where(open_ended, 0, score)))
        return np.where(open_ended, np.inf, found) + self.slack

    def distances(self, who: np.ndarray, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.norms[who][:, None] + self.longest - 2 * products.astype(np.float64)))

    def offer(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take what is among the k best: greater scores first, then smaller ids. Entries of ``scores`` at _LEAST don't count."""
        better = (scores >= np.maximum(self.least[who], self.scores[who, -1])[:, None]) & (scores > _LEAST)
        rows = np.flatnonzero(better.any(1))
        if not len(rows):
            return
        columns = better[rows].any(0)
        s, who = np.where(better[rows], scores[rows], _LEAST)[:, columns], who[rows]
        i = np.where(s > _LEAST, ids[columns][None], (1 << 63) - 1)
        s, i = np.concatenate([self.scores[who], s], 1), np.concatenate([self.ids[who], i], 1)
        by = np.lexsort((i, ~s), axis=1)[:, : self.k]  # ~s falls as s rises, for any 64-bit number
        self.scores[who], self.ids[who] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)

    def found(self):
        """(query, id, score), each once."""
        who, at = np.nonzero(self.scores > _LEAST)
        return who, self.ids[who, at], self.scores[who, at]


def _clipped(products: np.ndarray) -> np.ndarray:
    if products.dtype != object:
        return products
    return np.clip(products, _LEAST + 1, (1 << 63) - 1).astype(np.int64)


def search_pages(block: Block, who: np.ndarray, far: np.ndarray, radius: float, pages: list) -> None:
    """Best first: of the pages in hand, that which lies nearest to some query. ``far``: distances of the queries ``who`` to the
    root's routing vector, ``radius``: the root's covering radius. ``pages`` are opened when their turn comes."""
    heap = [(float((far - radius).min(initial=0)), 0, who, far, radius)]
    while heap:
        _, page, who, far, radius = heapq.heappop(heap)
        reach = block.reach(who)
        live = far - radius <= reach
        if not live.any():
            continue
        who, far, reach = who[live], far[live], reach[live]
        vectors, parent, *rest = _unpack(pages[page].as_py() if hasattr(pages[page], "as_py") else pages[page])
        cover = rest[0] if len(rest) == 2 else 0
        wanted = np.abs(far[:, None] - parent[None]) - cover <= reach[:, None]
        columns, rows = wanted.any(0), wanted.any(1)
        if not columns.any():
            continue
        who, wanted = who[rows], wanted[rows][:, columns]
        products = dot(block.x[who], vectors[columns].astype(np.int64))
        block.computed += products.size
        if len(rest) == 1:
            block.offer(who, np.where(wanted, _clipped(products), _LEAST), rest[0][columns])
            continue
        away = block.distances(who, products)
        for j, at in enumerate(np.flatnonzero(columns).tolist()):
            own = wanted[:, j] & (away[:, j] - cover[at] <= reach[rows])
            if own.any():
                d = away[own, j]
                heapq.heappush(heap, (float((d - cover[at]).min()), int(rest[1][at]), who[own], d, float(cover[at])))


@dataclasses.dataclass
class MetricTree:
    """``table`` has a row for each subtree: subtree, top (its routing vector's number), radius, n, pages. ``cuts``: on how many
    subtrees each routing vector's rows are dealt; ``first``: the number of the first of them."""

    table: DataFrame
    dims: int
    longest: float
    tops: np.ndarray
    cuts: list[int]
    copies: int

    @property
    def first(self) -> list[int]:
        return [0, *np.cumsum(self.cuts).tolist()]

    def placed(self, rows: DataFrame, columns: str) -> DataFrame:
        """``rows`` (id, key and others) with the number of the nearest routing vector, ``top``."""
        return _nearest(rows, self.tops, self.longest, columns)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` (id, top and others) with ``subtree`` for ``top``. The routing vectors are few, by ``build_tree``'s bound."""
        spark = rows.sparkSession
        numbers = spark.createDataFrame([(t, f, c) for t, (f, c) in enumerate(zip(self.first, self.cuts, strict=False))], "top int, first bigint, cuts bigint")
        own = F.col("first") + F.pmod(F.xxhash64("id"), "cuts")
        return rows.join(F.broadcast(numbers), "top").withColumn("subtree", own).drop("top", "first", "cuts")


def _nearest(rows: DataFrame, tops: np.ndarray, longest: float, columns: str) -> DataFrame:
    lifted = _lift(tops, longest)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                near = _between(_lift(unpacked(part.column("key").to_pylist(), tops.shape[1]), longest), lifted).argmin(1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(near.astype(np.int32))], names=[*names, "top"])

    return rows.select(*names).mapInArrow(run, f"{columns}, top int")


def build_tree(vectors: DataFrame, copies: int, pivots: int = 1024, rows: int = 4096) -> MetricTree | None:
    """Index ``vectors`` (id, key, dims); None where there are none with an id.

    Of equal vectors those of the ``copies`` least ids are kept, which is all that a search for so many can return. ``pivots``
    bounds how many routing vectors stand at the top (those of the least hashes), ``rows`` is about how many entries a subtree
    holds. Every row is indexed: both numbers set how well pages keep together and not what is found.
    """
    own = vectors.where("id is not null").select("id", "key", "dims").distinct()
    own = own.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("copy") <= copies)
    own = kept(own, "metric_tree_rows")
    n, dims = own.agg(F.count("*"), F.max("dims")).first()
    if not n:
        return None

    def norms(batches):
        for b in batches:
            keys = b.column("key").to_pylist()
            most = [float((unpacked(keys[i : i + 2048], dims).astype(np.float64) ** 2).sum(1).max()) for i in range(0, len(keys), 2048)]
            yield pa.RecordBatch.from_arrays([pa.array(most, pa.float64())], names=["norm"])

    distinct = own.where("copy = 1").select("key")
    longest = float(distinct.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0])
    sample = distinct.orderBy(F.xxhash64("key"), "key").limit(min(pivots, math.ceil(n / rows))).collect()
    tops = unpacked([bytes(r.key) for r in sample], dims)
    placed = kept(_nearest(own, tops, longest, "id bigint, key binary"), "metric_tree_placed")
    counts = dict(map(tuple, placed.groupBy("top").count().collect()))
    cuts = [max(1, math.ceil(counts.get(t, 0) / rows)) for t in range(len(tops))]
    tree = MetricTree(own, dims, longest, tops, cuts, copies)
    first = np.array(tree.first)

    def build(t: pa.Table) -> pa.Table:
        subtree = t.column("subtree")[0].as_py()
        top = int(np.searchsorted(first, subtree, "right")) - 1
        order = pa.compute.sort_indices(t, [("id", "ascending"), ("key", "ascending")])  # whatever order the rows came in
        t = t.take(order)
        pages, radius = build_pages(unpacked(t.column("key").to_pylist(), dims), t.column("id").to_numpy(), tops[top], longest)
        return pa.table({"subtree": [subtree], "top": pa.array([top], pa.int32()), "radius": [radius], "n": [t.num_rows], "pages": pa.array([pages], pa.list_(pa.binary()))})

    grouped = tree.dealt(placed).groupBy("subtree")
    tree.table = kept(grouped.applyInArrow(build, "subtree bigint, top int, radius double, n bigint, pages array<binary>"), "metric_tree")
    return tree


_ASKED = "query bigint, key binary, least bigint"
_FOUND = "query bigint, id bigint, score bigint"


def _blocks(batches, most: int, names: tuple[str, ...]):
    """Rows of a ``subtree`` that follow one another, packed into one row of lists, ``most`` at a time."""
    held: list[list] = [[] for _ in names]
    at = None

    def flush():
        arrays = [pa.array([at], pa.int64()), *(pa.array([h]) for h in held)]
        arrays[1:] = [pa.array([h], pa.list_(pa.binary() if n == "key" else pa.int64())) for n, h in zip(names, held, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["subtree", *names])

    for b in batches:
        own = [b.column(n).to_pylist() for n in names]
        for i, s in enumerate(b.column("subtree").to_pylist()):
            if held[0] and (s != at or len(held[0]) >= most):
                yield flush()
                held = [[] for _ in names]
            at = s
            for h, o in zip(held, own, strict=True):
                h.append(o[i])
    if held[0]:
        yield flush()


def _searched(pairs: DataFrame, tree: MetricTree, k: int, more: bool) -> DataFrame:
    """(query, id, score) of the ``k`` best of each query in its row's subtree; with ``more`` a row (query, null, least score that
    still counts) for each query too."""
    dims, longest, tops = tree.dims, tree.longest, tree.tops

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r] for c in b.schema.names}
                x = unpacked(one["key"].as_py(), dims)
                asked = np.array(one["query"].as_py(), np.int64)
                block = Block(x, np.array(one["least"].as_py(), np.int64), k, longest)
                who = np.arange(len(x))
                far = block.distances(who, dot(x, tops[one["top"].as_py()][None]))[:, 0]
                search_pages(block, who, far, one["radius"].as_py(), one["pages"].values)
                at, ids, scores = block.found()
                columns = [asked[at], ids, scores]
                if more:
                    columns = [np.concatenate([c, d]) for c, d in zip(columns, [asked, np.zeros_like(asked), block.scores[:, -1]], strict=True)]
                null = np.arange(len(columns[0])) >= len(at)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=null), pa.array(columns[2])], names=["query", "id", "score"])

    return pairs.select("query", "key", "least", "top", "radius", "pages").mapInArrow(run, _FOUND)


def _routed(blocks: DataFrame, tree: MetricTree, roots_a_row: int = 4096, broadcast_rows: int = 64) -> DataFrame:
    """Which queries of each block some subtree other than the block's own could answer: (subtree, query, key, least)."""
    dims, longest, tops = tree.dims, tree.longest, tree.tops
    count = max(1, math.ceil(tree.first[-1] / roots_a_row))
    roots = tree.table.groupBy(F.floor(F.col("subtree") / roots_a_row).alias("part")).agg(F.collect_list(F.struct("subtree", "top", "radius")).alias("roots"))
    blocks = blocks.withColumnRenamed("subtree", "home").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>")))
    pairs = blocks.join(F.broadcast(roots) if count <= broadcast_rows else roots, "part")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                one = {c: b.column(c)[r] for c in b.schema.names}
                keys, asked, least = (one[c].as_py() for c in ("key", "query", "least"))
                block = Block(unpacked(keys, dims), np.array(least, np.int64), 1, longest)
                who = np.arange(len(keys))
                reach = block.reach(who)
                far = block.distances(who, dot(block.x, tops))
                for s in one["roots"].as_py():
                    if s["subtree"] == one["home"].as_py():
                        continue
                    wanted = np.flatnonzero(far[:, s["top"]] - s["radius"] <= reach).tolist()
                    if wanted:
                        lists = [pa.array([[v[i] for i in wanted]], pa.list_(kind)) for v, kind in ((asked, pa.int64()), (keys, pa.binary()), (least, pa.int64()))]
                        yield pa.RecordBatch.from_arrays([pa.array([s["subtree"]], pa.int64()), *lists], names=["subtree", "query", "key", "least"])

    return pairs.mapInArrow(run, "subtree bigint, query array<bigint>, key array<binary>, least array<bigint>")


def nearest_by_product(tree: MetricTree | None, queries: DataFrame, k: int, block: int = 512) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each distinct row of ``queries`` (id, key) its ``k`` greatest inner products with
    the indexed vectors of other ids, ties to the smaller id.

    Equal query vectors are searched once, for one more than ``k``, and each id leaves itself out. Scores beyond 64 bits count
    as the greatest or least such number. Vectors shorter than the longest one count as padded by zeros.
    """
    spark = queries.sparkSession
    if tree is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if tree.copies <= k:
        raise ValueError("the tree must keep more copies than a search returns")
    queries = queries.where("id is not null").select("id", "key").distinct()
    asked = queries.groupBy("key").agg(F.min("id").alias("id"))
    # Two vectors of one id are two queries: their number is the id's, made different by the vector's hash.
    asked = asked.select(F.xxhash64("id", "key").alias("query"), "id", "key")
    homes = tree.dealt(tree.placed(asked, "query bigint, id bigint, key binary"))
    homes = homes.repartition("subtree").sortWithinPartitions("subtree", "query")
    pack = homes.select("subtree", "query", "key", F.lit(_LEAST).alias("least"))
    lists = "subtree bigint, query array<bigint>, key array<binary>, least array<bigint>"
    packed = kept(pack.mapInArrow(lambda bs: _blocks(bs, block, ("query", "key", "least")), lists), "metric_tree_queries")
    first = kept(_searched(packed.join(tree.table, "subtree"), tree, k + 1, more=True), "metric_tree_first")
    least = first.where("id is null").select("query", F.col("score").alias("least"))
    again = packed.select("subtree", F.explode(F.arrays_zip("query", "key")).alias("q")).select("subtree", "q.query", "q.key").join(least, "query")
    again = again.repartition("subtree").sortWithinPartitions("subtree", "least", "query").select("subtree", "query", "key", "least")
    blocks = again.mapInArrow(lambda bs: _blocks(bs, block, ("query", "key", "least")), lists)
    routed = kept(_routed(blocks, tree), "metric_tree_routed")
    # Files hold a query that is sent to many subtrees once, memory holds it for each: by its files the table would pass for small
    # enough to go through the driver.
    second = _searched(routed.hint("merge").join(tree.table, "subtree"), tree, k + 1, more=False)
    every = first.where("id is not null").union(second)
    best = every.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("place") <= k + 1)
    answers = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    answers = packed.select(F.explode(F.arrays_zip("query", "key")).alias("q")).select("q.query", "q.key").join(answers, "query").select("key", "found")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    named = queries.withColumnRenamed("id", "query_id").join(answers, "key")
    out = named.select("query_id", F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


def search_embeddings(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 1024, rows: int = 4096) -> DataFrame:
    """The ``k`` greatest inner products of each vector whose vec_id is divisible by ``every`` with all others, floor(``scale`` * x)
    standing for entry x.

    Vectors that are null or hold a null or an entry that is not finite take no part, nor do rows without an id, which could
    not be named. Repeated rows are one; a query's id is left out of its own answers, whatever vectors it has. Other columns
    play no part. Entries of 2 ** 62 / ``scale`` and more count as infinite. An empty table gives no rows.
    """
    vectors = kept(packed_vectors(df, "vec_id", "embedding", scale), "metric_tree_vectors")
    tree = build_tree(vectors, k + 1, pivots, rows)
    return nearest_by_product(tree, vectors.where(F.col("id") % every == 0), k)
