"""N-gram Jaccard self join by a token-group matrix.

Which texts link: the Jaccard likeness of their sets of word shingles is at least ``percent`` / 100. The join is exact
(on 64-bit hashes of shingles and of sets), and yields the connected components rather than all pairs:

1. A set can link only if ``percent`` of its shingles occur in further texts. Shingles are counted over all texts: tasks
   sort them into packs by hash range, a range's task marks those that come more than once, and the marks are summed up
   by text. Shingles are cut to 48 bits for this, and copies count as further texts; both let sets through that link
   with nothing, but hold none back that link.
2. The sets that are left are cut, by the range of their shingle hashes, into more parts than the number d of shingles in
   which a linked pair can differ. Linked sets therefore agree in all parts but d (pigeonhole), and in one that is not
   empty if either has more than d such parts; a set that has not also counts its empty ones. The parts that sets agree in
   are the tokens of the matrix: rare and selective even where texts share passages.
3. Inside each token's postings every set is compared with the least of them only (first inside a task, then over all),
   so a token of a third of all texts costs one comparison a text. The links found give components. Sets that share
   tokens are put into *groups* of about ``group_size`` shingles; each group has the union of its members' tokens.
4. What this leaves open are tokens that sets of different components share. There each set is a query on the groups that
   hold the token and a larger component. A linked pair has all of the query's tokens in common but d, so a group is
   opened only if its union holds as many; the query is compared with the members of other components in it. A token
   that m sets without links share costs m bounds for each of their groups; no pairs of sets are made.
5. The components of all links are the result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept, map_arrow, parts, slices, text_or_empty, texts_of
from ._words import U, mix, pack_planes, set_hash, shingle_set, unpack_planes, word_hashes
from .components import components

#: Entries that a task holds before it packs them, and about as many as one range of hashes gets.
FLUSH = 600_000
RANGE = 2_000_000
#: About as many shingles of sets that share tokens as one range of tokens gets; a set has fewer tokens than shingles.
TOKENS = 1_500_000


class Parts:
    """How sets of each size are cut; see the module's first step."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("percent must be in 1..100")
        self.percent = percent
        self.starts = [1, 2]
        self.bounds: dict[int, np.ndarray] = {}

    def most(self, k: int) -> int:
        """In how many shingles sets can differ that link, the smaller one of class k."""
        least = self.starts[k + 1] - 1
        return (100 - self.percent) * (least + least * 100 // self.percent) // (100 + self.percent)

    def _cut(self, shingles: np.ndarray, most: int, tag: int) -> tuple[np.ndarray, int]:
        n = most + 1 + (3 * most + 19) // 20 + 2
        if n not in self.bounds:
            self.bounds[n] = (np.arange(1, n, dtype=U) * U(((1 << 64) - 1) // n)).astype(U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(shingles ^ U(0xD1B54A32D192ED03)))])
        at = np.concatenate([[0], np.searchsorted(shingles, self.bounds[n]), [len(shingles)]])
        found = mix(sums[at[1:]] - sums[at[:-1]] + mix(np.arange(n, dtype=U) + U(tag << 40)))
        full = at[1:] > at[:-1]
        if full.sum() > most:  # all but ``most`` of them are the other set's too, which has them whether it leaves out any or not
            return found[full], int(full.sum()) - most
        return found, 1

    def cuts(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """A set's tokens with how many of them a linked set has at least: as the smaller one of a pair under its own
        class, then as the larger under that below."""
        while self.starts[-1] <= len(shingles):
            self.starts.append(self.starts[-1] * 100 // self.percent + 1)
        k = bisect_right(self.starts, len(shingles)) - 1
        for c in (k, k - 1):
            if c >= 0:
                yield self._cut(shingles, self.most(c), c)

    def tokens(self, shingles: np.ndarray) -> np.ndarray:
        return np.concatenate([x for x, _ in self.cuts(shingles)])


def _sets(texts, width: int) -> Iterator[np.ndarray]:
    """The sets of lower-cased texts."""
    for words in word_hashes(texts):
        yield shingle_set(words, width)


def document_sets(docs: DataFrame, width: int, columns: list[str]) -> DataFrame:
    """``columns`` of each row with n_shingles and node, the hash of its set; null and empty texts have no shingles and a
    null node. Repeated rows stay, an empty table gives no rows; a column named n_shingles or node can't be taken along."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [(len(s), set_hash(s) if len(s) else None) for s in _sets(texts_of(batch, "_la_whole", lower=True), width)]
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())]

    return map_arrow(docs.select(*columns, text_or_empty().alias("_la_whole")), run, "n_shingles long, node long", drop=("_la_whole",))


# -- sets with enough shingles in further texts

_COUNT = "bucket long, pack long, kind long, entries long, x binary, y binary"


def promising(docs: DataFrame, width: int, percent: int, total: int) -> DataFrame:
    """Distinct (node) of which ``percent`` of the shingles occur in more than one text; ``total`` shingles are expected.

    A pack has at most one row for each range of hashes, and never more rows than shingles.
    """
    buckets = max(2 * parts(docs), -(-total // RANGE))
    bounds = np.arange(1, buckets, dtype=U) * U((1 << 48) // buckets)

    def emit(held: dict[int, np.ndarray]):
        nodes = np.fromiter(held, np.int64, len(held))
        sizes = np.array([len(s) for s in held.values()], np.int64)
        pack = set_hash(nodes.view(U))
        keys = np.sort(np.concatenate(list(held.values())) >> U(16) << U(16) | np.repeat(np.arange(len(held), dtype=U), sizes))
        out = [(pack % buckets, pack, 0, len(keys), nodes.tobytes(), sizes.tobytes())]
        at = np.concatenate([[0], np.searchsorted(keys, bounds << U(16)), [len(keys)]])
        for p in np.flatnonzero(at[1:] > at[:-1]):
            own = keys[at[p] : at[p + 1]]
            out.append((int(p), pack, 1, len(own), pack_planes(np.diff(own >> U(16), prepend=U(0))), pack_planes(own.astype(np.uint16))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _COUNT.split(", ")])

    def run(batches):
        held, size = {}, 0
        for b in slices(batches):
            for s in _sets(texts_of(b, "text", lower=True), width):
                if len(s) and (h := set_hash(s)) not in held:
                    held[h] = s
                    size += len(s)
                    if size >= FLUSH or len(held) == 1 << 16:
                        yield pa.RecordBatch.from_pandas(emit(held))
                        held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pandas(emit(held))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each pack, its texts (by number) that have shingles of this range in common with others, and how many."""
        own = pdf[pdf["kind"] == 1]
        done = pdf[pdf["kind"] == 0]
        if len(own):
            n = own["entries"].to_numpy()
            values = np.concatenate([np.cumsum(unpack_planes(x, np.uint64), dtype=U) for x in own["x"]])
            texts = np.concatenate([unpack_planes(x, np.uint16) for x in own["y"]]).astype(np.int64) | np.repeat(np.arange(len(n)), n) << 16
            order = np.argsort(values)
            same = values[order]
            same = same[1:] == same[:-1]
            shared = np.zeros(len(order), bool)
            shared[order[1:]] = same
            shared[order[:-1]] |= same
            text, times = np.unique(texts[shared], return_counts=True)
            at = np.searchsorted(text >> 16, np.arange(len(n) + 1))
            marks = [((text[i:j] & 0xFFFF).astype(np.uint16).tobytes(), times[i:j].astype(np.uint32).tobytes()) for i, j in zip(at, at[1:])]
            done = pd.concat([done, own.assign(x=[x for x, _ in marks], y=[y for _, y in marks])])
        return done

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        known, marks = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        if known["entries"].sum() != marks["entries"].sum():
            raise RuntimeError("the input's rows came in another order when a task was run again; write it to a table first")
        nodes = np.frombuffer(known["x"].iloc[0], np.int64)
        sizes = np.frombuffer(known["y"].iloc[0], np.int64)
        shared = np.zeros(len(nodes), np.int64)
        for x, y in zip(marks["x"], marks["y"]):
            shared[np.frombuffer(x, np.uint16)] += np.frombuffer(y, np.uint32)
        return pd.DataFrame({"node": nodes[100 * shared >= percent * sizes]})

    packed = docs.select(text_or_empty().alias("text")).mapInArrow(run, _COUNT)
    counted = packed.groupBy("bucket").applyInPandas(count, _COUNT)
    return counted.groupBy("pack").applyInPandas(judge, "node long").distinct()


# -- tokens


def _stars(tokens: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (node, least node of its token), and one (token, least node) for each token."""
    order = np.lexsort((nodes, tokens))
    tokens, nodes = tokens[order], nodes[order]
    first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    hubs = nodes[np.flatnonzero(first)][np.cumsum(first) - 1]
    linked = nodes != hubs
    pairs = np.unique(np.stack([nodes[linked], hubs[linked]]), axis=1) if linked.any() else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1], tokens[first], nodes[first]


_PACK = "bucket long, kind int, x binary, y binary"


def _packs(bucket, kind, x, y) -> pd.DataFrame:
    return pd.DataFrame({"bucket": bucket, "kind": kind, "x": x, "y": y})


def star_pairs(sets: DataFrame, cut: Parts) -> DataFrame:
    """Distinct (query, grp) of ``sets(node, shingles)`` which share a token: each set with the least one of the token."""
    buckets = 2 * parts(sets)

    def emit(tokens: list, nodes: list):
        a, b, token, hub = _stars(np.concatenate(tokens), np.concatenate(nodes))
        place = (token % U(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        token, hub, place = token[order], hub[order], place[order]
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        ends = np.append(at[1:], len(place))
        yield _packs(place[at], 0, [token[i:j].tobytes() for i, j in zip(at, ends)], [hub[i:j].tobytes() for i, j in zip(at, ends)])
        if len(a):  # pairs found here pass through, by bucket only so as to be spread
            places = np.arange(0, len(a), 20_000)
            yield _packs(
                (places // 20_000 + int(token[0] % U(buckets))) % buckets,
                1,
                [a[i : i + 20_000].tobytes() for i in places],
                [b[i : i + 20_000].tobytes() for i in places],
            )

    def run(batches):
        tokens, nodes, size = [], [], 0
        for batch in batches:
            for node, x in zip(batch["node"], batch["shingles"]):
                t = cut.tokens(np.frombuffer(x, U))
                tokens.append(t)
                nodes.append(np.full(len(t), node, np.int64))
                size += len(t)
                if size >= FLUSH:
                    yield from emit(tokens, nodes)
                    tokens, nodes, size = [], [], 0
        if size:
            yield from emit(tokens, nodes)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        own, done = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        a = [np.frombuffer(x, np.int64) for x in done["x"]]
        b = [np.frombuffer(x, np.int64) for x in done["y"]]
        if len(own):
            pa_, pb, _, _ = _stars(np.concatenate([np.frombuffer(x, U) for x in own["x"]]), np.concatenate([np.frombuffer(x, np.int64) for x in own["y"]]))
            a.append(pa_)
            b.append(pb)
        return pd.DataFrame({"query": np.concatenate(a), "grp": np.concatenate(b)})

    packed = sets.select("node", "shingles").mapInPandas(run, _PACK)
    return packed.groupBy("bucket").applyInPandas(meet, "query long, grp long").distinct()


_MEMBER = np.dtype([("node", np.int64), ("component", np.int64), ("size", np.int64), ("grp", np.int64), ("need", np.int64)])


def _bounded(tokens: np.ndarray, owner: np.ndarray, members: np.ndarray, step: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(member, grp, number of tokens): how many of a member's tokens here are in a group, in sets of a larger component.

    ``owner``: each token's row in ``members``. Larger is by size, then by name. A row may come in several pieces.
    """
    rank = np.empty(len(members), np.int64)
    order = np.lexsort((members["component"], members["size"]))
    c = members["component"][order]
    rank[order] = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]]))
    names, group = np.unique(members["grp"], return_inverse=True)
    order = np.lexsort((rank[owner], group[owner], tokens))
    tokens, owner = tokens[order], owner[order]
    new_token = np.concatenate([[True], tokens[1:] != tokens[:-1]])
    new_group = new_token | np.concatenate([[True], group[owner][1:] != group[owner][:-1]])
    first = np.flatnonzero(new_group)  # a token's groups, each with the largest component in it
    most = rank[owner[np.append(first[1:], len(owner)) - 1]]
    of_token = np.cumsum(new_token) - 1
    begin = np.flatnonzero(new_token[first])
    n_groups = np.diff(np.append(begin, len(first)))
    top = np.maximum.reduceat(most, begin) if len(begin) else most
    asks = np.flatnonzero(rank[owner] < top[of_token])
    work = np.cumsum(n_groups[of_token[asks]])
    at = 0
    while at < len(asks):  # so many queries at a time that their groups are about ``step``
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + step)))
        own = asks[at:end]
        n = n_groups[of_token[own]]
        where = np.repeat(begin[of_token[own]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        who = np.repeat(owner[own], n)
        good = most[where] > rank[who]
        pairs, count = np.unique(who[good] * len(names) + group[owner[first[where[good]]]], return_counts=True)
        yield pairs // len(names), names[pairs % len(names)], count
        at = end


def open_groups(sets: DataFrame, labels: DataFrame, cut: Parts) -> DataFrame:
    """Distinct (query, grp): groups whose union of tokens holds enough of a query's, in sets of a larger component.

    ``labels(node, component, size, grp)``; a query reaches its bound under one of its two classes.
    """
    # as few ranges of tokens as tasks can hold, for a query and a group meet in each range anew
    total = labels.join(sets.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // TOKENS))

    def emit(members: list, tokens: list):
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        token = np.concatenate(tokens)
        place = (token % U(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, all_ = place[order], np.array(members, _MEMBER)
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rows = []
        for i, j in zip(at, np.append(at[1:], len(place))):
            some, own = np.unique(owner[order[i:j]], return_inverse=True)
            rows.append((int(place[i]), all_[some].tobytes(), token[order[i:j]].tobytes(), own.astype(np.uint32).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "members", "tokens", "owner"])

    def run(batches):
        members, tokens, size = [], [], 0
        for b in batches:
            for node, component, n, grp, x in zip(b["node"], b["component"], b["size"], b["grp"], b["shingles"]):
                for t, need in cut.cuts(np.frombuffer(x, U)):
                    members.append((node, component, n, grp, need))
                    tokens.append(t)
                    size += len(t)
                if size >= FLUSH:
                    yield emit(members, tokens)
                    members, tokens, size = [], [], 0
        if size:
            yield emit(members, tokens)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, _MEMBER) for x in pdf["members"]]
        before = np.cumsum([0] + [len(x) for x in held])
        owner = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + n for x, n in zip(pdf["owner"], before)])
        members = np.concatenate(held)
        found = list(_bounded(np.concatenate([np.frombuffer(x, U) for x in pdf["tokens"]]), owner, members))
        who, grp, n = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
        return pd.DataFrame({"query": members["node"][who], "grp": grp, "need": members["need"][who], "n": n})

    labelled = labels.join(sets, "node").select("node", "component", "size", "grp", "shingles")
    packed = labelled.mapInPandas(run, "bucket long, members binary, tokens binary, owner binary")
    counts = packed.groupBy("bucket").applyInPandas(meet, "query long, grp long, need long, n long")
    # the two classes of a set have tokens of their own; where they need as many, counting them together loses nothing
    enough = counts.groupBy("query", "grp", "need").agg(F.sum("n").alias("n")).where("n >= need")
    return enough.select("query", "grp").distinct()


class _Group:
    """An opened group: its members' sets, and their union with who has each shingle."""

    def __init__(self, members: list[tuple[int, int, bytes]], percent: int):
        self.percent = percent
        sets = [np.frombuffer(x, U) for _, _, x in members]
        self.nodes = np.array([n for n, _, _ in members], np.int64)
        self.components = np.array([c for _, c, _ in members], np.int64)
        self.sizes = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.union, self.first = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.first[1:], len(flat))

    def links(self, component: int, q: np.ndarray) -> np.ndarray:
        """The members of other components that the query links with."""
        fits = (100 * np.minimum(self.sizes, len(q)) >= self.percent * np.maximum(self.sizes, len(q))) & (self.components != component)
        if not fits.any():
            return self.nodes[:0]
        at = np.minimum(np.searchsorted(self.union, q), len(self.union) - 1)
        at = at[self.union[at] == q]
        if 100 * len(at) < self.percent * len(q):
            return self.nodes[:0]
        n = self.ends[at] - self.first[at]
        where = np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        both = np.bincount(self.owner[where], minlength=len(self.sizes))
        return self.nodes[fits & (100 * both >= self.percent * (self.sizes + len(q) - both))]


def opened(openings: DataFrame, members: DataFrame, sets: DataFrame, percent: int, share: int = 512) -> DataFrame:
    """Links (a, b) of queries with members of other components, for ``openings(query, grp)`` and ``members(node,
    component, grp)``. The queries of a group go to as many tasks as they are times ``share``, its members to each."""
    asked = openings.groupBy("grp").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))
    of = members.select("node", "component").distinct()
    queries = openings.join(of, F.col("query") == F.col("node")).join(sets, "node").join(asked, "grp")
    queries = queries.select("grp", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), F.lit(1).alias("side"), "node", "component", "shingles")
    held = members.join(asked, "grp").join(sets, "node").select(
        "grp",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(0).alias("side"),
        "node",
        "component",
        "shingles",
    )

    def run(batches):
        key, waiting, group = None, [], None
        for b in batches:
            found_a, found_b = [], []
            for grp, salt, side, node, component, x in zip(b["grp"], b["salt"], b["side"], b["node"], b["component"], b["shingles"]):
                if (grp, salt) != key:
                    key, waiting, group = (grp, salt), [], None
                if side == 0:
                    waiting.append((node, component, x))
                    continue
                if group is None:
                    group = _Group(waiting, percent)
                links = group.links(component, np.frombuffer(x, U))
                found_a.append(np.full(len(links), node, np.int64))
                found_b.append(links)
            if found_a:
                yield pd.DataFrame({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    rows = held.union(queries).repartition("grp", "salt").sortWithinPartitions("grp", "salt", "side")
    return rows.mapInPandas(run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, width: int = 3, percent: int = 90, group_size: int = 1 << 18, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Link near duplicates among ``docs(doc_id, text, ...)``.

    Returns per row: ``keys``, n_shingles (size of its set) and component_id, the smallest doc_id that links reach from
    it, itself included; also node, the hash of its set, and component, a hash that names the component. Repeated rows, and
    different doc_ids with equal sets, link as any others do. A null or empty text and one without words has no shingles and links with nothing: its component_id
    is its own doc_id. A null doc_id is never the smallest one: component_id is null only where all of a component are.
    Further columns of ``docs`` are not looked at.
    """
    cut = Parts(percent)
    docs = docs.select(*dict.fromkeys(["doc_id", *keys]), "text").withColumn("_la_hash_of_text", F.xxhash64(text_or_empty()))
    rows = kept(document_sets(docs, width, list(dict.fromkeys(["doc_id", *keys, "_la_hash_of_text"]))), "sets")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    some = kept(promising(docs, width, percent, total), "promising")
    sets = kept(_texts_of(docs, rows, some, width), "shingles")

    pairs = kept(star_pairs(sets, cut), "pairs")
    hubs = pairs.select(F.explode(F.array("query", "grp")).alias("node")).distinct().select(
        "node",
        F.col("node").alias("component"),
        F.col("node").alias("grp"),
    )
    links = kept(opened(pairs, hubs, sets, percent), "links")
    first = components(links)

    near = components(pairs.select(F.col("query").alias("a"), F.col("grp").alias("b")))
    labels = near.join(first.withColumnRenamed("component", "own"), "node", "left").select(
        "node",
        F.coalesce("own", "node").alias("component"),
        F.col("component").alias("cluster"),
    ).join(sets.select("node", "n"), "node")
    labels = kept(_groups(labels, group_size), "groups")
    openings = kept(open_groups(sets, labels, cut), "openings")
    if openings.isEmpty():
        final = first
    else:
        final = components(links.union(opened(openings, labels, sets, percent)))

    of = nodes.join(final, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    of = kept(of, "of")
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(least, "component").select("node", "component_id", "component")
    return rows.join(named, "node", "left").select(
        *keys,
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "node",
        "component",
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: of the least doc_id, and of the least hash of text where that is shared.

    Of equal rows one stays. Texts without words are components of their own, and so stay, each text once for a doc_id.
    All columns are kept; of rows that differ in other columns only, one is taken.
    """
    named = docs.withColumn("_la_text", F.xxhash64(text_or_empty()))
    found = ngram_jaccard_join(named.select("doc_id", "text", "_la_text"), width, percent, keys=("doc_id", "_la_text"))
    lone = F.col("node").isNull()
    group = F.when(lone, F.xxhash64("doc_id", "_la_text")).otherwise(F.col("component"))
    best = F.min_by(F.struct("doc_id", "_la_text"), F.struct(F.col("doc_id").isNull(), "doc_id", "_la_text"))
    chosen = kept(
        found.groupBy(lone.alias("lone"), group.alias("group")).agg(best.alias("best")).select(
            F.col("best.doc_id").alias("_la_id"),
            F.col("best._la_text").alias("_la_hash"),
        ).distinct(),
        "chosen",
    )
    same = F.col("doc_id").eqNullSafe(F.col("_la_id")) & (F.col("_la_text") == F.col("_la_hash"))
    left = named.join(chosen, same, "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "_la_text").orderBy(F.lit(0)))
    return left.withColumn("_la_first", first).where("_la_first = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def _groups(labels: DataFrame, group_size: int) -> DataFrame:
    """(node, component, size, grp) of ``labels(node, component, cluster, n)``: groups of similar sets with about
    ``group_size`` shingles, so that a task holds one whatever its sets' sizes. Large clusters of what shares tokens are cut,
    small ones put together; size is that of the component."""
    sizes = labels.groupBy("cluster").agg(F.sum("n").alias("in_cluster"))
    of = labels.groupBy("component").agg(F.count("*").alias("size"))
    few = max(1, (labels.agg(F.sum("n")).first()[0] or 0) // group_size)
    cut = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_cluster") / group_size)))
    grp = F.when(F.col("in_cluster") > group_size, cut).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(few)))
    return labels.join(sizes, "cluster").join(of, "component").select("node", "component", "size", grp.alias("grp"))


def _texts_of(docs: DataFrame, rows: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles) for the given nodes, from one document of each: its doc_id and the hash of its text say which, so that
    neither many copies nor many null doc_ids meet."""
    own = F.struct("doc_id", "_la_hash_of_text")
    holder = rows.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min_by(own, F.xxhash64("doc_id", "_la_hash_of_text")).alias("h")
    ).select("node", F.col("h.doc_id").alias("holder"), F.col("h._la_hash_of_text").alias("hash"))

    def run(batches):
        for b in slices(batches):
            found = [(set_hash(x) if len(x) else None, x) for x in _sets(texts_of(b, "text", lower=True), width)]
            good = [(h, x) for (h, x), wanted in zip(found, b.column("node").to_pylist()) if h == wanted]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in good], pa.int64()),
                    pa.array([len(x) for _, x in good], pa.int64()),
                    pa.array([x.tobytes() for _, x in good], pa.binary()),
                ],
                names=["node", "n", "shingles"],
            )

    same = F.col("doc_id").eqNullSafe(F.col("holder")) & (F.col("_la_hash_of_text") == F.col("hash"))
    texts = docs.select("doc_id", "_la_hash_of_text", text_or_empty().alias("text")).join(holder, same)
    return texts.select("node", "text").mapInArrow(run, "node long, n long, shingles binary").dropDuplicates(["node"])
