"""Trigram language model with deleted interpolation, trained on and applied to whole corpora.

P(w | u v) = l3(b) c(u, v, w) / c(u, v) + l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1), where b is the frequency
bucket of the longest context that occurs in training (the binary logarithm of its count; buckets of one-word contexts and
of no context are their own) and the weights of each bucket come from expectation maximisation on held-out counts: one
fold of the training texts whose own counts are taken out of the estimates.

The corpus is read once into packs of about ``pack_bytes`` of text. For each pack, the distinct n-grams (as hashes) go to
the range of the count table that holds them, and the counts come back to the pack; so a frequent word costs one entry a
pack, however often it occurs. Unigrams and bigrams go first. A trigram occurs no more often than either of its bigrams,
so afterwards only those go that their bigrams leave open: in a training text a bigram that comes once and is in no
held-out text tells that the trigram comes once, in a held-out text an unseen bigram tells that it is unseen. No part of
the model passes the driver but N, V and the table of weights. EM runs on a histogram of all held-out tokens over (bucket,
P3, P2, P1) in steps of a quarter of a binary digit, in a task for each bucket.

A pack has at most one row for each range, and never more rows than n-grams. Hashes of words have 64 bits, those of longer
n-grams 56.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, parts, slices, text_or_empty, texts_of
from ._words import U, mix, pack_planes, unpack_planes, word_hashes

END = np.array([0x1F83D9ABFB41BD6B], U)
START = np.array([0x5BE0CD19137E2179], U)
BUCKETS = 40
STEP = 4
ITERATIONS = 30
#: About as many n-grams as one range of the count table gets.
RANGE = 3_000_000

_PACK = "pack string, fold int, ids binary, nulls binary, sizes binary, body binary, tokens long"
_REQUEST = "bucket long, pack string, kind int, grams binary, counts binary, fold int"
#: Of a range's unigrams: tokens and distinct ones in training, and the same without fold 1.
STATS = ["n", "v", "n_other", "v_other"]
_ANSWER = "pack string, kind int, bucket long, counts binary, own binary, fold int" + "".join(f", {c} long" for c in STATS)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """Texts of one fold together: fold 0 is kept from training, fold 1 of training gives the weights."""

    def run(batches):
        import uuid

        held: dict[int, list[tuple[int, bool, bytes]]] = {}
        size: dict[int, int] = {}

        def flush(fold: int) -> pa.RecordBatch:
            ids, nulls, texts = zip(*held.pop(fold))
            size.pop(fold)
            body = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            tokens = sum(len(t) // 5 + 1 for t in texts)  # an estimate, for the number of ranges
            row = {
                "pack": uuid.uuid4().hex,
                "fold": fold,
                "ids": np.array(ids, np.int64).tobytes(),
                "nulls": np.array(nulls, bool).tobytes(),
                "sizes": np.array([len(t) for t in texts], np.int64).tobytes(),
                "body": body,
                "tokens": tokens,
            }
            return pa.RecordBatch.from_pylist(
                [row],
                schema=pa.schema(
                    [
                        ("pack", pa.string()),
                        ("fold", pa.int32()),
                        ("ids", pa.binary()),
                        ("nulls", pa.binary()),
                        ("sizes", pa.binary()),
                        ("body", pa.binary()),
                        ("tokens", pa.int64()),
                    ]
                ),
            )

        for b in slices(batches):
            ids, nulls = b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("doc_id").is_null().to_pylist()
            for i, null, fold, text in zip(ids.tolist(), nulls, b.column("fold").to_pylist(), texts_of(b, "text", lower=True)):
                held.setdefault(fold, []).append((i, null, text))
                size[fold] = size.get(fold, 0) + len(text) + 1
                if size[fold] >= pack_bytes:
                    yield flush(fold)
        for fold in list(held):
            yield flush(fold)

    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10
    fold = F.when(fold < 2, fold).otherwise(2).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), text_or_empty().alias("text")).mapInArrow(run, _PACK)


class _Text:
    """The tokens of a pack with the end token after each text, and the n-grams that end at each of them."""

    def __init__(self, sizes: bytes, body: bytes):
        n = np.frombuffer(sizes, np.int64)
        data = zstandard.ZstdDecompressor().decompress(body) if n.sum() else b""
        at = np.concatenate([[0], np.cumsum(n)])
        found, counts = [], []
        for words in word_hashes(data[i:j] for i, j in zip(at, at[1:])):
            found += [words, END]
            counts.append(len(words) + 1)
        self.n = np.array(counts, np.int64)
        self.begins = np.cumsum(self.n) - self.n
        self.tokens = np.concatenate(found)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.begins] = True
        self.bigrams = mix(mix(self.before(self.tokens, START[0])) + self.tokens)

    def before(self, x: np.ndarray, start) -> np.ndarray:
        """The value at the token before, and ``start`` at the first of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.begins] = start
        return out

    def grams(self, kind: int) -> np.ndarray:
        if kind == 1:
            return self.tokens
        if kind == 2:
            return self.bigrams >> U(8)
        return mix(mix(self.before(self.bigrams, START[0])) + self.tokens) >> U(8)

    def open(self, c2: np.ndarray, elsewhere: np.ndarray, fold: int) -> np.ndarray:
        """Which trigrams the counts of their bigrams leave open; ``elsewhere``: the bigram is in held-out texts too."""
        least = np.minimum(c2, self.before(c2, 0))
        if fold == 0:
            return ~self.first & (least > 0)
        return ~self.first & ((least > 1) | elsewhere & self.before(elsewhere, False))


def _narrow(x: np.ndarray) -> bytes:
    top = int(x.max(initial=0))
    return pack_planes(x.astype(next(k for k in (np.uint8, np.uint16, np.uint32, U) if top <= np.iinfo(k).max)))


def _wide(data: bytes, n: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: U}[len(data) // n]
    return unpack_planes(data, kind).astype(np.int64)


def _request_rows(pack: str, fold: int, kind: int, grams: np.ndarray, buckets: int) -> list[tuple]:
    """The distinct n-grams with their counts, a row for each range that has some."""
    grams, counts = np.unique(grams, return_counts=True)
    width = 64 if kind == 1 else 56
    bounds = np.arange(1, buckets, dtype=U) * U(((1 << width) - 1) // buckets)
    at = np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]])
    return [
        (
            int(p),
            pack,
            kind,
            pack_planes(np.diff(grams[at[p] : at[p + 1]], prepend=U(0))),
            _narrow(counts[at[p] : at[p + 1]]),
            fold,
        ) for p in np.flatnonzero(at[1:] > at[:-1])
    ]


def _requests(packs: DataFrame, buckets: int) -> DataFrame:
    """Each pack's unigrams (kind 1) and bigrams (kind 2) for each range of the count table."""

    def run(batches):
        for b in batches:
            for pack, fold, sizes, body in zip(b["pack"], b["fold"], b["sizes"], b["body"]):
                text = _Text(sizes, body)
                for kind in (1, 2):
                    yield pd.DataFrame(_request_rows(pack, int(fold), kind, text.grams(kind), buckets), columns=_names(_REQUEST))

    return packs.select("pack", "fold", "sizes", "body").mapInPandas(run, _REQUEST)


def _answers(requests: DataFrame) -> DataFrame:
    """For each request: counts in training, twice, and one more where held-out texts have it too; for fold 1 also the
    counts in it. Rows without pack have N, V and the like."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, bucket = [], int(pdf["bucket"].iloc[0])
        for kind in (1, 2, 3):
            own = pdf[pdf["kind"] == kind]
            if not len(own):
                continue
            grams = [np.cumsum(unpack_planes(g, U), dtype=U) for g in own["grams"]]
            n = [len(g) for g in grams]
            flat = np.concatenate([_wide(c, k) for c, k in zip(own["counts"], n)])
            _, at = np.unique(np.concatenate(grams), return_inverse=True)
            fold, size = np.repeat(own["fold"].to_numpy(), n), int(at.max()) + 1
            train, first = (np.bincount(at, flat * took, size).astype(np.int64) for took in (fold > 0, fold == 1))
            held = np.zeros(size, np.int64)
            held[at[fold == 0]] = 1
            if kind == 1:
                out.append((None, 0, bucket, None, None, -1, int(train.sum()), int((train > 0).sum()), int((train - first).sum()), int((train > first).sum())))
            for pack, f, where in zip(own["pack"], own["fold"], np.split(at, np.cumsum(n)[:-1])):
                out.append(
                    (pack, kind, bucket, _narrow(2 * train[where] + held[where]), _narrow(first[where]) if f == 1 else b"", int(f), None, None, None, None)
                )
        return pd.DataFrame(out, columns=_names(_ANSWER)).astype(dict.fromkeys(STATS, "Int64"))

    return requests.groupBy("bucket").applyInPandas(run, _ANSWER)


def _counts(text: _Text, answers: pd.DataFrame, kind: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """For the n-grams in order: counts in training, in fold 1 (None where not asked for), and whether held-out texts have it."""
    own = answers[answers["kind"] == kind].sort_values("bucket")
    grams, at = np.unique(grams, return_inverse=True)
    if not len(grams):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    # a row has as many entries as its range has n-grams of the pack, which its bytes alone don't tell: they are recounted
    width, buckets = (64 if kind == 1 else 56), int(answers["buckets"].iloc[0])
    bounds = np.arange(1, buckets, dtype=U) * U(((1 << width) - 1) // buckets)
    n = np.diff(np.concatenate([[0], np.searchsorted(grams, bounds), [len(grams)]]))[own["bucket"].to_numpy()]
    both = np.concatenate([_wide(c, k) for c, k in zip(own["counts"], n)])
    first = np.concatenate([_wide(c, k) for c, k in zip(own["own"], n)])[at] if (own["fold"] == 1).all() else None
    return (both >> 1)[at], first, (both & 1).astype(bool)[at]


class _Counts:
    """Of each token: c3, c2, c1 and the counts of its contexts, h2 and h1; ``other``: the same without fold 1."""

    def __init__(self, pack: dict, answers: pd.DataFrame):
        self.text = text = _Text(pack["sizes"], pack["body"])
        c1, own1, _ = _counts(text, answers, 1, text.grams(1))
        c2, own2, elsewhere = _counts(text, answers, 2, text.grams(2))
        asked = text.open(c2, elsewhere, pack["fold"])
        known = np.where(text.first, c2, pack["fold"] > 0)  # the first trigram of a text is its bigram with the start
        c3, own3, _ = _counts(text, answers, 3, text.grams(3)[asked])
        self.train = self._set(c1, c2, self._put(known, asked, c3))
        if pack["fold"] == 1:
            own = self._set(own1, own2, self._put(np.where(text.first, own2, 1), asked, own3))
            self.other = [a - b for a, b in zip(self.train, own)]

    @staticmethod
    def _put(known: np.ndarray, asked: np.ndarray, found: np.ndarray) -> np.ndarray:
        out = known.astype(np.int64)
        out[asked] = found
        return out

    def _set(self, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> list[np.ndarray]:
        texts = c1[self.text.n[0] - 1]  # as many starts as ends
        return [c3, self.text.before(c2, texts), c2, self.text.before(c1, texts), c1]


def _bucket(h2: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """0: no context is known; 1 .. BUCKETS - 1: by the one-word context; from BUCKETS on: by the two-word one."""
    digit = lambda c: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, BUCKETS - 1)
    return np.where(h2 > 0, BUCKETS + digit(h2), np.where(h1 > 0, digit(h1), 0))


def _step(c: np.ndarray, of: np.ndarray) -> np.ndarray:
    """log2(c / of) in steps; 1 where c is 0."""
    return np.where(c > 0, np.rint(STEP * np.log2(np.maximum(c, 1) / np.maximum(of, 1))), 1).astype(np.int64)


_HISTOGRAM = "bucket long, q3 long, q2 long, q1 long, tokens long"


def _pack_of(table: pa.Table) -> dict:
    return table.slice(0, 1).to_pylist()[0]


def _histogram(packs: DataFrame, answers: DataFrame, n: int) -> DataFrame:
    """All tokens of fold 1 by their bucket and what the estimates without fold 1 say of them."""

    def run(pack: pa.Table, answers: pa.Table) -> pa.Table:
        c3, h2, c2, h1, c1 = _Counts(_pack_of(pack), answers.to_pandas()).other
        rows = np.stack([_bucket(h2, h1), _step(c3, h2), _step(c2, h1), _step(c1, np.full(len(c1), n))], axis=1)
        rows, tokens = np.unique(rows, axis=0, return_counts=True)
        return pa.table([*rows.T, tokens], names=_names(_HISTOGRAM))

    held = packs.where("fold = 1").groupBy("pack").cogroup(answers.where("fold = 1").groupBy("pack"))
    return held.applyInArrow(run, _HISTOGRAM).groupBy("bucket", "q3", "q2", "q1").agg(F.sum("tokens").alias("tokens"))


def expectation_maximisation(p: np.ndarray, tokens: np.ndarray, weights: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Mixture weights for ``p``, a column for each estimate and a row for each kind of token."""
    for _ in range(iterations):
        mixed = p * weights
        weights = (mixed / mixed.sum(1, keepdims=True) * tokens[:, None]).sum(0) / tokens.sum()
    return weights


def fit_weights(histogram: DataFrame, v: int) -> np.ndarray:
    """EM for each bucket; rows are l3, l2, l1, l0. A bucket without held-out tokens takes the one below it in its kind."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        pdf = pdf.sort_values(["q3", "q2", "q1"])
        p = np.stack([*(np.where(pdf[q] <= 0, 2.0 ** (pdf[q] / STEP), 0.0) for q in ("q3", "q2", "q1")), np.full(len(pdf), 1 / (v + 1))], axis=1)
        start = np.array([0.3 * (b >= BUCKETS), 0.3 * (b > 0), 0.3, 0.1])
        w = expectation_maximisation(p, pdf["tokens"].to_numpy(np.float64), start / start.sum())
        w = np.maximum(w, [0.0, 0.0, 1e-9, 1e-9])
        return pd.DataFrame([(b, *(w / w.sum()))], columns=["bucket", "l3", "l2", "l1", "l0"])

    found = {
        r.bucket: [r.l3, r.l2, r.l1, r.l0] for r in histogram.groupBy("bucket").applyInPandas(
            run,
            "bucket long, l3 double, l2 double, l1 double, l0 double",
        ).collect()
    }
    weights = np.tile([0.0, 0.0, 0.9, 0.1], (2 * BUCKETS, 1))
    for b in range(2 * BUCKETS):
        if b in found:
            weights[b] = found[b]
        elif b not in (0, 1, BUCKETS, BUCKETS + 1):
            weights[b] = weights[b - 1]
    return weights


def train(docs: DataFrame, pack_bytes: int) -> tuple[DataFrame, DataFrame, int, int, np.ndarray]:
    """Packs, the answers to them, N, V and the weights."""
    packs = kept(_packs(docs, pack_bytes), "packs")
    total = packs.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(2 * parts(docs), -(-2 * total // RANGE))
    short = kept(_answers(_requests(packs, buckets)), "answers")
    n, v, n_other, v_other = (x or 0 for x in short.agg(*(F.sum(c) for c in STATS)).first())
    short = short.where("kind > 0").drop(*STATS).withColumn("buckets", F.lit(buckets))

    def ask(pack: pa.Table, answers: pa.Table) -> pa.Table:
        own, found = _pack_of(pack), answers.to_pandas()
        text = _Text(own["sizes"], own["body"])
        c2, _, elsewhere = _counts(text, found, 2, text.grams(2))
        rows = _request_rows(own["pack"], own["fold"], 3, text.grams(3)[text.open(c2, elsewhere, own["fold"])], buckets)
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=_names(_REQUEST))

    asked = packs.groupBy("pack").cogroup(short.where("kind = 2").groupBy("pack")).applyInArrow(ask, _REQUEST)
    long = kept(_answers(asked).drop(*STATS).withColumn("buckets", F.lit(buckets)), "trigrams")
    answers = short.unionByName(long)
    return packs, answers, n, v, fit_weights(_histogram(packs, answers, n_other), v_other)


def score(docs: DataFrame, pack_bytes: int = 6 << 20) -> DataFrame:
    """Train on ``docs(doc_id, text, ...)`` without fold 0 of crc32(doc_id) mod 10, and score all.

    Returns per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, as the module says; base
    is the unigram estimate with 0.1 added. A null or empty text is one end token. A null doc_id counts as the empty
    text, whose remainder is 0. Repeated rows are scored and counted each. Without training texts N and V are 0 and
    every token is unknown; an empty table gives no rows. Columns other than doc_id and text are not looked at.
    """
    packs, answers, n, v, weights = train(docs, pack_bytes)

    def run(pack: pa.Table, answers: pa.Table) -> pa.Table:
        own = _pack_of(pack)
        counts = _Counts(own, answers.to_pandas())
        c3, h2, c2, h1, c1 = counts.train
        w = weights[_bucket(h2, h1)]
        p = w[:, 0] * c3 / np.maximum(h2, 1) + w[:, 1] * c2 / np.maximum(h1, 1) + w[:, 2] * c1 / max(n, 1) + w[:, 3] / (v + 1)
        base = np.log10((c1 + 0.1) / (n + 0.1 * (v + 1)))
        by_text = lambda x: np.add.reduceat(x, counts.text.begins)
        size = len(counts.text.n)
        ids = pa.array(np.frombuffer(own["ids"], np.int64), mask=np.frombuffer(own["nulls"], bool))
        return pa.table(
            [
                ids,
                np.full(size, own["fold"] == 0),
                counts.text.n,
                by_text((c1 > 0).astype(np.int64)),
                np.full(size, n, np.int64),
                by_text(base),
                by_text(np.log10(p)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    both = packs.groupBy("pack").cogroup(answers.groupBy("pack"))
    return both.applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
