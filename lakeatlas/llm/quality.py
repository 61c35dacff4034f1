"""Quality classifier with hierarchical empirical Bayes over sites.

1. A document classifier, fitted on a bounded sample of labelled rows, says from the whole text how much more likely it is
   under "good" (quality 1 and not toxic) than under "bad": a logistic regression on shape features for quality, and a
   lexicon of words and word beginnings (once, twice or four times in a text) for toxicity, chosen to cover the toxic sample
   without touching the clean one. Features and counts are made by tasks; the driver gets sums and the lexicon.
2. All documents are summed up by host and by path. A host's rate of good documents is shrunk to the global one, a path's
   to its host's; how strongly follows from the spread of the rates (method of moments).
3. A document's posterior is its path's rate without itself, as prior odds, times its own evidence. Sparse sites keep near
   the global rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept, map_arrow, slices, text_or_empty, texts_of
from ._words import U, mix, shingle_set, word_hashes

PREFIXES = (4, 5, 6)
#: How often a term must be in a text, by the two lowest bits of its feature.
LEVELS = np.array([0, 1, 2, 4])
NATS = 12.0
_TO_SPACE = bytes(32 if i < 48 or 57 < i < 65 or 90 < i < 97 or 122 < i < 128 else i for i in range(256))
_LOWER, _UPPER, _DIGIT, _SPACE, _COMMON = (np.zeros(256, bool) for _ in range(5))
_LOWER[97:123] = _UPPER[65:91] = _DIGIT[48:58] = True
_SPACE[[32, *range(9, 14)]] = True
_COMMON[[ord(c) for c in ".,'\"-()"]] = True
_OTHER = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _COMMON)
_OTHER[128:] = False


def shape(data: bytes, words: np.ndarray) -> list[float]:
    """Features of a text's form. ``words``: hashes of its words as they stand."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w = max(1, len(data)), max(1, len(words))
    letters = max(1, counts[_LOWER].sum() + counts[_UPPER].sum())
    _, each = np.unique(words, return_counts=True)
    again = float((words[1:] == words[:-1]).mean()) if len(words) > 1 else 0.0
    expected = min(1.0, 3.0 / np.sqrt(w))
    return [
        counts[_OTHER].sum() / n,
        counts[_OTHER].sum() / w,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / n,
        counts[_SPACE].sum() / n,
        again,
        len(each) / w,
        max(0.0, expected - len(each) / w),
        float(each.max()) / w if len(each) else 0.0,
        np.log1p(w),
        len(data) / w / 10,
        counts[10] / w,
    ]


@dataclass
class Model:
    """A fitted document classifier; ``evidence`` gives log P(text | good) - log P(text | bad) for each text."""

    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0
    lexicon: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    hit: float = 0.0
    miss: float = 0.0

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Columns: log odds of quality, log odds of toxicity, both without priors. A text without words: -inf, 0."""
        out = np.zeros((len(texts), 2))
        forms = []
        for i, (d, words, hit) in enumerate(zip(texts, word_hashes(texts), self.hits(texts))):
            forms.append(shape(d, words))
            if not len(words):
                out[i, 0] = -np.inf
            elif len(self.lexicon):
                out[i, 1] = self.hit if hit else self.miss
        if len(self.weights) and forms:
            out[:, 0] += _design(np.array(forms), self.centre, self.scale) @ self.weights - self.prior
        return out

    def hits(self, texts: list[bytes]) -> Iterator[bool]:
        """Whether each text has a feature of the lexicon."""
        base, need = np.unique(self.lexicon >> U(2)), None
        if len(base):
            need = np.full(len(base), LEVELS[-1])
            np.minimum.at(need, np.searchsorted(base, self.lexicon >> U(2)), LEVELS[(self.lexicon & U(3)).astype(int)])
        for terms in _terms_of(texts):
            if need is None:
                yield False
                continue
            at = np.minimum(np.searchsorted(base, terms), len(base) - 1)
            at = at[base[at] == terms]
            yield bool(len(at)) and bool((np.bincount(at, minlength=len(base)) >= need).any())


def _terms_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """All terms of each text, in 62 bits: words and word beginnings, each as of its own kind."""
    for found in word_hashes((d.lower().translate(_TO_SPACE) for d in texts), PREFIXES):
        yield mix(found + np.arange(len(found), dtype=U)[:, None] * U(0xA0761D6478BD642F)).ravel() >> U(2)


def features_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct features of each text: its terms with each level that they reach."""
    for terms in _terms_of(texts):
        terms, n = np.unique(terms, return_counts=True)
        yield np.concatenate([terms[n >= least] << U(2) | U(k) for k, least in enumerate(LEVELS) if least])


def _design(forms: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    x = np.clip((forms - centre) / scale, -6, 6)
    return np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _cover(rows: list[np.ndarray], copies: np.ndarray, clearest: np.ndarray) -> list[int]:
    """Features (by number) that cover the toxic texts ``rows``: all of the clearest, and of the others those that cover
    most of what is left, until only single texts are."""
    found = np.flatnonzero(clearest).tolist()
    left = [r for r, c in zip(rows, copies) if not c and not clearest[r].any()]
    while left:
        gain = np.bincount(np.concatenate(left), minlength=len(clearest))
        if gain.max(initial=0) < 2:
            break
        best = int(gain.argmax())
        found.append(best)
        left = [r for r in left if best not in r]
    return found


def _copies(minima: list[np.ndarray]) -> np.ndarray:
    """Which texts are likely copies of an earlier one: two of eight minima of hashed word triples agree."""
    seen: set = set()
    out = np.zeros(len(minima), bool)
    for i, own in enumerate(minima):
        own = set(enumerate(own.tolist()))
        out[i] = len(own & seen) >= 2
        seen |= own
    return out


def _minima(texts: list[bytes]) -> Iterator[bytes]:
    for words in word_hashes(texts):
        x = shingle_set(words, 3)
        yield np.array([mix(x ^ U(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min() for k in range(1, 9)] if len(x) else [], U).tobytes()


def _counted(texts: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(feature, n): in how many of ``texts(text)`` a feature is; with ``among`` (sorted) those only."""

    def run(batches):
        held, size = [], 0
        for b in slices(batches):
            for x in features_of(texts_of(b, "text")):
                if among is not None:
                    x = x[among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x]
                held.append((x, np.ones(len(x), np.int64)))
                size += len(x)
                if size > 2_000_000:
                    held, size = [_summed(held)], 0
        if held:
            features, n = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(features.view(np.int64)), pa.array(n)], names=["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    features, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
    return features, np.bincount(at, np.concatenate([n for _, n in held]), len(features)).astype(np.int64)


def _sorted_features(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = counts.toPandas()
    features = pdf["feature"].to_numpy(np.int64).view(U)
    order = np.argsort(features)
    return features[order], pdf["n"].to_numpy(np.int64)[order]


def fit(sample: DataFrame, nats: float = NATS) -> Model:
    """``sample(text, quality, toxic)``: a bounded table of labelled rows. Without both classes there is no evidence.

    A feature of the lexicon must be in so many toxic texts that chance would put it there only with odds of e ** -nats.
    The driver gets the features of that many toxic texts, the rows' numbers of form, and sums.
    """
    rows = sample.dropDuplicates(["text"])
    classes = [(r.good, r.bad, r["count"]) for r in rows.groupBy((F.col("quality") > 0).alias("good"), (F.col("toxic") > 0).alias("bad")).count().collect()]
    n_good, n_toxic, n = (sum(c for g, b, c in classes if keep(g, b)) for keep in (lambda g, b: g, lambda g, b: b, lambda g, b: True))
    model = Model()
    if 0 < n_good < n:
        def forms(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = texts_of(batch, "text")
            return [pa.array([shape(d, w) for d, w in zip(texts, word_hashes(texts))], pa.list_(pa.float64()))]

        found = map_arrow(
            rows.select((F.col("quality") > 0).alias("good"), "text"),
            forms,
            "form array<double>",
            drop=("text",),
        ).orderBy("good", "form").collect()
        x, y = np.array([r.form for r in found]), np.array([r.good for r in found], float)
        model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
        model.weights = _logistic(_design(x, model.centre, model.scale), y)
        model.prior = float(np.log(n_good / (n - n_good)))
    if 0 < n_toxic < n:
        toxic, clean = rows.where("toxic > 0").select("text"), rows.where("toxic <= 0").select("text")
        _fit_lexicon(model, toxic, clean, n_toxic, n - n_toxic, max(3, int(np.ceil(nats / -np.log(n_toxic / n)))))
    return model


def _fit_lexicon(model: Model, toxic: DataFrame, clean: DataFrame, n_toxic: int, n_clean: int, least: int) -> None:
    toxic = toxic.withColumn("id", F.sha2("text", 256))
    minima = lambda b: [pa.array(list(_minima(texts_of(b, "text"))), pa.binary())]
    found = map_arrow(toxic, minima, "minima binary", drop=("text",)).orderBy("id").collect()
    copies = _copies([np.frombuffer(r.minima, U) for r in found])
    twice = {r.id for r, c in zip(found, copies) if c}
    once = map_arrow(toxic, lambda b: [pa.array([i not in twice for i in b.column("id").to_pylist()])], "once boolean").where("once")
    features, df = _sorted_features(_counted(once).where(F.col("n") >= least))
    if not len(features):
        return
    found_clean, n_inside = _sorted_features(_counted(clean, features))
    inside = np.zeros(len(features), np.int64)
    inside[np.searchsorted(features, found_clean)] = n_inside
    pure = inside * 100 <= df * n_clean / max(1, n_toxic)
    features, df, inside = features[pure], df[pure], inside[pure]
    if not len(features):
        return

    def own(b: pa.RecordBatch) -> list[pa.Array]:
        at = (np.searchsorted(features, x[np.isin(x, features)]).astype(np.int32).tobytes() for x in features_of(texts_of(b, "text")))
        return [pa.array(list(at), pa.binary())]

    rows = [np.frombuffer(r.own, np.int32) for r in map_arrow(toxic, own, "own binary", drop=("text",)).orderBy("id").collect()]
    chosen = _cover(rows, copies, (inside == 0) & (df >= 3 * least))
    model.lexicon = np.sort(features[chosen])
    hits = sum(bool(np.isin(r, chosen).any()) for r in rows)
    wrong = map_arrow(clean, lambda b: [pa.array(list(model.hits(texts_of(b, "text"))), pa.bool_())], "hit boolean", drop=("text",)).where("hit").count()
    t, c = (hits + 0.5) / (n_toxic + 1), (wrong + 0.5) / (n_clean + 1)
    model.hit, model.miss = float(np.log(t / c)), float(np.log((1 - t) / (1 - c)))


def _marked(labels: DataFrame) -> DataFrame:
    """One label for each document: of several the worst; labels with nulls are not used."""
    sound = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return sound.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))


def fit_on_labels(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> tuple[Model, float, float]:
    """A model fitted on at most ``per_class`` labelled texts of each (quality, toxic) pair, and three times as many good
    ones, whole, of whatever length; a hash of the doc_id chooses them. Also the shares of quality 1 and toxic 1 among all
    labels (0.85 and 0.1 where there are none)."""
    marked = kept(_marked(labels), "marked")
    good, bad = marked.agg(F.avg((F.col("quality") > 0).cast("int")), F.avg((F.col("toxic") > 0).cast("int"))).first()
    inside = lambda x, default: min(max(default if x is None else x, 0.01), 0.99)
    chosen = None
    for quality in (0, 1):
        for toxic in (0, 1):
            some = marked.where(
                (F.col("quality") == quality) & (F.col("toxic") == toxic)
            ).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class * (1 + 2 * (quality > toxic)))
            chosen = some if chosen is None else chosen.union(some)
    chosen = kept(chosen, "chosen")  # at most 6 * per_class rows of three numbers, so it may be broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"),
        F.first("quality").alias("quality"),
        F.first("toxic").alias("toxic"),
    )
    return fit(kept(rows.select("text", "quality", "toxic"), "sample")), inside(good, 0.85), inside(bad, 0.1)


def add_evidence(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default all) of docs with _la_quality and _la_toxic, the evidence of the whole text."""
    columns = columns or docs.columns

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        e = model.evidence(texts_of(b, "_la_text"))
        return [pa.array(e[:, 0]), pa.array(e[:, 1])]

    src = docs.select(*(F.col(f"`{c}`") for c in columns), text_or_empty().alias("_la_text"))
    return map_arrow(src, run, "_la_quality double, _la_toxic double", drop=("_la_text",))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, rate: str, prior: Column) -> float:
    """Pseudo-count of a beta prior whose spread is that of the groups' rates around ``prior``, in 1..10000."""
    m = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    noise = m * (1 - m)
    excess, noise = groups.agg(F.sum(F.col("n") * (F.col(rate) - m) ** 2 - noise), F.sum((F.col("n") - 1) * noise)).first()
    if not noise or excess is None:
        return 100.0
    between = max(excess / noise, 1e-4)  # the share of a document's variance that lies between groups
    return min(max(1 / between - 1, 1.0), 1e4)


def classify(scored: DataFrame, host: str, path: str, quality_prior: float = 0.85, toxic_prior: float = 0.1) -> DataFrame:
    """Add _la_rate and _la_posterior to a table with evidence. ``host``, ``path``: columns; nulls are a site of their own.

    The rate of a document's site leaves the document itself out, so that its evidence counts once.
    """
    own = scored.withColumn(
        "_la_own",
        _sigmoid(
            F.lit(float(np.log(quality_prior / (1 - quality_prior)))) + F.col("_la_quality")
        ) * _sigmoid(F.lit(-float(np.log(toxic_prior / (1 - toxic_prior)))) - F.col("_la_toxic")),
    )
    keyed = own.withColumn(
        "_la_host",
        F.coalesce(F.col(host).cast("string"), F.lit("\0")),
    ).withColumn("_la_path", F.coalesce(F.col(path).cast("string"), F.lit("\0")))
    paths = kept(keyed.groupBy("_la_host", "_la_path").agg(F.count("*").alias("n"), F.sum("_la_own").alias("s")), "paths")
    total, good = paths.agg(F.sum("n"), F.sum("s")).first()
    rate = min(max((good or 0.0) / total, 1e-6), 1 - 1e-6) if total else 0.5
    hosts = paths.groupBy("_la_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    a = _strength(hosts.select(F.col("host_n").alias("n"), (F.col("host_s") / F.col("host_n")).alias("rate")), "rate", F.lit(rate))
    host_rate = (F.col("host_s") + a * rate) / (F.col("host_n") + a)
    joined = paths.join(hosts, "_la_host").withColumn("rate", F.col("s") / F.col("n"))
    b = _strength(joined.withColumn("host_rate", host_rate), "rate", F.col("host_rate"))
    sites = joined.select("_la_host", "_la_path", *(F.col(c).alias(f"_la_{c}") for c in ("n", "s", "host_n", "host_s")))
    out = keyed.join(sites, ["_la_host", "_la_path"])
    of_host = (F.col("_la_host_s") - F.col("_la_own") + a * rate) / (F.col("_la_host_n") - 1 + a)
    out = out.withColumn("_la_rate", (F.col("_la_s") - F.col("_la_own") + b * of_host) / (F.col("_la_n") - 1 + b))
    # the text's own evidence is its odds less those which it has from the global rate alone
    base = float(np.log(quality_prior * (1 - toxic_prior) / (1 - quality_prior * (1 - toxic_prior))))
    return out.withColumn("_la_posterior", _sigmoid(_logit(F.col("_la_rate")) + _logit(F.col("_la_own")) - F.lit(base)))


def rate_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", per_class: int = 2000) -> DataFrame:
    """``(doc_id, host, path, quality_evidence, toxic_evidence, site_rate, posterior, keep)`` for each row of ``docs``.

    keep: the posterior of being good is at least 0.5. A text without words (null, empty) has posterior 0. Repeated rows
    are rated each; null doc_ids stay. Labels with nulls are not used, of several for a document the worst is. Without
    labels of both classes texts give no evidence and are kept unless empty. An empty table gives no rows. Other columns
    are not looked at.
    """
    model, quality, toxic = fit_on_labels(docs, labels, per_class)
    src = docs.select("doc_id", F.col(host).alias("host"), F.col(path).alias("path"), text_or_empty().alias("text"))

    scored = kept(add_evidence(src, model, ["doc_id", "host", "path"]), "evidence")
    done = classify(scored, "host", "path", quality, toxic)
    return done.select(
        "doc_id",
        "host",
        "path",
        F.col("_la_quality").alias("quality_evidence"),
        F.col("_la_toxic").alias("toxic_evidence"),
        F.col("_la_rate").alias("site_rate"),
        F.col("_la_posterior").alias("posterior"),
        (F.col("_la_posterior") >= 0.5).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", per_class: int = 2000) -> DataFrame:
    """``docs`` without the rows that ``rate_documents`` would not keep; all columns stay, whatever their names. Null ids,
    nulls in other columns, and repeated rows stay as they are; null and empty texts go. An empty table gives no rows."""
    model, quality, toxic = fit_on_labels(docs, labels, per_class)
    scored = kept(add_evidence(docs, model), "scored")
    return classify(scored, host, path, quality, toxic).where("_la_posterior >= 0.5").select(*(F.col(f"`{c}`") for c in docs.columns))
