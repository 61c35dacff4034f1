"""Temperature mixing of sources: weights are token shares to a power that is bisected to a target.

The exponent alpha lies in 0 (all sources equal) to 1 (as they are). It is the least one that keeps to all given limits:
entropy (in nats, as a share of the most possible, log of the number of sources) at most ``entropy``, and no source
repeated more than ``max_repeats`` times within the budget. Sources that break a limit as they are stay as they are, and are
marked as not meeting it. Each round of the search is one aggregation over the source
table, so the sources may be as many as hosts on the web; only a row of sums comes to the driver.

The quota of a source is then filled with blocks: every whole block is a permutation of all the source's documents (keyed by
``seed`` and block number), the last one is the head of such a permutation that still fits. A hash orders a permutation, and
the sums that find its head are taken over equal ranges of the hash first, so no task sorts a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import kept, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
POINTS = 16
ROUNDS = 10


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_shares(tokens: DataFrame) -> DataFrame:
    """(source, n_docs, n_tokens, share) of ``tokens(source, tokens)``; a source without tokens has share 0."""
    by = tokens.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
    return by.select("source", "n_docs", "n_tokens", F.col("n_tokens").cast("double").alias("size"))


def find_exponent(sources: DataFrame, budget: int, entropy: float | None, max_repeats: float | None) -> tuple[float, float, bool]:
    """(alpha, sum of size ** alpha, whether the limits hold there). They hold at alpha = 1 or else 1 is taken, and they fail
    from some point downwards."""
    live = sources.where("size > 0")
    n, top = live.agg(F.count("*"), F.max("size")).first()
    if not n:
        return 1.0, 1.0, True

    def look(points: list[float]) -> list[tuple[float, float, float, float]]:
        power = [F.pow(F.col("size") / top, F.lit(p)) for p in points]
        logs = F.log(F.col("size") / top)
        row = live.agg(*(x for p, w in zip(points, power) for x in (F.sum(w), F.sum(w * logs * F.lit(p)), F.max(w / F.col("size"))))).first()
        return [(p, row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, p in enumerate(points)]

    def holds(found) -> bool:
        _, z, weighted, most = found
        spread = (math.log(z) - weighted / z) / math.log(n) if n > 1 else 0.0
        return (entropy is None or spread <= entropy + 1e-12) and (max_repeats is None or budget * most / z <= max_repeats + 1e-12)

    if entropy is None and max_repeats is None:
        return 1.0, look([1.0])[0][1], True
    lo, hi = 0.0, 1.0
    if holds(look([0.0])[0]):
        hi = 0.0
    for _ in range(ROUNDS):  # each round keeps one of POINTS parts of the interval
        if hi - lo < 1e-12:
            break
        points = [lo + (hi - lo) * k / POINTS for k in range(1, POINTS)]
        good = [p for p, f in zip(points, look(points)) if holds(f)]
        first = min(good, default=hi)
        lo, hi = max([p for p in points if p < first], default=lo), first
    last = look([hi])[0]
    return hi, last[1], holds(last)


def source_weights(
    tokens: DataFrame,
    budget: int | None = None,
    entropy: float | None = 0.95,
    max_repeats: float | None = 4.0,
    epochs: float = 1.0,
) -> DataFrame:
    """(source, n_docs, n_tokens, weight, quota, met): weights sum to 1, quotas are whole tokens; met: the limits hold. See
    the module. Without a budget it is ``epochs`` times the tokens. A null source is a source of its own; no sources: no rows."""
    sources = kept(source_shares(tokens), "sources")
    if budget is None:
        budget = int(epochs * (sources.agg(F.sum("n_tokens")).first()[0] or 0))
    alpha, z, met = find_exponent(sources, budget, entropy, max_repeats)
    top = sources.agg(F.max("size")).first()[0] or 1.0
    weight = F.when(F.col("size") > 0, F.pow(F.col("size") / F.lit(top), F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    return sources.withColumn("weight", weight).select(
        "source",
        "n_docs",
        "n_tokens",
        "weight",
        F.floor(F.col("weight") * budget + 1e-6).cast("long").alias("quota"),
        F.lit(met).alias("met"),
    )


def _order(block: Column, seed: int) -> Column:
    return F.md5(
        F.concat_ws("/", F.lit(str(seed)), block.cast("string"), F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    )


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    entropy: float | None = 0.95,
    max_repeats: float | None = 4.0,
    seed: int = 7,
    head_docs: int = 8_192,
    epochs: float = 1.0,
) -> DataFrame:
    """``(doc_id, source, tokens, block, place, weight, met)``: one row for each time that a document of ``docs(doc_id, text,
    source, ...)`` is taken; block numbers a source's permutations from 0, place orders a block, met says whether the limits
    hold (the same in all rows).

    ``budget``: tokens to hand out; null: ``epochs`` times as many as there are. A null source is a source of its own. Documents without
    tokens (null or empty text) cost nothing and are in every block that is whole, and in the last one where their place
    comes before its end; a source without any tokens has weight 0 and is not taken. Repeated rows are rows of their own;
    ties in place are ordered by tokens. An empty table gives no rows. Other columns are not looked at.
    """
    tokens = kept(docs.select("doc_id", "source", token_count(text_or_empty()).alias("tokens")), "tokens")
    weights = kept(source_weights(tokens, budget, entropy, max_repeats, epochs), "weights")
    plan = weights.where("n_tokens > 0").select(
        F.col("source").alias("_source"),
        "weight",
        "met",
        F.floor(F.col("quota") / F.col("n_tokens")).cast("long").alias("whole"),
        F.expr("quota % n_tokens").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / head_docs)).cast("long").alias("ranges"),
    )
    taken = tokens.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    whole = taken.where("whole > 0").select(
        "doc_id",
        "source",
        "tokens",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("block"),
        "weight",
        "met",
    )
    whole = whole.withColumn("place", _order(F.col("block"), seed))

    # the last block: the range of the hash in which the quota ends, then the row
    last = taken.where("rest > 0").withColumn("block", F.col("whole")).withColumn("place", _order(F.col("block"), seed))
    share = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    last = last.withColumn("part", F.floor(share * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    sums = last.groupBy("source", "part").agg(F.sum("tokens").alias("in_part"))
    before = sums.withColumn(
        "before",
        F.sum("in_part").over(Window.partitionBy("source").orderBy("part")) - F.col("in_part"),
    ).select(F.col("source").alias("_source"), F.col("part").alias("_part"), "before", "in_part")
    last = last.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    full = last.where("before + in_part <= rest")
    ends = last.where("before <= rest AND before + in_part > rest")
    running = F.sum("tokens").over(Window.partitionBy("source", "part").orderBy("place", "tokens", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("running", F.col("before") + running).where("running <= rest")
    columns = ["doc_id", "source", "tokens", "block", "place", "weight", "met"]
    return whole.select(columns).union(full.select(columns)).union(ends.select(columns))
