"""Benchmark decontamination by templates.

Texts become sequences of words; numbers, names and units become typed placeholders, other words their lower-case form.
Runs of ``width`` such template words are joined by hash with those of the benchmark. Where a text has at least
``coverage`` of an item's windows, the slots decide: along the alignment with most windows, the values in the item's slots
must map one to one onto the values in the text's. A verbatim copy maps each value onto itself; a re-parameterised
question maps them consistently; text that only has the same shape does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import kept, text_or_empty

#: Number words and units of measurement.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split()
UNITS = "mm cm m km inch inches feet miles mile mg g kg lb lbs oz ml l litre litres liter liters gallon gallons s sec seconds min minutes hours hour hr days day weeks week years year mph kmh kw kwh w v hz mb gb tb usd eur dollars dollar euros euro cents percent degrees".split()
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: A word with the sentence end that may follow it.
TOKEN = r"[\p{L}\p{N}]+(?:[.,'’-][\p{L}\p{N}]+)*[.!?:|]?"


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def bare(word: Column) -> Column:
    return F.rtrim(word, F.lit(".!?:|"))


def template_of(words: Column) -> Column:
    """Template words: a capitalised word is a name unless it begins the text or follows a sentence end."""
    def one(word: Column, before: Column) -> Column:
        own = bare(word)
        low = F.lower(own)
        first = F.substring(own, 1, 1)
        inside = ~F.substring(before, -1, 1).isin(".", "!", "?", ":", "|")
        return (
            F.when(first.between("0", "9"), NUMBER)
            .when((first != F.lower(first)) & inside & (own != F.upper(own)), NAME)
            .when(low.isin(NUMBER_WORDS), NUMBER)
            .when(low.isin(UNITS), UNIT)
            .otherwise(low)
        )

    before = F.concat(F.array(F.lit(".")), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    return F.when(F.size(words) > 0, F.zip_with(words, before, one)).otherwise(F.array().cast("array<string>"))


def with_templates(texts: DataFrame) -> DataFrame:
    """Add words and template. Each is a projection of its own, so that no lambda computes the other anew."""
    return texts.withColumn("words", tokens_of(F.col("text"))).withColumn("template", template_of(F.col("words")))


def windows_of(template: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` template words by position; of fewer words, of the one run of all."""
    n = F.size(template)
    starts = F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))
    # each word is hashed once; words that a short text lacks are null, which a hash passes over
    of_words = F.transform(template, lambda w: F.xxhash64(w))
    runs = F.transform(F.array(of_words), lambda h: F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width)))))[0]
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def _row() -> Column:
    return F.xxhash64("doc_id", text_or_empty())


def _line(shift: Column, width: int) -> Column:
    """An item laid over the text at one shift: equal template words, runs of ``width`` of them, and the text's words."""
    at = lambda k: F.when(k + shift >= 0, k + shift).cast("int")
    equal = F.transform("item_template", lambda t, k: F.coalesce(t == F.get("template", at(k)), F.lit(False)))
    values = F.transform("item_template", lambda t, k: F.get("words", at(k)))
    return F.struct(shift.alias("shift"), equal.alias("equal"), values.alias("values"))


def _with_runs(line: Column, width: int) -> Column:
    n = F.size(line["equal"])
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.forall(F.slice(line["equal"], i + 1, F.lit(width)), lambda x: x))
    inside = F.transform(line["equal"], lambda _, k: F.exists(F.slice(runs, F.greatest(k - width + 2, F.lit(1)), F.least(k + 1, F.lit(width))), lambda x: x))
    return F.struct(line["shift"].alias("shift"), line["equal"].alias("equal"), line["values"].alias("values"), runs.alias("runs"), inside.alias("inside"))


PAIRS = "array<struct<t:string,a:string,b:string>>"


def _pair(line: Column, k: Column) -> Column:
    """The slot at word ``k`` of the item with both values, if it lies in a run that matches at this line's shift."""
    t = F.get("item_template", k)
    slot = F.array(F.struct(t.alias("t"), F.get("item_words", k).alias("a"), F.get(line["values"], k).alias("b")))
    return F.when(t.isin(NUMBER, NAME, UNIT) & F.get(line["inside"], k), slot).otherwise(F.array()).cast(PAIRS)


def _aligned(lines: Column) -> Column:
    """The best way through an item over its lines: (score, pairs).

    Score is the number of equal template words, less the words of the text that are jumped over. A jump to a greater
    shift leaves out words of the text, one to a lesser shift leaves out words of the item; no word is used twice.
    """
    kind = f"array<array<struct<score:int,pairs:{PAIRS}>>>"
    k_of = F.sequence(F.lit(0), F.size("item_template") - 1)
    start = F.array(F.transform(lines, lambda _: F.struct(F.lit(0).alias("score"), F.array().cast(PAIRS).alias("pairs")))).cast(kind)

    def step(done: Column, k: Column) -> Column:
        def one(line: Column) -> Column:
            def come(other: Column, i: Column) -> Column:
                d = (other["shift"] - line["shift"]).cast("int")
                before = F.get(F.get(done, F.when(d > 0, k - d).otherwise(k)), i)  # null where the item begins later
                return F.struct((before["score"] + F.least(d, F.lit(0))).alias("score"), before["pairs"].alias("pairs"))

            best = F.array_max(F.filter(F.transform(lines, come), lambda x: x["score"].isNotNull()))
            return F.transform(
                F.array(best),
                lambda x: F.struct((x["score"] + F.get(line["equal"], k).cast("int")).alias("score"), F.concat(x["pairs"], _pair(line, k)).alias("pairs")),
            )[0]

        return F.concat(done, F.array(F.transform(lines, one))).cast(kind)

    several = F.aggregate(k_of, start, step, lambda done: F.array_max(F.element_at(done, -1)))
    only = lines[0]
    single = F.struct(F.size(F.filter(only["equal"], lambda x: x)).alias("score"), F.flatten(F.transform(k_of, lambda k: _pair(only, k))).alias("pairs"))
    return F.when(F.size(lines) == 1, single).otherwise(several)


def _exact(texts: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """``(row, item)`` for items whose words, letter case aside, stand in a text one after another."""
    lower = lambda words: F.transform(words, lambda w: F.lower(bare(w)))
    wanted = items.select("item", lower(F.col("item_words")).alias("wanted")).dropDuplicates(["item"])
    first = wanted.select("item", windows_of(F.col("wanted"), width)[0].alias("hash"))
    own = texts.select("row", tokens_of(F.col("text")).alias("words")).withColumn("words", lower(F.col("words")))
    met = kept(
        own.select("row", F.posexplode(windows_of(F.col("words"), width)).alias("at", "hash")).join(first, "hash").select("row", "item", "at").distinct(),
        "exact",
    )
    again = own.join(met.select("row").distinct(), "row").dropDuplicates(["row"]).join(met, "row").join(wanted, "item")
    return again.where(F.slice("words", F.col("at") + 1, F.size("wanted")) == F.col("wanted")).select("row", "item").distinct()


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8, min_plain: int = 2, share: float = 0.85) -> DataFrame:
    """``(doc_id, item_id, coverage, verbatim, slots, row)`` for each text of ``docs(doc_id, text, ...)`` and benchmark item in it.

    coverage: share of the item's windows that the text has; verbatim: no slot value differs; slots: number of slots
    compared; row: a hash of doc_id and text. An item is found where, along one alignment, the text has at least ``share``
    of its template words or ``coverage`` of its windows, and the slots in matching windows map one to one.
    Null and empty texts, and texts and items without words, match nothing. Windows with fewer than ``min_plain`` plain
    words say too little and don't count; an item without other windows is found where all its words stand in a text as
    they are. Items of fewer than ``width`` words match texts of just these words. Repeated texts and items give a row
    each, null ids stay null. Rows of one doc_id count as texts of their own. Other columns are not looked at.
    """
    items = with_templates(benchmark.select("item_id", text_or_empty().alias("text")))
    items = kept(
        items.where("size(words) > 0").select(
            "item_id",
            F.transform("words", bare).alias("item_words"),
            F.col("template").alias("item_template"),
            F.xxhash64("item_id", "words").alias("item"),
        ),
        "items",
    )
    windows = items.select("item", "item_template", F.posexplode(windows_of(F.col("item_template"), width)).alias("item_at", "hash"))
    plain = F.size(F.filter(F.slice("item_template", F.col("item_at") + 1, F.lit(width)), lambda w: ~w.isin(NUMBER, NAME, UNIT)))
    windows = kept(
        windows.where((plain >= min_plain) | (plain == F.size("item_template"))).select(
            "item",
            "item_at",
            "hash",
            F.size("item_template").alias("n_words"),
        ).distinct(),
        "windows",
    )
    # a changed, added or left out word takes at most ``width`` windows
    spare = F.floor(F.round(F.col("n_words") * (1 - share), 6)).cast("int")
    bar = F.least(F.greatest(F.col("n_windows") - width * spare, F.lit(1)), F.col("n_windows") * coverage)
    n_windows = windows.groupBy("item", "n_words").agg(
        F.countDistinct("item_at").alias("n_windows"),
        F.collect_set("item_at").alias("plain_at"),
    ).withColumn("spare", spare).withColumn("bar", bar).drop("n_words")
    windows = windows.drop("n_words")  # a written table, so Spark knows its size and broadcasts it where that is small

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    key = _row()  # rows of equal id and text are one here; they part again below
    texts = texts.withColumn("row", key)
    hashes = with_templates(texts).select("row", F.explode(windows_of(F.col("template"), width)).alias("hash"))
    met = hashes.join(windows, "hash").distinct()
    found = met.groupBy("row", "item").agg(F.countDistinct("item_at").alias("n"))
    candidates = kept(
        found.join(n_windows.select("item", "n_windows", "bar"), "item").where("n >= bar").select(
            "row",
            "item",
            (F.col("n") / F.col("n_windows")).alias("coverage"),
        ),
        "candidates",
    )

    # the texts that remain are aligned with their items, at each shift and at each group of shifts near one another
    again = with_templates(texts.join(candidates.select("row").distinct(), "row"))
    again = kept(again.select("row", "doc_id", "template", F.transform("words", bare).alias("words")), "aligned")
    once = again.drop("doc_id").dropDuplicates(["row"])
    placed = once.select("row", F.posexplode(windows_of(F.col("template"), width)).alias("at", "hash")).join(windows, "hash").join(candidates, ["row", "item"])
    shifts = placed.groupBy("row", "item", "coverage").agg(F.array_sort(F.collect_set(F.col("at") - F.col("item_at"))).alias("shifts"))
    shifts = shifts.join(n_windows.select("item", "n_windows", "plain_at", "spare"), "item")
    near = F.transform("shifts", lambda s, i: F.filter(F.slice("shifts", i + 1, F.col("spare") + 1), lambda x: x <= s + F.col("spare")))
    bands = shifts.select(
        "row",
        "item",
        "coverage",
        "n_windows",
        "plain_at",
        F.explode(F.array_distinct(F.concat(F.transform("shifts", lambda s: F.array(s)), near))).alias("band"),
    )
    laid = once.join(bands, "row").join(items.select("item", "item_words", "item_template").dropDuplicates(["item"]), "item")
    laid = laid.withColumn("lines", F.transform("band", lambda s: _line(s, width))).drop("words", "template")
    laid = laid.withColumn("lines", F.transform("lines", lambda x: _with_runs(x, width))).withColumn("way", _aligned(F.col("lines")))
    held = F.size(F.filter("plain_at", lambda i: F.exists("lines", lambda x: F.get(x["runs"], i))))
    distinct = lambda f: F.size(F.array_distinct(F.transform("way.pairs", f)))
    n_pairs = distinct(lambda p: F.struct(p["t"], p["a"], p["b"]))
    consistent = (n_pairs == distinct(lambda p: F.struct(p["t"], p["a"]))) & (n_pairs == distinct(lambda p: F.struct(p["t"], p["b"])))
    verbatim = F.size(F.filter("way.pairs", lambda p: p["a"] != p["b"])) == 0
    ways = kept(
        laid.select(
            "row",
            "item",
            "coverage",
            "n_windows",
            F.size("item_template").alias("n_words"),
            F.size("band").alias("n_shifts"),
            held.alias("held"),
            F.col("way.score").alias("score"),
            consistent.alias("consistent"),
            verbatim.alias("verbatim"),
            F.size("way.pairs").cast("long").alias("slots"),
        ),
        "ways",
    )
    # windows of an item whose sentences are apart count together, at the shift that has most of them
    enough = F.col("consistent") & ((F.col("score") >= F.round(F.col("n_words") * F.lit(share), 6)) | (F.col("held") >= F.col("n_windows") * coverage))
    chosen = ways.groupBy("row", "item", "coverage").agg(
        F.max(F.when(enough, F.struct("score", "verbatim", "slots"))).alias("sure"),
        F.max(F.when(F.col("n_shifts") == 1, F.struct("held", "consistent", "verbatim", "slots"))).alias("most"),
    )
    chosen = chosen.where(F.col("sure").isNotNull() | ((F.col("coverage") >= coverage) & F.col("most.consistent")))
    leaks = chosen.select(
        "row",
        "item",
        "coverage",
        F.coalesce("sure.verbatim", "most.verbatim").alias("verbatim"),
        F.coalesce("sure.slots", "most.slots").alias("slots"),
    )
    out = again.select("row", "doc_id").join(leaks, "row").join(items.select("item", "item_id"), "item")
    bare_items = items.join(n_windows.select("item"), "item", "left_anti")
    if not bare_items.isEmpty():
        slots = F.size(F.filter("item_template", lambda t: t.isin(NUMBER, NAME, UNIT))).cast("long")
        same = kept(_exact(texts, bare_items, width), "same")
        more = texts.select("row", "doc_id").join(same, "row").join(bare_items.select("item", "item_id", slots.alias("slots")), "item")
        out = out.unionByName(more.withColumn("coverage", F.lit(1.0)).withColumn("verbatim", F.lit(True)))
    return out.select("doc_id", "item_id", "coverage", "verbatim", "slots", "row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, width: int = 5, coverage: float = 0.8) -> DataFrame:
    """``docs`` without the texts in which a benchmark item is found; all columns and other rows stay.

    A text goes with all rows that repeat it under its doc_id. Null and empty texts, null ids and nulls in other columns
    stay as they are; an empty table gives no rows, and without items nothing goes.
    """
    leaked = kept(find_leaks(docs, benchmark, width, coverage).select(F.col("row").alias("_la_row")).distinct(), "leaks")
    return docs.join(leaked, _row() == F.col("_la_row"), "left_anti")
