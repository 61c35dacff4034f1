"""Secret scan over an incremental ledger of text blobs.

Every version of a text is addressed by the SHA-256 of its content. The ledger is a stored table with one row for each
(blob, rule version) pair that has been scanned; only unseen pairs are scanned, each once however many paths hold the blob,
and appended to it; the findings are joined back from the ledger to every path. Positions are code points, ends exclusive.

A rule marks its matches with control characters by one regexp_replace, and the lengths of the pieces between the marks
give the positions; all of it runs as built-in functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import new_folder, text_or_empty, written

MARK, SPLIT = "\x01", "\x02"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value`` is the group whose length must reach ``least``; ``needs``: lower-case strings of which
    each match has one when lower-cased (a cheap test before the pattern; it loses nothing)."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


#: The patterns of the base kinds, in the order in which they are listed at equal starts.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?((?i:[A-Za-z0-9+/_.=-]+))""",
        2,
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Rule("access", r"AKIA[A-Z0-9]{16,}", needs=("akia",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published formats of further credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("-----begin ",)),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", needs=("aiza",)),
)
RULES = BASE + MORE
RULE_VERSION = "2"


def _pieces(rule: Rule, text: Column, low: Column) -> Column:
    found = F.split(F.regexp_replace(text, rule.pattern, f"{MARK}$0{SPLIT}${rule.value}{MARK}"), MARK)
    if rule.needs:
        guard = F.lit(False)
        for s in rule.needs:
            guard = guard | F.contains(low, F.lit(s))
        found = F.when(guard, found)
    return found


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans ARRAY<STRUCT<start, no, end, kind>>)`` of the blobs ``(blob, text)`` in which a rule finds something."""
    # no rule matches a control character, so another one in the mark's place changes no match and no position
    clean = blobs.select("blob", F.translate("text", MARK + SPLIT, "\x03\x03").alias("text")).withColumn("low", F.lower("text"))
    kinds = F.filter(
        F.array(
            *(F.struct(F.lit(i).alias("no"), F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least"), _pieces(r, F.col("text"), F.col("low")).alias("pieces")) for i, r in enumerate(rules))
        ),
        lambda k: F.size(k["pieces"]) > 1,
    )
    by_kind = clean.select("blob", F.explode(kinds).alias("k"))
    pieces = by_kind.select(
        "blob",
        F.col("k.no").alias("no"),
        F.col("k.kind").alias("kind"),
        F.col("k.least").alias("least"),
        F.posexplode("k.pieces").alias("at", "piece"),
    )
    shown = F.substring_index("piece", SPLIT, 1)
    sized = pieces.select(
        "blob",
        "no",
        "kind",
        "least",
        "at",
        F.char_length(shown).alias("n"),
        (F.char_length("piece") - F.char_length(shown) - 1).alias("value"),
    )
    end = F.sum("n").over(Window.partitionBy("blob", "no").orderBy("at"))
    spans = sized.withColumn("end", end).where("at % 2 = 1 AND value >= least")
    item = F.struct((F.col("end") - F.col("n")).alias("start"), "no", "end", "kind")
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(item)).alias("spans"))


LEDGER = "blob string, rule_version string, spans array<struct<start:bigint,no:int,end:bigint,kind:string>>"
#: Over how many tasks the paths of one blob are dealt when they are joined with its findings.
SALTS = 64


def unseen_blobs(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows: every blob of ``docs(text, ...)`` that ``ledger`` has not under this version, scanned.

    A blob without findings has a row with empty spans, so that it is not scanned again. Null texts are the empty blob.
    """
    texts = docs.select(text_or_empty().alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    texts = texts.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
    found = scan_blobs(blobs, rules)
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    seen = texts.select("blob").distinct()
    return seen.join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), F.coalesce("spans", empty).alias("spans"))


def update_ledger(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Append ``unseen_blobs`` to the ledger stored at ``path`` (made where it is not there), and return the whole ledger.

    One writer at a time; a job that fails leaves the ledger as it was.
    """
    spark = docs.sparkSession
    if not written(spark, path):
        spark.createDataFrame([], LEDGER).write.parquet(path)
    old = spark.read.schema(LEDGER).parquet(path)
    unseen_blobs(docs, old, rules, version).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def _with_findings(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """``keyed(doc_id, blob)`` left joined with ``found(blob, ...)``, a row for each blob with findings, by parts of each blob."""
    dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    return keyed.withColumn("salt", salt).join(dealt, ["blob", "salt"], "left").drop("salt")


def scan_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """``(doc_id, blob, spans)`` for every row of ``docs(doc_id, text, ...)``, from the ledger stored at the path ``ledger``
    (default: a new one in the shared folder), which is brought up to date first.

    A null or empty text is the empty blob, without spans. Repeated rows give a row each; a null doc_id stays null. An
    empty table gives no rows. Other columns are not looked at. Spans are ordered by start, then rule, then end.
    """
    known = update_ledger(docs, ledger or new_folder(docs.sparkSession, "ledger"), rules, version)
    found = known.where((F.col("rule_version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    texts = docs.select("doc_id", F.sha2(text_or_empty(), 256).alias("blob"))
    empty = F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string>>")
    return _with_findings(texts, found).select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _gaps(found: DataFrame) -> DataFrame:
    """(blob, gaps, tail): of ``found(blob, spans)`` the stretches before each secret, overlapping ones as one, and where
    the last one ends."""
    one = found.select("blob", F.explode("spans").alias("s")).select("blob", "s.start", "s.end", "s.no")
    before = F.coalesce(F.max("end").over(Window.partitionBy("blob").orderBy("start", "no", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    one = one.withColumn("before", before)
    gap = F.when(F.col("start") >= F.col("before"), F.struct(F.col("before").alias("at"), (F.col("start") - F.col("before")).alias("n")))
    return one.groupBy("blob").agg(F.array_sort(F.collect_list(gap)).alias("gaps"), F.max("end").alias("tail"))


def redact_secrets(
    docs: DataFrame,
    mask: str = "[SECRET]",
    ledger: str | None = None,
    rules: tuple[Rule, ...] = RULES,
    version: str = RULE_VERSION,
) -> DataFrame:
    """``docs`` with every found secret (overlapping ones as one) replaced by ``mask``, and n_chars set anew where it
    changes; findings come from the ledger as in ``scan_secrets``. No row goes; rows without findings are untouched. Nulls
    stay, empty and repeated rows too; an empty table gives no rows; all columns are kept, whatever their names."""
    columns = docs.columns
    known = update_ledger(docs, ledger or new_folder(docs.sparkSession, "ledger"), rules, version)
    found = _gaps(known.where((F.col("rule_version") == version) & (F.size("spans") > 0)))
    found = found.select(F.struct("gaps", "tail").alias("_la_found"), F.col("blob").alias("_la_blob"))
    dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_la_salt"))
    keyed = docs.withColumn("_la_blob", F.sha2(text_or_empty(), 256)).withColumn("_la_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = keyed.join(dealt, ["_la_blob", "_la_salt"], "left")
    text = F.col("text")
    pieces = F.transform("_la_found.gaps", lambda g: text.substr((g["at"] + 1).cast("int"), g["n"].cast("int")))
    masked = F.array_join(F.concat(pieces, F.array(text.substr((F.col("_la_found.tail") + 1).cast("int"), F.char_length(text)))), mask)
    changed = F.col("_la_found").isNotNull()
    out = out.withColumn("text", F.when(changed, masked).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in columns))
