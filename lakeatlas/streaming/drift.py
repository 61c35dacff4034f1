"""The drift gate as a stream: snapshot documents are compared with the last one of their schema as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeatlas.operators.canonical import document_json, exploded, fingerprint
from lakeatlas.operators.diff import schema_diff
from lakeatlas.operators.store import written
from lakeatlas.sources.documents import SNAPSHOT, is_snapshot, read_snapshots

EVENT = "schema_id STRING, snapshot_id STRING, ts TIMESTAMP, doc STRING"


def with_fingerprint(events: DataFrame) -> DataFrame:
    """Add the fingerprint of the canonical schema of each document (null where it is no snapshot); the stored one is not
    trusted, and neither are the document's order of keys and its blanks."""
    return events.withColumn("fingerprint", fingerprint(document_json(F.from_json("doc", SNAPSHOT))))


def changes(events: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Events whose fingerprint differs from that of the event before, or of ``last`` (as with_fingerprint gives it)."""
    own = events if "fingerprint" in events.columns else with_fingerprint(events)
    own = own.select("schema_id", "snapshot_id", "ts", "doc", "fingerprint", F.lit(1).alias("is_new"))
    every = own if last is None else own.unionByName(last.select("schema_id", "snapshot_id", "ts", "doc", "fingerprint", F.lit(0).alias("is_new")))
    w = Window.partitionBy("schema_id").orderBy("ts", "snapshot_id")
    before = every.withColumn("before", F.lag("fingerprint").over(w)).withColumn("before_doc", F.lag("doc").over(w))
    return before.where("is_new = 1 AND (before IS NULL OR before <> fingerprint)").drop("is_new")


#: After how many batches the last states are written whole again.
COMPACTION = 64


def _last_states(spark: SparkSession, batch_id: int, folder: str) -> DataFrame | None:
    """The newest state of each schema before a batch: from the last whole table, and what each batch since has added."""
    if batch_id == 0:
        return None
    first = (batch_id - 1) // COMPACTION * COMPACTION
    held = spark.read.parquet(*(f"{folder}/last/batch={b}" for b in range(first, batch_id)))
    return _newest(held)


def _newest(states: DataFrame) -> DataFrame:
    return states.groupBy("schema_id").agg(
        F.max_by(F.struct("snapshot_id", "ts", "doc", "fingerprint"), F.struct("ts", "snapshot_id")).alias("x")
    ).select("schema_id", "x.*")


def process(events: DataFrame, batch_id: int, folder: str) -> None:
    """One micro-batch: quarantine the documents that are malformed or older than the last state of their schema, write changes
    and their differences, and add the states that are newest now to the last ones (every COMPACTION-th batch writes them whole).

    Each batch writes folders of its own number, so that one that is run again replaces what it wrote. ``history`` keeps order
    beyond a batch; this keeps whole documents, and differences down to fields.
    """
    spark = events.sparkSession
    parsed = written(with_fingerprint(events).withColumn("sound", is_snapshot(F.from_json("doc", SNAPSHOT))), "events")
    last = _last_states(spark, batch_id, folder)
    sound = parsed.where("sound").drop("sound")
    bad = parsed.where("NOT sound").select("schema_id", "snapshot_id", "ts", "doc", F.lit("not a snapshot of format 1").alias("message"))
    if last is not None:
        newest = last.select("schema_id", F.struct("ts", "snapshot_id").alias("_newest"))
        known = sound.join(newest, "schema_id", "left").withColumn("_late", F.coalesce(F.struct("ts", "snapshot_id") <= F.col("_newest"), F.lit(False)))
        bad = bad.unionByName(known.where("_late").select("schema_id", "snapshot_id", "ts", "doc", F.lit("older than the last state").alias("message")))
        sound = known.where("NOT _late").drop("_late", "_newest")
    bad.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
    moved = changes(sound, last)
    moved.select("schema_id", "snapshot_id", "ts", "before", "fingerprint").write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")
    pairs = moved.where("before_doc IS NOT NULL").withColumn("schema_id", F.concat_ws("@", "schema_id", "snapshot_id"))
    sides = [exploded(read_snapshots(pairs.select("schema_id", F.col(c).alias("doc")))[0]) for c in ("doc", "before_doc")]
    schema_diff(*sides).write.mode("overwrite").parquet(f"{folder}/diff/batch={batch_id}")
    now = sound.select("schema_id", "snapshot_id", "ts", "doc", "fingerprint")
    if last is not None:
        own = now.select("schema_id").distinct()
        now = now.unionByName(last if batch_id % COMPACTION == 0 else last.join(own, "schema_id", "left_semi"))
    _newest(now).write.mode("overwrite").parquet(f"{folder}/last/batch={batch_id}")


def watch(spark: SparkSession, source: str, folder: str, **trigger) -> StreamingQuery:
    """Start the monitor over Parquet events arriving at ``source``; results and checkpoint lie in ``folder``."""
    stream = spark.readStream.schema(EVENT).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: process(df, n, folder)).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def drift_rate(stream: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Distinct states published for each schema and window; the same state within the watermark counts once."""
    own = with_fingerprint(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(["schema_id", "fingerprint"])
    return own.groupBy(F.window("ts", width), "schema_id").agg(F.count("*").alias("n"))
