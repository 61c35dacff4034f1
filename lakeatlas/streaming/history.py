"""The history of schemas as keyed state: snapshots as they arrive, changes as they happened.

State is held for each schema: the last snapshot that is settled (its time, id, fingerprint and leaves of its hash tree), and
the snapshots that have arrived since, in order of event time. A snapshot is settled when the watermark passes it, by an
event-time timer; what arrives out of order within the watermark's delay is so put into its place. What is older than the
settled snapshot of its schema can change nothing any more and is told as late. Documents themselves are not kept.

``follow`` holds the state by key, for batches that bring few of the schemas. ``follow_fleet`` is for batches that bring most of
them: the same state is a table, which each batch joins as a whole and writes anew, without a call for each key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakeatlas.operators.canonical import document_json, document_leaves, fingerprint
from lakeatlas.operators.store import remove, written_at
from lakeatlas.sources.documents import SNAPSHOT, is_snapshot

EVENT = "schema_id STRING, snapshot_id STRING, ts TIMESTAMP, doc STRING"
_STATE = "at bigint, snapshot_id string, fingerprint string, leaves map<string,string>"  # hashes by kind and item
OUT = "schema_id string, snapshot_id string, at bigint, kind string, before string, fingerprint string, leaves array<struct<kind:string,item:string,change:string>>"
#: The setting that keyed state with timers needs, and its value.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _changed(old: dict[str, str], new: dict[str, str]) -> list[tuple[str, str, str]]:
    moved = sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))
    return [(*k.split("\n", 1), "removed" if k not in new else "added" if k not in old else "changed") for k in moved]


class History(StatefulProcessor):
    """Rows (schema_id, snapshot_id, at, fingerprint, leaves, sound) of one schema to rows of ``OUT``.

    State is read and put back once for all rows that a schema has in a batch, and one timer stands for the first snapshot that
    waits: each call of the state goes from Python to the JVM and back.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", _STATE)
        self.waiting = handle.getValueState("waiting", f"snapshots array<struct<{_STATE.replace(' ', ':').replace(',:', ',')}>>")

    def _held(self) -> tuple[tuple | None, dict[tuple[int, str], tuple[str, dict[str, str]]]]:
        """The settled snapshot, and fingerprint and leaves of those that wait by their place."""
        last, waiting = self.settled.get(), self.waiting.get()
        return last, {(x[0], x[1]): (x[2], x[3]) for x in waiting[0]} if waiting else {}

    def _settle(self, schema_id: str, last: tuple | None, waiting: dict, until: int) -> Iterator[Row]:
        """Snapshots up to ``until`` (milliseconds), in order; a row for each whose fingerprint is not that of the one before.
        The others go on waiting."""
        due = sorted(place for place in waiting if place[0] // 1000 <= until)
        for place in due:
            mark, leaves = waiting.pop(place)
            if last is None or last[2] != mark:
                moved = [Row(kind=k, item=i, change=c) for k, i, c in _changed(last[3] if last else {}, leaves)]
                yield Row(schema_id=schema_id, snapshot_id=place[1], at=place[0], kind="change" if last else "first", before=last[2] if last else None, fingerprint=mark, leaves=moved)
            last = (*place, mark, leaves)
        if due:
            self.settled.update(last)

    def _wait(self, waiting: dict) -> None:
        """Keep what waits, with a timer for the first. Timers fire when the watermark is beyond them, and a snapshot is due when it
        reaches its time."""
        if not waiting:
            self.waiting.clear()
            return
        self.waiting.update(([(*place, *x) for place, x in waiting.items()],))
        self.handle.registerTimer(max(1, min(at for at, _ in waiting) // 1000 - 1))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        last, waiting = self._held()
        there = bool(waiting)
        for r in rows:
            if not r["sound"]:
                if r["snapshot_id"] is not None:  # else a heartbeat, which moves the watermark and says nothing
                    yield Row(schema_id=key[0], snapshot_id=r["snapshot_id"], at=r["at"], kind="malformed", before=None, fingerprint=None, leaves=[])
                continue
            place = (r["at"], r["snapshot_id"])
            if last is not None and place <= (last[0], last[1]):
                kind = "repeated" if place == (last[0], last[1]) and r["fingerprint"] == last[2] else "late"
                yield Row(schema_id=key[0], snapshot_id=r["snapshot_id"], at=r["at"], kind=kind, before=None, fingerprint=r["fingerprint"], leaves=[])
                continue
            if place not in waiting or waiting[place][0] < r["fingerprint"]:  # of two under one id the same one always
                waiting[place] = (r["fingerprint"], {f"{x['kind']}\n{x['item']}": x["hash"] for x in r["leaves"]})
        yield from self._settle(key[0], last, waiting, timerValues.getCurrentWatermarkInMs())
        if waiting or there:
            self._wait(waiting)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        last, waiting = self._held()
        if waiting:
            yield from self._settle(key[0], last, waiting, timerValues.getCurrentWatermarkInMs())
            self._wait(waiting)

    def close(self) -> None:
        pass


def history(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream of events (``EVENT``) as rows of ``OUT``: kind is first or change for a snapshot that differs from the one before
    it in event time, late for one older than what is settled, repeated for the settled one come again, malformed for what is
    no snapshot of format 1. ``leaves`` are the tables, notes and groups that differ.

    ``ts`` and ``snapshot_id`` order the snapshots of a schema; an event without them or without a schema is malformed, one with
    neither snapshot_id nor document is a heartbeat. Fingerprints and leaves are computed from the document, by the JVM. The
    event-time column ends before the state, so that Spark does not drop what is behind the watermark and it is told.
    """
    return _read(events.withWatermark("ts", delay)).groupBy("schema_id").transformWithState(History(), OUT, "Append", "EventTime")


def _read(events: DataFrame) -> DataFrame:
    """(schema_id, snapshot_id, at, fingerprint, leaves, sound) of events."""
    parsed = events.withColumn("d", F.from_json("doc", SNAPSHOT))
    sound = is_snapshot(F.col("d")) & F.col("ts").isNotNull() & F.col("snapshot_id").isNotNull() & F.col("schema_id").isNotNull()
    return parsed.select(
        "schema_id",
        "snapshot_id",
        F.unix_micros("ts").alias("at"),
        F.when(sound, fingerprint(document_json(F.col("d")))).alias("fingerprint"),
        F.when(sound, document_leaves(F.col("d"))).alias("leaves"),
        sound.alias("sound"),
    )


def follow(spark: SparkSession, source: str, folder: str, delay: str = "7 days", **trigger) -> StreamingQuery:
    """Follow Parquet events at ``source``: rows of ``OUT`` go to ``folder``/history, once each, with a checkpoint beside them from
    which a stopped stream goes on."""
    before = spark.conf.get(STATE_STORE[0], None)
    spark.conf.set(*STATE_STORE)
    try:
        stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(source)
        writer = history(stream, delay).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/history")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.unset(STATE_STORE[0]) if before is None else spark.conf.set(STATE_STORE[0], before)


_LEAVES = "array<struct<kind:string,item:string,hash:string>>"
_HELD = f"role string, schema_id string, at bigint, snapshot_id string, fingerprint string, leaves {_LEAVES}"


def _named(leaves: Column) -> Column:
    return F.transform(leaves, lambda x: F.struct(x["kind"].alias("kind"), x["item"].alias("item")))


def _last_of_each(leaves: Column) -> Column:
    """Leaves by name; of several under one name (which are rare) the last."""
    later = lambda x, i: ~F.array_contains(F.slice(_named(leaves), i + 2, F.size(leaves)), F.struct(x["kind"].alias("kind"), x["item"].alias("item")))
    return F.when(F.size(F.array_distinct(_named(leaves))) == F.size(leaves), leaves).otherwise(F.filter(leaves, later))


def _moved(old: Column, new: Column) -> Column:
    """What ``_changed`` tells, of two columns of leaves."""
    old = F.coalesce(old, F.array().cast(_LEAVES))
    differ = F.array_sort(F.array_distinct(_named(F.concat(F.array_except(new, old), F.array_except(old, new)))))
    change = lambda k: F.when(~F.array_contains(_named(new), k), "removed").when(~F.array_contains(_named(old), k), "added").otherwise("changed")
    return F.transform(differ, lambda k: F.struct(k["kind"].alias("kind"), k["item"].alias("item"), change(k).alias("change")))


def settle(events: DataFrame, batch_id: int, folder: str, delay: str = "7 days") -> None:
    """One micro-batch of ``follow_fleet``: its events take their places between what is settled and what waits, and those that the
    watermark has passed, with this batch counted, are settled.

    All rows of a schema meet in one shuffle. State and results lie in folders of the batch's number, so that one that is run
    again replaces what it wrote; the state before the last is removed.
    """
    spark = events.sparkSession
    state = lambda n: f"{folder}/state/batch={n}"
    held = spark.read.schema(_HELD).parquet(state(batch_id - 1)) if batch_id else spark.createDataFrame([], _HELD)
    now = events.agg(F.unix_millis(F.max("ts") - F.expr(f"INTERVAL {delay}"))).first()[0]
    before = held.where("role = 'mark'").agg(F.max("at")).first()[0]
    mark = max(x or 0 for x in (now, before, 0))

    place = F.struct("at", "snapshot_id")
    new = _read(events).withColumns({"role": F.when(F.col("sound"), "new").otherwise("malformed"), "leaves": _last_of_each(F.col("leaves"))})
    every = held.where("role <> 'mark'").unionByName(new.where("sound OR snapshot_id IS NOT NULL").drop("sound"))
    last = F.max(F.when(F.col("role") == "settled", F.struct("at", "snapshot_id", "fingerprint"))).over(Window.partitionBy("schema_id"))
    known = F.struct(F.col("last.at").alias("at"), F.col("last.snapshot_id").alias("snapshot_id"))
    late = F.when(place == known, F.when(F.col("fingerprint") == F.col("last.fingerprint"), "repeated").otherwise("late")).when(place < known, "late")
    told = F.when(F.col("role") == "malformed", "malformed").when((F.col("role") == "new") & F.col("last").isNotNull(), late)
    rows = every.withColumn("last", last).withColumn("told", told).drop("last")

    apart = Window.partitionBy("schema_id", F.col("told").isNull())
    twice = F.lag(place).over(apart.orderBy("at", "snapshot_id", F.desc("fingerprint"))) == place  # the first has the greatest fingerprint
    rows = rows.withColumn("twice", F.coalesce(twice, F.lit(False))).where("told IS NOT NULL OR NOT twice").drop("twice")
    rows = rows.withColumn("due", (F.col("role") == "settled") | (F.floor(F.col("at") / 1000) <= mark))
    order = apart.orderBy("at", "snapshot_id")
    rows = rows.withColumns({"before": F.lag("fingerprint").over(order), "old": F.lag("leaves").over(order), "is_last": ~F.coalesce(F.lead("due").over(order), F.lit(False))})
    settled = F.col("told").isNull() & F.col("due")
    moves = settled & (F.col("role") != "settled") & ~F.col("before").eqNullSafe(F.col("fingerprint"))
    marked = rows.select(
        F.when(settled & F.col("is_last"), "settled").when(F.col("told").isNull() & ~F.col("due"), "waiting").alias("role"),
        "schema_id",
        "at",
        "snapshot_id",
        "fingerprint",
        "leaves",
        F.coalesce("told", F.when(moves, F.when(F.col("before").isNull(), "first").otherwise("change"))).alias("kind"),
        F.when(moves, F.col("before")).alias("before"),
        F.when(moves, _moved(F.col("old"), F.col("leaves"))).otherwise(F.array().cast("array<struct<kind:string,item:string,change:string>>")).alias("moved"),
    )
    marked = written_at(marked.where("role IS NOT NULL OR kind IS NOT NULL"), work := f"{folder}/work/batch={batch_id}")
    out = marked.where("kind IS NOT NULL").select("schema_id", "snapshot_id", "at", "kind", "before", "fingerprint", F.col("moved").alias("leaves"))
    written_at(out, f"{folder}/history/batch={batch_id}")
    own = marked.where("role IS NOT NULL").select("role", "schema_id", "at", "snapshot_id", "fingerprint", "leaves")
    written_at(own.unionByName(spark.createDataFrame([("mark", mark)], "role string, at bigint"), allowMissingColumns=True), state(batch_id))
    remove(spark, work)
    remove(spark, state(batch_id - 2))


def follow_fleet(spark: SparkSession, source: str, folder: str, delay: str = "7 days", **trigger) -> StreamingQuery:
    """What ``follow`` does, with the state as a table (``settle``). A batch settles what its own events let the watermark pass."""
    stream = spark.readStream.schema(EVENT).option("recursiveFileLookup", True).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, n: settle(df, n, folder, delay)).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/history").drop("batch")
