"""State as a table gives what state by key gives."""

import random

from lakeatlas.plans import documents
from lakeatlas.streaming.history import EVENT, follow, follow_fleet, read_history

from .test_history import day, snap


def land(spark, way, folder, events):
    spark.createDataFrame(events, EVENT).repartition(3).write.mode("append").parquet(f"{folder}/in")
    way(spark, f"{folder}/in", f"{folder}/out", delay="2 days").awaitTermination(120)
    rows = read_history(spark, f"{folder}/out").collect()
    return sorted((r.schema_id or "", r.snapshot_id, r.at, r.kind, r.before or "", r.fingerprint or "", [(x.kind, x.item, x.change) for x in r.leaves]) for r in rows)


def some(seed, first):
    rng = random.Random(seed)
    out = [(s, str(i), day(first + rng.randrange(5)), rng.choice([snap("x"), snap("y"), snap("y", "n"), snap(None, "m"), "{"])) for s in "abcd" for i in range(6)]
    return [*out, *out[:3], ("a", None, day(first), snap("x")), (None, "q", day(first), "{"), (None, None, day(first + 1), None)]


def test_as_by_key(spark, tmp_path):
    once = ("f", "1", day(1), snap("x"))
    batches = [[*some(1, 1), once], some(2, 3), [once, ("e", "1", day(2), snap("old")), (None, None, day(12), None)], [("a", "9", day(6), snap("z")), (None, None, day(28), None)]]
    kinds = set()
    for events in batches:
        one, other = (land(spark, way, f"{tmp_path}/{way.__name__}", events) for way in (follow, follow_fleet))
        assert one == other
        kinds |= {r[3] for r in other}
    assert kinds == {"first", "change", "late", "repeated", "malformed"}


def test_a_batch_that_is_run_again(spark, tmp_path):
    from lakeatlas.streaming.history import settle

    out = str(tmp_path / "out")
    events = [spark.createDataFrame(e, EVENT) for e in (some(3, 1), some(4, 3), [(None, None, day(28), None)])]
    for n, e in enumerate(events):
        settle(e, n, out)
        once = sorted(map(str, read_history(spark, out).collect()))
        settle(e, n, out)
        assert sorted(map(str, read_history(spark, out).collect())) == once
    state = spark.read.parquet(f"{out}/state")
    assert {r.batch for r in state.collect()} == {1, 2} and state.where("batch = 2 AND role = 'waiting'").count() == 0


def test_notes_of_one_name(spark, tmp_path):
    twice = '{"format":1,"schema":{"tables":{},"notes":[{"id":"n","scope":"global","text":"%s"},{"id":"n","scope":"global","text":"%s"}]}}'
    events = [("s", "1", day(1), twice % ("a", "b")), ("s", "2", day(2), twice % ("c", "b")), ("s", "3", day(3), twice % ("b", "d")), (None, None, day(20), None)]
    one, other = (land(spark, way, f"{tmp_path}/{way.__name__}", events) for way in (follow, follow_fleet))
    assert one == other


def test_the_query_makes_no_call_for_each_key(spark, monkeypatch):
    from lakeatlas.streaming import history

    monkeypatch.setattr(history, "follow", None)
    assert documents.QUERIES["drift_stream"](spark, "/root/testdata/sf0.001").count()
