import datetime
import json

import pytest

from lakeatlas.streaming.history import EVENT, follow, read_history


def snap(comment, note=None):
    schema = {"tables": {"t": {"associations": [], "columns": [{"name": "a", "nullable": True, "type": "int"}], "comment": comment, "indexes": []}}}
    if note:
        schema["notes"] = [{"id": "n", "scope": "global", "text": note}]
    return json.dumps({"fingerprint": "?", "format": 1, "schema": schema})


def day(d):
    return datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc)


@pytest.fixture()
def stream(spark, tmp_path):
    def land(*events):
        spark.createDataFrame(list(events), EVENT).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        follow(spark, f"{tmp_path}/in", str(tmp_path / "out"), delay="2 days").awaitTermination(120)
        rows = read_history(spark, str(tmp_path / "out")).collect()
        return sorted((r.schema_id or "", r.snapshot_id, r.kind, [(x.kind, x.item, x.change) for x in r.leaves]) for r in rows)

    return land


def test_late_and_out_of_order(stream):
    got = stream(("s", "1", day(1), snap("x")), ("s", "3", day(4), snap("x")), ("r", "1", day(9), snap("x")))
    first = [("table", "t", "added")]
    assert got == [("s", "1", "first", first)]  # the watermark stands at day 7: 3 is settled and says nothing new
    got = stream(("s", "2", day(3), snap("late")), ("s", "5", day(9), snap("y")), ("s", "4", day(8), snap("x", "hint")), ("s", "3", day(4), snap("x")), ("s", "6", day(9), "{"))
    assert got == [("s", "1", "first", first), ("s", "2", "late", []), ("s", "3", "repeated", []), ("s", "6", "malformed", [])]
    got = stream((None, None, day(20), None))
    assert got == [
        ("r", "1", "first", first),
        ("s", "1", "first", first),
        ("s", "2", "late", []),
        ("s", "3", "repeated", []),
        ("s", "4", "change", [("note", "n", "added")]),
        ("s", "5", "change", [("note", "n", "removed"), ("table", "t", "changed")]),
        ("s", "6", "malformed", []),
    ]
    assert stream(("s", "7", day(20), snap("y")), (None, None, day(29), None)) == got


def test_state_is_read_and_written_once_for_a_batch():
    from lakeatlas.streaming.history import History

    calls = []

    class Value:
        def __init__(self, name):
            self.name, self.held = name, None

        def get(self):
            calls.append(f"get {self.name}")
            return self.held

        def update(self, held):
            calls.append(f"update {self.name}")
            self.held = held

        def clear(self):
            calls.append(f"clear {self.name}")
            self.held = None

    class Handle:
        def getValueState(self, name, schema):  # noqa: N802
            return Value(name)

        def registerTimer(self, at):  # noqa: N802
            calls.append(f"timer {at}")

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    h = History()
    h.init(Handle())
    row = lambda i: {"sound": True, "snapshot_id": str(i), "at": i * 1000, "fingerprint": f"f{i // 2}", "leaves": [{"kind": "table", "item": "t", "hash": f"h{i // 2}"}]}
    out = list(h.handleInputRows(("s",), iter([row(i) for i in (5, 3, 2, 9, 8, 4)]), Now(4)))
    assert [(r.snapshot_id, r.kind) for r in out] == [("2", "first"), ("4", "change")]
    assert sorted(calls) == ["get settled", "get waiting", "timer 4", "update settled", "update waiting"]
    calls.clear()
    out = list(h.handleExpiredTimer(("s",), Now(8), None))
    assert [(r.snapshot_id, r.kind) for r in out] == [("8", "change")]
    assert sorted(calls) == ["get settled", "get waiting", "timer 8", "update settled", "update waiting"]
    assert [(r.snapshot_id, r.kind) for r in h.handleExpiredTimer(("s",), Now(9), None)] == [] and h.waiting.held is None
