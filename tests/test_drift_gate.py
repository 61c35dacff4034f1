"""The drift gate by document."""

import datetime
import hashlib
import json

from lakeatlas.streaming import drift


def snap(comment):
    schema = {"tables": {"t": {"associations": [], "columns": [{"name": "a", "nullable": True, "type": "int"}], "comment": comment, "indexes": []}}}
    return json.dumps({"fingerprint": "sha256:x", "format": 1, "schema": schema}, sort_keys=True, separators=(",", ":"))


def test_a_malformed_snapshot_leaves_alone(spark, tmp_path):
    t = lambda d: datetime.datetime(2024, 1, d)
    events = [("s", "1", t(1), snap("x")), ("s", "2", t(2), "{"), ("s", "3", t(3), snap("y"))]
    drift.process(spark.createDataFrame(events, drift.EVENT), 0, str(tmp_path))
    got = lambda name: spark.read.parquet(f"{tmp_path}/{name}").collect()
    assert sorted(r.snapshot_id for r in got("changes")) == ["1", "3"]
    assert [(r.schema_id, r.snapshot_id, r.ts, r.doc) for r in got("quarantine")] == [("s", "2", t(2), "{")]
    assert [r.snapshot_id for r in got("last")] == ["3"] and len(got("diff")) == 1


def test_fingerprints_are_canonical(spark):
    table = {
        "columns": [{"type": "int", "name": "a", "nullable": True, "comment": ""}],
        "comment": "x",
        "associations": [
            {"type": "has_many", "name": "b", "target": "b", "provenance": "declared", "sources": []},
            {"type": "belongs_to", "name": "é\n\"", "target": "c", "provenance": "declared", "sources": [], "polymorphic": False},
        ],
        "indexes": [{"columns": ["b"], "unique": True}, {"columns": ["a"], "unique": False, "name": ""}],
    }
    whole = {"format": 1, "fingerprint": "sha256:x", "schema": {"tables": {"t\"1": table, "a": {"columns": []}}}}
    other = json.loads(json.dumps(whole))
    other["schema"]["tables"]["t\"1"]["associations"].reverse()
    other["schema"]["tables"]["t\"1"]["indexes"].reverse()
    changed = json.loads(json.dumps(whole))
    changed["schema"]["tables"]["t\"1"]["columns"][0]["type"] = "text"
    docs = [json.dumps(whole), json.dumps(other, indent=2, sort_keys=True) + "\n ", json.dumps(changed), json.dumps(changed) + " ", "{"]
    df = spark.createDataFrame([("s", str(i), datetime.datetime(2024, 1, 1), d) for i, d in enumerate(docs)], drift.EVENT)
    got = [r.fingerprint for r in drift.with_fingerprint(df).orderBy("snapshot_id").collect()]
    assert got[0] == got[1] != got[2] == got[3] and got[4] is None
    columns = '[{"name":"a","nullable":true,"type":"int"}]'
    plain = '{"format":1,"schema":{"tables":{"t":{"associations":[],"columns":' + columns + ',"comment":"x","indexes":[]}}}}'
    one = spark.createDataFrame([("s", "0", datetime.datetime(2024, 1, 1), snap("x"))], drift.EVENT)
    assert drift.with_fingerprint(one).first().fingerprint == "sha256:" + hashlib.sha256(plain.encode()).hexdigest()


def test_batches_keep_the_newest_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(drift, "COMPACTION", 2)
    t = lambda d: datetime.datetime(2024, 1, d)
    batches = [
        [("s", "1", t(1), snap("x")), ("r", "1", t(1), snap("x"))],
        [("s", "2", t(2), snap("y"))],
        [("q", "1", t(3), snap("x"))],
        [("r", "2", t(4), snap("x")), ("s", "3", t(4), snap("z"))],
    ]
    for n, events in enumerate(batches):
        drift.process(spark.createDataFrame(events, drift.EVENT), n, str(tmp_path))
        drift.process(spark.createDataFrame(events, drift.EVENT), n, str(tmp_path))  # run again
    late = [("s", "0", t(2), snap("z")), ("s", "2", t(2), snap("y"))]
    drift.process(spark.createDataFrame(late, drift.EVENT), 4, str(tmp_path))
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{tmp_path}/quarantine/batch=4").collect()) == ["0", "2"]
    moved = {(r.batch, r.schema_id, r.snapshot_id) for r in spark.read.parquet(f"{tmp_path}/changes").collect()}
    assert moved == {(0, "s", "1"), (0, "r", "1"), (1, "s", "2"), (2, "q", "1"), (3, "s", "3")}
    assert {r.schema_id for r in spark.read.parquet(f"{tmp_path}/last/batch=1").collect()} == {"s"}
    assert {r.schema_id for r in spark.read.parquet(f"{tmp_path}/last/batch=2").collect()} == {"q", "r", "s"}
