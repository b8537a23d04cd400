"""Table log, import job, rollback and erasure cascade, stopped where it hurts."""

import json

import pytest
from pyspark.sql import functions as F

from parlance import jobs
from parlance.operators import governance
from parlance.sources.tablelog import Conflict, TableLog


class Killed(BaseException):
    """A process that ends here."""


def test_table_log(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    assert log.version() == -1 and log.tables() == {}
    one = spark.range(3)
    log.commit(-1, {"a": one, "b": one}, note={"by": "me"})
    log.commit(0, append={"a": spark.range(3, 5)})
    with pytest.raises(Conflict):
        log.commit(0, {"a": one})
    assert (log.read("a").count(), log.read("a", 0).count(), log.read("b").count(), log.manifest(0)["note"]) == (5, 3, 3, {"by": "me"})
    seen = []

    def make(tables):  # another writer comes between, once
        seen.append(tables["a"].count())
        if len(seen) == 1:
            log.commit(log.version(), append={"a": spark.range(10, 11)})
        return {}, {"a": spark.range(100, 101)}, "done"

    assert log.change(make) == "done" and seen == [5, 6] and log.read("a").count() == 7
    log.compact(2)
    assert len(log.manifest()["tables"]["a"]["paths"]) == 1 and log.read("a").count() == 7
    assert log.vacuum(1) > 0 and log.read("a").count() == 7 and log.read("b").count() == 3
    log.commit(log.version(), {"a": one.limit(0)})
    assert log.read("a").count() == 0


def export(path, n, chat=7):
    messages = []
    for i in range(1, n + 1):
        m = {"id": i, "type": "message", "date_unixtime": str(1_700_000_000 + i), "from": f"N{i % 5}", "from_id": f"user{i % 5}", "text": f"text {i}"}
        if i % 7 == 0:
            m["reply_to_message_id"] = i - 3 if i % 2 else i + 3  # the later target isn't there yet
        if i % 11 == 0:
            m["text"] = [m["text"], {"type": "hashtag", "text": " #offrecord"}]
        if i % 13 == 0:
            m["type"] = "service"
        if i % 17 == 0:
            m["from_id"] = "user99999999999999999999"
        if i % 19 == 0:
            m["text"] += " #nomem" if isinstance(m["text"], str) else ""
        messages.append(m)
    messages.append(messages[0])  # once more
    path.write_text(json.dumps({"id": chat, "name": "n", "type": "private_group", "messages": messages}))
    return str(path)


def contents(log):
    """All rows of an archive but times of runs."""
    return {n: sorted(map(repr, (df.drop("started_at", "finished_at", "captured_at") if n == "runs" else df).collect())) for n, df in log.tables().items()}


def test_import(spark, tmp_path, monkeypatch, capsys):
    path = export(tmp_path / "e.json", 60)
    whole = tmp_path / "whole"
    assert jobs.import_export(spark, path, str(whole), size=40) == {"run": 1, "slices": 2, "outcomes": {"applied": 48, "no_user": 3, "offrecord": 5, "service": 4, "stored_duplicate": 1}}
    log = TableLog(spark, str(whole))
    m = {r.message_id: r for r in log.read("messages").collect()}
    assert len(m) == 53 and m[1].text == "text 1" and m[22].text is None and m[22].is_redacted and m[19].memory_policy == "nomem"
    assert m[7].reply_to == 4 and m[14].reply_to is None and m[1].raw_id == "import:1:7:1" and str(m[1].date) == "2023-11-14 22:13:21"
    assert log.read("versions").count() == 53 and log.read("raws").count() == 53 and log.read("marks").count() == 8
    assert {r.user_id: r.first_name for r in log.read("users").collect()} == {i: f"N{i}" for i in range(5)}
    assert json.loads(log.read("raws").where("message_id = 7").first().payload)["reply_to_message_id"] == 4

    # Killed in its second commit (the run) and its fourth (the last slice): nothing of the step is seen, and the resumed import ends like the other one.
    publish = TableLog._publish
    for n in (1, 3):
        folder, left = tmp_path / f"killed{n}", [n]

        def dying(self, version, manifest, left=left):
            left[0] -= 1
            if left[0] < 0:
                raise Killed
            publish(self, version, manifest)

        monkeypatch.setattr(TableLog, "_publish", dying)
        with pytest.raises(Killed):
            jobs.import_export(spark, path, str(folder), size=40)
        monkeypatch.setattr(TableLog, "_publish", publish)
        if n > 1:
            with pytest.raises(jobs.PartialRun):
                jobs.import_export(spark, path, str(folder), size=40)
            assert TableLog(spark, str(folder)).read("messages").count() == log.read("messages", n - 1).count() > 0
        assert jobs.import_export(spark, path, str(folder), resume=True, size=40)["outcomes"]["applied"] == 48
        assert contents(TableLog(spark, str(folder))) == contents(log)

    # A run that fails says why, and is resumed.
    failing = tmp_path / "failing"

    def bad(*args):
        raise RuntimeError("no")

    monkeypatch.setattr(jobs, "_apply_slice", bad)
    assert jobs.main(["import", path, str(failing)]) == 5
    (run,) = TableLog(spark, str(failing)).read("runs").collect()
    assert (run.status, run.error, run.finished_at is not None) == ("failed", "RuntimeError", True)
    monkeypatch.undo()
    assert jobs.main(["import", path, str(failing)]) == 2
    assert jobs.main(["import", str(tmp_path / "none.json"), str(failing)]) == 4
    capsys.readouterr()

    # Rollback of two runs, each twice.
    second = export(tmp_path / "f.json", 20, chat=8)
    assert jobs.main(["import", second, str(whole)]) == 0
    capsys.readouterr()
    assert [jobs.main(["rollback", str(whole), run]) for run in ("9", "1", "1")] == [3, 0, 0]
    reports = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [r["done_before"] for r in reports] == [False, True] and reports[0]["messages"] == reports[1]["messages"] == 53
    assert {r.chat_id for n in ("messages", "versions", "marks", "raws") for r in log.read(n).collect()} == {8}
    monkeypatch.setattr(TableLog, "_publish", lambda *a: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        jobs.rollback(spark, str(whole), 2)
    monkeypatch.undo()
    assert log.read("messages").count() == 18 and log.read("marks").count() > 0
    assert jobs.main(["rollback", str(whole), "2"]) == 0 and log.read("messages").count() == log.read("marks").count() == 0
    assert jobs.main(["rollback", str(whole), "3"]) == 2  # the audit row is no import


def test_cascade(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    jobs.import_export(spark, export(tmp_path / "e.json", 30), folder)
    log = TableLog(spark, folder)
    events = [(1, "user:2", "user", "2"), (2, "message:7:1", "message", "1"), (3, "message_hash:x", "message_hash", "x"), (4, "user:none", "user", "none"), (5, "user:3", "user", "3")]
    d = spark.createDataFrame([(*e, "pending") for e in events], "id long, tombstone_key string, target_type string, target_id string, status string")
    d = d.withColumns({"created_at": F.timestamp_seconds("id"), "cascade": F.lit(None).cast("map<string,struct<status:string,reason:string>>"), "error": F.lit(None).cast("string")})
    traces = spark.createDataFrame([(1, 2, "what?", False), (2, 4, "who?", False)], "query_id long, user_id long, query_text string, query_redacted boolean")
    log.commit(log.version(), {"tombstones": d, "traces": traces})

    def broken(rows, hit, events):
        raise RuntimeError("no")

    got = governance.run_cascade(log, 2, governance.LAYERS | {"versions": broken})
    assert got == {"claimed": [1, 2], "failed": {1: "failed layers: versions", 2: "failed layers: versions"}}
    e = {r.id: r for r in log.read("tombstones").collect()}
    assert e[1].cascade["versions"].asDict() == {"status": "failed", "reason": "RuntimeError"} and e[1].cascade["messages"].status == e[1].cascade["traces"].status == "completed"
    assert e[2].cascade["traces"].reason == "not_applicable" and e[1].cascade["links"].reason == "table_not_exists" and e[5].status == "pending"
    m = {r.message_id: r for r in log.read("messages").collect()}
    assert m[2].text is None and m[2].memory_policy == "forgotten" and m[1].text is None and m[3].text == "text 3"
    assert {r.message_id for r in log.read("versions").where("text is null").collect()} == {11, 22}
    assert {r.query_id: r.query_text for r in log.read("traces").collect()} == {1: None, 2: "who?"}

    # Another tick comes between reading and claiming: each event is claimed once.
    claims, publish = [], TableLog._publish

    def racing(self, version, manifest):
        if manifest["note"].get("step") == "claim" and not claims:
            claims.append(None)
            claims[0] = governance.run_cascade(TableLog(spark, folder), 2)
        publish(self, version, manifest)

    monkeypatch.setattr(TableLog, "_publish", racing)
    late = governance.run_cascade(log, 2)
    assert claims[0] == {"claimed": [3, 4], "failed": {4: "target_id must be a whole number"}} and late == {"claimed": [5], "failed": {}}
    e = {r.id: r for r in log.read("tombstones").collect()}
    assert {i: r.status for i, r in e.items()} == {1: "failed", 2: "failed", 3: "completed", 4: "failed", 5: "completed"}
    assert e[3].cascade["messages"].reason == "target_type_not_supported_yet" and not e[4].cascade
    assert log.read("versions").where("message_id = 3 and text is null").count() == 1
    assert jobs.forget(spark, folder) == {"claimed": [], "failed": {}}
