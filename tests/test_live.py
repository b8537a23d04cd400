"""Live updates by keyed state, broken and restarted, against a plain fold and the batch operator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import versions
from parlance.sources.tablelog import TableLog
from parlance.streaming import live


def update(i, event, message, text, chat=7, sender=3):
    m = {"chat": {"id": chat}, "message_id": message, "text": text, "date": 1_700_000_000}
    return json.dumps({"update_id": i, "payload": json.dumps({event: m | ({"from": {"id": sender}} if sender else {})}), "received_at": "2026-01-01T00:00:00Z"})


def some_updates():
    rng = random.Random(5)
    said, known, out = ["a", "b", "c #nomem", "d", "e"], set(), []
    for i in range(1, 91):
        m = rng.randrange(12)
        text = "so #OffRecord" if rng.random() < 0.06 else rng.choice(said)
        edit = m in known or rng.random() < 0.2
        out.append((i, "edited_message" if edit else "message", m, text))
        if not edit:
            known.add(m)
    return out


def test_streams(spark, tmp_path, monkeypatch):
    source, folder, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    source.mkdir()
    rows = some_updates()
    # Redelivered and foreign updates, and one without a sender.
    odd = [update(91, "message", rows[0][2], "again"), update(92, "message", 50, "x", chat=8), update(93, "message", 51, "x", sender=None), json.dumps({"update_id": 94, "payload": '{"poll": {}}', "received_at": None})]
    run = lambda: {n: q.awaitTermination() for n, q in live.live_streams(spark, str(source), folder, checkpoint, 7).items()}
    (source / "a.json").write_text("\n".join(update(*r) for r in rows[:40]))
    run()
    log = TableLog(spark, folder)
    first = log.read("states").count()
    assert first > 10 and log.read("ledger").count() == 1

    # The sink of messages breaks after its commit, as if the driver had died: raws go on, and the batch that runs again adds nothing.
    (source / "b.json").write_text("\n".join([*[update(*r) for r in rows[40:]], *odd]))
    store = live.store_batch

    def dying(*args, **more):
        store(*args, **more)
        raise RuntimeError("died")

    monkeypatch.setattr(live, "store_batch", dying)
    queries = live.live_streams(spark, str(source), folder, checkpoint, 7)
    queries["raws"].awaitTermination()
    with pytest.raises(Exception, match="died"):
        queries["messages"].awaitTermination()
    monkeypatch.undo()
    states = log.read("states").count()
    run()
    assert log.read("states").count() == states > first
    assert sorted(r.update_id for r in spark.read.parquet(f"{folder}/raw_updates").collect()) == list(range(1, 95))
    assert [(r.run_type, r.status) for r in log.read("runs").collect()] == [("live", "running")]

    # Against the batch fold: messages as they came first, then their edits.
    none = F.lit(None).cast("string")
    made = {m: i for i, event, m, _ in reversed(rows) if event == "message"}
    d = spark.createDataFrame([(7, m, i, text) for i, event, m, text in rows if event == "message"], "chat_id long, message_id long, seq long, text string").withColumn("off", T.policy(F.col("text")) == "offrecord")
    m0 = d.select("chat_id", "message_id", T.policy(F.col("text")).alias("memory_policy"))
    text = F.when(~F.col("off"), F.col("text"))
    v0 = d.select("chat_id", "message_id", F.lit(1).cast("long").alias("version_seq"), T.content_hash(text, none, F.lit("text")).alias("content_hash"), text.alias("text"), F.col("off").alias("is_redacted"))
    edits = spark.createDataFrame([(7, m, i, text) for i, event, m, text in rows if event != "message" and i > made.get(m, 10**9)], "chat_id long, message_id long, seq long, text string")
    edits = edits.withColumns({"kind": F.lit("text"), "entities": F.lit(None).cast("array<struct<offset:int,length:int,type:string>>")})
    want, _ = versions.edit_versions(m0, v0, edits)
    columns = ["chat_id", "message_id", "version_seq", "content_hash", "text", "is_redacted"]
    stored = lambda: sorted(map(repr, live.stored_versions(log.read("live_versions"), log.read("redactions")).select(*columns).collect()))
    assert stored() == sorted(map(repr, want.select(*columns).collect()))

    # Against a plain fold.
    policy, seen, marks, late = {}, {}, set(), []
    for i, event, m, text in rows:
        if event != "message" and m not in seen:
            late.append(i)
            continue
        own = "offrecord" if "#OffRecord" in text else "nomem" if "#nomem" in text else "normal"
        if own != "normal" and policy.get(m) != "offrecord":
            marks.add((m, own))
        policy[m] = "offrecord" if policy.get(m) == "offrecord" else own
        seen[m] = None if policy[m] == "offrecord" else text
    view = lambda: {r.message_id: (r.memory_policy, r.text) for r in live.current_messages(log.read("states")).collect()}
    assert view() == {m: (policy[m], seen[m]) for m in seen}
    assert {(r.message_id, r.mark_type) for r in log.read("live_marks").collect()} == marks and sorted(r.seq for r in log.read("late_edits").collect()) == late and late

    before, shown = stored(), view()
    live.compact_live(log)
    assert stored() == before and view() == shown and log.read("states").count() == len(seen)
    # The next batch writes its own events alone.
    (source / "c.json").write_text(update(95, "edited_message", next(m for m, p in policy.items() if p == "normal"), "last"))
    run()
    assert log.read("states").count() == len(seen) + 1
