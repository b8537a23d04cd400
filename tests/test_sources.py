"""Exports, streams, seeds and text functions on small files and literals."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import governance, ingest, search, versions
from parlance.sources import exports
from parlance.streaming import updates


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    return str(path)


ENTRIES = [
    {"id": 1, "type": "message", "text": "plain"},
    {"id": 2, "type": "message", "text": ["two ", 3, {"type": "bold", "text": "b"}, ["in", ["ner"]], {"type": "x", "text": None}, True, 1.5]},
    {"id": 3, "type": "message", "text": "", "text_entities": [{"type": "hashtag", "text": "#nomem"}]},
    {"id": 4, "type": "message", "poll": {"question": "who?"}},
    {"id": 5, "type": "message", "contact_information": {"first_name": "A", "last_name": ""}, "text": ""},
    {"id": 6, "type": "message", "media_type": "photo", "text": "caption", "reply_to_message_id": 1},
    {"id": 7, "type": "message", "dice": {"emoji": "x"}},
    {"id": "8", "type": "message"},
    {"type": "message", "text": "no id"},
    "no object",
    {"id": True},
]


def test_export_entries(spark, tmp_path):
    path = write(tmp_path / "e.json", {"name": "n", "type": "private_group", "id": 7, "messages": ENTRIES})
    d = exports.read_export(spark, path)
    rows = {r.id: r for r in d.collect()}
    assert set(rows) == set(range(1, 8)) and all(r.chat_id == 7 for r in rows.values())
    assert rows[2].text == "two 3binner1.5" and rows[3].text == "" and rows[3].entities_text == "#nomem" and rows[4].text is None
    assert rows[4].poll_question == "who?" and rows[6].reply_to_message_id == 1
    kinds = {r.id: r.kind for r in d.select("id", T.message_kind(names=d.columns).alias("kind")).collect()}
    assert kinds == {1: "text", 2: "text", 3: "text", 4: "poll", 5: "contact", 6: "photo", 7: "dice"}
    parts = {r.id: (r.x.text, r.x.caption) for r in d.select("id", T.text_and_caption(T.message_kind(names=d.columns), F.coalesce("text", F.lit("")), F.col("entities_text")).alias("x")).collect()}
    assert parts[3] == ("#nomem", None) and parts[6] == (None, "caption") and parts[4] == (None, None)
    bad = {(r.place, r.reason) for r in exports.unreadable_entries(spark, path).collect()}
    assert bad == {(7, "id is no whole number"), (8, "no id"), (9, "no object"), (10, "id is no whole number")}
    assert exports.export_chat_id(spark, path) == 7
    exports.split_export(spark, path, str(tmp_path / "lines"))
    again = exports.read_split(spark, str(tmp_path / "lines"))
    assert sorted(map(repr, again.select(*d.columns).collect())) == sorted(map(repr, d.collect()))


@pytest.mark.parametrize("bad", ["[1]", "not json", {"chats": [], "messages": []}, {"messages": {}}, {"id": 1}])
def test_export_refused(spark, tmp_path, bad):
    with pytest.raises(exports.ExportError):
        exports.read_export(spark, write(tmp_path / "bad.json", bad))


def test_export_missing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        exports.read_export(spark, str(tmp_path / "none.json"))
    with pytest.raises(exports.ExportError):
        exports.export_chat_id(spark, write(tmp_path / "s.json", {"id": "7", "messages": []}))


def test_lines_and_sheet(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"a": 1}\n\n{"a": 2\n{"a": 3}\n')
    rows = exports.read_jsonl(spark, path, "a int").collect()
    assert sorted(r.a for r in rows if r.a is not None) == [1, 3] and sum(r._corrupt_record is not None for r in rows) == 1
    with pytest.raises(ValueError, match=":3:"):
        exports.check_jsonl(spark, path)
    sheet = write(tmp_path / "s.csv", "id,name\n 5 ,x\nno,y\n,z\n6,w\n")
    assert {r.user_id for r in exports.read_sheet(spark, sheet).collect()} == {5, 6}
    assert exports.source_digest(sheet, 7) == hashlib.sha256(open(sheet, "rb").read()).hexdigest()
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "row_number long, q0 string")
    exports.write_sheet(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    history = write(tmp_path / "h.jsonl", "\n".join(json.dumps({"ts": f"2026-01-0{d}T00:00:00Z", "role": "u", "text": str(d)}) for d in range(1, 6)))
    assert [r.text for r in exports.recent_history(spark, history, F.lit("2026-01-05 12:00:00").cast("timestamp"), 48, 1).collect()] == ["5"]
    report = spark.createDataFrame([(1, datetime.datetime(2026, 1, 2, 3, 4, 5))], "n int, at timestamp")
    assert json.loads(exports.report_json(report).first().value) == {"n": 1, "at": "2026-01-02T03:04:05Z"}
    exports.write_version(report, str(tmp_path / "table"), 3)
    assert spark.read.parquet(str(tmp_path / "table/v=3")).count() == 1


def test_update_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "t")
    source.mkdir()

    def payload(**x):
        return json.dumps(x)

    first = [
        {"update_id": 1, "payload": payload(message={"chat": {"id": 5}, "message_id": 9, "text": "hello"}), "received_at": "2026-01-01T00:00:00Z"},
        {"update_id": 1, "payload": payload(message={"chat": {"id": 5}, "message_id": 9, "text": "hello"}), "received_at": "2026-01-01T00:00:00Z"},
        {"payload": payload(my_chat_member={"chat": {"id": 6}}), "received_at": "2026-01-01T00:00:00Z"},
        {"update_id": 3_000_000, "payload": payload(message_reaction_count={"x": 1}), "received_at": "2026-01-01T00:00:00Z"},
        {"update_id": 4, "payload": payload(edited_message={"message_id": 1, "text": "#OFFRECORD x", "reply_to_message": {"text": "secret", "quote": {"text": "deep"}}}), "received_at": "2026-01-01T00:00:00Z"},
    ]
    (source / "a.json").write_text("\n".join(map(json.dumps, first)))
    run = lambda: updates.archive_stream(spark, str(source), target, str(tmp_path / "c")).awaitTermination()
    run()
    rows = {r.update_id: r for r in spark.read.parquet(target).collect()}
    assert set(rows) == {1, None, 3_000_000, 4} and spark.read.parquet(target).count() == 4
    assert rows[None].kind == "my_chat_member" and rows[None].chat_id == 6 and rows[3_000_000].kind == "message_reaction_count"
    assert rows[4].is_redacted and "secret" not in rows[4].payload and "deep" not in rows[4].payload and "#OFF" not in rows[4].payload
    (source / "b.json").write_text("\n".join(map(json.dumps, [first[0], first[3], {**first[0], "update_id": 2}])))
    run()
    assert sorted(r.update_id or 0 for r in spark.read.parquet(target).collect()) == [0, 1, 2, 4, 3_000_000]
    # The same batch once more, as after a failure: nothing doubles, rows without an id neither.
    again = updates.describe(spark.read.schema(updates.UPDATE).json(str(source / "a.json")))
    updates.store_updates(again, 0, target)
    assert spark.read.parquet(target).count() == 5
    with pytest.raises(Exception, match="."):  # a target that can't be read isn't taken for an empty one
        (tmp_path / "broken").mkdir()
        (tmp_path / "broken" / "x.parquet").write_text("no parquet")
        updates.store_updates(again, 7, str(tmp_path / "broken"))


def test_raw_hash(spark):
    rows = spark.createDataFrame([('{"b": 1, "a": "é"}',), ('{"a":"\\u00e9","b":1}',), ("no json",), (None,)], "p string").select(updates.raw_hash("p").alias("h")).collect()
    want = hashlib.sha256(json.dumps({"a": "é", "b": 1}, sort_keys=True).encode()).hexdigest()
    assert [r.h for r in rows] == [want, want, hashlib.sha256(b"no json").hexdigest(), None]


def test_edit_stream(spark, tmp_path):
    state = str(tmp_path / "s")
    spark.createDataFrame([(1, 1, "a", "normal"), (1, 2, "b", "normal")], "chat_id long, message_id long, text string, memory_policy string").write.parquet(f"{state}/v=0")
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps(x) for x in [{"chat_id": 1, "message_id": 1, "seq": 2, "text": "c #nomem"}, {"chat_id": 1, "message_id": 1, "seq": 1, "text": "x"}, {"chat_id": 9, "message_id": 9, "seq": 1, "text": "early"}]))
    updates.edit_stream(spark, str(source), state, str(tmp_path / "late"), str(tmp_path / "c")).awaitTermination()
    (source / "b.json").write_text(json.dumps({"chat_id": 1, "message_id": 1, "seq": 3, "text": "so #offrecord"}))
    updates.edit_stream(spark, str(source), state, str(tmp_path / "late"), str(tmp_path / "c")).awaitTermination()
    one = {r.message_id: (r.text, r.memory_policy) for r in spark.read.parquet(f"{state}/v=1").collect()}
    two = {r.message_id: (r.text, r.memory_policy) for r in spark.read.parquet(f"{state}/v=2").collect()}
    assert one == {1: ("c #nomem", "nomem"), 2: ("b", "normal")} and two == {1: (None, "offrecord"), 2: ("b", "normal")}
    assert [r.text for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["early"]


def test_scrub(spark):
    deep = {"message": {"text": "t", "message_id": 1, "reply_to_message": {"caption": "c", "pinned_message": {"text": "p", "entities": []}}}, "other": {"text": "stays"}}
    got = spark.createDataFrame([(json.dumps(deep),), ("[1]",), ("broken",), (None,)], "p string").select(governance.scrub_update("p").alias("s")).collect()
    assert json.loads(got[0].s) == {"message": {"message_id": 1, "reply_to_message": {"pinned_message": {}}}, "other": {"text": "stays"}}
    assert [r.s for r in got[1:]] == [None, None, None]


def test_policies_and_times(spark):
    rows = spark.createDataFrame([("1700000000", None), ("1700000000.5", None), ("x", "2026-01-02T03:04:05"), (None, "2026-01-02T03:04:05+03:00"), (None, "bad"), (None, "2026-01-02")], "u string, i string")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = [r.t for r in rows.select(F.unix_micros(T.export_time(F.col("u"), F.col("i"))).alias("t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    utc = lambda *x: int(datetime.datetime(*x, tzinfo=datetime.timezone.utc).timestamp() * 1e6)
    assert got == [1_700_000_000_000_000, 1_700_000_000_500_000, utc(2026, 1, 2, 3, 4, 5), utc(2026, 1, 2, 0, 4, 5), None, utc(2026, 1, 2)]
    marks = spark.createDataFrame([("a#nomem",), ("#NoMem!",), ("привет #offrecord",), ("#offrecordя",), ("#nomem_x",), (None,)], "t string").select(T.policy(F.col("t")).alias("p")).collect()
    assert [r.p for r in marks] == ["normal", "nomem", "offrecord", "normal", "normal", "normal"]
    names = spark.createDataFrame([("user12",), ("channel9",), ("user-1",), ("bot3",), (None,), ("user99999999999999999999",)], "f string").select(T.export_user_id(F.col("f")).alias("u")).collect()
    assert [r.u for r in names] == [12, -1, None, None, None, None]


def test_stem(spark):
    words = {"важная": "важн", "важнейшие": "важн", "вазы": "ваз", "вазах": "ваз", "говорила": "говор", "говорить": "говор", "говоря": "говор", "новостями": "новост", "новость": "новост", "скорость": "скорост", "скоростью": "скорост", "кошки": "кошк", "кошка": "кошк", "хочется": "хочет", "abc": "abc", "всё": "все"}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", T.russian_stem(F.col("w")).alias("s")).collect()}
    assert {w: s for w, s in got.items() if s != words[w]} == {}


def test_search_stems(spark):
    m = spark.createDataFrame([(1, 1, 1, "Новости города", None, "normal", False, 1, None), (1, 2, 1, "о скоростях и новостях", None, "normal", False, 2, None), (1, 3, 1, "новостями города", None, "normal", True, 3, None)],
                              "chat_id long, message_id long, user_id long, text string, caption string, memory_policy string, is_redacted boolean, captured_at long, content_hash string")
    q = spark.createDataFrame([(1, 1, "новость"), (2, 1, "в городе новость")], "query_id long, chat_id long, query string")
    none = spark.createDataFrame([], "tombstone_key string, status string")
    got = {(r.query_id, r.message_id) for r in search.search(m, q, none, analyzer="russian", stop_words=["в", "и", "о"]).collect()}
    assert got == {(1, 1), (1, 2), (2, 1)}
    with pytest.raises(ValueError):
        search.search(m, q, none, 0)


def test_hidden_without_id(spark):
    """A row without an id is hidden by its user's erasure, and others like it stay."""
    m = spark.createDataFrame([(1, None, 5, "h1"), (1, None, 6, "h2"), (1, 7, None, None)], "chat_id long, message_id long, user_id long, content_hash string")
    t = spark.createDataFrame([("user:5", "completed"), ("message:1:7", "failed")], "tombstone_key string, status string")
    assert {r.user_id for r in governance.without_tombstones(m, t, governance.ACTIVE).collect()} == {6, None}
    assert {r.user_id for r in governance.without_tombstones(m, t).collect()} == {6}


def test_seed(spark):
    m = spark.createDataFrame([("a", 1), ("b", 2)], "seed_local_id string, message_id long")
    q = "query_id string, query string, expected_ids array<string>, expected_abstain boolean"
    good = spark.createDataFrame([("q1", "x", ["b", "a"], False), ("q2", "y", [], True)], q)
    search.check_seed(m, good)
    assert {r.query_id: r.expected_ids for r in search.expected_messages(good, m).collect()} == {"q1": [2, 1], "q2": []}
    for bad in ([("q1", "x", ["c"], False)], [("q1", "x", [], False)], [("q1", "x", ["a"], True)], [("q1", "x", ["a"], False)] * 2, [("q1", "", ["a"], False)]):
        with pytest.raises(search.SeedError):
            search.check_seed(m, spark.createDataFrame(bad, q))
    with pytest.raises(search.SeedError):
        search.check_seed(m.union(m), good)
    assert search.seed_digest([{"b": 1, "a": "é"}]) == hashlib.sha256('{"a":"é","b":1}\n'.encode()).hexdigest()


def test_rollback_refused(spark):
    runs = spark.createDataFrame([(1, "import", "completed", None), (2, "live", "running", None), (3, "rolled_back", "completed", '{"original_run_id": 1, "raws": 4, "messages": 3, "versions": 2}'), (4, "import", "failed", None), (5, "rolled_back", "completed", '{"original_run_id": 4}')], "run_id long, run_type string, status string, stats string")
    runs = runs.withColumns({"started_at": F.current_timestamp(), "finished_at": F.current_timestamp()})
    for run, error in ((9, LookupError), (2, ValueError), (4, RuntimeError)):
        with pytest.raises(error):
            ingest.rollback_once({}, runs, run, F.current_timestamp())
    _, after, report = ingest.rollback_once({}, runs, 1, F.current_timestamp())
    assert report == {"raws": 4, "messages": 3, "versions": 2, "done_before": True} and after.count() == 5


def test_checkpoints_and_flags(spark):
    e = spark.createDataFrame([(1, "processing", None), (2, "pending", None)], "id long, status string, cascade map<string,string>")
    after, refused = governance.checkpoint_layer(e, spark.createDataFrame([(1, "messages", "completed"), (1, "versions", "completed"), (2, "messages", "completed"), (3, "messages", "completed")], "id long, layer string, state string"))
    assert {r.id: r.cascade for r in after.collect()} == {1: {"messages": "completed", "versions": "completed"}, 2: None} and refused.count() == 2
    tables = {"messages": spark.createDataFrame([(1, 1, 5, "h", "text", None, None, False, "normal")], "chat_id long, message_id long, user_id long, content_hash string, text string, caption string, raw_json string, is_redacted boolean, memory_policy string")}
    events = spark.createDataFrame([(1, "pending", "user", "5", "user:5", 1)], "id long, status string, target_type string, target_id string, tombstone_key string, created_at long")
    flags = spark.createDataFrame([("memory.forget.cascade_worker.enabled", None, None, True)], "key string, scope_type string, scope_id string, enabled boolean")
    off, _ = governance.cascade_tick(tables, events, flags.limit(0))
    on, done = governance.cascade_tick(tables, events, flags)
    assert off["messages"].first().text == "text" and on["messages"].first().text is None and done.first().status == "completed"
    twice, _ = governance.cascade_tick(on, events, flags)
    assert twice["messages"].collect() == on["messages"].collect()


def test_upsert_order(spark):
    """A policy returns to normal, but neither offrecord nor forgotten do."""
    schema = "chat_id long, message_id long, text string, memory_policy string, is_redacted boolean"
    old = spark.createDataFrame([(1, 1, "a", "nomem", False), (1, 2, "b", "forgotten", True), (1, 3, "c", "normal", False)], schema)
    new = spark.createDataFrame([(1, 1, "x", "normal", False, 1), (1, 2, "x", "normal", False, 1), (1, 3, "x", "offrecord", True, 1), (1, 3, "x", "normal", False, 2), (1, 4, "new", "nomem", None, 1), (1, 4, "late", None, None, 2)], schema + ", arrival long")
    got = {r.message_id: (r.text, r.memory_policy, r.is_redacted) for r in versions.upsert_messages(old, new).collect()}
    assert got == {1: ("a", "normal", False), 2: ("b", "forgotten", True), 3: ("c", "offrecord", True), 4: ("new", "nomem", False)}


def test_versions(spark):
    m = spark.createDataFrame([(1, 1, 2, "old"), (1, 2, None, "b")], "chat_id long, message_id long, current_version long, text string")
    v = spark.createDataFrame([(1, 1, 1, "h1", "one", False), (1, 1, 2, "h2", "two", True)], "chat_id long, message_id long, version_seq long, content_hash string, text string, is_redacted boolean")
    (row,) = versions.current_versions(m, v).collect()
    assert (row.text, row.version_redacted, row.content_hash) == ("two", True, "h2")
    b = versions.backfill_first_versions(m.withColumns({"caption": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"), "date": F.lit(1)})).collect()
    assert [(r.message_id, r.version_seq) for r in b] == [(2, 1)]
    fixed = spark.range(1).select(T.content_hash(F.lit("hello"), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("h")).first().h
    assert fixed == hashlib.sha256('["chv1","hello","","text",[]]'.encode()).hexdigest()


def test_outcome_counts(spark):
    o = spark.createDataFrame([(1, i, i, "applied" if i % 3 else "service") for i in range(30)], "chat_id long, message_id long, place long, outcome string")
    got = {r.outcome: (r.n, r.ids) for r in ingest.outcome_counts(o, 4).collect()}
    assert got == {"applied": (20, [1, 2, 4, 5]), "service": (10, [0, 3, 6, 9])}


def test_jobs(spark, tmp_path, capsys):
    from parlance import jobs

    path = write(tmp_path / "e.json", {"name": "n", "type": "private_group", "id": 7, "messages": ENTRIES})
    assert jobs.main(["dry-run", path]) == 0
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (report["total"], report["unreadable"], report["policy_nomem"], report["kinds"]["photo"], report["replies"]) == (7, 4, 1, 1, 1)
    assert jobs.main(["dry-run", str(tmp_path / "none.json")]) == 4


def test_live_messages(spark):
    def update(i, **m):
        return (i, json.dumps({"message": {"chat": {"id": 7}, "message_id": i, "from": {"id": 3}, **m}}), None)

    rows = [update(1, text="a #nomem", entities=[{"offset": 2, "length": 6, "type": "hashtag", "url": "u"}], date=1_700_000_000), update(2, poll={"question": "#offrecord?"}), update(3, chat={"id": 8}, text="elsewhere"), update(4, caption="c", photo=[1], reply_to_message={"message_id": 1}), (5, json.dumps({"message": {"chat": {"id": 7}, "message_id": 5}}), None)]
    d = updates.live_messages(spark.createDataFrame(rows, updates.UPDATE), 7)
    got = {r.message_id: r for r in d.collect()}
    assert set(got) == {1, 2, 4} and (got[4].kind, got[4].reply_to, got[4].caption) == ("photo", 1, "c") and got[1].entities[0].toPython() == {"offset": 2, "length": 6, "type": "hashtag", "url": "u"}
    m, marks, v = versions.persist(d)
    assert {r.message_id: (r.memory_policy, r.text) for r in m.collect()} == {1: ("nomem", "a #nomem"), 2: ("offrecord", None), 4: ("normal", None)}
    assert {r.message_id for r in marks.collect()} == {1, 2} and v.count() == 3
