"""Queries over what changes in the archive: storing, importing, erasing, membership, sheets. Each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import community, governance, ingest, search, versions
from parlance.plans.archive import DETECT, query
from parlance.plans.proxies import AS_OF

QUOTED = r"""replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(10), '\n')"""


def hash_sql(text: str, kind: str, entities: str = "''") -> str:
    """A version's digest; text and kind are SQL expressions, caption is empty."""
    return f"""sha256('["chv1","' || {QUOTED.format(text)} || '","","' || {kind} || '",[' || {entities} || ']]')"""


def incoming(messages):
    """New messages: each text as it is, every third a poll whose question or contact whose name carries a marker now and then."""
    m = F.col("message_id")
    entity = lambda a, n, t: F.struct(a.cast("int").alias("offset"), F.lit(n).cast("int").alias("length"), F.lit(t).alias("type"))
    return messages.select(
        "chat_id",
        "message_id",
        "user_id",
        "text",
        F.lit(None).cast("string").alias("caption"),
        F.when(m % 3 == 0, "poll").otherwise("text").alias("kind"),
        T.merge_entities(F.array(entity(m % 4, 5, "bold"), entity(F.lit(2), 5, "bold")), F.array(entity(m % 4, 5, "bold"), entity(F.lit(1), 3, "code"))).alias("entities"),
        F.when(m % 21 == 0, "who is in? #OFFRECORD").alias("poll_question"),
        T.contact_name(F.when(m % 10 == 1, "#nomem"), F.when(m % 20 == 1, "Smith")).alias("contact_name"),
        F.lit(None).cast("timestamp").alias("date"),
        m.alias("arrival"),
    )


STORED = f""", p AS (SELECT *, {DETECT} AS by_text FROM messages),
s AS (SELECT *, CASE WHEN by_text = 'offrecord' OR message_id % 21 = 0 THEN 'offrecord' WHEN by_text = 'nomem' OR message_id % 10 = 1 THEN 'nomem' ELSE 'normal' END AS policy, CASE WHEN message_id % 3 = 0 THEN 'poll' ELSE 'text' END AS kind FROM p),
e AS (SELECT *, CASE message_id % 4 WHEN 0 THEN [[0, 5], [1, 3], [2, 5]] WHEN 1 THEN [[1, 3], [1, 5], [2, 5]] WHEN 2 THEN [[1, 3], [2, 5]] ELSE [[1, 3], [2, 5], [3, 5]] END AS es FROM s)
"""
_ENTITIES = """list_aggregate(list_transform(es, lambda e: '{"length":' || e[2] || ',"offset":' || e[1] || ',"type":"' || CASE WHEN e[2] = 3 THEN 'code' ELSE 'bold' END || '"}'), 'string_agg', ',')"""


@query("messages", oracle=STORED + "SELECT chat_id, message_id, policy AS memory_policy, policy = 'offrecord' AS is_redacted, CASE WHEN policy <> 'offrecord' THEN sha256(text) END AS text_hash FROM e")
def persisted_messages(spark, messages):
    return versions.persist(incoming(messages))[0].select("chat_id", "message_id", "memory_policy", "is_redacted", F.sha2("text", 256).alias("text_hash"))


@query("messages", oracle=STORED + "SELECT chat_id, message_id, policy AS mark_type, 'deterministic_token_match_v1' AS detected_by FROM e WHERE policy <> 'normal'")
def persisted_marks(spark, messages):
    return versions.persist(incoming(messages))[1].select("chat_id", "message_id", "mark_type", "detected_by")


@query("messages", oracle=STORED + f"SELECT chat_id, message_id, CASE WHEN policy = 'offrecord' THEN {hash_sql(chr(39) * 2, 'kind')} ELSE {hash_sql('text', 'kind', _ENTITIES)} END AS content_hash FROM e")
def persisted_versions(spark, messages):
    return versions.persist(incoming(messages))[2].select("chat_id", "message_id", "content_hash")


@query("messages", oracle=f" SELECT message_id, {DETECT} AS policy, CASE WHEN {DETECT} <> 'normal' THEN 'deterministic_token_match_v1' END AS detected_by, CASE WHEN {DETECT} <> 'normal' THEN true END AS in_text, CASE WHEN {DETECT} <> 'normal' THEN false END AS in_caption FROM messages")
def policy_audit(spark, messages):
    d = messages.select("message_id", T.policy_audit(text=F.col("text"), caption=F.col("caption")).alias("a"))
    return d.select("message_id", *[f"a.{c}" for c in ("policy", "detected_by", "in_text", "in_caption")])


@query(
    "exported",
    oracle=""", k AS (SELECT *, CASE WHEN place % 3 = 0 THEN 'photo' WHEN place % 3 = 1 THEN 'text' ELSE 'voice' END AS kind, CASE WHEN place % 4 = 0 THEN '' ELSE text END AS t, CASE WHEN place % 8 < 4 THEN 'said' ELSE '' END AS e FROM exported),
w AS (SELECT *, CASE WHEN t <> '' THEN t WHEN e <> '' THEN e END AS whole FROM k)
SELECT place, CASE WHEN kind = 'text' THEN sha256(whole) END AS text, CASE WHEN kind <> 'text' THEN sha256(whole) END AS caption FROM w""",
)
def text_or_caption(spark, exported):
    p = F.col("place")
    kind = F.when(p % 3 == 0, "photo").when(p % 3 == 1, "text").otherwise("voice")
    d = exported.select("place", T.text_and_caption(kind, F.when(p % 4 == 0, "").otherwise(F.col("text")), F.when(p % 8 < 4, "said").otherwise("")).alias("x"))
    return d.select("place", F.sha2("x.text", 256).alias("text"), F.sha2("x.caption", 256).alias("caption"))


_LIVE = ["forward_origin", "photo", "voice", "poll", "new_chat_members", "pinned_message", "text", "other"]
_LIVE_KIND = {"forward_origin": "forward", "new_chat_members": "service", "pinned_message": "service", "other": "unknown"}


@query("exported", oracle=" SELECT place, CASE least(place % 8, (place // 8) % 8) " + " ".join(f"WHEN {i} THEN '{_LIVE_KIND.get(x, x)}'" for i, x in enumerate(_LIVE)) + " END AS kind FROM exported")
def live_kinds(spark, exported):
    name = lambda i: F.element_at(F.array(*map(F.lit, _LIVE)), i.cast("int") + 1)
    payload = F.concat(F.lit('{"'), name(F.col("place") % 8), F.lit('": {"x": 1}, "'), name(F.floor(F.col("place") / 8) % 8), F.lit('": "y", "video": null}'))
    return exported.select("place", T.live_kind(payload).alias("kind"))


@query(
    "exported",
    "users",
    "tombstones",
    oracle=""", d AS (SELECT *, CASE WHEN type = 'service' THEN 'service' WHEN id % 23 = 0 THEN 'tombstone' WHEN id % 19 = 0 THEN 'live_overlap' WHEN id % 17 = 0 OR id % 29 = 0 THEN 'stored_duplicate'
WHEN from_id LIKE 'channel%' AND conv % 20 = 3 THEN 'no_user' WHEN from_id = 'user7' THEN 'tombstone' ELSE 'applied' END AS alone FROM (SELECT *, place // 10 AS conv FROM exported)),
e AS (SELECT *, coalesce(bool_or(alone = 'applied') OVER (PARTITION BY chat_id, id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM d)
SELECT chat_id, id AS message_id, place, CASE WHEN earlier AND alone IN ('applied', 'no_user') THEN 'stored_duplicate' WHEN alone = 'applied' AND place % 31 = 0 THEN 'offrecord' ELSE alone END AS outcome FROM e WHERE id > 40""",
)
def import_applied(spark, exported, users, tombstones):
    return _import(spark, exported, users)[1]


@query(
    "exported",
    "users",
    "tombstones",
    oracle=""" SELECT u AS user_id, true AS imported_only FROM (SELECT DISTINCT CASE WHEN from_id LIKE 'channel%' THEN -1 ELSE user_id END AS u FROM exported WHERE type <> 'service' AND id % 23 <> 0 AND id % 19 <> 0 AND id % 17 <> 0 AND id % 29 <> 0
AND NOT (from_id LIKE 'channel%' AND (place // 10) % 20 = 3) AND from_id <> 'user7' AND id > 40) WHERE u NOT IN (SELECT user_id FROM users WHERE user_id % 2 = 0)""",
)
def import_ghost_users(spark, exported, users, tombstones):
    return _import(spark, exported, users)[0]["users"].select("user_id", "imported_only")


def _import(spark, exported, users):
    """An import into an archive that has live messages (ids by 19), stored ones (by 17) and raw rows of an earlier import (by 29)."""
    p, i = F.col("place"), F.col("id")
    nothing = F.lit(None).cast("string")
    m = exported.select(
        "chat_id", "place", "id", "type", F.when(F.col("from_id").startswith("channel") & (F.floor(p / 10) % 20 == 3), "bot3").otherwise(F.col("from_id")).alias("from_id"), nothing.alias("from"),
        F.when(p % 31 == 0, F.concat("text", F.lit(" #offrecord"))).otherwise(F.col("text")).alias("text"), nothing.alias("caption"), F.lit("text").alias("kind"),
        F.lit(None).cast("array<struct<offset:int,length:int,type:string>>").alias("entities"), nothing.alias("poll_question"), nothing.alias("contact_name"), "reply_to", F.lit(None).cast("timestamp").alias("date"),
    )
    ids = exported.where(i.isNotNull()).select("chat_id", F.col("id").alias("message_id")).distinct()
    mid = F.col("message_id")
    stored = ids.where((mid % 19 == 0) | (mid % 17 == 0)).select("chat_id", "message_id", F.when(mid % 19 == 0, mid).otherwise(-mid).alias("raw_id"))
    live = ids.where(mid % 19 == 0).select(mid.alias("raw_id"), "chat_id", "message_id", mid.alias("update_id"), F.lit(None).cast("int").alias("run_id"))
    past = ids.where(mid % 29 == 0).select((-mid - 1_000_000).alias("raw_id"), "chat_id", "message_id", F.lit(None).cast("bigint").alias("update_id"), F.lit(1).alias("run_id"))
    erased = ids.where(mid % 23 == 0).select(F.concat_ws(":", F.lit("message"), "chat_id", "message_id").alias("tombstone_key")).unionByName(spark.createDataFrame([("user:7",)], "tombstone_key string"))
    return ingest.apply_import(m, stored, live.unionByName(past), erased, users.where("user_id % 2 = 0"), 2, resume_point=40)


@query(
    "exported",
    oracle=""", i AS (SELECT DISTINCT chat_id, id FROM exported WHERE id IS NOT NULL), b AS (SELECT e.chat_id, e.reply_to FROM exported e WHERE type <> 'service' AND reply_to IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i WHERE i.chat_id = e.chat_id AND i.id = e.reply_to))
SELECT (SELECT count(*) FROM i WHERE id % 23 = 0) AS tombstone_count, (SELECT string_agg(id, ',' ORDER BY id) FROM i WHERE id % 23 = 0) AS tombstones, (SELECT count(*) FROM i WHERE id % 23 <> 0 AND id % 17 = 0) AS duplicate_count,
(SELECT string_agg(id, ',' ORDER BY id) FROM i WHERE id % 23 <> 0 AND id % 17 = 0) AS duplicates, (SELECT count(*) FROM b WHERE reply_to % 40 <> 0) AS broken_replies""",
)
def stored_report(spark, exported):
    ids = exported.select("chat_id", F.col("id").alias("message_id"))
    keys = ids.where("message_id % 23 = 0").select(F.concat_ws(":", F.lit("message"), "chat_id", "message_id").alias("tombstone_key")).distinct()
    lost = exported.where("reply_to is not null and reply_to % 40 = 0").select("chat_id", F.col("reply_to").alias("message_id"), F.col("place").alias("target"), F.lit(None).cast("int").alias("run_id"), F.lit(None).cast("int").alias("run_started_at"))
    d = ingest.stored_report(exported, ids.where("message_id % 17 = 0"), keys, lost, listed=1_000_000)
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return d.select("tombstone_count", listed(F.col("tombstone_ids")).alias("tombstones"), "duplicate_count", listed(F.col("duplicate_ids")).alias("duplicates"), "broken_replies")


@query("exported", oracle=""" SELECT count(*) FILTER (place % 4 = 3) AS same_run, count(*) FILTER (place % 4 IN (1, 2)) AS prior_run, count(*) FILTER (place % 4 = 0) AS live, 0 AS unresolved FROM (SELECT DISTINCT chat_id, place FROM exported)""")
def resolution_counts(spark, exported):
    run = F.when(F.col("place") % 4 != 0, (F.col("place") % 4).cast("int"))
    c = exported.select("chat_id", F.col("place").alias("message_id"), F.col("place").alias("target"), run.alias("run_id"), (run * 100).alias("run_started_at"))
    r = exported.select("chat_id", F.col("place").alias("reply_to"), F.lit(3).alias("run_id"), F.lit(300).alias("started_at")).distinct()
    return ingest.resolution_counts(ingest.resolve_replies(r, c))


@query("exported", oracle=" SELECT e.chat_id, e.reply_to, min(s.place) AS message_id FROM (SELECT DISTINCT chat_id, reply_to FROM exported WHERE reply_to IS NOT NULL) e JOIN exported s ON s.chat_id = e.chat_id AND s.id = e.reply_to GROUP BY ALL")
def replies_by_raw(spark, exported):
    stored = exported.select("chat_id", F.col("place").alias("message_id"), F.col("place").alias("raw_id"))
    return ingest.reply_by_raw(exported.where("reply_to is not null").select("chat_id", "reply_to").distinct(), stored, exported.select(F.col("place").alias("raw_id"), F.col("id").alias("message_id")))


def _runs(users):
    u = F.col("user_id")
    status = F.element_at(F.array(*map(F.lit, ("running", "failed", "completed", "cancelled", "dry_run"))), (u % 5).cast("int") + 1)
    stats = F.when(u % 3 == 0, F.format_string('{"last_processed_export_msg_id": %d, "chunk_index": 2}', u)).when(u % 3 == 1, F.lit('{"last_processed_export_msg_id": true}'))
    return users.select(
        u.alias("run_id"), F.when(u % 11 == 0, "live").otherwise("import").alias("run_type"), F.concat(F.lit("p"), (u % 40).cast("string")).alias("path"), F.concat(F.lit("h"), (u % 70).cast("string")).alias("hash"),
        status.alias("status"), (u * 7 % 1000).alias("started_at"), stats.alias("stats"), F.when(u % 2 == 0, u).alias("finished_at"), F.lit(None).cast("string").alias("error"),
    )


_RUNS = """, r AS (SELECT user_id AS run_id, CASE WHEN user_id % 11 = 0 THEN 'live' ELSE 'import' END AS run_type, concat('p', user_id % 40) AS path, concat('h', user_id % 70) AS hash, ['running', 'failed', 'completed', 'cancelled', 'dry_run'][user_id % 5 + 1] AS status,
user_id * 7 % 1000 AS started_at, user_id % 3 AS k, CASE WHEN user_id % 2 = 0 THEN user_id END AS finished_at FROM users)"""


@query(
    "users",
    oracle=_RUNS
    + """, n AS (SELECT * FROM r WHERE run_type = 'import' QUALIFY row_number() OVER (PARTITION BY hash ORDER BY started_at DESC, run_id DESC) = 1), q AS (SELECT * FROM r WHERE run_type = 'import' QUALIFY row_number() OVER (PARTITION BY path ORDER BY started_at DESC, run_id DESC) = 1),
d AS (SELECT u.user_id AS source_id, n.run_id, n.k, CASE WHEN n.status IS NULL THEN CASE WHEN u.user_id % 2 = 0 AND q.status IN ('running', 'failed') THEN 'block_partial_present' ELSE 'start_fresh' END WHEN n.status NOT IN ('running', 'failed') THEN 'start_fresh'
WHEN u.user_id % 2 = 0 THEN 'resume_existing' ELSE 'block_partial_present' END AS mode FROM users u LEFT JOIN n ON n.hash = concat('h', u.user_id % 90) LEFT JOIN q ON q.path = concat('p', u.user_id % 50))
SELECT source_id, mode, CASE WHEN mode = 'resume_existing' THEN run_id END AS run_id, CASE WHEN mode = 'resume_existing' AND k = 0 THEN run_id END AS resume_point FROM d""",
)
def run_decisions(spark, users):
    u = F.col("user_id")
    sources = users.select(u.alias("source_id"), F.concat(F.lit("p"), (u % 50).cast("string")).alias("path"), F.concat(F.lit("h"), (u % 90).cast("string")).alias("hash"), (u % 2 == 0).alias("resume"))
    return ingest.decide_runs(sources, _runs(users)).select("source_id", "mode", "run_id", "resume_point")


@query("users", oracle=_RUNS + " SELECT run_id, CASE WHEN run_id % 4 < 2 AND status IN ('running', 'failed') THEN 'completed' ELSE status END AS status, CASE WHEN run_id % 4 < 2 AND status IN ('running', 'failed') THEN coalesce(finished_at, -5) ELSE finished_at END AS finished_at FROM r")
def finalized_runs(spark, users):
    wanted = users.where("user_id % 4 < 2").select(F.col("user_id").alias("run_id"), F.lit("completed").alias("to_status"), F.lit(None).cast("string").alias("new_error"))
    return ingest.finalize_runs(_runs(users), wanted, F.lit(-5).cast("long")).select("run_id", "status", "finished_at")


@query("users", oracle=" SELECT user_id, CASE WHEN user_id % 5 IN (0, 4) THEN user_id END AS last_id, user_id % 5 IN (0, 3, 4) AS is_valid FROM users")
def checkpoint_values(spark, users):
    u = F.col("user_id")
    stats = (
        F.when(u % 5 == 0, F.format_string('{"last_processed_export_msg_id": %d, "last_checkpoint_at": "2026-01-02T03:04:05+00:00"}', u))
        .when(u % 5 == 1, F.format_string('{"last_processed_export_msg_id": "%d"}', u))
        .when(u % 5 == 2, F.lit('{"last_processed_export_msg_id": true}'))
        .when(u % 5 == 4, F.format_string('{"last_processed_export_msg_id": %d, "chunk_index": 0, "other": [1]}', u))
    )
    return users.select("user_id", ingest.checkpoint(stats).alias("c")).select("user_id", "c.last_id", "c.is_valid")


@query("users", oracle=""" SELECT user_id, CASE WHEN user_id % 3 = 0 THEN '{"a": 1, "b": ' || user_id || '}' WHEN user_id % 3 = 1 THEN '{"a": 1, "b": 2}' ELSE '{"b": ' || user_id || '}' END AS merged FROM users""")
def merged_stats(spark, users):
    u = F.col("user_id")
    old = F.when(u % 3 < 2, '{"b": 2, "a": 1}')
    return users.select("user_id", ingest.merge_json(old, F.when(u % 3 != 1, F.format_string('{"b": %d}', u))).alias("merged"))


@query("users", oracle=" SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'botToken' WHEN user_id % 3 = 1 THEN 'PASSWORD,api-key' ELSE '' END AS refused FROM users")
def secret_configs(spark, users):
    u = F.col("user_id")
    config = F.when(u % 3 == 0, '{"chat_id": 1, "botToken": "x"}').when(u % 3 == 1, '{"api-key": 1, "PASSWORD": 2, "inner": {"secret": 1}}')
    return users.select("user_id", F.array_join(F.array_sort(ingest.secret_keys(config)), ",").alias("refused"))


@query("exported", oracle=""" SELECT 'rolled_back' AS run_type, count(*) FILTER (place % 3 = 1 AND place % 5 <> 0) AS raws, count(*) FILTER (place % 3 = 1 AND place % 5 <> 0) AS messages, 3 AS run_id FROM exported""")
def rollback_audit(spark, exported):
    m = exported.select("chat_id", F.col("place").alias("message_id"), F.col("place").alias("raw_id"))
    raws = m.select("raw_id", (F.col("raw_id") % 3).alias("run_id"), F.when(F.col("raw_id") % 5 == 0, F.col("raw_id")).alias("update_id"))
    runs = spark.createDataFrame([(1, "import", "completed", None), (2, "live", "running", None)], "run_id long, run_type string, status string, stats string")
    runs = runs.withColumns({"started_at": F.expr(AS_OF), "finished_at": F.expr(AS_OF)})
    _, audited, _ = ingest.rollback_once({"raws": raws, "messages": m, "versions": m.select("chat_id", "message_id")}, runs, 1, F.expr(AS_OF))
    stat = lambda n: F.get_json_object("stats", f"$.{n}").cast("long").alias(n)
    return audited.where("run_type = 'rolled_back'").select("run_type", stat("raws"), stat("messages"), "run_id")


@query(
    "messages",
    "users",
    oracle=""", q AS (SELECT message_id AS place, message_id % 150 AS requester, chat_id, CASE WHEN message_id % 4 = 0 THEN NULL ELSE message_id - message_id % 3 END AS target FROM messages),
j AS (SELECT q.*, u.user_id IS NOT NULL AS known, coalesce(u.is_admin, false) AS adm, m.user_id AS author, m.message_id IS NOT NULL AS there FROM q LEFT JOIN users u ON u.user_id = requester LEFT JOIN messages m ON m.chat_id = q.chat_id AND m.message_id = target),
o AS (SELECT *, CASE WHEN NOT known THEN 'unknown_user' WHEN target IS NULL THEN 'accepted' WHEN NOT there THEN 'unknown_message' WHEN author = requester OR adm THEN 'accepted' ELSE 'denied' END AS outcome FROM j)
SELECT tombstone_key, arg_min(CASE WHEN target IS NULL OR author = requester THEN 'self' ELSE 'admin' END, place) AS authorized_by FROM (SELECT *, CASE WHEN target IS NULL THEN concat('user:', requester) ELSE concat('message:', chat_id, ':', target) END AS tombstone_key FROM o WHERE outcome = 'accepted')
WHERE tombstone_key <> 'user:4' GROUP BY tombstone_key""",
)
def forget_requests(spark, messages, users):
    m = F.col("message_id")
    asked = messages.select(m.alias("place"), (m % 150).alias("requester"), "chat_id", F.when(m % 4 != 0, m - m % 3).alias("message_id"))
    new, _ = governance.forget_requests(asked, users, messages, spark.createDataFrame([("user:4",)], "tombstone_key string"))
    return new.select("tombstone_key", "authorized_by")


@query("users", oracle=""" SELECT 'f' || (user_id % 9) AS key, CASE WHEN user_id % 3 = 0 THEN 'chat' END AS scope_type, arg_max(user_id % 2 = 0, user_id) AS enabled FROM users GROUP BY 1, 2""")
def flags_after(spark, users):
    u = F.col("user_id")
    changes = users.select(F.concat(F.lit("f"), (u % 9).cast("string")).alias("key"), F.when(u % 3 == 0, "chat").alias("scope_type"), F.lit(None).cast("string").alias("scope_id"), (u % 2 == 0).alias("enabled"), u.alias("place"))
    return governance.set_flags(changes.drop("place").limit(0), changes).select("key", "scope_type", "enabled")


@query("users", oracle=""" SELECT user_id, coalesce((user_id % 9) IN (2, 5, 8) AND false, false) OR CASE WHEN user_id % 3 = 0 THEN user_id % 9 = 0 ELSE false END AS enabled FROM users""")
def flags_read(spark, users):
    flags = spark.createDataFrame([("f0", "chat", None, True), ("f1", "chat", None, True), ("f2", None, "x", True)], "key string, scope_type string, scope_id string, enabled boolean")
    u = F.col("user_id")
    wanted = users.select(F.concat(F.lit("f"), (u % 9).cast("string")).alias("key"), F.when(u % 3 == 0, "chat").alias("scope_type"), F.lit(None).cast("string").alias("scope_id"), "user_id")
    found = governance.flag_enabled(flags, wanted.drop("user_id").distinct())
    same = lambda c: F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}"))
    return wanted.alias("w").join(found.alias("f"), same("key") & same("scope_type") & same("scope_id")).select("user_id", "enabled")


def _people(users, applications):
    u, i = F.col("user_id"), F.col("id")
    people = users.select("user_id", "is_member", "is_admin", F.lit(None).cast("long").alias("joined_at"), F.when(u % 6 == 0, u).alias("left_at"))
    apps = applications.select("id", "user_id", F.when(i % 2 == 0, "vouched").otherwise(F.col("status")).alias("status"), F.when(i % 5 > 0, F.col("user_id")).alias("invite_user_id"), "created_at", F.lit(None).cast("long").alias("added_at"))
    changes = users.where("user_id % 3 < 2").select("user_id", F.when(u % 3 == 0, "left").otherwise("member").alias("old_status"), F.when(u % 3 == 0, "member").otherwise("kicked").alias("new_status"), (u + 100).alias("at"))
    return people, apps, changes


_PEOPLE = """, a AS (SELECT id, user_id, CASE WHEN id % 2 = 0 THEN 'vouched' ELSE status END AS status, id % 5 > 0 AS invited, created_at FROM applications),
l AS (SELECT * FROM a WHERE status IN ('filling', 'pending', 'vouched', 'privacy_block') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1),
j AS (SELECT u.*, l.id AS app, CASE WHEN u.user_id % 3 <> 0 THEN NULL WHEN is_admin THEN 'ok' WHEN l.id IS NULL THEN 'no_application' WHEN l.status <> 'vouched' THEN 'wrong_status' WHEN NOT invited THEN 'wrong_user' ELSE 'ok' END AS reason FROM users u LEFT JOIN l USING (user_id))"""


@query(
    "users",
    "applications",
    "intros",
    oracle=_PEOPLE
    + """ SELECT user_id, CASE WHEN reason = 'ok' THEN true WHEN reason IS NOT NULL OR user_id % 3 = 1 THEN false ELSE is_member END AS is_member, CASE WHEN reason = 'ok' THEN user_id + 100 END AS joined_at,
CASE WHEN reason <> 'ok' OR user_id % 3 = 1 THEN user_id + 100 WHEN user_id % 6 = 0 THEN user_id END AS left_at FROM j""",
)
def members_after_changes(spark, users, applications, intros):
    people, apps, changes = _people(users, applications)
    return community.apply_membership(people, apps, intros, changes)[0].select("user_id", "is_member", "joined_at", "left_at")


@query("users", "applications", "intros", oracle=_PEOPLE + " SELECT user_id, reason, user_id % 6 <> 0 AS first_time FROM j WHERE reason <> 'ok'")
def rejected_joins(spark, users, applications, intros):
    people, apps, changes = _people(users, applications)
    return community.apply_membership(people, apps, intros, changes)[3]


@query("users", "applications", "intros", oracle=_PEOPLE + " SELECT a.id, CASE WHEN j.app IS NOT NULL THEN 'added' ELSE a.status END AS status FROM a LEFT JOIN j ON j.app = a.id AND j.reason = 'ok' AND NOT j.is_admin AND j.user_id NOT IN (SELECT user_id FROM intros)")
def applications_after_joins(spark, users, applications, intros):
    people, apps, changes = _people(users, applications)
    return community.apply_membership(people, apps, intros, changes)[1].select("id", "status")


@query(
    "applications",
    oracle=""", t AS (SELECT id, user_id, CASE WHEN id % 7 = 0 THEN 'privacy_block' ELSE status END AS status FROM applications),
s AS (SELECT *, CASE WHEN id % 3 = 0 THEN status = 'pending' WHEN id % 3 = 1 THEN true ELSE status = 'privacy_block' AND id % 2 = 0 END AS first_fits FROM t)
SELECT id, CASE WHEN first_fits THEN CASE id % 3 WHEN 0 THEN 'vouched' WHEN 1 THEN 'pending' ELSE 'vouched' END WHEN status = 'pending' THEN 'rejected' ELSE status END AS status,
CASE WHEN first_fits AND id % 3 <> 1 THEN user_id END AS invite_user_id FROM s""",
)
def application_actions(spark, applications):
    i = F.col("id")
    apps = applications.select("id", "user_id", F.when(i % 7 == 0, "privacy_block").otherwise(F.col("status")).alias("status"), F.lit(None).cast("long").alias("submitted_at"), F.lit(None).cast("long").alias("invite_user_id"))
    name = F.element_at(F.array(F.lit("vouch"), F.lit("confirm"), F.lit("ready")), (i % 3).cast("int") + 1)
    actor = F.when((i % 3 == 2) & (i % 2 == 0), F.col("user_id")).otherwise(F.col("user_id") + 1)
    first = applications.select("id", actor.alias("actor"), name.alias("action"), F.lit(1).alias("seq"), i.alias("at"))
    second = applications.select("id", F.lit(0).cast("long").alias("actor"), F.lit("reject").alias("action"), F.lit(2).alias("seq"), i.alias("at"))
    return community.apply_actions(apps, first.union(second))[0].select("id", "status", "invite_user_id")


@query("applications", oracle=" SELECT user_id AS application_id, min(id) AS id FROM applications WHERE user_id NOT IN (SELECT user_id FROM applications WHERE id % 4 = 0) GROUP BY user_id")
def outbox_appended(spark, applications):
    box = applications.where("id % 4 = 0").select("id", F.col("user_id").alias("application_id"), F.lit("pending").alias("status"))
    after, _ = community.append_pending(box, applications.select("id", F.col("user_id").alias("application_id")))
    return after.join(box.select("id"), "id", "left_anti").select("application_id", "id")


@query("applications", oracle=" SELECT id, user_id FROM applications WHERE status = 'pending' ORDER BY id LIMIT 10")
def outbox_next(spark, applications):
    return community.next_in_outbox(applications).select("id", "user_id")


@query("applications", oracle=" SELECT id, user_id % 3 <> 0 AND NOT (user_id % 3 = 1 AND id % 4 = 1) AS is_current FROM applications")
def answers_retired(spark, applications):
    a = applications.select("id", "user_id", (F.col("id") % 4).alias("application_id"), F.lit(True).alias("is_current"))
    every = applications.where("user_id % 3 = 0").select("user_id", F.lit(None).cast("long").alias("application_id"))
    some = applications.where("user_id % 3 = 1").select("user_id", F.lit(1).cast("long").alias("application_id"))
    return community.retire_answers(a, every.union(some)).select("id", "is_current")


@query("applications", oracle=" SELECT user_id, id % 2 AS application_id, max(id % 7) AS last_index FROM applications GROUP BY ALL")
def answers_last(spark, applications):
    return community.last_answered(applications.select("user_id", (F.col("id") % 2).alias("application_id"), (F.col("id") % 7).alias("question_index")))


@query(
    "messages",
    "users",
    "intros",
    oracle=""", t AS (SELECT text, arg_max(user_id, message_id) AS author FROM messages GROUP BY text)
SELECT m.message_id AS query_id, CASE WHEN u.user_id IS NULL THEN 'nothing' WHEN i.user_id IS NULL THEN 'no_intro' ELSE 'intro' END AS found, u.user_id FROM messages m LEFT JOIN t ON t.text = CASE WHEN m.message_id % 3 = 0 THEN 'nobody' ELSE m.text END LEFT JOIN users u ON u.user_id = t.author LEFT JOIN intros i ON i.user_id = t.author""",
)
def forward_lookup(spark, messages, users, intros):
    texts = messages.select(F.col("message_id").alias("query_id"), F.when(F.col("message_id") % 3 == 0, "nobody").otherwise(F.col("text")).alias("text"))
    return community.forward_lookup(texts, messages, users, intros).select("query_id", "found", "user_id")


def _sheet(users, intros):
    u = F.col("user_id")
    cells = [F.when((u % 10 == 3) & (F.lit(k) == 2), "said in the sheet").otherwise(F.concat(F.lit(f"a{k} "), u.cast("string"))).alias(f"q{k}") for k in range(7)]
    sheet = users.where("user_id % 3 = 0").select((u + 1).alias("row_number"), "user_id", F.lit("").alias("username"), *cells, F.when(u % 2 == 0, "sheet voucher").otherwise("").alias("voucher"), F.lit("").alias("status"))
    answers = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("question_index")).withColumn("answer", F.concat(F.lit("a"), F.col("question_index").cast("string"), F.lit(" "), u.cast("string"))).withColumn("is_current", F.lit(True))
    mine = intros.select("user_id", "intro_text", "voucher", "row_number", F.lit(None).cast("timestamp").alias("synced_at"))
    return community.sync_sheet(sheet, mine, users, answers, "{0}|{2}", F.expr(AS_OF))


_SHEET = """, last AS (SELECT max(user_id + 1) AS e FROM users WHERE user_id % 3 = 0), n AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r FROM intros WHERE row_number IS NULL),
x AS (SELECT i.*, coalesce(i.row_number, e + r) AS new_row, i.user_id % 3 = 0 AND i.user_id % 10 = 3 AS differs FROM intros i LEFT JOIN n USING (user_id), last)"""


@query("users", "intros", oracle=_SHEET + " SELECT user_id, new_row AS row_number, CASE WHEN differs THEN 'a0 ' || user_id || '|said in the sheet' ELSE intro_text END AS intro_text, CASE WHEN differs AND user_id % 2 = 0 THEN 'sheet voucher' ELSE voucher END AS voucher FROM x")
def sheet_intros(spark, users, intros):
    return _sheet(users, intros)[1].select("user_id", "row_number", "intro_text", "voucher")


@query(
    "users",
    "intros",
    oracle=_SHEET
    + """ SELECT user_id + 1 AS row_number, user_id, CASE WHEN user_id IN (SELECT user_id FROM intros) THEN 'есть интро' ELSE 'нет интро' END AS status FROM users WHERE user_id % 3 = 0
UNION ALL SELECT new_row, user_id, 'есть интро' FROM x WHERE row_number IS NULL""",
)
def sheet_rows(spark, users, intros):
    return _sheet(users, intros)[0].select("row_number", "user_id", "status")


@query("users", "intros", oracle=" SELECT user_id, CAST(q AS INTEGER) AS question_index, CASE WHEN user_id % 3 = 0 AND user_id % 10 = 3 AND q = 2 AND user_id IN (SELECT user_id FROM intros) THEN 'said in the sheet' ELSE 'a' || q || ' ' || user_id END AS answer FROM users, range(7) r(q)")
def sheet_answers(spark, users, intros):
    return _sheet(users, intros)[2].select("user_id", "question_index", "answer")


@query("users", oracle=" SELECT user_id, 'Name: ' || CASE WHEN user_id % 2 = 0 THEN '—' ELSE 'a &amp; &quot;b&quot;' END || ', from ' || name AS intro FROM users")
def intro_texts(spark, users):
    return users.select("user_id", T.intro_text("Name: {0}, from {1}", [F.when(F.col("user_id") % 2 == 1, ' a & "b" ').otherwise(" "), F.col("name")]).alias("intro"))


@query(
    "users",
    "messages",
    "tombstones",
    oracle=""", asked AS (SELECT user_id AS query_id, user_id, CASE WHEN user_id % 5 = 0 THEN 9 ELSE 0 END AS chat_id, CASE WHEN user_id % 4 = 0 THEN 'the #nomem' WHEN user_id % 4 = 1 THEN '' ELSE 'zzzz nothing' END AS query FROM users)
SELECT query_id, user_id, chat_id, CASE WHEN query <> 'the #nomem' THEN query END AS query_text, query = 'the #nomem' AS query_redacted, true AS abstained FROM asked WHERE query_id % 4 <> 0""",
)
def recall_traces(spark, users, messages, tombstones):
    u = F.col("user_id")
    asked = users.where("user_id % 4 <> 0").select(u.alias("query_id"), "user_id", F.when(u % 5 == 0, 9).otherwise(0).cast("long").alias("chat_id"), F.when(u % 4 == 0, "the #nomem").when(u % 4 == 1, " ").otherwise("zzzz nothing").alias("query"))
    people = users.withColumns({"first_name": F.col("name"), "last_name": F.lit(None).cast("string")})
    return search.recall(asked, people, messages, tombstones, 0)[1].drop("message_ids")


@query(
    "users",
    "messages",
    "tombstones",
    oracle=""", ask AS (SELECT u.user_id AS query_id, is_member OR is_admin AS may FROM users u WHERE u.user_id <= 40),
v AS (SELECT message_id, user_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS ts FROM messages m WHERE chat_id = 0 AND memory_policy = 'normal' AND NOT is_redacted AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.status <> 'failed'
AND t.tombstone_key IN (concat('message:', m.chat_id, ':', m.message_id), 'message_hash:' || m.content_hash, concat('user:', m.user_id)))),
best AS (SELECT message_id, user_id, row_number() OVER (ORDER BY round(len(list_filter(ts, lambda t: t = 'the')) * 0.1::DOUBLE, 6) DESC, message_id DESC) AS place FROM v WHERE list_contains(ts, 'the') QUALIFY place <= 3)
SELECT query_id, b.message_id, b.user_id, b.place, coalesce(w.name, '—') AS author, concat('https://t.me/c/0/', b.message_id) AS link FROM ask, best b LEFT JOIN users w ON w.user_id = b.user_id WHERE may""",
)
def recall_answers(spark, users, messages, tombstones):
    asked = users.where("user_id <= 40").select(F.col("user_id").alias("query_id"), "user_id", F.lit(0).cast("long").alias("chat_id"), F.lit(" The ").alias("query"))
    people = users.withColumns({"first_name": F.col("name"), "last_name": F.lit(None).cast("string")})
    return search.recall(asked, people, messages, tombstones, 0)[0].drop("rank")


@query("users", oracle=" SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE name END AS name, user_id % 2 <> 0 AS imported_only FROM users WHERE user_id % 5 <> 0 UNION ALL SELECT user_id, 'new', false FROM users WHERE user_id % 5 = 0 AND user_id % 2 = 0")
def users_upserted(spark, users):
    old = users.where("user_id % 5 <> 0").select("user_id", "name", F.lit(True).alias("imported_only"), F.lit(0).alias("seq"))
    new = users.where("user_id % 2 = 0").select("user_id", F.lit("new").alias("name"), F.lit(False).alias("imported_only"), F.lit(1).alias("seq"))
    return governance.last_writer_wins(old, new.withColumn("name", F.lit("stale")).union(new.withColumn("seq", F.lit(2))), ["user_id"], ["seq"]).drop("seq")


@query("messages", oracle=""", o AS (SELECT chat_id, message_id, memory_policy, text FROM messages WHERE memory_policy <> 'offrecord')
SELECT chat_id, message_id, 1::BIGINT AS version_seq, message_id % 6 = 0 AS is_redacted FROM o UNION ALL SELECT chat_id, message_id, 2, message_id % 6 = 0 FROM o WHERE message_id % 2 = 0 UNION ALL SELECT chat_id, message_id, 3, true FROM o WHERE message_id % 6 = 0""")
def edited_versions(spark, messages):
    """Every second message is edited, edited back and, every sixth, made offrecord."""
    m = messages.where("memory_policy <> 'offrecord'")
    first = m.select("chat_id", "message_id", F.lit(1).cast("long").alias("version_seq"), T.content_hash(F.col("text"), F.lit(None).cast("string"), F.lit("text")).alias("content_hash"), "text", F.lit(False).alias("is_redacted"))
    nothing = F.lit(None).cast("array<struct<offset:int,length:int,type:string>>")
    edit = lambda d, seq, text: d.select("chat_id", "message_id", F.lit(seq).alias("seq"), text.alias("text"), F.lit("text").alias("kind"), nothing.alias("entities"))
    second = m.where("message_id % 2 = 0")
    edits = edit(second, 1, F.lit("edited")).union(edit(second, 2, F.col("text"))).union(edit(second.where("message_id % 6 = 0"), 3, F.lit("so #offrecord")))
    return versions.edit_versions(m, first, edits)[0].select("chat_id", "message_id", "version_seq", "is_redacted")


@query("messages", oracle=" SELECT user_id, count(*) AS n FROM messages GROUP BY user_id")
def messages_by_sender(spark, messages):
    return community.messages_of(messages)


@query("applications", oracle=" SELECT coalesce(sum(n), 0) AS surplus FROM (SELECT count(*) - 1 AS n FROM applications WHERE status = 'pending' GROUP BY user_id HAVING count(*) > 1)")
def outbox_surplus(spark, applications):
    return community.surplus_pending(applications.withColumnRenamed("user_id", "application_id")).select(F.col("surplus").cast("long").alias("surplus"))


@query("exported", oracle=" SELECT DISTINCT from_id FROM exported WHERE type = 'message' AND from_id IS NOT NULL")
def distinct_senders(spark, exported):
    return ingest.distinct_senders(exported)


@query(
    "messages",
    oracle=""" SELECT chat_id, message_id, CASE WHEN message_id % 2 = 1 THEN inc WHEN memory_policy = 'offrecord' THEN 'offrecord' ELSE coalesce(inc, memory_policy) END AS memory_policy,
message_id % 10 = 0 OR message_id % 2 = 0 AND is_redacted AS is_redacted FROM (SELECT *, CASE message_id % 6 WHEN 0 THEN 'normal' WHEN 1 THEN 'nomem' WHEN 2 THEN 'offrecord' WHEN 3 THEN 'normal' END AS inc FROM messages)""",
)
def policy_ratchet_stored(spark, messages):
    """Every second message is stored before all are delivered: offrecord stays, a missing policy changes nothing."""
    m = F.col("message_id")
    incoming = F.when(m % 6 == 0, "normal").when(m % 6 == 1, "nomem").when(m % 6 == 2, "offrecord").when(m % 6 == 3, "normal")
    columns = ["chat_id", "message_id", "memory_policy", "is_redacted"]
    new = messages.select("chat_id", "message_id", incoming.alias("memory_policy"), (m % 10 == 0).alias("is_redacted"), m.alias("arrival"))
    return versions.upsert_messages(messages.where("message_id % 2 = 0").select(*columns), new)


@query(
    "messages",
    "tombstones",
    oracle=""", due AS (SELECT * FROM tombstones WHERE status = 'pending' ORDER BY created_at, id LIMIT 10), hit AS (SELECT DISTINCT m.chat_id, m.message_id FROM messages m JOIN due d ON d.target_type <> 'message_hash' AND d.target_id <> 'none'
AND d.tombstone_key IN (concat('message:', m.chat_id, ':', m.message_id), concat('user:', m.user_id)))
SELECT m.chat_id, m.message_id, v.n::BIGINT AS version_seq, h.message_id IS NOT NULL OR n = 2 AS is_redacted, CASE WHEN h.message_id IS NULL THEN sha256(text) END AS text_hash, CASE WHEN h.message_id IS NULL THEN 'n' || v.n END AS normalized_text, content_hash
FROM messages m CROSS JOIN (VALUES (1), (2)) v(n) LEFT JOIN hit h ON h.chat_id = m.chat_id AND h.message_id = m.message_id""",
)
def forgotten_versions(spark, messages, tombstones):
    """An erasure blanks all versions of a message; their hashes stay."""
    none = F.lit(None).cast("string")
    v = messages.withColumn("version_seq", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")))
    v = v.select("chat_id", "message_id", "version_seq", "content_hash", "text", none.alias("caption"), F.concat(F.lit("n"), F.col("version_seq").cast("string")).alias("normalized_text"), none.alias("entities"), (F.col("version_seq") == 2).alias("is_redacted"))
    after, _ = governance.forget_cascade({"messages": messages, "versions": v}, tombstones)
    return after["versions"].select("chat_id", "message_id", "version_seq", "is_redacted", F.sha2("text", 256).alias("text_hash"), "normalized_text", "content_hash")


@query(
    "exported",
    oracle=""" SELECT count(*) FILTER (NOT far AND place % 4 = 3) AS same_run, count(*) FILTER (NOT far AND place % 4 IN (1, 2)) AS prior_run, count(*) FILTER (NOT far AND place % 4 = 0) AS live, count(*) FILTER (far) AS unresolved
FROM (SELECT DISTINCT chat_id, place, place % 5 = 0 AS far FROM exported)""",
)
def replies_unresolved(spark, exported):
    run = F.when(F.col("place") % 4 != 0, (F.col("place") % 4).cast("int"))
    c = exported.select("chat_id", F.col("place").alias("message_id"), F.col("place").alias("target"), run.alias("run_id"), (run * 100).alias("run_started_at"))
    asked = F.when(F.col("place") % 5 == 0, -F.col("place") - 1).otherwise(F.col("place"))
    r = exported.select("chat_id", asked.alias("reply_to"), F.lit(3).alias("run_id"), F.lit(300).alias("started_at")).distinct()
    return ingest.resolution_counts(ingest.resolve_replies(r, c))


@query(
    "users",
    "messages",
    "tombstones",
    oracle=""", ask AS (SELECT u.user_id AS query_id, is_member OR is_admin AS may, u.user_id % 2 = 0 AS other FROM users u WHERE u.user_id <= 40),
v AS (SELECT message_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS ts FROM messages m WHERE chat_id = 0 AND memory_policy = 'normal' AND NOT is_redacted AND NOT EXISTS (SELECT 1 FROM tombstones t WHERE t.status <> 'failed'
AND t.tombstone_key IN (concat('message:', m.chat_id, ':', m.message_id), 'message_hash:' || m.content_hash, concat('user:', m.user_id)))),
best AS (SELECT message_id, row_number() OVER (ORDER BY round(len(list_filter(ts, lambda t: t = 'the')) * 0.1::DOUBLE, 6) DESC, message_id DESC) AS place FROM v WHERE list_contains(ts, 'the') QUALIFY place <= 3),
ids AS (SELECT coalesce(string_agg(message_id, ',' ORDER BY place), '') AS s FROM best)
SELECT query_id, query_id AS user_id, 'The' AS query_text, CASE WHEN may AND NOT other THEN s ELSE '' END AS message_ids, NOT (may AND NOT other AND s <> '') AS abstained FROM ask, ids""",
)
def recall_trace_hits(spark, users, messages, tombstones):
    """Traces name the messages that were shown; who may not ask, or asks in another chat, gets none."""
    u = F.col("user_id")
    asked = users.where("user_id <= 40").select(u.alias("query_id"), "user_id", F.when(u % 2 == 0, 9).otherwise(0).cast("long").alias("chat_id"), F.lit(" The ").alias("query"))
    people = users.withColumns({"first_name": F.col("name"), "last_name": F.lit(None).cast("string")})
    traces = search.recall(asked, people, messages, tombstones, 0)[1]
    return traces.select("query_id", "user_id", "query_text", F.array_join(F.transform("message_ids", lambda x: x.cast("string")), ",").alias("message_ids"), "abstained")


@query("messages", oracle=""" SELECT message_id AS query_id, '{"message_id":' || message_id || ',"place":1,"captured_at":"' || strftime(to_timestamp(message_id)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') || '+00:00"}' AS item FROM messages""")
def evidence_items(spark, messages):
    m = F.col("message_id")
    return search.evidence_json(messages.select(m.alias("query_id"), "message_id", F.lit(1).alias("place"), F.timestamp_seconds(m).alias("captured_at")), without=["query_id"])


@query("users", oracle=" SELECT user_id, strftime(to_timestamp(user_id * 1000)::TIMESTAMP, '%Y-%m-%d %H:%M') AS shown FROM users")
def shown_times(spark, users):
    return users.select("user_id", T.shown_time(F.timestamp_seconds(F.col("user_id") * 1000)).alias("shown"))


@query(
    "users",
    "intros",
    oracle=""" SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'second' ELSE intro_text END AS intro_text, CASE WHEN user_id % 2 = 0 THEN 'v' ELSE voucher END AS voucher, row_number FROM intros WHERE user_id % 7 <> 0
UNION ALL SELECT user_id, 'second', 'v', NULL FROM users WHERE user_id % 2 = 0 AND user_id % 7 <> 0 AND user_id NOT IN (SELECT user_id FROM intros)""",
)
def intros_after(spark, users, intros):
    """Two writers of the same intros, then some intros are deleted."""
    new = lambda text, at: users.where("user_id % 2 = 0").select("user_id", F.lit(text).alias("intro_text"), F.lit("v").alias("voucher"), F.lit(at).alias("at"))
    after = community.upsert_intros(intros, new("second", 2).union(new("first", 1)))
    return community.delete_intros(after, users.where("user_id % 7 = 0")).select("user_id", "intro_text", "voucher", "row_number")


@query("users", oracle=" SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NOT is_member ELSE is_member END AS is_member, CASE WHEN user_id % 6 = 0 THEN user_id ELSE -1 END AS joined_at, CASE WHEN user_id % 6 = 3 THEN user_id ELSE -2 END AS left_at FROM users")
def members_set(spark, users):
    u = F.col("user_id")
    before = users.select("user_id", "is_member", F.lit(-1).cast("long").alias("joined_at"), F.lit(-2).cast("long").alias("left_at"))
    changes = users.where("user_id % 3 = 0").select("user_id", (~F.col("is_member")).alias("is_member"), F.when(u % 6 == 0, u).alias("joined_at"), F.when(u % 6 == 3, u).alias("left_at"))
    return community.set_member(before, changes)


@query(
    "applications",
    oracle=""", s AS (SELECT user_id AS host, id AS ts, id % 11 AS restarts, id % 120 AS pending, CASE WHEN id % 50 = 0 THEN 'exited:1' ELSE 'running' END AS status FROM applications),
d AS (SELECT *, restarts - lag(restarts) OVER w AS dr, pending - lag(pending) OVER w AS dp FROM s WINDOW w AS (PARTITION BY host ORDER BY ts))
SELECT host, ts, CASE WHEN status LIKE 'exited:%' OR coalesce(dr, 0) > 2 OR (pending > 50 AND coalesce(dp, 0) > 0) THEN 'red' ELSE 'green' END AS state FROM d""",
)
def health_states(spark, applications):
    i = F.col("id")
    samples = applications.select(F.col("user_id").alias("host"), i.alias("ts"), (i % 11).alias("restarts"), (i % 120).alias("pending"), F.when(i % 50 == 0, "exited:1").otherwise("running").alias("status"))
    return community.health_deltas(samples).select("host", "ts", "state")


@query("users", oracle=" SELECT user_id, name, row_number() OVER (ORDER BY name, user_id) AS place FROM users WHERE is_member QUALIFY place <= 20")
def members_first(spark, users):
    return community.members_by_name(users, 20).select("user_id", "name", "place")


@query("users", oracle=" SELECT user_id, row_number() OVER (ORDER BY user_id % 2, user_id % 13 DESC, user_id) AS place FROM users QUALIFY place <= 50")
def chats_unanswered(spark, users):
    u = F.col("user_id")
    return community.unanswered_first(users.select("user_id", (u % 2 == 1).alias("last_from_me"), (u % 13).alias("unread")), "user_id", 50).select("user_id", "place")
