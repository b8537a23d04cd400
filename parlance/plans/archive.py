"""Queries over the archive's proxies, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import community, governance, ingest, search, search_index, versions
from parlance.plans.proxies import AS_OF, sql, table

QUERIES, ORACLES = {}, {}


def query(*tables: str, oracle: str | None = None):
    """Registers f(spark, table...) under its name; oracle follows the tables' WITH clauses."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *[table(spark, sf_dir, t) for t in tables])
        if oracle:
            ORACLES[f.__name__] = sql(*tables) + "\n" + oracle
        return f

    return register


# Search queries of the proxies.
ASKED = [(1, 0, "the and"), (2, 1, "  der die UND "), (3, 2, "que"), (4, 3, "les des"), (5, 0, ""), (6, 1, "zzz nothing"), (7, 2, "of the in")]
ASKED_SQL = ", asked(query_id, chat_id, query) AS (VALUES " + ", ".join(f"({i}, {c}, '{q}')" for i, c, q in ASKED) + ")"


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id long, chat_id long, query string")


VISIBLE_SQL = """, shown AS (
  SELECT * FROM messages m WHERE memory_policy = 'normal' AND NOT is_redacted AND NOT EXISTS (
    SELECT 1 FROM tombstones t WHERE t.tombstone_key IN (concat('message:', m.chat_id, ':', m.message_id), 'message_hash:' || m.content_hash, concat('user:', m.user_id)) AND t.status IN ('pending', 'processing', 'completed'))
)"""
FOUND_SQL = (
    ASKED_SQL
    + VISIBLE_SQL
    + r""", terms AS (SELECT query_id, chat_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(trim(query)), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS term FROM asked),
toks AS (SELECT chat_id, message_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM shown),
tok AS (SELECT chat_id, message_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM toks),
ev AS (SELECT query_id, t.chat_id, message_id, t.term, pos FROM tok t JOIN terms q ON t.term = q.term AND t.chat_id = q.chat_id),
need AS (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id),
one AS (SELECT e.query_id, e.chat_id, e.message_id, e.pos, o.term, max(o.pos) AS m FROM ev e JOIN ev o ON e.query_id = o.query_id AND e.chat_id = o.chat_id AND e.message_id = o.message_id AND o.pos <= e.pos GROUP BY ALL),
beg AS (SELECT query_id, chat_id, message_id, pos, CASE WHEN count(*) = any_value(n) THEN min(m) ELSE -1 END AS s FROM one JOIN need USING (query_id) GROUP BY ALL),
cov AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY query_id, chat_id, message_id ORDER BY pos), -1) AS before FROM beg),
worth AS (SELECT c.query_id, c.chat_id, c.message_id, c.pos, 0.1::DOUBLE / (1 + (c.pos - c.s) - (count(*) - 1)) AS w FROM cov c JOIN ev e ON c.query_id = e.query_id AND c.chat_id = e.chat_id AND c.message_id = e.message_id AND e.pos BETWEEN c.s AND c.pos WHERE c.s > c.before GROUP BY c.query_id, c.chat_id, c.message_id, c.pos, c.s),
ranked AS (SELECT query_id, chat_id, message_id, round(sum(w), 6) AS rank FROM worth GROUP BY ALL),
hits AS (SELECT query_id, chat_id, message_id, message_id % 97 AS user_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank DESC, message_id DESC) AS place
         FROM ranked QUALIFY place <= 3)
"""
)


@query("messages", "tombstones", oracle=FOUND_SQL + "SELECT query_id, chat_id, message_id, user_id, rank, place FROM hits")
def governed_search_topk(spark, messages, tombstones):
    return search.search(messages, asked(spark), tombstones)


@query("messages", "tombstones", oracle=FOUND_SQL + "SELECT query_id, chat_id, message_id, user_id, rank, place FROM hits")
def indexed_search(spark, messages, tombstones):
    return search_index.search_postings(search_index.postings(messages), search_index.unposted(messages.limit(0), 0), asked(spark), tombstones)


_CHANGED = (
    ", before AS (SELECT * FROM messages), edited AS (SELECT * REPLACE (CASE WHEN message_id % 7 = 0 THEN concat('und the der and die ', text) WHEN message_id % 7 = 1 THEN 'new' ELSE text END AS text, is_redacted OR message_id % 9 = 0 AS is_redacted) FROM before)"
)


@query("messages", "tombstones", oracle=_CHANGED + FOUND_SQL.replace("FROM messages m", "FROM edited m") + "SELECT query_id, chat_id, message_id, user_id, rank, place FROM hits")
def indexed_search_after_edits(spark, messages, tombstones):
    """Edits and erasures go into an index of all messages by their own rows alone."""
    m = F.col("message_id")
    changed = messages.where((m % 7 < 2) | (m % 9 == 0))
    text = F.when(m % 7 == 0, F.concat(F.lit("und the der and die "), "text")).when(m % 7 == 1, "new").otherwise(F.col("text"))
    changed = changed.withColumn("text", text).withColumn("is_redacted", F.col("is_redacted") | (m % 9 == 0))
    rows = search_index.postings(messages, 0).unionByName(search_index.postings(changed, 1))
    return search_index.search_postings(rows, search_index.unposted(changed, 1), asked(spark), tombstones)


@query("messages", "tombstones", oracle=", before AS (SELECT * FROM messages), edited AS (SELECT * REPLACE (CASE WHEN message_id % 3 = 0 THEN concat('the and ', text) ELSE text END AS text, is_redacted OR message_id % 30 = 0 AS is_redacted) FROM before)" + FOUND_SQL.replace("FROM messages m", "FROM edited m") + "SELECT query_id, chat_id, message_id, user_id, rank, place FROM hits")
def current_version_search(spark, messages, tombstones):
    """Every third message has a second version, every thirtieth a blank one: earlier versions aren't found."""
    m = F.col("message_id")
    version = lambda n, text, off: messages.select("chat_id", "message_id", F.lit(n).alias("version_seq"), text.alias("text"), F.lit(None).cast("string").alias("caption"), off.alias("is_redacted"))
    stored = version(1, F.col("text"), F.lit(False)).union(version(2, F.concat(F.lit("the and "), "text"), m % 30 == 0).where("message_id % 3 = 0"))
    current = versions.current_versions(messages.withColumn("current_version", F.when(m % 3 == 0, 2).otherwise(1)), stored)
    return search.search(current, asked(spark), tombstones)


@query(
    "messages",
    "tombstones",
    oracle=VISIBLE_SQL + " SELECT c AS query_id, chat_id, message_id, user_id, 0.1::DOUBLE AS rank, row_number() OVER (PARTITION BY chat_id ORDER BY message_id DESC) AS place FROM shown, range(4) r(c) WHERE chat_id = c AND message_id % 4 < 2 QUALIFY place <= 3",
)
def stemmed_search(spark, messages, tombstones):
    """Russian words meet in any form; words that say little don't count, nor do they take a place."""
    m = F.col("message_id")
    text = F.when(m % 4 == 0, "Новости города").when(m % 4 == 1, "новостями о городе!").when(m % 4 == 2, "скорость города").otherwise(F.col("text"))
    q = messages.select("chat_id").distinct().select(F.col("chat_id").alias("query_id"), "chat_id", F.lit(" новость, в  ГОРОДАХ ").alias("query"))
    return search.search(messages.withColumn("text", text), q, tombstones, analyzer="russian", stop_words=T.RUSSIAN_STOP_WORDS)


_USER = """'{"first_name":"U' || user_id || '","id":' || user_id || '}'"""


@query(
    "messages",
    oracle=f""" SELECT message_id, sha256('["chv1","x","","text",[' || CASE WHEN message_id % 3 = 0 THEN '{{"length":2,"offset":1,"type":"text_link","url":"https://e.org/?q=\\"' || message_id || '\\""}}'
WHEN message_id % 3 = 1 THEN '{{"language":"py","length":3,"offset":0,"type":"pre"}},{{"length":4,"offset":5,"type":"text_mention","user":' || {_USER} || '}}' ELSE '' END || ']]') AS content_hash FROM messages""",
)
def entity_hashes(spark, messages):
    """Links, languages and users are part of a hash; keys are sorted and nulls left out at every depth."""
    m = F.col("message_id")
    user = F.struct(F.col("user_id").alias("id"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("first_name"), F.lit(None).cast("string").alias("last_name"))

    def entity(kind, offset, length, url=None, language=None, user=user.cast("struct<id:bigint,first_name:string,last_name:string>"), named=False):
        none = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), F.lit(offset).alias("offset"), F.lit(length).alias("length"), (none if url is None else url).alias("url"), (none if language is None else F.lit(language)).alias("language"), F.when(F.lit(named), user).alias("user"))

    link = entity("text_link", 1, 2, url=F.concat(F.lit('https://e.org/?q="'), m.cast("string"), F.lit('"')))
    two = F.array(entity("text_mention", 5, 4, named=True), entity("pre", 0, 3, language="py"))
    entities = F.when(m % 3 == 0, F.array(link)).when(m % 3 == 1, two)
    return messages.select("message_id", T.content_hash(F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("string"), entities).alias("content_hash"))


@query(
    "messages",
    "tombstones",
    oracle=FOUND_SQL + "SELECT query_id, coalesce((SELECT string_agg(message_id, ',' ORDER BY place) FROM hits h WHERE h.query_id = asked.query_id), '') AS message_ids, NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = asked.query_id) AS abstained FROM asked",
)
def evidence_bundle(spark, messages, tombstones):
    found = search.evidence(asked(spark), search.search(messages, asked(spark), tombstones))
    return found.withColumn("message_ids", F.array_join(F.transform("message_ids", lambda x: x.cast("string")), ","))


@query("messages", "tombstones")
def search_snippets(spark, messages, tombstones):
    hits = search.search(messages, asked(spark), tombstones)
    return search.snippets(hits, messages, asked(spark)).withColumn("html", T.highlight_html(F.col("snippet"))).withColumn("link", T.permalink(F.col("chat_id"), F.col("message_id")))


@query(
    "messages",
    "tombstones",
    oracle=FOUND_SQL
    + """, expected AS (SELECT query_id, chat_id * 7 + 3 AS a, chat_id + 40 AS b FROM asked), k(k) AS (VALUES (1), (3), (5))
SELECT e.query_id, CAST(k AS INTEGER) AS k, n / 2.0::DOUBLE AS recall, n / k::DOUBLE AS precision
FROM expected e, k, LATERAL (SELECT count(*)::DOUBLE AS n FROM hits h WHERE h.query_id = e.query_id AND place <= k AND message_id IN (a, b)) x""",
)
def recall_precision(spark, messages, tombstones):
    q = asked(spark)
    bundles = search.evidence(q, search.search(messages, q, tombstones))
    return search.retrieval_scores(bundles, q.select("query_id", F.expr("array(chat_id * 7 + 3, chat_id + 40)").alias("expected_ids")))


@query("messages", "tombstones", oracle=VISIBLE_SQL + " SELECT chat_id, message_id FROM shown")
def tombstone_antijoin(spark, messages, tombstones):
    return governance.without_tombstones(governance.visible(messages), tombstones, governance.ACTIVE).select("chat_id", "message_id")


@query(
    "messages",
    "tombstones",
    oracle=""", k AS (SELECT chat_id, message_id, 1 AS priority, concat('message:', chat_id, ':', message_id) AS tombstone_key FROM messages UNION ALL SELECT chat_id, message_id, 2, 'message_hash:' || content_hash FROM messages
UNION ALL SELECT chat_id, message_id, 3, concat('user:', user_id) FROM messages)
SELECT chat_id, message_id, arg_min(tombstone_key, priority) AS tombstone_key, CAST(min(priority) AS INTEGER) AS priority FROM k WHERE tombstone_key IN (SELECT tombstone_key FROM tombstones) GROUP BY chat_id, message_id""",
)
def tombstone_priority(spark, messages, tombstones):
    return governance.tombstone_priority(messages, tombstones)


_MARK = r"(?i)(^|[^\p{L}\p{N}_])"
DETECT = " CASE WHEN regexp_matches(text, '" + _MARK + r"#offrecord($|[^\p{L}\p{N}_])') THEN 'offrecord' WHEN regexp_matches(text, '" + _MARK + r"#nomem($|[^\p{L}\p{N}_])') THEN 'nomem' ELSE 'normal' END"


@query("messages", oracle=f" SELECT message_id, {DETECT} AS policy FROM messages")
def policy_detect(spark, messages):
    return messages.select("message_id", T.policy(F.col("text"), F.col("caption")).alias("policy"))


@query("messages", oracle=f" SELECT policy, count(*) AS n FROM (SELECT {DETECT} AS policy FROM messages) GROUP BY policy")
def policy_histogram(spark, messages):
    return ingest.histogram(messages.select(T.policy(F.col("text"), F.col("caption")).alias("policy")), "policy")


@query("messages", oracle=r""" SELECT message_id, sha256('["chv1","' || replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') || '","","text",[]]') AS content_hash FROM messages""")
def content_hashes(spark, messages):
    return messages.select("message_id", T.content_hash(F.col("text"), F.col("caption"), F.lit(None)).alias("content_hash"))


@query("messages", oracle=" SELECT content_hash, min(message_id) AS message_id FROM messages GROUP BY content_hash")
def content_hash_dedup(spark, messages):
    return versions.keep_first(messages, ["content_hash"], ["message_id"]).select("content_hash", "message_id")


def _edited(messages):
    """The message of each text, its copies being later arrivals of one message per user."""
    return messages.select("chat_id", F.col("user_id").alias("message_id"), "content_hash", F.col("message_id").alias("arrival"), "memory_policy", "is_redacted", "text")


@query(
    "messages",
    oracle=""", v AS (SELECT chat_id, user_id AS message_id, content_hash, min(message_id) AS arrival FROM messages GROUP BY ALL)
SELECT chat_id, message_id, row_number() OVER (PARTITION BY chat_id, message_id ORDER BY arrival, content_hash) AS version_seq, content_hash FROM v""",
)
def version_chain(spark, messages):
    none = spark.createDataFrame([], "chat_id long, message_id long, version_seq long, content_hash string")
    return versions.append_versions(none, _edited(messages))


@query(
    "messages",
    oracle=""" SELECT chat_id, user_id AS message_id, sha256(arg_min(text, message_id)) AS text_hash, min(captured_at) AS captured_at, bool_or(is_redacted) AS is_redacted,
coalesce(arg_min(memory_policy, message_id) FILTER (memory_policy IN ('offrecord', 'forgotten')), arg_max(memory_policy, message_id)) AS memory_policy FROM messages GROUP BY chat_id, user_id""",
)
def upsert_policy_ratchet(spark, messages):
    e = _edited(messages).select("chat_id", "message_id", "text", "memory_policy", "is_redacted", "arrival", F.col("arrival").alias("captured_at"))
    return versions.upsert_messages(e.limit(0).drop("arrival"), e).select("chat_id", "message_id", F.sha2("text", 256).alias("text_hash"), "captured_at", "memory_policy", "is_redacted")


@query(
    "messages",
    "tombstones",
    oracle=""", due AS (SELECT * FROM tombstones WHERE status = 'pending' ORDER BY created_at, id LIMIT 10), hit AS (SELECT DISTINCT m.chat_id, m.message_id FROM messages m JOIN due d ON d.target_type <> 'message_hash' AND d.target_id <> 'none'
AND d.tombstone_key IN (concat('message:', m.chat_id, ':', m.message_id), concat('user:', m.user_id)))
SELECT m.chat_id, m.message_id, h.message_id IS NOT NULL OR is_redacted AS is_redacted, CASE WHEN h.message_id IS NOT NULL THEN 'forgotten' ELSE memory_policy END AS memory_policy, h.message_id IS NULL AS has_text, content_hash
FROM messages m LEFT JOIN hit h ON h.chat_id = m.chat_id AND h.message_id = m.message_id""",
)
def forget_cascade(spark, messages, tombstones):
    after, _ = governance.forget_cascade({"messages": messages}, tombstones)
    return after["messages"].select("chat_id", "message_id", "is_redacted", "memory_policy", F.col("text").isNotNull().alias("has_text"), "content_hash")


@query(
    "messages",
    "tombstones",
    oracle=""", due AS (SELECT * FROM tombstones WHERE status = 'pending' ORDER BY created_at, id LIMIT 10)
SELECT t.id, CASE WHEN d.id IS NULL THEN t.status WHEN d.target_id = 'none' AND d.target_type <> 'message_hash' THEN 'failed' ELSE 'completed' END AS status,
CASE WHEN d.id IS NULL OR (d.target_id = 'none' AND d.target_type <> 'message_hash') THEN NULL WHEN d.target_type = 'message_hash' THEN 'skipped target_type_not_supported_yet' WHEN d.target_type = 'user' THEN 'completed ' ELSE 'completed not_applicable' END AS traces,
CASE WHEN d.id IS NULL OR (d.target_id = 'none' AND d.target_type <> 'message_hash') THEN NULL WHEN d.target_type = 'message_hash' THEN 'skipped target_type_not_supported_yet' ELSE 'skipped table_not_exists' END AS links
FROM tombstones t LEFT JOIN due d ON d.id = t.id""",
)
def forget_events_after(spark, messages, tombstones):
    _, events = governance.forget_cascade({"messages": messages}, tombstones)
    said = lambda layer: F.when(F.col("cascade").isNotNull(), F.concat(F.col("cascade")[layer]["status"], F.lit(" "), F.coalesce(F.col("cascade")[layer]["reason"], F.lit(""))))
    return events.select("id", "status", said("traces").alias("traces"), said("links").alias("links"))


@query(
    "messages",
    "tombstones",
    "exported",
    oracle=""", u AS (SELECT DISTINCT try_cast(target_id AS BIGINT) AS u FROM tombstones WHERE status = 'pending' AND target_type = 'user' AND target_id <> 'none')
SELECT place, CASE WHEN user_id IN (SELECT u FROM u) AND place % 5 <> 0 THEN NULL ELSE sha256(text) END AS query_text, place % 5 = 0 OR user_id IN (SELECT u FROM u) AS query_redacted FROM exported""",
)
def forgotten_traces(spark, messages, tombstones, exported):
    traces = exported.select("place", "user_id", F.sha2("text", 256).alias("query_text"), (F.col("place") % 5 == 0).alias("query_redacted"))
    after, _ = governance.forget_cascade({"messages": messages, "traces": traces}, tombstones, limit=1_000_000)
    return after["traces"].select("place", "query_text", "query_redacted")


KIND = """CASE WHEN type = 'service' THEN 'service' WHEN forwarded_from IS NOT NULL THEN 'forward' WHEN media_type = 'voice_message' THEN 'voice' WHEN media_type = 'photo' THEN 'photo' WHEN media_type IS NOT NULL THEN 'unknown' WHEN photo IS NOT NULL THEN 'photo'
WHEN location_information IS NOT NULL THEN 'location' WHEN contact_information IS NOT NULL THEN 'contact' WHEN poll IS NOT NULL THEN 'poll' WHEN dice IS NOT NULL THEN 'dice' WHEN mime_type LIKE 'application/%' THEN 'document' WHEN text IS NOT NULL THEN 'text' ELSE 'unknown' END"""


@query("exported", oracle=f" SELECT {KIND} AS kind, count(*) AS n FROM exported GROUP BY 1")
def kind_histogram(spark, exported):
    return ingest.histogram(exported.select(T.message_kind().alias("kind")), "kind")


@query(
    "exported",
    oracle=""" SELECT count(*) AS total, count(*) FILTER (type = 'message') AS user_messages, count(*) FILTER (type = 'service') AS service_messages, count(*) FILTER (type = 'message' AND (media_type IS NOT NULL OR photo IS NOT NULL)) AS media,
count(*) FILTER (type = 'message' AND reply_to IS NOT NULL) AS replies, count(*) FILTER (type = 'message' AND forwarded_from IS NOT NULL) AS forwards, count(*) FILTER (type = 'message' AND edited) AS edits,
count(*) FILTER (type = 'message' AND from_id LIKE 'channel%') AS anonymous, count(DISTINCT from_id) FILTER (type = 'message' AND from_id NOT LIKE 'channel%') AS distinct_users,
count(*) FILTER (type = 'message' AND policy = 'normal') AS policy_normal, count(*) FILTER (type = 'message' AND policy = 'nomem') AS policy_nomem, count(*) FILTER (type = 'message' AND policy = 'offrecord') AS policy_offrecord,
min(date) AS first_date, max(date) AS last_date, (SELECT count(*) FROM exported WHERE type = 'message' AND reply_to IS NOT NULL AND reply_to NOT IN (SELECT id FROM exported)) AS dangling_replies,
(SELECT count(*) FROM (SELECT id FROM exported GROUP BY id HAVING count(*) > 1)) AS duplicate_ids FROM exported""",
)
def dry_run_report(spark, exported):
    return ingest.dry_run_report(exported.withColumn("has_media", F.col("media_type").isNotNull() | F.col("photo").isNotNull()).withColumn("forwarded", F.col("forwarded_from").isNotNull()))


@query("exported", oracle=" SELECT id, count(*) AS n FROM exported GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, exported):
    return ingest.histogram(exported, "id").where("n > 1")


@query("exported", oracle=" SELECT id, reply_to FROM exported WHERE type = 'message' AND reply_to IS NOT NULL AND reply_to NOT IN (SELECT id FROM exported)")
def dangling_replies(spark, exported):
    return exported.where("type = 'message' and reply_to is not null").select("id", "reply_to").join(exported.select(F.col("id").alias("reply_to")).distinct(), "reply_to", "left_anti")


@query(
    "exported",
    oracle=""", rp AS (SELECT DISTINCT chat_id, reply_to, 3 AS run_id, 300 AS started_at FROM exported WHERE reply_to IS NOT NULL), c AS (SELECT chat_id, id AS message_id, place AS target, CASE WHEN place % 4 = 0 THEN NULL ELSE place % 4 END AS run_id, CASE WHEN place % 4 = 0 THEN NULL ELSE place % 4 * 100 END AS s FROM exported),
m AS (SELECT rp.*, target, CASE WHEN c.run_id = rp.run_id THEN 'same_run' WHEN c.run_id IS NOT NULL AND s < started_at THEN 'prior_run' WHEN target IS NOT NULL AND c.run_id IS NULL THEN 'live' END AS via, s
      FROM rp LEFT JOIN c ON c.chat_id = rp.chat_id AND c.message_id = rp.reply_to)
SELECT chat_id, reply_to, run_id::INTEGER AS run_id, started_at::INTEGER AS started_at, CASE WHEN via IS NOT NULL THEN target END AS target, coalesce(via, 'unresolved') AS via FROM m
QUALIFY row_number() OVER (PARTITION BY chat_id, reply_to ORDER BY CASE via WHEN 'same_run' THEN 0 WHEN 'prior_run' THEN 1 WHEN 'live' THEN 2 ELSE 3 END, s DESC NULLS LAST, target) = 1""",
)
def reply_resolution(spark, exported):
    replies = exported.where("reply_to is not null").select("chat_id", "reply_to", F.lit(3).alias("run_id"), F.lit(300).alias("started_at")).distinct()
    run = F.when(F.col("place") % 4 != 0, (F.col("place") % 4).cast("int"))
    return ingest.resolve_replies(replies, exported.select("chat_id", F.col("id").alias("message_id"), F.col("place").alias("target"), run.alias("run_id"), (run * 100).alias("run_started_at")))


@query(
    "exported",
    oracle=""", d AS (SELECT *, CASE WHEN type = 'service' THEN 'service' WHEN id % 23 = 0 THEN 'tombstone' WHEN id % 19 = 0 THEN 'live_overlap' WHEN id % 17 = 0 THEN 'stored_duplicate' WHEN user_id >= 35 THEN 'no_user' WHEN policy = 'offrecord' THEN 'offrecord' ELSE 'applied' END AS alone FROM exported),
e AS (SELECT *, coalesce(bool_or(alone IN ('applied', 'offrecord')) OVER (PARTITION BY chat_id, id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM d)
SELECT chat_id, id AS message_id, place, CASE WHEN earlier AND alone IN ('applied', 'offrecord', 'no_user') THEN 'stored_duplicate' ELSE alone END AS outcome FROM e""",
)
def import_outcomes(spark, exported):
    m = exported.withColumnRenamed("id", "message_id")
    keys = m.select(F.concat_ws(":", F.lit("message"), "chat_id", "message_id").alias("tombstone_key"), "message_id", "chat_id")
    return ingest.import_outcomes(m, keys.where("message_id % 23 = 0"), keys.where("message_id % 19 = 0"), keys.where("message_id % 17 = 0"), m.where("user_id < 35"))


@query("exported", oracle=" SELECT id AS message_id, place FROM exported WHERE id > 500")
def resume_filter(spark, exported):
    return ingest.resume_after(exported.select(F.col("id").alias("message_id"), "place"), 500)


@query("exported", oracle=" SELECT chat_id, place AS message_id FROM exported WHERE NOT (place % 3 = 1 AND place % 5 <> 0)")
def rollback_survivors(spark, exported):
    m = exported.select("chat_id", F.col("place").alias("message_id"), F.col("place").alias("raw_id"))
    raws = m.select("raw_id", (F.col("raw_id") % 3).alias("run_id"), F.when(F.col("raw_id") % 5 == 0, F.col("raw_id")).alias("update_id"))
    after, _ = ingest.rollback({"raws": raws, "messages": m, "versions": m.select("chat_id", "message_id")}, 1)
    return after["messages"].select("chat_id", "message_id")


@query("exported", oracle=""" SELECT a.place AS message_id, 100 AS started_at, max(b.place % 90) AS prior_run FROM exported a JOIN exported b ON b.id = a.place AND b.place % 90 < 100 WHERE b.place % 90 IS NOT NULL GROUP BY ALL""")
def prior_run_latest(spark, exported):
    m = exported.select(F.col("place").alias("message_id"), F.lit(100).alias("started_at"))
    return ingest.latest_prior_run(m, exported.select(F.col("id").alias("message_id"), (F.col("place") % 90).alias("run_id"), (F.col("place") % 90).alias("started_at")))


@query("updates", oracle=" SELECT update_id FROM updates WHERE NOT stored AND update_id IS NULL UNION ALL SELECT DISTINCT update_id FROM updates WHERE NOT stored AND update_id IS NOT NULL AND update_id NOT IN (SELECT update_id FROM updates WHERE stored AND update_id IS NOT NULL)")
def updates_dedup(spark, updates):
    return ingest.updates_once(updates.where("not stored").select("update_id"), updates.where("stored and update_id is not null").select("update_id"))


@query("applications", oracle=" SELECT status, count(*) AS n FROM applications GROUP BY status")
def funnel_by_status(spark, applications):
    return community.funnel(applications)


@query("applications", oracle=" SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'vouched', 'added', 'rejected')) AS filled, count(*) FILTER (status = 'pending') AS waiting, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'rejected') AS rejected FROM applications")
def dashboard_counts(spark, applications):
    return community.dashboard(applications)


@query(
    "users",
    "intros",
    "applications",
    oracle=""", v AS (SELECT user_id, voucher_id FROM applications WHERE voucher_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1)
SELECT u.user_id, u.name, intro_at, w.name AS voucher_name FROM users u LEFT JOIN intros USING (user_id) LEFT JOIN v USING (user_id) LEFT JOIN users w ON w.user_id = v.voucher_id WHERE u.is_member""",
)
def members_latest_vouch(spark, users, intros, applications):
    return community.members_overview(users, intros, applications)


@query("users", "intros", oracle=" SELECT user_id FROM users WHERE is_member AND user_id NOT IN (SELECT user_id FROM intros)")
def members_without_intro(spark, users, intros):
    return community.members_without_intro(users, intros).select("user_id")


@query("users", "intros", oracle=" SELECT (SELECT count(*) FROM users WHERE is_member) AS members, (SELECT count(*) FROM intros) AS intros, (SELECT count(*) FROM users WHERE is_member AND user_id NOT IN (SELECT user_id FROM intros)) AS without_intro")
def admin_stats(spark, users, intros):
    return community.admin_stats(users, intros)


@query(
    "applications",
    oracle=f""" SELECT id, unnest(CASE WHEN coalesce(submitted_at, created_at) < {AS_OF} - INTERVAL 72 HOUR THEN ['reject'] WHEN created_at < {AS_OF} - INTERVAL 48 HOUR
THEN list_filter([CASE WHEN nudged_at IS NULL THEN 'nudge' END, CASE WHEN notified_at IS NULL THEN 'notify' END], lambda x: x IS NOT NULL) END) AS action FROM applications WHERE status = 'pending'""",
)
def vouch_deadlines(spark, applications):
    return community.vouch_deadlines(applications, F.expr(AS_OF))


@query("intros", oracle=f" SELECT user_id FROM intros WHERE updated_at < {AS_OF} - INTERVAL 90 DAY")
def stale_intros(spark, intros):
    return community.stale_intros(intros, F.expr(AS_OF), 90).select("user_id")


@query(
    "intros",
    oracle=""", t AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'every_2_days' ELSE 'done' END AS phase, user_id % 10 AS sent, CASE WHEN user_id % 7 > 0 THEN user_id % 4 END AS age FROM intros),
n AS (SELECT *, CASE WHEN phase = 'done' THEN 'done' WHEN phase = 'daily' AND sent < 5 THEN 'daily' WHEN sent < 8 THEN 'every_2_days' ELSE 'done' END AS next FROM t)
SELECT user_id, next AS phase, CASE next WHEN 'daily' THEN coalesce(age >= 1, true) WHEN 'every_2_days' THEN coalesce(age >= 2, true) ELSE false END AS due FROM n""",
)
def intro_refresh(spark, intros):
    phase = F.element_at(F.array(F.lit("daily"), F.lit("every_2_days"), F.lit("done")), (F.col("user_id") % 3).cast("int") + 1)
    step = community.refresh_step(phase, F.col("user_id") % 10, F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 4))
    return intros.select("user_id", step.alias("s")).select("user_id", "s.phase", "s.due")


@query("users", oracle=r" SELECT user_id FROM users WHERE name ILIKE '%r#00%1_3%' OR username ILIKE '%r#00%1_3%'")
def member_search(spark, users):
    return community.search_members(users, "R#00%1_3", ["name", "username"]).select("user_id")


@query(
    "users",
    oracle=""" SELECT user_id, CASE WHEN user_id % 5 > 0 THEN concat(name, CASE WHEN user_id % 2 = 0 THEN ' &lt;b&gt;' ELSE '' END) WHEN username IS NOT NULL THEN concat('@', username) ELSE '—' END AS display,
concat('https://t.me/c/', user_id, '/', user_id) AS link FROM users""",
)
def member_names(spark, users):
    first, last = F.when(F.col("user_id") % 5 > 0, F.col("name")), F.when(F.col("user_id") % 2 == 0, "<b>")
    return users.select("user_id", T.display_name(first, last, F.col("username")).alias("display"), T.permalink(F.concat(F.lit("-100"), F.col("user_id").cast("string")), F.col("user_id")).alias("link"))


@query("applications", oracle=""", o AS (SELECT id, user_id AS application_id, CASE WHEN id % 4 = 0 THEN 'sent' ELSE 'pending' END AS status, created_at FROM applications)
SELECT id, application_id, status FROM o QUALIFY status <> 'pending' OR row_number() OVER (PARTITION BY application_id, status ORDER BY created_at, id) = 1""")
def outbox_keep_first(spark, applications):
    o = applications.select("id", F.col("user_id").alias("application_id"), F.when(F.col("id") % 4 == 0, "sent").otherwise("pending").alias("status"), "created_at")
    return community.one_pending(o).select("id", "application_id", "status")


@query("applications", oracle=" SELECT id, CAST(id % 6 + 1 AS BIGINT) AS attempts, CASE WHEN id % 6 + 1 >= 5 THEN 'failed' ELSE status END AS status FROM applications")
def outbox_retry(spark, applications):
    return community.after_attempt(applications.select("id", "status", (F.col("id") % 6).alias("attempts"), F.lit("timeout").alias("error"))).select("id", "attempts", "status")


_Q = ", ".join(f"coalesce(max(CASE WHEN o.id % 2 = 0 AND o.id % 7 = {k} THEN concat('a', o.id) END), '—') AS q{k}" for k in range(7))


@query("applications", oracle=f" SELECT user_id, {_Q} FROM applications o GROUP BY user_id")
def answers_pivot(spark, applications):
    return community.answers_wide(applications.select("user_id", (F.col("id") % 2 == 0).alias("is_current"), (F.col("id") % 7).alias("question_index"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("answer")))


@query("users", oracle=" SELECT user_id, sha256(concat(name, '|', coalesce(username, ''))) AS row_hash FROM users WHERE user_id % 6 = 0 AND user_id % 12 <> 0")
def sheet_hash_diff(spark, users):
    sheet = users.where("user_id % 6 = 0").select("user_id", T.row_hash(F.col("name"), F.col("username")).alias("row_hash"))
    local = users.select("user_id", T.row_hash(F.when(F.col("user_id") % 12 == 0, F.col("name")).otherwise("old"), F.col("username")).alias("row_hash"))
    return community.sheet_changes(sheet, local)


@query("applications", oracle=" SELECT id, CASE WHEN status = 'pending' AND id % 3 = 0 THEN 'rejected' WHEN status = 'pending' THEN 'vouched' ELSE status END AS status FROM applications")
def vouch_compare_and_set(spark, applications):
    a = applications.select("id", F.lit(2).alias("seq"), F.lit("pending").alias("expected"), F.lit("vouched").alias("new_status"))
    b = applications.where("id % 3 = 0").select("id", F.lit(1).alias("seq"), F.lit("pending").alias("expected"), F.lit("rejected").alias("new_status"))
    return community.compare_and_set(applications.select("id", "status"), a.union(b))


@query("messages", oracle=""", o AS (SELECT chat_id, message_id, text, memory_policy FROM messages), e AS (SELECT chat_id, message_id FROM messages WHERE message_id % 7 = 0)
SELECT chat_id, message_id, CASE WHEN memory_policy = 'offrecord' THEN NULL WHEN message_id % 7 = 0 THEN 'edited #nomem' ELSE sha256(text) END AS text, CASE WHEN memory_policy = 'offrecord' THEN 'offrecord' WHEN message_id % 7 = 0 THEN 'nomem' ELSE memory_policy END AS memory_policy FROM o""")
def edit_fold(spark, messages):
    edits = messages.where("message_id % 7 = 0").select("chat_id", "message_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("first edit").alias("text")), F.struct(F.lit(2).alias("seq"), F.lit("edited #nomem").alias("text")))).alias("x"))
    m = messages.select("chat_id", "message_id", F.sha2("text", 256).alias("text"), "memory_policy")
    return versions.fold_edits(m, edits.select("chat_id", "message_id", "x.seq", "x.text"))


@query("tombstones", oracle=" SELECT id, CASE WHEN status = 'pending' AND id % 2 = 1 THEN 'processing' ELSE status END AS status FROM tombstones")
def forget_event_lifecycle(spark, tombstones):
    wanted = tombstones.select("id", F.when(F.col("id") % 2 == 1, "processing").otherwise("completed").alias("to_status"))
    return governance.apply_transitions(tombstones.select("id", "status"), wanted)[0]


@query(
    "users",
    oracle=""", r AS (SELECT user_id, CASE user_id % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'completed' WHEN 3 THEN 'cancelled' END AS status, user_id % 4 < 2 AS resume, CASE WHEN user_id % 5 = 0 THEN 'failed' WHEN user_id % 5 = 1 THEN 'completed' END AS other FROM users)
SELECT user_id, CASE WHEN status IN ('completed', 'cancelled') THEN 'start_fresh' WHEN status IS NOT NULL THEN CASE WHEN resume THEN 'resume_existing' ELSE 'block_partial_present' END
WHEN resume AND other = 'failed' THEN 'block_partial_present' ELSE 'start_fresh' END AS decision FROM r""",
)
def resume_decisions(spark, users):
    status = F.element_at(F.array(*map(F.lit, ("running", "failed", "completed", "cancelled")), *[F.lit(None).cast("string")] * 2), (F.col("user_id") % 6).cast("int") + 1)
    other = F.when(F.col("user_id") % 5 == 0, "failed").when(F.col("user_id") % 5 == 1, "completed")
    return users.select("user_id", ingest.resume_decision(status, F.col("user_id") % 4 < 2, other).alias("decision"))


@query("users", oracle=" SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'no_application' WHEN user_id % 5 IN (1, 2) THEN 'wrong_status' WHEN user_id % 8 = 3 THEN 'wrong_user' ELSE 'ok' END AS reason FROM users")
def admission_reasons(spark, users):
    u = F.col("user_id")
    status = F.when(u % 5 == 1, "pending").when(u % 5 == 2, "added").otherwise("vouched")
    return users.select("user_id", community.admission(u % 5 != 0, status, F.when(u % 8 == 3, u + 1).otherwise(u), u).alias("reason"))


@query("users", "intros", "applications", oracle=" SELECT 'users' AS name, count(*) AS n FROM users UNION ALL SELECT 'intros', count(*) FROM intros UNION ALL SELECT 'applications', count(*) FROM applications")
def table_counts(spark, users, intros, applications):
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return one("users", users).unionByName(one("intros", intros)).unionByName(one("applications", applications))
