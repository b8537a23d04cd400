"""Imports of exported conversations: dry run, outcomes, replies, resume, rollback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import canonical_json, content_hash, export_user_id, json_string, let, policy, tombstone_keys, utc_time
from parlance.operators.versions import persist


def dry_run_report(messages: DataFrame) -> DataFrame:
    """One row of counts over messages: id, type, from_id, kind, policy, reply_to, edited, forwarded, has_media, date."""
    user = F.col("type") == "message"
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    replies = messages.where(user & F.col("reply_to").isNotNull()).select("reply_to")
    dangling = replies.join(messages.select(F.col("id").alias("reply_to")).distinct(), "reply_to", "left_anti").agg(F.count(F.lit(1)).alias("dangling_replies"))
    repeated = messages.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    totals = messages.agg(
        F.count(F.lit(1)).alias("total"),
        count(user).alias("user_messages"),
        count(F.col("type") == "service").alias("service_messages"),
        count(user & F.col("has_media")).alias("media"),
        count(user & F.col("reply_to").isNotNull()).alias("replies"),
        count(user & F.col("forwarded")).alias("forwards"),
        count(user & F.col("edited")).alias("edits"),
        count(user & F.col("from_id").startswith("channel")).alias("anonymous"),
        F.count_distinct(F.when(user & ~F.col("from_id").startswith("channel"), F.col("from_id"))).alias("distinct_users"),
        *[count(user & (F.col("policy") == p)).alias(f"policy_{p}") for p in ("normal", "nomem", "offrecord")],
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return totals.crossJoin(dangling).crossJoin(repeated)  # three rows of one


def distinct_senders(messages: DataFrame) -> DataFrame:
    """Senders of user messages, channels too, one row each."""
    return messages.where((F.col("type") == "message") & F.col("from_id").isNotNull()).select("from_id").distinct()


def stored_report(messages: DataFrame, stored: DataFrame, tombstones: DataFrame, candidates: DataFrame, listed: int = 1000) -> DataFrame:
    """What an import would meet in the archive, one row: ids that are erased, ids that are stored and not erased (counts and the first ids
    of each), and messages whose reply's target is neither in the export nor in the archive.

    messages: chat_id, id, type, reply_to. stored: chat_id, message_id. candidates: as for resolve_replies.
    """
    ids = messages.where(F.col("id").isNotNull()).select("chat_id", "id").distinct()
    key = F.concat(F.lit("message:"), F.col("chat_id").cast("string"), F.lit(":"), F.col("id").cast("string"))
    keyed = ids.withColumn("tombstone_key", key)
    erased = keyed.join(tombstones.select("tombstone_key"), "tombstone_key", "left_semi").select("chat_id", "id")
    twice = ids.join(erased, ["chat_id", "id"], "left_anti").join(stored.select("chat_id", F.col("message_id").alias("id")), ["chat_id", "id"], "left_semi")
    outside = messages.where((F.col("type") != "service") & F.col("reply_to").isNotNull()).select("chat_id", "reply_to").join(ids.withColumnRenamed("id", "reply_to"), ["chat_id", "reply_to"], "left_anti")
    run = outside.distinct().select("chat_id", "reply_to", F.lit(None).cast("int").alias("run_id"), F.lit(None).cast("int").alias("started_at"))
    lost = resolve_replies(run, candidates).where("via = 'unresolved'").select("chat_id", "reply_to")
    broken = outside.join(lost, ["chat_id", "reply_to"], "left_semi").agg(F.count(F.lit(1)).alias("broken_replies"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        first = df.select("id").orderBy("id").limit(listed).agg(F.array_sort(F.collect_list("id")).alias(f"{name}_ids"))
        return df.agg(F.count(F.lit(1)).alias(f"{name}_count")).crossJoin(first)  # one row each

    return counted(erased, "tombstone").crossJoin(counted(twice, "duplicate")).crossJoin(broken)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


#: What becomes of a message: the first that holds.
OUTCOMES = ["no_id", "service", "tombstone", "live_overlap", "stored_duplicate", "prior_import", "no_user", "offrecord"]


def outcome(**holds: Column) -> Column:
    out = None
    for name in OUTCOMES:
        if name in holds:
            out = F.when(holds[name], name) if out is None else out.when(holds[name], name)
    return F.lit("applied") if out is None else out.otherwise("applied")


def import_outcomes(messages: DataFrame, tombstones: DataFrame, live: DataFrame, stored: DataFrame, users: DataFrame) -> DataFrame:
    """chat_id, message_id, outcome. Later rows of one id (by place) are duplicates if the first one was stored."""
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    key = F.concat(F.lit("message:"), F.col("chat_id").cast("string"), F.lit(":"), F.col("message_id").cast("string"))
    d = (
        messages.withColumn("tombstone_key", key)
        .join(mark(tombstones, ["tombstone_key"], "_tomb"), "tombstone_key", "left")
        .join(mark(live, ["chat_id", "message_id"], "_live"), ["chat_id", "message_id"], "left")
        .join(mark(stored, ["chat_id", "message_id"], "_stored"), ["chat_id", "message_id"], "left")
        .join(mark(users, ["user_id"], "_user"), "user_id", "left")
    )
    is_ = lambda c: F.coalesce(c, F.lit(False))
    rules = dict(no_id=F.col("message_id").isNull(), service=F.col("type") == "service", tombstone=is_("_tomb"), live_overlap=is_("_live"), stored_duplicate=is_("_stored"))
    alone = d.withColumn("_alone", outcome(**rules, no_user=~is_("_user"), offrecord=F.col("policy") == "offrecord"))
    # An earlier row of the same id counts if it was stored, that is, applied or offrecord.
    earlier = F.max(F.col("_alone").isin("applied", "offrecord")).over(W.partitionBy("chat_id", "message_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    late = alone.withColumn("_again", is_(earlier) & F.col("_alone").isin("applied", "offrecord", "no_user"))
    return late.select("chat_id", "message_id", "place", F.when(F.col("_again"), "stored_duplicate").otherwise(F.col("_alone")).alias("outcome"))


def outcome_counts(outcomes: DataFrame, listed: int = 1000) -> DataFrame:
    """Messages per outcome and the first ids of each. Only as many ids as are listed come together."""
    n = F.row_number().over(W.partitionBy("outcome").orderBy("chat_id", "message_id", "place"))
    first = outcomes.withColumn("_n", n).where(F.col("_n") <= listed).groupBy("outcome").agg(F.sort_array(F.collect_list("message_id")).alias("ids"))
    return histogram(outcomes, "outcome").join(first, "outcome")


def resolve_replies(replies: DataFrame, candidates: DataFrame) -> DataFrame:
    """replies (chat_id, reply_to, run_id, started_at) with target and via.

    candidates: chat_id, message_id, target, run_id (null: live), run_started_at. A message of the same run wins over one of
    an earlier run (the newest first), that over a live one; nothing left gives unresolved. Without a run of its own
    (null) a reply may find any run's message.
    """
    c = candidates.select(F.col("chat_id").alias("c_chat"), F.col("message_id").alias("c_message"), "target", F.col("run_id").alias("c_run"), "run_started_at")
    met = replies.join(c, (F.col("chat_id") == F.col("c_chat")) & (F.col("reply_to") == F.col("c_message")), "left")
    via = (
        F.when(F.col("c_run") == F.col("run_id"), "same_run")
        .when(F.col("c_run").isNotNull() & (F.col("started_at").isNull() | (F.col("run_started_at") < F.col("started_at"))), "prior_run")
        .when(F.col("target").isNotNull() & F.col("c_run").isNull(), "live")
    )
    rank = F.struct(F.when(via == "same_run", 3).when(via == "prior_run", 2).when(via == "live", 1).alias("rank"), "run_started_at", "c_run", (-F.col("target")).alias("t"))
    best = met.withColumn("via", via).withColumn("rank", F.when(via.isNotNull(), rank))
    keys = ["chat_id", "reply_to", "run_id", "started_at"]
    return best.groupBy(*keys).agg(F.max_by("target", "rank").alias("target"), F.coalesce(F.max_by("via", "rank"), F.lit("unresolved")).alias("via"))


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """One row: replies found in the same run, in a prior one, live, and not at all."""
    return resolved.agg(*[F.count_if(F.col("via") == v).alias(v) for v in ("same_run", "prior_run", "live", "unresolved")])


def reply_by_raw(replies: DataFrame, messages: DataFrame, raws: DataFrame) -> DataFrame:
    """chat_id, reply_to, message_id: the stored message (the least id of several) whose raw update carries the id that is replied to."""
    r = raws.select("raw_id", F.col("message_id").alias("_raw_message"))
    m = messages.join(r, "raw_id").select(F.col("chat_id").alias("_chat"), "_raw_message", F.col("message_id").alias("_id"))
    met = replies.join(m, (F.col("chat_id") == F.col("_chat")) & (F.col("reply_to") == F.col("_raw_message")))
    return met.groupBy("chat_id", "reply_to").agg(F.min("_id").alias("message_id"))


# What of an exported message may be kept beside its stored content.
SAFE_KEYS = [
    "id", "type", "date", "date_unixtime", "edited", "edited_unixtime", "from_id", "reply_to_message_id", "media_type",
    "mime_type", "forwarded_from", "duration_seconds", "width", "height", "actor_id", "action",
]


def raw_payload(names: list[str]) -> Column:
    """JSON of an exported message's safe columns (of those there are), with chat_id and message_id; nulls are left out. The date as
    the export writes it may stand in date_text."""
    kept = [F.col("date_text").alias("date") if c == "date" and "date_text" in names else F.col(f"`{c}`") for c in SAFE_KEYS if c in names]
    return F.to_json(F.struct(*kept, F.col("chat_id"), F.col("id").alias("message_id")))


def apply_import(messages: DataFrame, stored: DataFrame, raws: DataFrame, tombstones: DataFrame, users: DataFrame, run_id: int, resume_point: int | None = None, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows that an import adds (raws, users, messages, marks, versions), and an outcome for each message.

    messages: chat_id, place, id, type, from_id, from, text, caption, kind, entities, poll_question, contact_name, reply_to, date and columns of
    the export. stored: chat_id, message_id, raw_id. raws: raw_id, chat_id, message_id, update_id, run_id. A message meets, in this order: an
    erasure of its id, a live copy, a stored or (by its raw row) imported copy, a sender that can't be read, an erasure by content or
    user. What is left is written; offrecord messages are written blank. Senders not among users are added as imported only, channels as one.
    Every message that gets so far leaves a raw row, with a null update_id and without content; its raw_id names run and message, so
    that a run which starts over makes the same rows. All of it is joins over all messages given. cut: writes the judged messages and reads
    them back, as several tables are made of them.
    """
    left = messages if resume_point is None else messages.where(F.col("id") > resume_point)
    d = left.withColumn("user_id", export_user_id(F.col("from_id"))).withColumn("content_hash", content_hash(F.col("text"), F.col("caption"), F.col("kind"), F.col("entities")))
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    live = raws.where(F.col("update_id").isNotNull()).select("raw_id")
    live = stored.join(live, "raw_id", "left_semi")
    ids = lambda df: df.select("chat_id", F.col("message_id").alias("id"))
    before = ids(stored).unionByName(ids(raws.where("update_id is null")))
    d = d.join(mark(ids(live), ["chat_id", "id"], "_live"), ["chat_id", "id"], "left").join(mark(before, ["chat_id", "id"], "_stored"), ["chat_id", "id"], "left")
    keys = tombstone_keys(F.col("chat_id"), F.col("id"), F.col("content_hash"), F.col("user_id"))
    d = d.withColumn("_keys", F.map_from_entries(F.transform(keys, lambda x: F.struct(x["priority"], x["key"]))))
    for priority, name in ((1, "_by_id"), (2, "_by_hash"), (3, "_by_user")):
        d = d.withColumn("tombstone_key", F.try_element_at("_keys", F.lit(priority))).join(mark(tombstones, ["tombstone_key"], name), "tombstone_key", "left").drop("tombstone_key")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    alone = (
        F.when(F.col("id").isNull(), "no_id")
        .when(F.col("type") == "service", "service")
        .when(is_("_by_id"), "tombstone")
        .when(is_("_live"), "live_overlap")
        .when(is_("_stored"), "stored_duplicate")
        .when(F.col("user_id").isNull(), "no_user")
        .when(is_("_by_hash") | is_("_by_user"), "tombstone")
        .otherwise("applied")
    )
    d = d.withColumn("_alone", alone)
    earlier = F.max(F.col("_alone") == "applied").over(W.partitionBy("chat_id", "id").orderBy("place").rowsBetween(W.unboundedPreceding, -1))
    late = is_(earlier) & F.col("_alone").isin("applied", "no_user")
    d = d.withColumn("outcome", F.when(late, "stored_duplicate").otherwise(F.col("_alone")))
    if cut:
        d = cut(d.drop("_keys", "_alone"))
    new = d.where("outcome = 'applied'")
    written, marks, versions = persist(new.select("chat_id", F.col("id").alias("message_id"), "user_id", "text", "caption", "kind", "entities", "poll_question", "contact_name", "date", F.col("place").alias("arrival")))
    off = policy(F.col("text"), F.col("caption"), F.col("poll_question"), F.col("contact_name")) == "offrecord"
    raw_id = lambda message: F.concat_ws(":", F.lit("import"), F.lit(run_id), F.col("chat_id"), F.col(message)).alias("raw_id")
    raw = new.select(raw_id("id"), "chat_id", F.col("id").alias("message_id"), F.lit(None).cast("long").alias("update_id"), F.lit(run_id).alias("run_id"), raw_payload(messages.columns).alias("payload"), off.alias("is_redacted"))
    known = users.select("user_id")
    name = F.max_by("from", F.struct(F.col("from").isNotNull(), -F.col("place")))
    ghosts = new.groupBy("user_id").agg(name.alias("first_name")).join(known, "user_id", "left_anti").withColumn("imported_only", F.lit(True))
    outcomes = d.withColumn("outcome", F.when((F.col("outcome") == "applied") & off, "offrecord").otherwise(F.col("outcome"))).select("chat_id", F.col("id").alias("message_id"), "place", "outcome")
    return {"raws": raw, "users": ghosts, "messages": written.withColumn("raw_id", raw_id("message_id")), "marks": marks, "versions": versions}, outcomes


def latest_prior_run(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """For each (message_id, started_at) the newest run that had the message and began before."""
    j = messages.join(runs.select(F.col("message_id").alias("m"), F.col("run_id").alias("prior_run"), F.col("started_at").alias("prior_started")), (F.col("message_id") == F.col("m")) & (F.col("prior_started") < F.col("started_at")))
    return j.groupBy("message_id", "started_at").agg(F.max(F.struct("prior_started", "prior_run")).alias("x")).select("message_id", "started_at", "x.prior_run")


def resume_after(messages: DataFrame, last_id: int | None) -> DataFrame:
    """What is left of an import after its checkpoint."""
    return messages if last_id is None else messages.where(F.col("message_id") > last_id)


# Statuses of a run that may be continued, and those that end it.
PARTIAL, TERMINAL = ["running", "failed"], ["completed", "cancelled", "dry_run"]


def resume_decision(status: Column, resume: Column, path_status: Column) -> Column:
    """start_fresh, resume_existing or block_partial_present. status: of the newest run of this very source (null: none);
    path_status: of the newest run of the same path but another content (null: none)."""
    return (
        F.when(status.isNull(), F.when(resume & F.coalesce(path_status.isin(*PARTIAL), F.lit(False)), "block_partial_present").otherwise("start_fresh"))
        .when(~status.isin(*PARTIAL), "start_fresh")
        .when(resume, "resume_existing")
        .otherwise("block_partial_present")
    )


def decide_runs(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """sources (source_id, path, hash, resume) with mode, the run to continue and the id after which it goes on.

    runs: run_id, run_type, path, hash, status, started_at, stats (JSON).
    """
    imports = runs.where("run_type = 'import'").withColumn("_order", F.struct("started_at", "run_id"))
    same = imports.groupBy(F.col("hash").alias("_hash")).agg(*[F.max_by(c, "_order").alias(f"_{c}") for c in ("run_id", "status", "stats")])
    path = imports.groupBy(F.col("path").alias("_path")).agg(F.max_by("status", "_order").alias("_path_status"))
    d = sources.join(same, F.col("hash") == F.col("_hash"), "left").join(path, F.col("path") == F.col("_path"), "left")
    d = d.withColumn("mode", resume_decision(F.col("_status"), F.col("resume"), F.col("_path_status")))
    going = F.col("mode") == "resume_existing"
    return d.select(*sources.columns, "mode", F.when(going, F.col("_run_id")).alias("run_id"), F.when(going, checkpoint(F.col("_stats"))["last_id"]).alias("resume_point"))


def checkpoint(stats: Column) -> Column:
    """Struct of last_id, chunk, at and is_valid from a run's stats (JSON). Whole numbers alone are ids: true, "7" or 7.5 make it invalid."""
    v = F.try_parse_json(stats)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    whole = lambda name: F.coalesce(kind(name).isin("BIGINT", "VOID"), F.lit(True))
    at = utc_time(F.try_variant_get(v, "$.last_checkpoint_at", "string"))
    dated = F.try_variant_get(v, "$.last_checkpoint_at", "string").isNull() | at.isNotNull()
    valid = whole("last_processed_export_msg_id") & whole("chunk_index") & dated
    number = lambda name: F.when(whole(name), F.try_variant_get(v, f"$.{name}", "bigint"))
    return F.struct(number("last_processed_export_msg_id").alias("last_id"), F.coalesce(number("chunk_index"), F.lit(0)).alias("chunk"), at.alias("at"), valid.alias("is_valid"))


def merge_json(old: Column, patch: Column) -> Column:
    """Top-level keys of two JSON objects, the patch's first; keys in order, blanks behind commas and colons. A null or empty string is an empty
    object; what is no JSON ends the job. Nested values may be six deep."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    given = lambda c: F.coalesce(F.try_variant_get(F.parse_json(F.nullif(c, F.lit(""))), "$", "map<string,variant>"), none)
    both = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    def shown(m: Column) -> Column:
        field = lambda k: F.concat(json_string(k), F.lit(": "), canonical_json(F.try_element_at(m, k), nulls=True, spaced=True))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(m)), field), ", "), F.lit("}"))

    return let(given(old), lambda a: let(given(patch), lambda b: let(both(a, b), shown)))


def finalize_runs(runs: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """runs (run_id, status, finished_at, error) after wanted (run_id, to_status, new_error): completed, cancelled and dry runs stay as they are;
    the first end of a run keeps its time."""
    d = runs.join(wanted, "run_id", "left")
    moves = F.col("to_status").isNotNull() & ~F.col("status").isin(*TERMINAL)
    return d.withColumns(
        {
            "error": F.when(moves & F.col("new_error").isNotNull(), F.col("new_error")).otherwise(F.col("error")),
            "finished_at": F.when(moves, F.coalesce("finished_at", as_of)).otherwise(F.col("finished_at")),
            "status": F.when(moves, F.col("to_status")).otherwise(F.col("status")),
        }
    ).select(*runs.columns)


def live_run(runs: DataFrame) -> DataFrame:
    """The newest live run that is running, or no row: then one is to be made."""
    return runs.where("run_type = 'live' and status = 'running'").orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


#: Columns of runs that new_run fills.
RUN = "run_id long, run_type string, status string, path string, hash string, chat_id long, stats string, error string, started_at timestamp, finished_at timestamp"


def new_run(runs: DataFrame, run_type: str, as_of: Column, path: str | None = None, digest: str | None = None, chat_id: int | None = None) -> DataFrame:
    """A row for runs: the next number, running."""
    if run_type not in RUN_TYPES:
        raise ValueError(f"no type of run: {run_type}")
    given = {"run_type": run_type, "status": "running", "path": path, "hash": digest, "chat_id": chat_id, "stats": "{}", "error": None}
    kinds = dict(x.split() for x in RUN.split(", "))
    row = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).cast("long").alias("run_id"))
    return row.select("run_id", *[F.lit(v).cast(kinds[k]).alias(k) for k, v in given.items()], as_of.cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))


def live_run_or_new(runs: DataFrame, as_of: Column) -> tuple[int, DataFrame | None]:
    """The running live run's number, and the row to append to runs if there was none."""
    found = live_run(runs).first()
    if found is not None:
        return found["run_id"], None
    row = new_run(runs, "live", as_of)
    return row.first()["run_id"], row


# Types of runs.
RUN_TYPES = ["live", "import", "dry_run", "cancelled", "rolled_back"]


def stored_replies(new: DataFrame, messages: DataFrame, raws: DataFrame, runs: DataFrame, run_id: int) -> DataFrame:
    """new (chat_id, message_id, reply_to and others) with reply_to only where its target is stored or is new and has a smaller id.

    A target is found by its id among the messages of this run, of earlier ones and live ones (see resolve_replies), else by
    the id in its raw row (see reply_by_raw), whose message's id takes its place. messages: chat_id, message_id, raw_id. raws: raw_id,
    message_id, run_id. runs: run_id, started_at.
    """
    stored = messages.join(raws.select("raw_id", "run_id"), "raw_id", "left").join(runs.select("run_id", F.col("started_at").alias("run_started_at")), "run_id", "left")
    columns = ["chat_id", "message_id", F.col("message_id").alias("target"), "run_id", "run_started_at"]
    began = runs.where(F.col("run_id") == run_id).select("started_at").first()["started_at"]
    mine = {"run_id": F.lit(run_id).cast("long"), "started_at": F.lit(began).cast("timestamp")}
    known = stored.select(*columns).unionByName(new.withColumns({"run_id": mine["run_id"], "run_started_at": mine["started_at"]}).select(*columns))
    asked = new.where("reply_to is not null").withColumns(mine)
    ask = lambda d: d.select("chat_id", "reply_to", "run_id", "started_at").distinct()
    earlier = resolve_replies(ask(asked.where("reply_to < message_id")), known).withColumn("earlier", F.lit(True))
    later = resolve_replies(ask(asked.where("reply_to >= message_id")), stored.select(*columns)).withColumn("earlier", F.lit(False))
    found = earlier.unionByName(later)
    lost = found.where("target is null").select("chat_id", "reply_to").distinct()
    by_raw = reply_by_raw(lost, messages, raws).select("chat_id", "reply_to", F.col("message_id").alias("by_raw"))
    targets = found.join(by_raw, ["chat_id", "reply_to"], "left").select(F.col("chat_id").alias("_chat"), F.col("reply_to").alias("_reply"), F.col("earlier").alias("_earlier"), F.coalesce("target", "by_raw").alias("_target"))
    same = (F.col("chat_id") == F.col("_chat")) & (F.col("reply_to") == F.col("_reply")) & ((F.col("reply_to") < F.col("message_id")) == F.col("_earlier"))
    return new.join(targets, same, "left").withColumn("reply_to", F.col("_target")).select(*new.columns)


# Names of secrets.
SECRET = r"(?i)(token|secret|password|passphrase|api[_-]?key)"


def secret_keys(config: Column) -> Column:
    """Top-level keys of a JSON object whose names look like secrets; such a configuration must not be stored."""
    return F.filter(F.coalesce(F.json_object_keys(config), F.array().cast("array<string>")), lambda k: F.regexp_like(k, F.lit(SECRET)))


def rollback(tables: dict[str, DataFrame], run_id: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables (raws, messages, versions, and marks if given) without what a run has imported, and its counts. Live rows have no
    run and stay."""
    gone_raws = tables["raws"].where((F.col("run_id") == run_id) & F.col("update_id").isNull()).select("raw_id")
    gone = tables["messages"].join(gone_raws, "raw_id", "left_semi").select("chat_id", "message_id")
    after = {"raws": tables["raws"].join(gone_raws, "raw_id", "left_anti")}
    for name in ("messages", "versions", "marks"):
        if name in tables:
            after[name] = tables[name].join(gone, ["chat_id", "message_id"], "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    gone_versions = tables["versions"].join(gone, ["chat_id", "message_id"], "left_semi")
    return after, count(gone_raws, "raws").crossJoin(count(gone, "messages")).crossJoin(count(gone_versions, "versions"))


def rollback_once(tables: dict[str, DataFrame], runs: DataFrame, run_id: int, as_of: Column) -> tuple[dict[str, DataFrame], DataFrame, dict]:
    """rollback with its audit: tables, runs with a new row of type rolled_back, and the report (counts and whether it was done before).

    A run that isn't there raises LookupError, one that is no import ValueError. If an audit row names the run, nothing changes
    and its counts are reported. runs: run_id, run_type, status, stats (JSON), started_at, finished_at.
    """
    kind = runs.where(F.col("run_id") == run_id).select("run_type").first()
    if kind is None:
        raise LookupError(f"no run {run_id}")
    if kind[0] != "import":
        raise ValueError(f"run {run_id} is of type {kind[0]}, only imports are rolled back")
    names = ["raws", "messages", "versions"]
    stat = lambda name: F.get_json_object("stats", f"$.{name}")
    audit = runs.where((F.col("run_type") == "rolled_back") & (stat("original_run_id") == str(run_id))).orderBy("run_id").select("stats", *[stat(n).try_cast("long").alias(n) for n in names]).first()
    if audit is not None:
        if any(audit[n] is None for n in names):
            raise RuntimeError(f"the audit of run {run_id} has no counts")
        return tables, runs, {n: audit[n] for n in names} | {"done_before": True}
    after, counts = rollback(tables, run_id)
    found = counts.first()
    report = {n: found[n] for n in names}
    stats = F.to_json(F.struct(F.lit(run_id).alias("original_run_id"), *[F.lit(report[n]).alias(n) for n in names]))
    row = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id")).select(
        "run_id", F.lit("rolled_back").alias("run_type"), F.lit("completed").alias("status"), stats.alias("stats"), as_of.alias("started_at"), as_of.alias("finished_at")
    )
    return after, runs.unionByName(row, allowMissingColumns=True), report | {"done_before": False}


def updates_once(updates: DataFrame, stored: DataFrame) -> DataFrame:
    """Updates that aren't stored, one per id; updates without an id all stay."""
    known = updates.where(F.col("update_id").isNotNull()).dropDuplicates(["update_id"]).join(stored.select("update_id"), "update_id", "left_anti")
    return known.unionByName(updates.where(F.col("update_id").isNull()).select(*known.columns))
