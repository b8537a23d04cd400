"""Privacy rules: what may be shown, what has been erased, and how erasure works through the archive."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from parlance.functions.text import tombstone_keys


def visible(messages: DataFrame, chat_id: int | None = None) -> DataFrame:
    """Rows that may be shown: normal policy, nothing redacted (neither the message nor its version), and of the chat if one is
    given."""
    kept = messages.where((F.col("memory_policy") == "normal") & ~F.col("is_redacted"))
    if "version_redacted" in messages.columns:
        kept = kept.where(~F.col("version_redacted"))
    return kept if chat_id is None else kept.where(F.col("chat_id") == chat_id)


# Statuses of an erasure that hides messages from search; imports are blocked by any status.
ACTIVE = ["pending", "processing", "completed"]
#: What an erasure's keys are made of, so rows that agree in them are erased together.
IDENTITY = ["chat_id", "message_id", "content_hash", "user_id"]


def _keys(messages: DataFrame, row: list[str]) -> DataFrame:
    keys = tombstone_keys(F.col("chat_id"), F.col("message_id"), F.col("content_hash"), F.col("user_id"))
    return messages.select(*row, F.inline(keys))


def without_tombstones(messages: DataFrame, tombstones: DataFrame, statuses: list[str] | None = None) -> DataFrame:
    """Anti-join on any of three keys, against tombstones of any status or of those given.

    Written as an equi-join per exploded key: the disjunction itself would be planned as a nested loop. Rows are told apart
    by all parts of the keys, nulls included, so a row without an id is hidden by its user's or content's key alone.
    """
    named = tombstones if statuses is None else tombstones.where(F.col("status").isin(*statuses))
    hit = _keys(messages, IDENTITY).join(named.select(F.col("tombstone_key").alias("key")), "key", "left_semi").select(*[F.col(c).alias(f"_{c}") for c in IDENTITY]).distinct()
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return messages.join(hit, same, "left_anti")


def tombstone_priority(messages: DataFrame, tombstones: DataFrame) -> DataFrame:
    """chat_id, message_id and the key that erases them: by message before by content before by user."""
    hit = _keys(messages, ["chat_id", "message_id"]).join(tombstones.select(F.col("tombstone_key").alias("key")).distinct(), "key")
    return hit.groupBy("chat_id", "message_id").agg(F.min_by("key", "priority").alias("tombstone_key"), F.min("priority").alias("priority"))


def redact(rows: DataFrame, targets: DataFrame, on: list[str], blank: list[str], policy: str | None = None) -> DataFrame:
    """Blank the columns of rows that targets name; content_hash is never among them."""
    marked = rows.join(targets.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    hit = F.coalesce("_hit", F.lit(False))
    changes = {c: F.when(~hit, F.col(c)) for c in blank} | {"is_redacted": F.col("is_redacted") | hit}
    if policy:
        changes["memory_policy"] = F.when(hit, F.lit(policy)).otherwise(F.col("memory_policy"))
    return marked.withColumns(changes).drop("_hit").select(*rows.columns)


def redact_traces(traces: DataFrame, hit: DataFrame, events: DataFrame) -> DataFrame:
    """Blank what erased users have asked; rows stay for the audit, and those redacted before aren't touched."""
    users = events.where("target_type = 'user'").select(F.col("target_id").try_cast("long").alias("_u")).where("_u is not null").distinct()
    d = traces.join(users, F.col("user_id") == F.col("_u"), "left")
    now = F.col("_u").isNotNull() & ~F.col("query_redacted")
    return d.withColumns({"query_text": F.when(~now, F.col("query_text")), "query_redacted": F.col("query_redacted") | now}).select(*traces.columns)


Layer = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
#: Layers of the cascade, in order: table, and what erasures do to it (table, messages hit, events). Those without a function
#: have no table yet and are skipped.
LAYERS: dict[str, Layer | None] = {
    "messages": lambda t, hit, events: redact(t, hit, ["chat_id", "message_id"], ["text", "caption", "raw_json"], "forgotten"),
    "versions": lambda t, hit, events: redact(t, hit, ["chat_id", "message_id"], ["text", "caption", "normalized_text", "entities"]),
    "entities": None,
    "links": None,
    "attachments": None,
    "search_rows": None,
    "traces": redact_traces,
}
#: Layers that apply to erasures of a user alone, and targets that no layer supports.
USER_LAYERS, UNSUPPORTED = ["traces"], ["message_hash", "export"]


def layer_state(layer: str, target_type: Column) -> Column:
    """What a layer records for a supported or unsupported target."""
    done = F.struct(F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"))
    skipped = lambda reason: F.struct(F.lit("skipped").alias("status"), F.lit(reason).alias("reason"))
    out = F.when(target_type.isin(*UNSUPPORTED), skipped("target_type_not_supported_yet"))
    if LAYERS[layer] is None:
        return out.otherwise(skipped("table_not_exists"))
    if layer in USER_LAYERS:
        out = out.when(target_type != "user", F.struct(F.lit("completed").alias("status"), F.lit("not_applicable").alias("reason")))
    return out.otherwise(done)


def forget_cascade(tables: dict[str, DataFrame], events: DataFrame, limit: int = 10) -> tuple[dict[str, DataFrame], DataFrame]:
    """One tick: the oldest pending events, applied to every layer; new tables, and events with their new status, cascade (layer to
    status and reason) and error.

    An event whose target is no whole number fails and applies to nothing; those by content or export complete with all layers skipped.
    Layers that an event's cascade (if it has that column, a map) names as completed are kept as recorded. Applying an event
    twice changes nothing, so a tick that is run again after a failure is safe.
    """
    due = events.where("status = 'pending'").orderBy("created_at", "id").limit(limit)
    fine = F.col("target_type").isin(*UNSUPPORTED) | F.col("target_id").try_cast("long").isNotNull() if "target_id" in events.columns else F.lit(True)
    applies = due.where(fine & F.col("target_type").isin("message", "user"))
    messages = tables["messages"]
    keys = _keys(messages, ["chat_id", "message_id"]).where("priority <> 2").join(applies.select(F.col("tombstone_key").alias("key")), "key", "left_semi")
    hit = keys.select("chat_id", "message_id").distinct()
    after = {name: LAYERS[name](t, hit, applies) if LAYERS.get(name) else t for name, t in tables.items()}
    state = F.map_from_arrays(F.array(*map(F.lit, LAYERS)), F.array(*[layer_state(x, F.col("target_type")) for x in LAYERS]))
    if "cascade" in events.columns:
        before = F.map_filter(F.coalesce("cascade", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<status:string,reason:string>>"))), lambda k, v: v["status"] == "completed")
        state = F.map_concat(before, F.map_filter(state, lambda k, v: ~F.map_contains_key(before, k)))
    ticked = due.select("id", fine.alias("_fine"), F.when(fine, state).alias("_state"))
    d = events.drop("cascade").join(ticked, "id", "left") if "cascade" not in events.columns else events.withColumnRenamed("cascade", "_old").join(ticked, "id", "left")
    kept = F.col("_old") if "cascade" in events.columns else F.lit(None)
    d = d.withColumn("status", F.when(F.col("_fine"), "completed").when(~F.col("_fine"), "failed").otherwise(F.col("status")))
    d = d.withColumn("cascade", F.coalesce("_state", kept)).withColumn("error", F.when(~F.col("_fine"), "target_id must be a whole number"))
    return after, d.drop("_fine", "_state", "_old")


def run_cascade(log, limit: int = 10, layers: dict[str, Layer | None] | None = None) -> dict:
    """One tick over a table log (see sources.tablelog) with tombstones (id, tombstone_key, target_type, target_id, status, created_at, cascade,
    error) and the layers' tables: the ids that were claimed, and those that failed with their error.

    The oldest pending events go to processing in one commit, so of two ticks at once only one claims an event. Then each layer's change
    and what it records in the events are one commit; a layer that raises is recorded as failed, with its error, and the
    others go on. At the end events go to completed, or to failed if a layer has. Layers that an event names as completed are not
    applied again. A layer whose table is not in the log is skipped.
    """
    layers = LAYERS if layers is None else layers

    def claim(tables):
        events = tables["tombstones"]
        due = [r["id"] for r in events.where("status = 'pending'").orderBy("created_at", "id").limit(limit).collect()]
        taken = events.withColumn("status", F.when(F.col("id").isin(*due), "processing").otherwise(F.col("status")))
        return ({"tombstones": taken} if due else {}), {}, due

    ids = log.change(claim, {"job": "forget", "step": "claim"})
    if not ids:
        return {"claimed": [], "failed": {}}
    mine = F.col("id").isin(*ids) & (F.col("status") == "processing")
    fine = F.col("target_type").isin(*UNSUPPORTED) | F.col("target_id").try_cast("long").isNotNull()
    done = lambda name: F.coalesce(F.try_element_at("cascade", F.lit(name))["status"] == "completed", F.lit(False))

    def recorded(events, name, state):
        old = F.coalesce("cascade", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<struct<status:string,reason:string>>")))
        new = F.map_concat(F.map_filter(old, lambda k, v: k != name), F.create_map(F.lit(name), state))
        return events.withColumn("cascade", F.when(mine & fine & ~done(name), new).otherwise(F.col("cascade")))

    errors = {}
    for name, layer in layers.items():
        skipped = F.struct(F.lit("skipped").alias("status"), F.lit("table_not_exists").alias("reason"))

        def step(tables, name=name, layer=layer, skipped=skipped):
            events = tables["tombstones"]
            here = layer is not None and name in tables
            applies = events.where(mine & fine & ~done(name) & F.col("target_type").isin("message", "user"))
            changed = {}
            if here and not applies.isEmpty():
                keys = _keys(tables["messages"], ["chat_id", "message_id"]).where("priority <> 2").join(applies.select(F.col("tombstone_key").alias("key")), "key", "left_semi")
                changed = {name: layer(tables[name], keys.select("chat_id", "message_id").distinct(), applies)}
            state = layer_state(name, F.col("target_type")) if here else F.when(F.col("target_type").isin(*UNSUPPORTED), layer_state(name, F.col("target_type"))).otherwise(skipped)
            return {"tombstones": recorded(events, name, state), **changed}, {}, None

        try:
            log.change(step, {"job": "forget", "layer": name})
        except Exception as e:
            errors[name] = type(e).__name__
            failed = F.struct(F.lit("failed").alias("status"), F.lit(errors[name]).alias("reason"))
            log.change(lambda tables, name=name, failed=failed: ({"tombstones": recorded(tables["tombstones"], name, failed)}, {}, None), {"job": "forget", "layer": name})

    def end(tables):
        wrong = F.array_join(F.map_keys(F.map_filter(F.col("cascade"), lambda k, v: v["status"] == "failed")), ", ")
        error = F.when(~fine, "target_id must be a whole number").when(wrong != "", F.concat(F.lit("failed layers: "), wrong))
        d = tables["tombstones"].withColumn("_error", F.when(mine, error))
        d = d.withColumn("error", F.when(mine, F.col("_error")).otherwise(F.col("error")))
        ended = log.stage(d.withColumn("status", F.when(mine & F.col("_error").isNotNull(), "failed").when(mine, "completed").otherwise(F.col("status"))).drop("_error"))
        bad = ended.where(F.col("id").isin(*ids) & (F.col("status") == "failed")).select("id", "error").collect()
        return {"tombstones": ended}, {}, {r["id"]: r["error"] for r in bad}

    return {"claimed": ids, "failed": log.change(end, {"job": "forget", "step": "end"})}


def cascade_tick(tables: dict[str, DataFrame], events: DataFrame, flags: DataFrame, limit: int = 10, flag: str = "memory.forget.cascade_worker.enabled") -> tuple[dict[str, DataFrame], DataFrame]:
    """forget_cascade if the flag (of no scope) is on; else nothing changes. The flag is read once, on the driver."""
    on = flags.where((F.col("key") == flag) & F.col("scope_type").isNull() & F.col("scope_id").isNull() & F.col("enabled")).limit(1).count()
    return forget_cascade(tables, events, limit) if on else (tables, events)


def checkpoint_layer(events: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events (id, status, cascade: a map from layer to status) after done (id, layer, state), and those rows of done whose event isn't in processing."""
    known = done.join(events.select("id", "status"), "id", "left")
    good = F.coalesce(F.col("status") == "processing", F.lit(False))
    new = known.where(good).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("layer", "state"))).alias("_new"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    d = events.join(new, "id", "left")
    old, more = F.coalesce("cascade", none), F.coalesce("_new", none)
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(more, k)), more)
    return d.withColumn("cascade", F.when(F.col("_new").isNotNull(), merged).otherwise(F.col("cascade"))).drop("_new"), known.where(~good).select(*done.columns)


def forget_requests(requests: DataFrame, users: DataFrame, messages: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending erasures from requests (requester, chat_id and message_id of a message, both null: all that is the requester's;
    place), and each request with its outcome.

    An unknown requester or message, and one who is neither author nor admin, give nothing. existing: tombstone_key. Of
    requests with one key the first by place counts; a key that exists is left as it is.
    """
    u = users.select(F.col("user_id").alias("_id"), "is_admin")
    m = messages.select(F.col("chat_id").alias("_chat"), F.col("message_id").alias("_message"), F.col("user_id").alias("_author"))
    d = requests.join(u, F.col("requester") == F.col("_id"), "left").join(m, (F.col("chat_id") == F.col("_chat")) & (F.col("message_id") == F.col("_message")), "left")
    own = F.col("message_id").isNull()
    author = F.coalesce(F.col("_author") == F.col("requester"), F.lit(False))
    outcome = (
        F.when(F.col("_id").isNull(), "unknown_user").when(own, "accepted").when(F.col("_message").isNull(), "unknown_message").when(author | F.coalesce("is_admin", F.lit(False)), "accepted").otherwise("denied")
    )
    key = F.when(own, F.concat(F.lit("user:"), F.col("requester").cast("string"))).otherwise(F.concat(F.lit("message:"), F.col("chat_id").cast("string"), F.lit(":"), F.col("message_id").cast("string")))
    judged = d.withColumn("outcome", outcome)
    new = judged.where("outcome = 'accepted'").select(
        key.alias("tombstone_key"),
        F.when(own, "user").otherwise("message").alias("target_type"),
        F.when(own | author, "self").otherwise("admin").alias("authorized_by"),
        F.lit("pending").alias("status"),
        F.col("requester").alias("actor"),
        "place",
    )
    return first_writer_wins(existing.select("tombstone_key"), new, ["tombstone_key"], ["place"], only_new=True), judged.select(*requests.columns, "outcome")


# Event fields of a raw update, what is dropped from a message in them, and messages inside a message.
EVENT_FIELDS = ["message", "edited_message", "channel_post", "edited_channel_post"]
CONTENT_FIELDS = ["text", "caption", "entities", "caption_entities"]
NESTED_FIELDS = ["reply_to_message", "pinned_message", "external_reply", "quote"]


def _without_content(message: dict) -> dict:
    kept = {k: v for k, v in message.items() if k not in CONTENT_FIELDS}
    return kept | {k: _without_content(kept[k]) for k in NESTED_FIELDS if isinstance(kept.get(k), dict)}


@F.pandas_udf(StringType())
def scrub_update(payload: pd.Series) -> pd.Series:
    """A raw update's JSON without the content of its messages, however deep they are nested. Null stays null; what is no JSON object
    becomes null, as nothing is known about what it holds."""

    def scrub(raw: str | None) -> str | None:
        try:
            update = json.loads(raw) if raw is not None else None
        except ValueError:
            return None
        if not isinstance(update, dict):
            return None
        return json.dumps(update | {k: _without_content(update[k]) for k in EVENT_FIELDS if isinstance(update.get(k), dict)}, ensure_ascii=False)

    return payload.map(scrub)


# Transitions that a forget event may make.
TRANSITIONS = [("pending", "processing"), ("processing", "completed"), ("processing", "failed")]


def apply_transitions(events: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events (id, status) after wanted (id, to_status), and the wanted rows that are not allowed."""
    both = wanted.join(events.select("id", "status"), "id", "left")
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("status") == a) & (F.col("to_status") == b))
    good = both.where(allowed).select("id", "to_status")
    after = events.join(good, "id", "left").withColumn("status", F.coalesce("to_status", "status")).drop("to_status")
    return after, both.where(~F.coalesce(allowed, F.lit(False)))


def first_writer_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], only_new: bool = False) -> DataFrame:
    """existing and those incoming rows whose key is new (or these alone); of several with one key the first in order."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    new = incoming.withColumn("_n", n).where("_n = 1").drop("_n").join(existing.select(*keys), keys, "left_anti")
    return new if only_new else existing.unionByName(new)


def last_writer_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing, with rows of a key replaced by the last incoming one."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    new = incoming.withColumn("_n", n).where("_n = 1").drop("_n")
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def flag_enabled(flags: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, scope_type, scope_id) with enabled: null scopes match null scopes only, a missing flag is off."""
    f = flags.select(*[F.col(c).alias(f"f_{c}") for c in ("key", "scope_type", "scope_id")], "enabled")
    match = (F.col("key") == F.col("f_key")) & F.col("scope_type").eqNullSafe(F.col("f_scope_type")) & F.col("scope_id").eqNullSafe(F.col("f_scope_id"))
    joined = wanted.join(f, match, "left")
    return joined.groupBy("key", "scope_type", "scope_id").agg(F.coalesce(F.max("enabled"), F.lit(False)).alias("enabled"))


def set_flags(flags: DataFrame, changes: DataFrame) -> DataFrame:
    """flags (key, scope_type, scope_id, enabled) after changes (these and place): the last change of a key and scope counts; null scopes
    match null scopes."""
    scope = ["key", "scope_type", "scope_id"]
    rows = flags.select(*scope, "enabled", F.lit(-1).cast("long").alias("place")).unionByName(changes.select(*scope, "enabled", F.col("place").cast("long").alias("place")))
    return rows.groupBy(*scope).agg(F.max_by("enabled", "place").alias("enabled"))


def may_ask(user: Column, is_member: Column, is_admin: Column) -> Column:
    """Whether a known user is a member or an admin."""
    return user.isNotNull() & (F.coalesce(is_member, F.lit(False)) | F.coalesce(is_admin, F.lit(False)))
