"""Message versions: idempotent inserts, the sticky policy ratchet, backfill and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import content_hash, has_marker, policy, policy_audit

KEY = ["chat_id", "message_id"]


#: Policies that stay once a message has them.
STICKY = ["offrecord", "forgotten"]


def upsert_messages(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing (chat_id, message_id, memory_policy, is_redacted and any other columns) and incoming (these and arrival).

    A known message changes in two columns alone, in the order of arrival: its policy becomes the incoming one unless it is
    offrecord or forgotten, which stay (a null leaves it), and redaction once set stays. Of a new message the first arrival
    gives all other columns. The fold needs only its first sticky and its last policy, so one aggregate does it.
    """
    rows = existing.withColumn("arrival", F.lit(-1).cast("long")).unionByName(incoming.withColumn("arrival", F.col("arrival").cast("long")))
    others = [c for c in existing.columns if c not in (*KEY, "memory_policy", "is_redacted")]
    when = lambda c: F.when(c, F.col("arrival"))
    folded = rows.groupBy(*KEY).agg(
        F.min_by(F.struct(*others) if others else F.lit(None), "arrival").alias("_first"),
        F.min_by("memory_policy", when(F.col("memory_policy").isin(*STICKY))).alias("_sticky"),
        F.max_by("memory_policy", when(F.col("memory_policy").isNotNull())).alias("_last"),
        F.coalesce(F.max("is_redacted"), F.lit(False)).alias("is_redacted"),
    )
    picked = {c: F.col(f"_first.{c}") for c in others} | {"memory_policy": F.coalesce("_sticky", "_last"), "is_redacted": F.col("is_redacted")}
    return folded.select(*KEY, *[x.alias(c) for c, x in picked.items()]).select(*existing.columns)


def persist(incoming: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows for messages, marks and first versions from new messages, whatever their source.

    incoming: chat_id, message_id, user_id, text, caption, kind, entities, poll_question, contact_name, date, arrival. A message marked
    offrecord is stored without its content, and its version's hash is that of an empty message of its kind, so that nothing tells what it
    said. Any mark leaves a row that names it. What is stored before is not looked at: give the rows to upsert_messages,
    first_writer_wins (marks) and append_versions.
    """
    audit = policy_audit(text=F.col("text"), caption=F.col("caption"), poll_question=F.col("poll_question"), contact_name=F.col("contact_name"))
    d = incoming.withColumn("_audit", audit).withColumn("memory_policy", F.col("_audit.policy")).withColumn("is_redacted", F.col("memory_policy") == "offrecord")
    d = d.withColumns({c: F.when(~F.col("is_redacted"), F.col(c)) for c in ("text", "caption", "entities")})
    digest = content_hash(F.col("text"), F.col("caption"), F.col("kind"), F.col("entities"))
    messages = d.select(*KEY, "user_id", "text", "caption", "kind", "date", "memory_policy", "is_redacted", digest.alias("content_hash"), "arrival")
    marks = d.where("memory_policy <> 'normal'").select(*KEY, F.col("memory_policy").alias("mark_type"), F.col("_audit.detected_by").alias("detected_by"), F.col("user_id").alias("set_by"), "arrival")
    versions = d.select(*KEY, digest.alias("content_hash"), "text", "caption", "is_redacted", "arrival")
    return messages, marks, versions


def append_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing (chat_id, message_id, version_seq, content_hash) with new contents numbered on from the last version.

    A content that a message already has makes no version; of equal incoming ones the first arrival counts.
    """
    first = incoming.groupBy(*KEY, "content_hash").agg(F.min("arrival").alias("arrival"))
    new = first.join(existing.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")
    last = existing.groupBy(*KEY).agg(F.max("version_seq").alias("last"))
    seq = F.coalesce("last", F.lit(0)) + F.row_number().over(W.partitionBy(*KEY).orderBy("arrival", "content_hash"))
    numbered = new.join(last, KEY, "left").withColumn("version_seq", seq.cast("long"))
    return existing.select(*KEY, "version_seq", "content_hash").unionByName(numbered.select(*KEY, "version_seq", "content_hash"))


def current_versions(messages: DataFrame, versions: DataFrame) -> DataFrame:
    """Messages (with current_version) joined with that version alone: its other columns, is_redacted as version_redacted."""
    v = versions.withColumnRenamed("version_seq", "current_version")
    if "is_redacted" in v.columns:
        v = v.withColumnRenamed("is_redacted", "version_redacted")
    taken = [c for c in v.columns if c in messages.columns and c not in (*KEY, "current_version")]
    return messages.drop(*taken).join(v, [*KEY, "current_version"])


def backfill_first_versions(messages: DataFrame) -> DataFrame:
    """Version 1 of every message that has none, captured at the message's own date."""
    missing = messages.where(F.col("current_version").isNull())
    digest = content_hash(F.col("text"), F.col("caption"), F.col("kind"))
    return missing.select(*KEY, F.lit(1).cast("long").alias("version_seq"), digest.alias("content_hash"), F.col("date").alias("captured_at"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def fold_edits(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """messages (chat_id, message_id, text, memory_policy) after edits (chat_id, message_id, seq, text) in order of seq.

    A marker for offrecord, once in any edit or the original, blanks the text and stays for good, and so does a forgotten message;
    otherwise text and policy are those of the last edit. Edits of unknown messages are left out (see unknown_edits). The policy is a maximum
    and the text the last one, so the fold needs no state that runs along the edits.
    """
    last = edits.groupBy(*KEY).agg(
        F.max_by("text", "seq").alias("_text"), F.max(has_marker(F.col("text"), "#offrecord")).alias("_off"), F.max_by(has_marker(F.col("text"), "#nomem"), "seq").alias("_nomem")
    )
    d = messages.join(last, KEY, "left")
    gone = F.col("memory_policy") == "forgotten"
    off = (F.col("memory_policy") == "offrecord") | (~gone & F.coalesce("_off", F.lit(False)))
    edited = F.col("_nomem").isNotNull()
    policy = F.when(gone, "forgotten").when(off, "offrecord").when(edited, F.when(F.col("_nomem"), "nomem").otherwise("normal")).otherwise(F.col("memory_policy"))
    return d.select(*KEY, F.when(~off & ~gone, F.when(edited, F.col("_text")).otherwise(F.col("text"))).alias("text"), policy.alias("memory_policy"))


def unknown_edits(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits that came before their message, or without it."""
    return edits.join(messages.select(*KEY), KEY, "left_anti")


def edit_versions(messages: DataFrame, versions: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """versions (chat_id, message_id, version_seq, content_hash, text, is_redacted) after edits (chat_id, message_id, seq, text, kind,
    entities), and marks for messages that edits made offrecord or nomem.

    From the first offrecord edit on (or if the message was offrecord) every version of a message is blank; hashes of earlier versions stay,
    that of a blank edit is the one of an empty message, so it adds one version at most. An edit to content that a message has had
    before adds none.
    """
    key = [F.col(c) for c in KEY]
    d = edits.join(messages.select(*KEY, F.col("memory_policy").alias("_policy")), KEY)
    w = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    off = (F.col("_policy") == "offrecord") | F.max(has_marker(F.col("text"), "#offrecord")).over(w)
    d = d.withColumn("is_redacted", off).withColumn("text", F.when(~off, F.col("text"))).withColumn("entities", F.when(~off, F.col("entities")))
    new = d.select(*KEY, content_hash(F.col("text"), F.lit(None).cast("string"), F.col("kind"), F.col("entities")).alias("content_hash"), "text", "is_redacted", F.col("seq").alias("arrival"))
    ever = d.groupBy(*KEY).agg(F.max("is_redacted").alias("_off"))
    blank = versions.join(ever, KEY, "left").withColumn("_off", F.coalesce("_off", F.lit(False)))
    blank = blank.withColumn("text", F.when(~F.col("_off"), F.col("text"))).withColumn("is_redacted", F.col("is_redacted") | F.col("_off")).drop("_off")
    numbered = append_versions(blank.select(*KEY, "version_seq", "content_hash"), new)
    contents = new.groupBy(*KEY, "content_hash").agg(F.min_by("text", "arrival").alias("text"), F.min_by("is_redacted", "arrival").alias("is_redacted"))
    added = numbered.join(blank.select(*KEY, "version_seq"), [*KEY, "version_seq"], "left_anti").join(contents, [*KEY, "content_hash"]).join(ever, KEY, "left")
    added = added.withColumn("text", F.when(~F.col("_off"), F.col("text"))).withColumn("is_redacted", F.col("is_redacted") | F.col("_off"))
    marked = edits.join(messages.select(*KEY, F.col("memory_policy").alias("_policy")).where(~F.col("memory_policy").isin(*STICKY)), KEY).withColumn("mark_type", policy(F.col("text"))).where("mark_type <> 'normal'")
    return blank.unionByName(added.select(*blank.columns)), marked.select(*KEY, "mark_type").distinct()
