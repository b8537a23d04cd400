"""Live updates into messages, versions and marks, by keyed state; and, apart from that, into the raw archive.

The state of a message (its policy, the hashes it has had, its last version) is kept by Spark under the query's checkpoint, so a batch
reads and writes what its own events need: new rows of states, versions, marks, late edits and redactions are appended to a
table log, all of a batch in one commit with the batch's number (ledger). A batch that runs again finds its number and adds
nothing. Readers see the newest state of each message (current_messages) and its versions without what was made offrecord later
(stored_versions); compact_live folds both in.

The raw archive is another query over the same updates with a checkpoint of its own (archive_stream): neither waits for the other
nor fails with it, and each goes on from where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.functions.text import contact_name, content_hash, live_kind, merge_entities, policy
from parlance.operators.ingest import RUN, live_run_or_new
from parlance.sources.tablelog import TableLog
from parlance.streaming.updates import UPDATE, archive_stream

KEY = ["chat_id", "message_id"]
TABLES = {
    "states": "chat_id long, message_id long, seq long, user_id long, raw_id string, kind string, text string, memory_policy string, is_redacted boolean, current_version long, run_id long",
    "live_versions": "chat_id long, message_id long, version_seq long, content_hash string, text string, is_redacted boolean, seq long",
    "live_marks": "chat_id long, message_id long, mark_type string, seq long",
    "late_edits": "chat_id long, message_id long, seq long, text string",
    "redactions": "chat_id long, message_id long, seq long",
    "ledger": "sink string, batch long",
    "runs": RUN,
}
_OUT = "row string, chat_id long, message_id long, seq long, user_id long, kind string, text string, memory_policy string, is_redacted boolean, version_seq long, content_hash string, mark_type string"
_STATE = "off boolean, hashes array<string>, marks array<string>, user_id long"


def live_events(updates: DataFrame, community: int) -> DataFrame:
    """New and edited messages of the community's chat with a known sender, from raw updates: keys, seq (the update's id), is_edit, user_id, text (or
    caption), kind, memory_policy by its own parts, and the hashes of the message as it is and without its content.

    Updates without an id, of other chats and without message or sender give nothing.
    """
    event = F.coalesce(F.get_json_object("payload", "$.message"), F.get_json_object("payload", "$.edited_message"))
    is_edit = F.get_json_object("payload", "$.message").isNull()
    d = updates.where("update_id is not null").select(F.col("update_id").alias("seq"), event.alias("m"), is_edit.alias("is_edit"))
    at = lambda p, kind="string": F.get_json_object("m", f"$.{p}").try_cast(kind)
    listed = lambda p: F.from_json(F.get_json_object("m", f"$.{p}"), "array<variant>")
    kind, none = live_kind(F.col("m")), F.lit(None).cast("string")
    marked = policy(at("text"), at("caption"), at("poll.question"), contact_name(at("contact.first_name"), at("contact.last_name")))
    return d.where((at("chat.id", "long") == community) & at("message_id", "long").isNotNull() & at("from.id", "long").isNotNull()).select(
        at("chat.id", "long").alias("chat_id"),
        at("message_id", "long").alias("message_id"),
        "seq",
        "is_edit",
        at("from.id", "long").alias("user_id"),
        F.coalesce(at("text"), at("caption")).alias("text"),
        kind.alias("kind"),
        marked.alias("memory_policy"),
        content_hash(at("text"), at("caption"), kind, merge_entities(listed("entities"), listed("caption_entities"))).alias("open_hash"),
        content_hash(none, none, kind).alias("blank_hash"),
    )


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A message's events of a batch, by seq, onto its state."""
    known = state.exists
    off, hashes, marks, user = state.get if known else (False, [], [], None)
    hashes, marks, rows = list(hashes or []), list(marks or []), []
    events = pd.concat(list(frames)).sort_values("seq", kind="stable").drop_duplicates("seq")  # of one message
    for e in events.itertuples(index=False):
        row = dict(chat_id=key[0], message_id=key[1], seq=e.seq)
        if not known and e.is_edit:
            rows.append(row | dict(row="late", text=e.text))
            continue
        if known and not e.is_edit:
            # A message that is delivered again may become stricter, nothing else.
            if e.memory_policy != "offrecord" or off:
                continue
        user = user if known else e.user_id
        known = True
        if e.memory_policy != "normal" and not off and e.memory_policy not in marks:
            marks.append(e.memory_policy)
            rows.append(row | dict(row="mark", mark_type=e.memory_policy))
        if e.memory_policy == "offrecord" and not off:
            off = True
            if hashes:
                rows.append(row | dict(row="redaction"))
        digest, text = (e.blank_hash, None) if off else (e.open_hash, e.text)
        if digest not in hashes:
            hashes.append(digest)
            rows.append(row | dict(row="version", version_seq=len(hashes), content_hash=digest, text=text, is_redacted=off))
        rows.append(row | dict(row="state", user_id=user, kind=e.kind, text=text, is_redacted=off, memory_policy="offrecord" if off else e.memory_policy, version_seq=hashes.index(digest) + 1))
    if known:
        state.update((off, hashes, marks, user))
    names = [x.split()[0] for x in _OUT.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    for c in ("seq", "user_id", "version_seq", "chat_id", "message_id"):
        out[c] = out[c].astype("Int64")
    out["is_redacted"] = out["is_redacted"].astype("boolean")
    yield out


def open_live(spark: SparkSession, folder: str) -> tuple[TableLog, int]:
    """The folder's table log with all tables of the stream, and the number of its live run, which is made if none is running."""
    log = TableLog(spark, folder)
    log.change(lambda t: ({n: spark.createDataFrame([], s) for n, s in TABLES.items() if n not in t}, {}, None), {"live": "open"})

    def run(tables):
        number, row = live_run_or_new(tables["runs"], F.current_timestamp())
        return {}, {} if row is None else {"runs": row}, number

    return log, log.change(run, {"live": "run"})


def store_batch(log: TableLog, out: DataFrame, batch_id: int, run: int, sink: str = "messages") -> None:
    """A batch's rows and its number in one commit; nothing if the number is there."""
    rows = out.persist()
    rows.count()  # states must be written for all of a batch, also of one whose rows are there

    def make(tables):
        done = tables["ledger"].where(F.col("sink") == sink).agg(F.max("batch")).first()[0]
        if done is not None and done >= batch_id:
            return {}, {}, None
        of = lambda row, table, **more: rows.where(F.col("row") == row).withColumns(more).select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in TABLES[table].split(", ")])
        raw_id = F.concat(F.lit("update:"), F.col("seq").cast("string"))
        add = {
            "states": of("state", "states", current_version=F.col("version_seq"), run_id=F.lit(run), raw_id=raw_id),
            "live_versions": of("version", "live_versions"),
            "live_marks": of("mark", "live_marks"),
            "late_edits": of("late", "late_edits"),
            "redactions": of("redaction", "redactions"),
        }
        ledger = tables["ledger"].where(F.col("sink") != sink).unionByName(log.spark.createDataFrame([(sink, batch_id)], TABLES["ledger"]))
        return {"ledger": ledger}, add, None

    try:
        log.change(make, {"live": sink, "batch": batch_id})
    finally:
        rows.unpersist()


def message_stream(spark: SparkSession, source: str, folder: str, checkpoint: str, community: int) -> StreamingQuery:
    """New and edited messages from JSON files of updates in source into the folder's table log."""
    log, run = open_live(spark, folder)
    events = live_events(spark.readStream.schema(UPDATE).json(source), community)
    folded = events.groupBy(*KEY).applyInPandasWithState(_fold, _OUT, _STATE, "update", "NoTimeout")
    return folded.writeStream.outputMode("update").foreachBatch(lambda out, n: store_batch(log, out, n, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_streams(spark: SparkSession, source: str, folder: str, checkpoint: str, community: int) -> dict[str, StreamingQuery]:
    """Both queries over the same updates, each with its own checkpoint: the raw archive (a Parquet table under the folder) and messages."""
    return {
        "raws": archive_stream(spark, source, f"{folder}/raw_updates", f"{checkpoint}/raws"),
        "messages": message_stream(spark, source, folder, f"{checkpoint}/messages", community),
    }


def current_messages(states: DataFrame) -> DataFrame:
    """The newest state of each message."""
    others = [c for c in states.columns if c not in (*KEY, "seq")]
    newest = states.groupBy(*KEY).agg(F.max_by(F.struct(*others), "seq").alias("s"), F.max("seq").alias("seq"))
    return newest.select(*KEY, "seq", "s.*")


def stored_versions(versions: DataFrame, redactions: DataFrame) -> DataFrame:
    """Versions, without the text of messages that were made offrecord."""
    gone = redactions.select(*KEY).distinct().withColumn("_gone", F.lit(True))
    d = versions.join(gone, KEY, "left")
    return d.withColumns({"text": F.when(F.col("_gone").isNull(), F.col("text")), "is_redacted": F.col("is_redacted") | F.col("_gone").isNotNull()}).drop("_gone")


def compact_live(log: TableLog) -> None:
    """One commit: a state for each message, versions without what was redacted, first marks. Texts that were made offrecord are gone after
    the next vacuum."""

    def make(t):
        first = t["live_marks"].withColumn("_n", F.row_number().over(W.partitionBy(*KEY, "mark_type").orderBy("seq"))).where("_n = 1").drop("_n")
        states = current_messages(t["states"]).select(*[x.split()[0] for x in TABLES["states"].split(", ")])
        return {"states": states, "live_versions": stored_versions(t["live_versions"], t["redactions"]), "live_marks": first, "redactions": t["redactions"].limit(0)}, {}, None

    log.change(make, {"live": "compact"})
