"""The stream of raw updates into the archive, and of messages and edits into their state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.streaming import StreamingQuery

from parlance.functions.text import contact_name, has_marker, live_kind, merge_entities
from parlance.operators.governance import scrub_update
from parlance.operators.versions import KEY, fold_edits, unknown_edits

UPDATE = "update_id bigint, payload string, received_at timestamp"
# Kinds of update, in the order in which their fields are looked for.
KINDS = ["message", "edited_message", "callback_query", "chat_member", "my_chat_member", "message_reaction", "message_reaction_count"]
#: Update ids share a folder of the archive by this many, so that a batch reads the folders of its own ids alone.
ID_BLOCK = 1_000_000


@F.pandas_udf(StringType())
def raw_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of an update's JSON with keys in order and ASCII alone, so that the order of keys doesn't matter; of the text as it is if it
    is no JSON."""
    import hashlib

    def digest(raw: str | None) -> str | None:
        if raw is None:
            return None
        try:
            raw = json.dumps(json.loads(raw), sort_keys=True)
        except ValueError:
            pass
        return hashlib.sha256(raw.encode()).hexdigest()

    return payload.map(digest)


def describe(updates: DataFrame) -> DataFrame:
    """kind, chat_id, message_id, and the payload, without its content if it is marked offrecord, from an update's JSON."""
    at = lambda *path: F.coalesce(*[F.get_json_object("payload", f"$.{p}") for p in path])
    kind = F.coalesce(*[F.when(F.get_json_object("payload", f"$.{k}").isNotNull(), k) for k in KINDS], F.lit("unknown"))
    parts = ("text", "caption", "poll.question")
    off = F.lit(False)
    for event in ("message", "edited_message"):
        for part in parts:
            off = off | has_marker(at(f"{event}.{part}"), "#offrecord")
    return updates.select(
        "update_id",
        kind.alias("kind"),
        at("message.chat.id", "edited_message.chat.id", "callback_query.message.chat.id", "chat_member.chat.id", "my_chat_member.chat.id").try_cast("long").alias("chat_id"),
        at("message.message_id", "edited_message.message_id", "callback_query.message.message_id").try_cast("long").alias("message_id"),
        F.when(off, scrub_update("payload")).otherwise(F.col("payload")).alias("payload"),
        raw_hash("payload").alias("raw_hash"),
        off.alias("is_redacted"),
        "received_at",
    )


def live_messages(updates: DataFrame, community: int) -> DataFrame:
    """New messages of the community's chat with a known sender, from raw updates, as versions.persist takes them; reply and thread
    beside it. The order of arrival is that of update ids."""
    at = lambda p, kind="string": F.get_json_object("payload", f"$.message.{p}").try_cast(kind)
    listed = lambda p: F.from_json(F.get_json_object("payload", f"$.message.{p}"), "array<variant>")
    d = updates.where((at("chat.id", "long") == community) & at("from.id", "long").isNotNull())
    return d.select(
        at("chat.id", "long").alias("chat_id"),
        at("message_id", "long").alias("message_id"),
        at("from.id", "long").alias("user_id"),
        at("text").alias("text"),
        at("caption").alias("caption"),
        live_kind(F.get_json_object("payload", "$.message")).alias("kind"),
        merge_entities(listed("entities"), listed("caption_entities")).alias("entities"),
        at("poll.question").alias("poll_question"),
        contact_name(at("contact.first_name"), at("contact.last_name")).alias("contact_name"),
        F.timestamp_seconds(at("date", "long")).alias("date"),
        F.col("update_id").alias("arrival"),
        at("reply_to_message.message_id", "long").alias("reply_to"),
        at("message_thread_id", "long").alias("thread_id"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def store_updates(batch: DataFrame, batch_id: int, target: str) -> None:
    """Append a batch's new updates to target: each update_id once for all time, updates without an id once for a batch.

    The archive lies in folders by block of ids. Only those of the batch's own blocks are read to find known ids; a batch
    that runs again finds its rows stored, those without an id by the batch's number.
    """
    spark = batch.sparkSession
    block = F.coalesce(F.floor(F.col("update_id") / ID_BLOCK), F.lit(-1)).cast("long")
    rows = batch.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("id_block", block)
    new = rows.where("update_id is not null").dropDuplicates(["update_id"])
    no_id = rows.where("update_id is null")
    if _exists(spark, target):
        stored = spark.read.schema(rows.schema).parquet(target)
        blocks = [r.id_block for r in new.select("id_block").distinct().collect()]  # ids of a batch are near each other
        new = new.join(stored.where(F.col("id_block").isin(blocks)).select("update_id"), "update_id", "left_anti")
        no_id = no_id.join(stored.where((F.col("id_block") == -1) & (F.col("batch_id") == batch_id)).select("batch_id").distinct(), "batch_id", "left_anti")
    new.unionByName(no_id).write.mode("append").partitionBy("id_block").parquet(target)


def archive_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """New updates from JSON files in source go to the Parquet table target, each update_id once for all time. Trouble in reading or
    writing ends the query; it goes on from its checkpoint."""
    stream = describe(spark.readStream.schema(UPDATE).json(source))
    return stream.writeStream.foreachBatch(lambda batch, n: store_updates(batch, n, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_edits(batch: DataFrame, batch_id: int, state: str, late: str) -> None:
    """One batch of edits (chat_id, message_id, seq, text) onto the newest version of the table state; edits of unknown messages
    are appended to late.

    State is a folder v=<n> for each batch, so a batch that runs again reads what it has read before and overwrites its own version alone.
    """
    spark = batch.sparkSession
    before = spark.read.parquet(f"{state}/v={batch_id}")
    edits = batch.persist()
    unknown_edits(before, edits).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
    fold_edits(before, edits).write.mode("overwrite").parquet(f"{state}/v={batch_id + 1}")
    edits.unpersist()


def edit_stream(spark: SparkSession, source: str, state: str, late: str, checkpoint: str) -> StreamingQuery:
    """Edits from JSON files in source onto state, whose version v=0 (chat_id, message_id, text, memory_policy) is there before."""
    stream = spark.readStream.schema(", ".join(f"{c} bigint" for c in (*KEY, "seq")) + ", text string").json(source)
    return stream.writeStream.foreachBatch(lambda batch, n: apply_edits(batch, n, state, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
