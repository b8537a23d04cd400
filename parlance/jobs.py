"""Jobs from the command line: python -m parlance.jobs dry-run EXPORT | import EXPORT TABLES [--resume] | rollback TABLES RUN | forget TABLES.

TABLES is a table log (see sources.tablelog): what a job changes becomes visible together, and a job that died has changed nothing or
all of a step. Exit codes: 0 done, 2 wrong kind of run, or an unfinished import that --resume was not given for, 3 no such run,
4 unreadable, 5 an import failed (its run says why).
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import text as T
from parlance.operators import governance, ingest
from parlance.sources import exports
from parlance.sources.tablelog import TableLog

#: Tables of an archive and their columns.
ARCHIVE = {
    "runs": ingest.RUN,
    "raws": "raw_id string, chat_id long, message_id long, update_id long, run_id long, payload string, is_redacted boolean",
    "users": "user_id long, first_name string, imported_only boolean, is_member boolean, is_admin boolean",
    "messages": "chat_id long, message_id long, user_id long, raw_id string, text string, caption string, raw_json string, kind string, date timestamp, memory_policy string, is_redacted boolean, content_hash string, reply_to long, current_version long",
    "marks": "chat_id long, message_id long, mark_type string, detected_by string, set_by long",
    "versions": "chat_id long, message_id long, version_seq long, content_hash string, text string, caption string, normalized_text string, entities string, is_redacted boolean, captured_at timestamp",
    "tombstones": "id long, tombstone_key string, target_type string, target_id string, status string, created_at timestamp, cascade map<string,struct<status:string,reason:string>>, error string",
}
#: Messages of an import that are committed at a time.
SLICE = 5_000_000


class PartialRun(ValueError):
    """An import of this file, or of another content under its path, has not ended."""


def open_archive(spark: SparkSession, folder: str) -> TableLog:
    """The folder's table log, with all tables of an archive."""
    log = TableLog(spark, folder)

    def missing(tables):
        return {n: spark.createDataFrame([], s) for n, s in ARCHIVE.items() if n not in tables}, {}, None

    log.change(missing, {"job": "open"})
    return log


def exported_messages(spark: SparkSession, path: str) -> DataFrame:
    """An export's messages as apply_import takes them: kind, text or caption, policy's parts, time and reply beside the export's own columns."""
    d = exports.read_export(spark, path)
    kind = T.message_kind(names=d.columns)
    d = d.withColumns({"kind": kind, "_parts": T.text_and_caption(kind, F.coalesce("text", F.lit("")), F.col("entities_text"))})
    return d.withColumns(
        {
            "text": F.col("_parts.text"),
            "caption": F.col("_parts.caption"),
            "entities": F.lit(None).cast("array<struct<offset:int,length:int,type:string>>"),  # an export has no offsets
            "contact_name": T.contact_name(F.col("contact_first_name"), F.col("contact_last_name")),
            "reply_to": F.col("reply_to_message_id"),
            "sent": T.export_time(F.col("date_unixtime"), F.col("date")),
        }
    ).drop("_parts")


def dry_run(spark: SparkSession, path: str) -> dict:
    """What an export holds, as one JSON-ready report."""
    m = exported_messages(spark, path)
    m = m.withColumns({"edited": F.col("edited").isNotNull() | F.col("edited_unixtime").isNotNull(), "forwarded": F.col("forwarded_from").isNotNull(), "has_media": F.col("kind").isin(*T.MEDIA_KINDS)})
    m = m.withColumn("policy", T.policy(F.col("text"), F.col("caption"))).withColumn("date", F.col("sent"))
    report = ingest.dry_run_report(m).withColumns({c: T.iso_time(F.col(c)) for c in ("first_date", "last_date")}).first().asDict()
    kinds = {r.kind: r.n for r in ingest.histogram(m, "kind").orderBy("kind").collect()}
    return report | {"kinds": kinds, "unreadable": exports.unreadable_entries(spark, path).count()}


def _begin(log: TableLog, path: str, digest: str, chat_id: int, resume: bool) -> tuple[int, int | None]:
    """The import's run, made and committed or found unfinished, and the id after which it goes on."""

    def make(tables):
        source = log.spark.createDataFrame([(1, path, digest, resume)], "source_id long, path string, hash string, resume boolean")
        d = ingest.decide_runs(source, tables["runs"]).first()
        if d["mode"] == "block_partial_present":
            raise PartialRun(f"an import of {path} has not ended: resume it")
        if d["mode"] == "resume_existing":
            going = tables["runs"].withColumn("status", F.when(F.col("run_id") == d["run_id"], "running").otherwise(F.col("status")))
            return {"runs": going}, {}, (d["run_id"], d["resume_point"])
        row = log.stage(ingest.new_run(tables["runs"], "import", F.current_timestamp(), path, digest, chat_id))
        return {}, {"runs": row}, (row.first()["run_id"], None)

    return log.change(make, {"job": "import", "step": "begin"})


def _end(log: TableLog, run: int, status: str, error: str | None = None) -> None:
    def make(tables):
        wanted = log.spark.createDataFrame([(run, status, error)], "run_id long, to_status string, new_error string")
        return {"runs": ingest.finalize_runs(tables["runs"], wanted, F.current_timestamp())}, {}, None

    log.change(make, {"job": "import", "step": status})


def _slices(ids: DataFrame, size: int) -> list[int]:
    """Last ids of slices of about so many rows, ascending; no rows, no slices."""
    found = ids.agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last")).first()
    parts = -(-found["n"] // size)
    if parts < 2:
        return [found["last"]] if found["n"] else []
    inner = ids.agg(F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100_000))).first()[0]
    return sorted({*inner, found["last"]})


def _apply_slice(log: TableLog, messages: DataFrame, run: int, low: int | None, high: int) -> None:
    """One commit: the slice's rows, and with them the checkpoint and the outcomes counted so far."""

    def make(tables):
        d = messages.where(F.col("id") <= high)
        rows, outcomes = ingest.apply_import(d, tables["messages"], tables["raws"], tables["tombstones"], tables["users"], run, low, log.stage)
        counts = {r["outcome"]: r["n"] for r in ingest.histogram(outcomes, "outcome").collect()}
        stats = json.loads(tables["runs"].where(F.col("run_id") == run).first()["stats"] or "{}")
        counts = {k: stats.get("outcomes", {}).get(k, 0) + counts.get(k, 0) for k in {*stats.get("outcomes", {}), *counts}}
        patch = {"outcomes": counts, "last_processed_export_msg_id": high, "chunk_index": stats.get("chunk_index", 0) + 1}
        replies = d.groupBy("chat_id", F.col("id").alias("message_id")).agg(F.min_by("reply_to", "place").alias("reply_to"))
        new = log.stage(rows["messages"].join(replies, ["chat_id", "message_id"]))
        placed = ingest.stored_replies(new, tables["messages"], tables["raws"], tables["runs"], run)
        add = {"messages": placed.withColumn("current_version", F.lit(1)), "versions": rows["versions"].withColumn("version_seq", F.lit(1)), "raws": rows["raws"], "marks": rows["marks"], "users": rows["users"].withColumns({"is_member": F.lit(False), "is_admin": F.lit(False)})}
        sent = d.groupBy("chat_id", F.col("id").alias("message_id")).agg(F.min_by("sent", "place").alias("captured_at"))
        add["versions"] = add["versions"].join(sent, ["chat_id", "message_id"])
        kinds = {n: dict(x.split() for x in ARCHIVE[n].split(", ")) for n in add}
        typed = {n: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds[n].items()]) for n, df in add.items()}
        now = F.when(F.col("run_id") == run, F.lit(json.dumps(stats | patch, sort_keys=True))).otherwise(F.col("stats"))
        return {"runs": tables["runs"].withColumn("stats", now)}, typed, None

    log.change(make, {"job": "import", "run": run, "up_to": high})


def import_export(spark: SparkSession, export: str, folder: str, resume: bool = False, size: int = SLICE) -> dict:
    """Imports an export into an archive, in slices by message id: a report of its run, outcomes and slices.

    Each slice's rows and the checkpoint after it are one commit, so an import that was stopped anywhere and is resumed leaves what one that ran
    through does. One that fails leaves its run as failed, with the error's name. An unfinished import of the file (or of
    another content under its path) raises PartialRun, unless resume is set.
    """
    chat_id, digest = exports.export_chat_id(spark, export), exports.file_digest(spark, export)
    log = open_archive(spark, folder)
    run, done = _begin(log, export, digest, chat_id, resume)
    try:
        m = exported_messages(spark, export)
        m = log.stage(m.withColumns({"date_text": F.col("date"), "date": F.col("sent")}))
        left = m if done is None else m.where(F.col("id") > done)
        low = done
        for high in _slices(left.select("id"), size):
            _apply_slice(log, m, run, low, high)
            low = high
    except Exception as e:
        _end(log, run, "failed", type(e).__name__)
        raise
    _end(log, run, "completed")
    log.compact()
    stats = json.loads(log.read("runs").where(F.col("run_id") == run).first()["stats"])
    return {"run": run, "outcomes": dict(sorted(stats.get("outcomes", {}).items())), "slices": stats.get("chunk_index", 0)}


def rollback(spark: SparkSession, folder: str, run: int) -> dict:
    """Takes back an import's rows (raws, messages, marks, versions) in one commit with the row that says so; a run that was rolled back
    before reports that."""
    log = open_archive(spark, folder)

    def make(tables):
        after, runs, report = ingest.rollback_once({n: tables[n] for n in ("raws", "messages", "versions", "marks")}, tables["runs"], run, F.current_timestamp())
        return ({} if report["done_before"] else after | {"runs": runs}), {}, report

    return log.change(make, {"job": "rollback", "run": run})


def forget(spark: SparkSession, folder: str, limit: int = 10) -> dict:
    """One tick of the erasure cascade over an archive: claims the oldest pending erasures, applies each layer and ends them. Each step
    is a commit, see governance.run_cascade."""
    return governance.run_cascade(open_archive(spark, folder), limit)


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="parlance.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    jobs.add_parser("dry-run").add_argument("export")
    take = jobs.add_parser("import")
    take.add_argument("export")
    take.add_argument("tables")
    take.add_argument("--resume", action="store_true")
    back = jobs.add_parser("rollback")
    back.add_argument("tables")
    back.add_argument("run", type=int)
    jobs.add_parser("forget").add_argument("tables")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    run = {
        "dry-run": lambda: dry_run(spark, given.export),
        "import": lambda: import_export(spark, given.export, given.tables, given.resume),
        "rollback": lambda: rollback(spark, given.tables, given.run),
        "forget": lambda: forget(spark, given.tables),
    }[given.job]
    try:
        report = run()
    except (exports.ExportError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 4
    except PartialRun as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        if given.job == "import":
            return 5
        for kinds, code in (((LookupError,), 3), ((ValueError,), 2), ((RuntimeError,), 4)):
            if isinstance(e, kinds):
                return code
        raise
    print(json.dumps(report, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
