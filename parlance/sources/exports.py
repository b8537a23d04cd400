"""Readers of exports and seeds, and writers of reports and table versions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.sources.ranges import Ranges

# Fields of an exported message that are read, beside its text and entities.
FIELDS = [
    "type", "date", "date_unixtime", "from", "from_id", "reply_to_message_id", "forwarded_from", "edited", "edited_unixtime", "media_type",
    "mime_type", "photo", "file", "action", "actor", "actor_id", "width", "height", "duration_seconds",
]
NUMBERS = ["reply_to_message_id", "width", "height", "duration_seconds"]
#: Objects that tell a message's kind, as JSON.
OBJECTS = ["location_information", "contact_information", "poll", "dice"]
ENTITIES = "array<struct<offset:int,length:int,type:string,text:string>>"


class ExportError(ValueError):
    """The file is no export of one conversation."""


def _envelope(spark: SparkSession, path: str) -> Ranges:
    """The file's ranges and envelope, if it is an object; see _open_export for errors."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(path)
    try:
        ranges = Ranges(spark, path)
    except ValueError as e:
        raise ExportError("not a JSON object") from e
    if not isinstance(ranges.envelope, dict):
        raise ExportError("not a JSON object")
    return ranges


def _is_id(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and abs(value) < 1 << 63


def _open_export(spark: SparkSession, path: str) -> DataFrame:
    """chat_id, place, raw, m: the entries of an export as text and as variants (null: no JSON), read by as many tasks as the file has
    ranges. A missing file raises FileNotFoundError, a file that is no JSON object, holds a whole account (chats), or whose messages are no
    list or not there raises ExportError. An entry of more than 128 MiB is no JSON."""
    ranges = _envelope(spark, path)
    top = ranges.envelope
    if top.get("chats") is not None:
        raise ExportError("a whole account, not one conversation")
    if not isinstance(top.get("messages"), list):
        raise ExportError("messages is no list" if "messages" in top else "no messages")
    chat_id = F.lit(top["id"] if _is_id(top.get("id")) else None).cast("long")
    return ranges.entries("messages").select(chat_id.alias("chat_id"), F.col("place").cast("int").alias("place"), "raw", F.try_parse_json("raw").alias("m"))


def export_chat_id(spark: SparkSession, path: str) -> int:
    """The conversation's id; ExportError if it is no whole number."""
    found = _envelope(spark, path).envelope.get("id")
    if not _is_id(found):
        raise ExportError("the conversation's id is no whole number")
    return found


def split_export(spark: SparkSession, path: str, lines: str) -> None:
    """Write an export's entries as JSON Lines (chat_id, place, m), a line each, for readers of JSON Lines."""
    _open_export(spark, path).select("chat_id", "place", F.expr("to_json(m)").alias("m")).where("m is not null").write.mode("errorifexists").json(lines)


def read_split(spark: SparkSession, lines: str) -> DataFrame:
    """Messages of a split export, as from read_export."""
    return _messages(spark.read.schema("chat_id bigint, place int, m string").json(lines).withColumn("m", F.parse_json("m")))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of an export (one JSON object), a row each, with chat_id, place (in the file) and text, all its parts joined.

    Entries that are no objects or have no whole number as id are left out here; unreadable_entries returns them. See _open_export for
    errors. The file is read once for its envelope and once for each use of the result.
    """
    return _messages(_open_export(spark, path))


def _is_message():
    return F.expr("schema_of_variant(m)").startswith("OBJECT") & F.coalesce(F.expr("schema_of_variant(try_variant_get(m, '$.id', 'variant'))") == "BIGINT", F.lit(False))


def unreadable_entries(spark: SparkSession, path: str) -> DataFrame:
    """chat_id, place, reason and entry (JSON; as it stands in the file, if it is none) of what read_export leaves out."""
    d = _open_export(spark, path)
    reason = F.when(F.col("m").isNull(), "no JSON").when(~F.expr("schema_of_variant(m)").startswith("OBJECT"), "no object").when(F.expr("try_variant_get(m, '$.id', 'variant')").isNull(), "no id").otherwise("id is no whole number")
    return d.where(~F.coalesce(_is_message(), F.lit(False))).select("chat_id", "place", reason.alias("reason"), F.coalesce(F.expr("to_json(m)"), F.col("raw")).alias("entry"))


def _messages(entries: DataFrame) -> DataFrame:
    get = lambda name, kind="string": F.expr(f"try_variant_get(m, '$.{name}', '{kind}')")
    return entries.where(_is_message()).select(
        "chat_id",
        "place",
        get("id", "bigint").alias("id"),
        *[get(f, "bigint" if f in NUMBERS else "string").alias(f) for f in FIELDS],
        *[F.expr(f"to_json(try_variant_get(m, '$.{f}', 'variant'))").alias(f) for f in OBJECTS],
        get("poll.question").alias("poll_question"),
        get("contact_information.first_name").alias("contact_first_name"),
        get("contact_information.last_name").alias("contact_last_name"),
        F.when(get("text", "variant").isNotNull(), flatten_text("text")).alias("text"),
        get("text_entities", ENTITIES).alias("text_entities"),
        flatten_text("text_entities").alias("entities_text"),
    )


#: How deep lists may stand in lists; the format has one level. Text further down is left out.
DEPTH = 16


def flatten_text(field: str):
    """Text of a field of the variant column m: a string or number, or a list of strings, numbers, objects with a text that is a
    string, and such lists, joined; all else is left out. Empty if there is none."""

    def one(v, depth: int):
        kind = F.schema_of_variant(v)
        plain = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(v, "$", "string"))
        inner = F.try_variant_get(v, "$.text", "variant")
        plain = plain.when(kind.startswith("OBJECT") & (F.schema_of_variant(inner) == "STRING"), F.try_variant_get(v, "$.text", "string"))
        if depth:
            plain = plain.when(kind.startswith("ARRAY"), listed(F.try_variant_get(v, "$", "array<variant>"), depth - 1))
        return F.coalesce(plain, F.lit(""))

    def listed(items, depth: int):
        return F.array_join(F.transform(items, lambda v: one(v, depth)), "")

    whole = F.expr(f"try_variant_get(m, '$.{field}', 'variant')")
    kind = F.schema_of_variant(whole)
    text = F.when(kind.startswith("ARRAY"), listed(F.expr(f"try_variant_get(m, '$.{field}', 'array<variant>')"), DEPTH))
    return F.coalesce(text.when(kind.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(whole, "$", "string")), F.lit(""))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON Lines file; lines that don't parse stand in _corrupt_record, blank ones are left out."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path)


def check_jsonl(spark: SparkSession, path: str) -> None:
    """Raise ValueError with the number of the first line that is no JSON object. Lines are numbered on the driver, up to that one: for
    seeds, not for tables."""
    for n, row in enumerate(spark.read.text(path).toLocalIterator(), 1):
        if row.value.strip():
            try:
                ok = isinstance(json.loads(row.value), dict)
            except ValueError:
                ok = False
            if not ok:
                raise ValueError(f"{path}:{n}: no JSON object")


def recent_history(spark: SparkSession, path: str, as_of, hours: int = 24, last: int = 50) -> DataFrame:
    """The last rows (ts, role, text) of a JSON Lines file within so many hours before as_of."""
    rows = spark.read.schema("ts timestamp, role string, text string").json(path)
    return rows.where(F.col("ts") >= as_of - F.make_interval(hours=F.lit(hours))).orderBy(F.desc("ts")).limit(last)


def read_sheet(spark: SparkSession, path: str, columns: int = 11) -> DataFrame:
    """Rows of a sheet saved as CSV with a header, padded to a number of columns; rows whose first cell is no integer are left out."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("user_id", F.trim("c0").try_cast("long")).where("user_id is not null")


def source_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in blocks."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file in any store that Spark reads, streamed through the driver's JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def report_json(report: DataFrame) -> DataFrame:
    """Each row as a JSON string."""
    return report.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("value"))


def write_version(df: DataFrame, table: str, version: int) -> str:
    """A table's next version beside the older ones: readers of those aren't disturbed."""
    path = f"{table}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_sheet(rows: DataFrame, path: str) -> None:
    """A sheet's rows as CSV with a header, in the order of row_number. Readers of the folder see it once it is whole."""
    rows.sort("row_number").write.mode("overwrite").option("header", True).csv(path)
