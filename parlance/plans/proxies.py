"""The archive's tables made from the driver's. Every column is one SQL expression that Spark and DuckDB read alike, so
that queries and their oracles start from the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '1998-01-01 00:00:00'"

TABLES = {
    # table: (driver's table, {column: expression})
    "messages": (
        "documents",
        {
            "chat_id": "CAST(replace(source, 'src', '') AS BIGINT) % 4",
            "message_id": "doc_id",
            "user_id": "doc_id % 97",
            "text": "CASE WHEN doc_id % 11 = 0 THEN concat(text, ' #nomem') WHEN doc_id % 13 = 0 THEN concat('#OffRecord ', text) ELSE text END",
            "caption": "CAST(NULL AS STRING)",
            "raw_json": "CAST(NULL AS STRING)",
            "memory_policy": "CASE WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN 'offrecord' WHEN doc_id % 11 = 0 THEN 'nomem' ELSE 'normal' END",
            "is_redacted": "doc_id % 17 = 0",
            "captured_at": "doc_id",
            "content_hash": "sha256(text)",
        },
    ),
    "tombstones": (
        "documents",
        {
            "tombstone_key": "CASE doc_id % 3 WHEN 0 THEN concat('message:', CAST(CAST(replace(source, 'src', '') AS BIGINT) % 4 AS STRING), ':', CAST(doc_id AS STRING)) WHEN 1 THEN concat('message_hash:', sha256(text)) ELSE concat('user:', CAST(doc_id % 97 AS STRING)) END",
            "status": "CASE WHEN doc_id % 5 = 0 THEN 'pending' WHEN doc_id % 5 = 1 THEN 'failed' ELSE 'completed' END",
            "id": "doc_id",
            "target_type": "CASE doc_id % 3 WHEN 0 THEN 'message' WHEN 1 THEN 'message_hash' ELSE 'user' END",
            "created_at": "-doc_id",
            "target_id": "CASE WHEN doc_id % 7 = 3 THEN 'none' ELSE CAST(CASE WHEN doc_id % 3 = 2 THEN doc_id % 97 ELSE doc_id END AS STRING) END",
            "keep": "doc_id % 49 = 7",
        },
    ),
    "exported": (
        "conversations",
        {
            "chat_id": "conv_id % 3",
            "id": "conv_id * 10 + turn - CASE WHEN turn > 0 AND conv_id % 9 = 0 THEN 1 ELSE 0 END",
            "place": "conv_id * 10 + turn",
            "type": "CASE WHEN (conv_id + turn) % 12 = 5 THEN 'service' ELSE 'message' END",
            "from_id": "CASE WHEN conv_id % 10 = 3 THEN concat('channel', CAST(conv_id AS STRING)) ELSE concat('user', CAST(conv_id % 40 AS STRING)) END",
            "user_id": "conv_id % 40",
            "media_type": "CASE WHEN (conv_id + turn) % 7 = 0 THEN 'voice_message' WHEN (conv_id + turn) % 7 = 1 THEN 'hologram' WHEN (conv_id + turn) % 35 = 2 THEN 'photo' END",
            "location_information": "CASE WHEN (conv_id + turn) % 9 = 1 THEN '{}' END",
            "contact_information": "CASE WHEN (conv_id + turn) % 9 = 2 THEN '{}' END",
            "poll": "CASE WHEN (conv_id + turn) % 9 = 3 THEN '{}' END",
            "dice": "CASE WHEN (conv_id + turn) % 9 = 4 THEN '{}' END",
            "text_entities": "CAST(NULL AS STRING)",
            "forwarded_from": "CASE WHEN (conv_id + turn) % 6 = 0 THEN 'someone' END",
            "photo": "CASE WHEN (conv_id + turn) % 8 = 0 THEN 'p.jpg' END",
            "mime_type": "CASE WHEN (conv_id + turn) % 8 = 1 THEN 'application/pdf' END",
            "text": "text",
            "reply_to": "CASE WHEN turn > 0 THEN conv_id * 10 + turn - 1 WHEN conv_id % 4 = 0 THEN conv_id * 10 + 100000 END",
            "edited": "conv_id % 5 = 0",
            "policy": "CASE WHEN conv_id % 8 = 1 THEN 'nomem' WHEN conv_id % 8 = 2 THEN 'offrecord' ELSE 'normal' END",
            "date": "conv_id * 60 + turn",
        },
    ),
    "users": (
        "customer",
        {
            "user_id": "c_custkey",
            "name": "c_name",
            "username": "CASE WHEN c_custkey % 3 = 0 THEN concat('u_', c_mktsegment) END",
            "is_member": "c_custkey % 4 <> 0",
            "is_admin": "c_custkey % 50 = 0",
        },
    ),
    "intros": (
        "customer",
        {
            "user_id": "c_custkey",
            "intro_at": "c_custkey * 3",
            "intro_text": "concat('intro of ', c_name)",
            "voucher": "CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END",
            "updated_at": "TIMESTAMP '1997-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 700)",
            "row_number": "CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 END",
            "keep": "c_custkey % 5 < 3",
        },
    ),
    "applications": (
        "orders",
        {
            "id": "o_orderkey",
            "user_id": "o_custkey",
            "status": "CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'vouched' WHEN o_orderkey % 3 = 1 THEN 'filling' ELSE 'pending' END WHEN o_orderkey % 5 = 0 THEN 'rejected' ELSE 'added' END",
            "created_at": "o_orderdate",
            "submitted_at": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '1' DAY END",
            "nudged_at": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END",
            "notified_at": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END",
            "voucher_id": "CASE WHEN o_orderkey % 3 = 0 THEN (o_custkey * 7) % 1000 + 1 END",
        },
    ),
    "updates": ("events", {"update_id": "CASE WHEN event_id % 20 = 0 THEN NULL ELSE event_id - event_id % 3 END", "kind": "event_type", "stored": "event_id % 10 < 2"}),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = TABLES[name]
    exprs = [f"{e.replace('sha256(text)', 'sha2(text, 256)')} AS {c}" for c, e in columns.items()]
    df = spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*exprs)
    return df.where("keep").drop("keep") if "keep" in columns else df


def sql(*names: str) -> str:
    """WITH clauses of the tables in DuckDB's SQL."""
    parts = []
    for name in names:
        source, columns = TABLES[name]
        body = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}".replace("AS STRING", "AS VARCHAR")
        parts.append(f"{name} AS ({f'SELECT * FROM ({body}) WHERE keep' if 'keep' in columns else body})")
    return "WITH RECURSIVE " + ",\n".join(parts)
