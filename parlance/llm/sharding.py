"""Proportional stratified interleaving: shards that all have the mixture's proportions.

Rows are shuffled by a seeded hash inside each source, get the fractional rank
(rank - 1/2) / rows of the source, and are cut into shards along the order of that fraction. Every
shard then holds each source's share to within a row or two, and row counts differ by one at most.

Ranks are taken in two steps so that a source with a third of all rows is no single task: rows are
counted per (source, hash bucket), the counts are summed up over the buckets, and only rows of one
bucket are sorted together. The same is done for the order of fractions, which are evenly spread by
construction. Texts never move: only the id, the source and the digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import documents, free_name, text_bytes

#: Hash buckets of a source, and of the order of fractions. Rows per task fall with it; the only
#: single-task steps sum this many counts (per source).
BUCKETS = 4096
HEX = 3  # hex digits of the md5 that give the bucket: 16 ** 3 == BUCKETS


def assign_shards(
    rows: DataFrame, shards: int, seed: int = 17, key: str = "doc_id", source: str = "source", keep: list[str] | None = None
) -> DataFrame:
    """key, source, the columns in keep, and shard (0 to shards - 1) and slot (gapless from 0).

    A null source is a source of its own, a null key hashes as an empty string. Repeated rows each
    get a slot; equal rows are interchangeable, so it doesn't matter which of them gets which.
    An empty table gives an empty result.
    """
    keep = keep or []
    shuffle = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    # Inner names that cannot clash with the caller's columns.
    d = rows.select(
        F.col(source).alias("_source"),
        F.col(key).alias("_key"),
        shuffle.alias("_hash"),
        F.struct(*[F.col(c) for c in keep]).alias("_keep") if keep else F.lit(None).cast("string").alias("_keep"),
    ).withColumn("_bucket", F.substring("_hash", 1, HEX))

    counts = d.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    by_source = W.partitionBy("_source")
    starts = counts.select(
        F.col("_source").alias("_s"),
        F.col("_bucket").alias("_b"),
        (F.sum("_n").over(by_source.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(by_source).alias("_of"),
    )
    order = [F.col("_hash"), F.col("_key"), F.col("_keep")] if keep else [F.col("_hash"), F.col("_key")]
    ranked = d.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn(
        "_rank", F.col("_before") + F.row_number().over(W.partitionBy("_source", "_bucket").orderBy(*order))
    )
    placed = ranked.select(
        "_source", "_key", "_hash", "_keep", ((F.col("_rank") - F.lit(0.5)) / F.col("_of")).alias("_fraction")
    ).withColumn("_part", F.floor(F.col("_fraction") * BUCKETS))

    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    everything = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_part").alias("_p"), "_n").select(  # BUCKETS rows at most
        "_p",
        F.coalesce(F.sum("_n").over(everything), F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(F.lit(0))).alias("_all"),
    )
    at = F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("_fraction", "_source", *order)) - 1
    shard = F.expr(f"_at * {shards} div _all")
    return (
        placed.join(offsets, F.col("_part") == F.col("_p"))
        .withColumn("_at", at)
        .withColumn("_shard", shard)
        .select(
            F.col("_key").alias(key),
            F.col("_source").alias(source),
            *[F.col(f"_keep.{c}").alias(c) for c in keep],
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_at") - F.expr(f"(_shard * _all + {shards - 1}) div {shards}")).alias("slot"),
        )
    )


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 17, key: str = "doc_id", source: str = "source") -> None:
    """Write whole rows to path, a folder for each shard (shard=N) with its rows in the order of slot.

    Every row is written once, repeated ones and those without key or source too. Where rows have columns shard or slot, the
    new ones have underscores before their names. Rows are ordered by all they hold, so columns can't be maps.
    """
    whole, shard, slot = (free_name(rows, n) for n in ("whole_row", "shard", "slot"))
    packed = rows.select(key, source, F.struct("*").alias(whole))
    placed = assign_shards(packed, shards, seed, key, source, keep=[whole]).select(f"{whole}.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed.repartition(shards, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


SHARDS = 24


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        (text_bytes("text") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    a = assign_shards(d, SHARDS, keep=["size", "text_crc32"])
    return a.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: DuckDB SQL for op2's rows; CRC-32 by its table, as there is no such function.
OP2_SQL = """
WITH s_t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table),
s_d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 8 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes, md5('17:' || doc_id) AS h FROM documents),
s_c AS (SELECT doc_id, source, size, h, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bytes, lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM s_d, s_t),
s_r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS f FROM s_c),
s_a AS (SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM s_r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 24 // n AS INTEGER) AS shard, pos - ((pos * 24 // n) * n + 23) // 24 AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM s_a
"""
