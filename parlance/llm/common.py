"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@functools.cache
def _app_folder(app_id: str, base: str) -> str:
    return f"{base.rstrip('/')}/parlance-{app_id}"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir, which driver and executors share.

    Only where a session on one machine (master local) names none, as in tests, a temporary folder is set.
    It is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parlance-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = _app_folder(spark.sparkContext.applicationId, base)
    if path not in _cleaned:
        _cleaned.add(path)
        atexit.register(_delete, spark, path)
    return path


_cleaned: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended first; the folder is temporary anyway
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost
    executor costs no recomputation before this point."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    # Zstandard: small, and its codec keeps no buffers outside the heap, which add up over many tables.
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_bytes(col):
    """UTF-8 length; null counts 0."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


#: Bits of the filter below: a broadcast of FILTER_BITS / 64 rows of 16 bytes at most, 8 MB.
FILTER_BITS = 1 << 25


def maybe_among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose column may be among keys: all that are and, by equal hash bits, a few that are not.

    It makes the shuffle of a later exact join small; its own broadcast has a fixed bound. Nulls match nulls.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    word, ones, h = (free_name(df, n) for n in ("filter_word", "filter_ones", "filter_bit"))
    bits = keys.select(bit(key).alias(h)).select(F.expr(f"CAST({h} div 64 AS INT)").alias(word), F.expr(f"shiftleft(1L, CAST({h} % 64 AS INT))").alias(ones))
    bits = bits.groupBy(word).agg(F.bit_or(ones).alias(ones))
    found = df.withColumn(h, bit(column)).join(F.broadcast(bits), (F.expr(f"CAST({h} div 64 AS INT)") == F.col(word)) & F.expr(f"shiftright({ones}, CAST({h} % 64 AS INT)) & 1 = 1"))
    return found.drop(h, word, ones)
