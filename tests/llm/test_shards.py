"""Whole rows in shards: repeated rows, null ids and clashing columns."""

from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import sharding


def test_write_shards(spark, tmp_path):
    rows = [(i % 40 if i % 5 else None, f"text {i % 60}", None if i % 9 == 0 else f"s{i % 3}", i % 4, "x") for i in range(200)] + [(7, "same", "s1", 0, "x")] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int, slot string").repartition(3)
    sharding.write_shards(d, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "source", "shard", "slot").collect()) == Counter(rows)
    slots = {r["_shard"]: (r.n, r.m) for r in got.groupBy("_shard").agg(F.countDistinct("_slot").alias("n"), F.max("_slot").alias("m")).collect()}
    assert sorted(n for n, _ in slots.values()) == [52, 52, 52, 53] and all(m == n - 1 for n, m in slots.values())
    sharding.write_shards(d.limit(0), str(tmp_path / "none"), 4)


def test_pipeline_empty(spark, tmp_path):
    """No documents, and columns that clash with those of the stages: no rows, and no crash."""
    import corpus_pipeline

    extra = {c: F.lit(1) for c in ("lines", "hits", "bucket", "kept", "component", "row", "h")}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).withColumns(extra).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
