"""Exports read by byte ranges, against json.load."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.sources import exports, ranges


def some_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", " ", "a", "é", "\n", "😀", '\\"', "\\\\"]) for _ in range(rng.randrange(12)))


def some_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind > 4:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {some_text(rng): some_value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [some_text(rng), rng.randrange(-5, 5), None, True][kind]


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_entries(spark, tmp_path, size):
    """Ranges of a few bytes: entries, strings and escapes cross them."""
    rng = random.Random(size)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for n in range(2 if size < 64 else 6):
            value = {"name": some_text(rng), "about": {"x": [1, {}]}, "messages": [some_value(rng) for _ in range(rng.randrange(25))], "other": [[1], {"messages": [3]}], "id": n}
            path = tmp_path / f"{size}-{n}.json"
            text = json.dumps(value, ensure_ascii=bool(n % 2), indent=n % 3 or None)
            path.write_text(text + "\n" * (n % 2))
            r = ranges.Ranges(spark, str(path))
            assert (r.envelope["name"], r.envelope["id"], r.envelope["about"], len(r.envelope["other"])) == (value["name"], n, {}, 1)
            for name in ("messages", "other"):
                got = {x.place: json.loads(x.raw) for x in r.entries(name).collect()}
                assert [got[i] for i in range(len(got))] == value[name]
            assert len(r.ranges) > min(4, len(text) // size // 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
        spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


@pytest.mark.parametrize("bad", ['{"messages": [{"id": 1}', '{"messages": [1]}]', '{"messages": ["x]}', "", "{]", '{"a": 1,}', "7", '[{"id": 1}]'])
def test_broken(spark, tmp_path, bad):
    (tmp_path / "bad.json").write_text(bad)
    with pytest.raises(exports.ExportError):
        exports.read_export(spark, str(tmp_path / "bad.json"))


def test_broken_entry(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 3, "messages": [{"id": 1, "text": "a"}, {"id": 2 "text"}, {"id": 4}]}')
    assert sorted(r.id for r in exports.read_export(spark, str(tmp_path / "e.json")).collect()) == [1, 4]
    assert [(r.place, r.reason, r.entry) for r in exports.unreadable_entries(spark, str(tmp_path / "e.json")).collect()] == [(1, "no JSON", '{"id": 2 "text"}')]


def test_deep_text(spark, tmp_path):
    deep = "end"
    for i in range(10):
        deep = [f"{i}", deep]
    (tmp_path / "d.json").write_text(json.dumps({"id": 3, "messages": [{"id": 1, "text": deep}]}))
    assert exports.read_export(spark, str(tmp_path / "d.json")).first().text == "9876543210end"


def test_large(spark, tmp_path):
    """140 MB, above what one value can hold, read by several tasks."""
    line = json.dumps({"id": 0, "type": "message", "date_unixtime": "1700000000", "from_id": "user7", "text": ["word \\\" } ] " * 60, {"type": "bold", "text": "b"}]})
    n = 140_000_000 // (len(line) + 10)
    with open(tmp_path / "large.json", "w") as f:
        f.write('{"name": "n", "id": 12, "messages": [')
        f.writelines(line.replace('"id": 0', f'"id": {i}', 1) + ("," if i < n - 1 else "]}") for i in range(n))
    d = exports.read_export(spark, str(tmp_path / "large.json"))
    assert d.rdd.getNumPartitions() > 1
    got = d.agg(F.count("id").alias("n"), F.sum("id").alias("ids"), F.sum((F.col("id") == F.col("place")).cast("int")).alias("placed"), F.min(F.length("text")).alias("short"), F.max("chat_id").alias("chat")).first()
    assert tuple(got) == (n, n * (n - 1) // 2, n, len('word \\" } ] ' * 60) + 1, 12)
