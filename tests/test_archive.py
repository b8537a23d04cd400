"""Every query of the archive against its SQL in DuckDB, and sources and streams on small files."""

import datetime
import decimal
import json
import math
from pathlib import Path

import duckdb
import pytest

from parlance.plans import archive

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool):
        return "nan" if math.isnan(x) else round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([[plain(r[i]) for i in order] for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(archive.ORACLES))
def test_against_sql(spark, duck, name):
    got = archive.QUERIES[name](spark, SF)
    want = duck.sql(archive.ORACLES[name])
    assert sorted_rows(got.columns, got.collect()) == sorted_rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(archive.QUERIES) - set(archive.ORACLES)))
def test_runs(spark, name):
    assert archive.QUERIES[name](spark, SF).collect()


def test_entry_points(spark):
    import __spark_entry__

    assert set(archive.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


def test_export(spark, tmp_path):
    from parlance.sources import exports

    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"name": "n", "type": "private_group", "id": 7, "messages": [{"id": 1, "type": "message", "text": "one"}, {"id": 2, "type": "message", "text": ["two ", {"type": "bold", "text": "b"}]}]}))
    bad.write_text(json.dumps({"chats": []}))
    assert exports.read_export(spark, str(good)).count() == 2
    with pytest.raises(exports.ExportError):
        exports.read_export(spark, str(bad))
