"""Every registered query that has an SQL twin, against it."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from kelpline.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{DATA}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    left = sorted(tuple(map(plain, r)) for r in got.collect())
    right = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert left == right


def test_files_come_back(spark):
    rows = QUERIES["extract_text"](spark, DATA)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in rows.collect():
        number, kind = r["path"].split(".")
        want = texts[int(number)]
        assert r["status"] == "ok"
        assert r["text"] == (want if kind == "txt" else "\n".join(x.strip() for x in want.split("\n") if x.strip()) if kind == "hwpx" else want.strip())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
