"""The watcher as a stateful processor: polls by timers, once for each key, over restarts."""

import time
from datetime import datetime, timedelta

import pytest
from kelpline.streaming import watch

START = datetime(2026, 1, 1)
SCHEMAS = {"registrations": "key string, target double, spot double, ts timestamp", "quotes": "ts timestamp, spot double", "answers": "key string, target double, ok boolean, ts timestamp"}


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, watch.PROVIDER)
    yield
    spark.conf.set(name, before)


def test_rows_are_dealt_to_groups(spark):
    made = spark.createDataFrame([("a", 80.0, None, START), ("b", 1e9, 1.0, START), (None, 5.0, None, START), ("c", -1.0, None, START), ("d", 0.5, None, START)], SCHEMAS["registrations"])
    quotes = spark.createDataFrame([(START, 70.0), (START, None)], SCHEMAS["quotes"])
    rows = watch.dealt(made, quotes).collect()
    assert {(r["key"], r["range"]) for r in rows if r["kind"] == "register"} == {("a", 20), ("b", watch.LAST), ("d", 0)}
    groups = [(r["range"], r["salt"]) for r in rows if r["kind"] == "quote"]
    assert len(groups) == len(set(groups)) == (watch.LAST + 1) * watch.SALTS


def test_polls_and_restarts(spark, store, tmp_path):
    """Keys fire by their own spot, at a poll, never twice, and a failed one when it registers again; between two runs only the checkpoint is kept."""
    files = {name: str(tmp_path / name) for name in SCHEMAS}
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(files[name])

    def add(name, *rows):
        spark.createDataFrame(list(rows), SCHEMAS[name]).coalesce(1).write.mode("append").parquet(files[name])

    def run(until):
        streams = [spark.readStream.schema(SCHEMAS[name]).parquet(files[name]) for name in ("registrations", "quotes", "answers")]
        query = watch.due_alerts(watch.dealt(*streams), poll_ms=300).writeStream.format("parquet").option("path", str(tmp_path / "due")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
        end = time.time() + 100
        while time.time() < end and query.isActive and not until():
            time.sleep(0.5)
        time.sleep(3)
        assert query.exception() is None
        query.stop()

    def due():
        return sorted((r["key"], r["spot"]) for r in spark.read.schema(watch.DUE).parquet(str(tmp_path / "due")).collect()) if (tmp_path / "due" / "_spark_metadata").exists() else []

    at = lambda m: START + timedelta(minutes=m)
    add("registrations", ("now", 80.0, 79.5, at(0)), ("a", 80.0, 90.0, at(0)), ("b", 60.0, None, at(0)), ("high", 999.0, 1e6, at(0)))
    add("quotes", (at(1), 85.0))
    run(lambda: len(due()) >= 2)
    assert due() == [("high", 85.0), ("now", 79.5)]
    # A later quote reaches a; b waits on; now isn't sent again, though it registers again; an older quote that comes late changes nothing.
    add("registrations", ("now", 80.0, 70.0, at(2)), ("a", 80.0, 90.0, at(2)))
    add("quotes", (at(3), 78.0), (at(0), 10.0))
    run(lambda: len(due()) >= 3)
    assert due() == [("a", 78.0), ("high", 85.0), ("now", 79.5)]
    # Its mail failed: a may register again.
    add("answers", ("a", 80.0, False, at(4)), ("now", 80.0, True, at(4)))
    begun = time.time()
    run(lambda: time.time() > begun + 6)
    add("registrations", ("a", 80.0, 60.5, at(5)), ("now", 80.0, 60.5, at(5)))
    run(lambda: len(due()) >= 4)
    assert due() == [("a", 60.5), ("a", 78.0), ("high", 85.0), ("now", 79.5)]
