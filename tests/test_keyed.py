"""Stored tables under merges, replays and broken runs; price answers, the rate log and the alert watcher on them."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import feeds, market
from kelpline.sources import keyed
from kelpline.streaming import alerts as stream

NOW = datetime(2026, 8, 7, 12)
def part():
    return F.col("k") % 4


def newest(held, rows):
    return held.join(rows.select("k"), "k", "left_anti").unionByName(rows)


def table(spark, path):
    return {r["k"]: r["v"] for r in keyed.load(spark, path).collect()}


def test_merges_touch_their_parts_only(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert keyed.load(spark, path) is None and not keyed.is_done(spark, path, "a")
    assert keyed.merge(rows(*((i, "a") for i in range(8))), path, part(), newest, "a")
    assert keyed.merge(rows((1, "b"), (5, "b"), (9, "b")), path, part(), newest, "b")
    assert not keyed.merge(rows((1, "x")), path, part(), newest, "b") and not keyed.merge(rows((1, "x")), path, part(), newest, "a")
    assert table(spark, path) == {i: "b" if i in (1, 5, 9) else "a" for i in range(8)} | {9: "b"}
    assert [p.name for p in sorted((tmp_path / "t" / "v=1").glob("_part=*"))] == ["_part=1"]
    before = keyed.load(spark, path)
    assert keyed.merge(rows((2, "c")), path, part(), newest, "c") and keyed.merge(rows((3, "d")), path, part(), lambda held, new: held.limit(0), "d")
    assert before.count() == 9 and table(spark, path) == {0: "a", 4: "a", 2: "c", 6: "a", 1: "b", 5: "b", 9: "b"}
    for i in range(5):
        keyed.merge(rows((1, f"e{i}")), path, part(), newest, f"e{i}")
    assert table(spark, path)[1] == "e4" and len(list((tmp_path / "t" / "commits").glob("[0-9]*"))) == keyed.KEEP + 1
    assert keyed.merge(rows().limit(0), path, part(), newest, "none") and table(spark, path)[1] == "e4"
    with pytest.raises(ValueError, match="null"):
        keyed.merge(rows((None, "x")), path, part(), newest, "null")


def test_a_merge_that_breaks_before_its_commit_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k long, v string")
    write, calls = keyed.Folder.write, []

    def breaks(self, name, text):
        calls.append(name)
        if len(calls) == 1:  # the data are written, the commit isn't
            raise OSError("down")
        write(self, name, text)
        if len(calls) == 2:  # the commit is written, its token isn't noted
            raise OSError("down")

    monkeypatch.setattr(keyed.Folder, "write", breaks)
    for _ in range(2):
        with pytest.raises(OSError, match="down"):
            keyed.merge(rows, path, part(), DataFrame.unionByName, "a")
    assert not keyed.merge(rows, path, part(), DataFrame.unionByName, "a")
    assert keyed.merge(rows.withColumn("k", F.lit(2).cast("long")), path, part(), DataFrame.unionByName, "b")
    assert not keyed.merge(rows, path, part(), DataFrame.unionByName, "a") and table(spark, path) == {1: "a", 2: "a"}


def test_a_second_writer_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k long, v string")

    def meanwhile(held, new):
        keyed.Folder(spark, path).write("commits/0", "other")
        return new

    with pytest.raises(Exception, match="commits/0"):
        keyed.merge(rows, path, part(), meanwhile, "a")


def test_rates_are_logged_once(spark, tmp_path):
    rows = spark.createDataFrame([("EUR", 1.1, 1500.0, None), ("USD", None, None, "no rates")], "base string, usd_per_eur double, krw_per_eur double, reason string")
    path, day = str(tmp_path / "log"), timedelta(days=1)
    assert feeds.log_rates_once(rows, F.lit(NOW), path, "run 1") and not feeds.log_rates_once(rows, F.lit(NOW), path, "run 1")
    assert feeds.log_rates_once(rows, F.lit(NOW + day), path, "run 2") and feeds.log_rates_once(rows, F.lit(NOW + day / 24), path, "run 3")
    log = keyed.load(spark, path)
    assert log.count() == 6 and log.filter(F.to_date("fetched_at") == F.lit(NOW.date())).count() == 4
    none = spark.createDataFrame([("EUR", None, None)], "base string, usd_per_eur double, krw_per_eur double")
    assert feeds.fx_answer(log, none, F.lit(NOW + day * 1.5)).first()["status"] == "cached"


def test_price_answers(spark, tmp_path):
    path = str(tmp_path / "prices")
    day = lambda d: date(2026, 8, d)
    stored = [("fresh", day(d), 70.0 + d, NOW - timedelta(minutes=5 if d == 6 else 500)) for d in range(1, 7)]
    stored += [("old", day(5), 80.0, NOW - timedelta(hours=9)), ("old", day(6), 82.0, NOW - timedelta(hours=8)), ("lone", day(6), 75.0, NOW), ("zero", day(5), 1.0, NOW - timedelta(hours=9))]
    keyed.merge(spark.createDataFrame(stored, market.PRICES), path, F.lit(0), DataFrame.unionByName, "first")
    seconds = lambda *days: [int((datetime(2026, 8, d, 9) - datetime(1970, 1, 1)).total_seconds()) for d in days]
    charts = [("fresh", seconds(6, 7), [1.0, 2.0]), ("old", None, None), ("lone", seconds(5, 6, 7), [None, 76.0, 77.0]), ("new", seconds(1, 2, 3, 4, 5, 6, 7), [float(i) for i in range(10, 17)]), ("zero", seconds(6, 7), [0.0, 3.0]), ("none", seconds(7), [3.0])]
    quotes = spark.createDataFrame(charts, "key string, times array<long>, closes array<double>")
    got = {r["key"]: (r["status"], r["is_live"], r["spot"], r["day_change_pct"] and round(r["day_change_pct"], 4), r["as_of"], r["closes"]) for r in market.price_answers(quotes, path, F.lit(NOW), "second").collect()}
    assert got == {
        "fresh": ("cached", True, 76.0, round(100 / 75, 4), day(6), [72.0, 73.0, 74.0, 75.0, 76.0]), "old": ("stale", False, 82.0, 2.5, day(6), [80.0, 82.0]), "lone": ("fetched", True, 77.0, round(100 / 76, 4), day(7), [76.0, 77.0]),
        "new": ("fetched", True, 16.0, round(100 / 15, 4), day(7), [12.0, 13.0, 14.0, 15.0, 16.0]), "zero": ("unavailable", False, None, None, None, None), "none": ("unavailable", False, None, None, None, None),
    }
    table = lambda: sorted((r["key"], r["price_date"], r["close"]) for r in keyed.load(spark, path).collect())
    after = table()
    assert len(after) == len(stored) + 2 and ("new", day(7), 16.0) in after and ("lone", day(7), 77.0) in after
    again = {r["key"]: r["status"] for r in market.price_answers(quotes, path, F.lit(NOW), "second").collect()}
    assert again["lone"] == "cached" and again["new"] == "fetched" and table() == after
    later = {r["key"]: r for r in market.price_answers(quotes.filter("key = 'new'").withColumn("closes", F.transform("closes", lambda x: x + 1)), path, F.lit(NOW + timedelta(hours=1)), "third").collect()}
    assert later["new"]["spot"] == 17.0 and ("new", day(7), 17.0) in table() and len(table()) == len(after)


SCHEMA = "key string, target double, spot double"


def watch(spark, tmp_path, checkpoint, price, send, rows=()):
    if rows:
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = stream.run_batches(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "alerts"), str(tmp_path / checkpoint), lambda: price, send, availableNow=True)
    try:
        q.awaitTermination(120)
    except Exception as e:  # a sender that is down
        assert "down" in str(e)
    return {r["key"]: r["status"] for r in keyed.load(spark, str(tmp_path / "alerts")).collect()} if (tmp_path / "alerts" / "commits").exists() else {}


def test_the_table_outlives_the_checkpoint(spark, tmp_path):
    sent = []

    def send(due):
        sent.extend(r["key"] for r in due.collect())
        return due.select("key", (F.col("key") != "fails").alias("ok"))

    assert watch(spark, tmp_path, "cp1", 70.0, send, [("a", 80.0, None), ("fails", 75.0, None), ("waits", 60.0, None)]) == {"a": "sent", "fails": "failed", "waits": "pending"}
    # A new checkpoint reads the old registrations again: a is not sent twice, fails is taken up, b is stored.
    assert watch(spark, tmp_path, "cp2", 65.0, send, [("b", 50.0, None)]) == {"a": "sent", "fails": "failed", "waits": "pending", "b": "pending"}
    assert sorted(sent) == ["a", "fails", "fails"]
    assert watch(spark, tmp_path, "cp2", 55.0, send, [("c", 10.0, None)])["waits"] == "sent" and sent.count("waits") == 1


def test_claims_of_a_lost_checkpoint_are_kept(spark, tmp_path):
    calls = []

    def breaks(due):
        calls.append(sorted(r["key"] for r in due.collect()))
        raise RuntimeError("down")

    def send(due):
        calls.append(sorted(r["key"] for r in due.collect()))
        return due.select("key", F.lit(True).alias("ok"))

    assert watch(spark, tmp_path, "cp1", 70.0, breaks, [("a", 80.0, None), ("b", 60.0, None)]) == {}
    # Its mail may have gone: a stays claimed, and b wasn't lost.
    assert watch(spark, tmp_path, "cp2", 70.0, send, [("c", 90.0, None)]) == {"a": "sending", "b": "pending", "c": "sent"}
    assert calls == [["a"], ["c"]]


def test_a_batch_that_was_done_is_not_done_again(spark, tmp_path):
    sent = []

    def send(due):
        sent.extend(r["key"] for r in due.collect())
        return due.select("key", F.lit(True).alias("ok"))

    first = watch(spark, tmp_path, "cp", 70.0, send, [("a", 80.0, None)])
    for f in (tmp_path / "cp" / "commits").iterdir():  # the stream forgets that its batch ended
        f.unlink()
    assert watch(spark, tmp_path, "cp", 70.0, send) == first == {"a": "sent"} and sent == ["a"]
