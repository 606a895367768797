import io
import zipfile
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from kelpline.operators import alerts, chunks, market
from kelpline.sources import files, seeds
from kelpline.streaming import alerts as stream

NOW = datetime(2026, 8, 7, 12)


def test_chunker(spark):
    long = "The obligation applies to ships above five thousand gross tonnage."
    html = (
        f'<div class="eli-subdivision" id="art_2"><p class="oj-ti-art">Article 2</p><p class="oj-sti-art">Scope &amp; more</p><div><p>{long}</p></div></div>'
        f'<div class="eli-subdivision" id="art_3gb"><p class="title-article-norm">Section</p><p>{long}</p></div>'
        f'<div class="eli-subdivision" id="art_2.tit_1">x</div><div class="eli-subdivision" id="art_x">x</div>'
        f'<div class="eli-subdivision" id="art_99"><p>{long}</p></div><div class="eli-subdivision" id="art_4"><p>deleted</p></div>'
        f'<div class="eli-subdivision" id="art_2"><p>{long} again</p></div><div class="eli-subdivision" id="art_5"><div><p>{long}'
    )
    pages = spark.createDataFrame([("D", html), ("E", None)], "doc_key string, html string")
    limits = spark.createDataFrame([("D", 33), ("E", 33)], "doc_key string, max_article int")
    articles, dropped = chunks.chunk(pages, limits)
    got = {r["art"]: (r["num"], r["suffix"], r["heading"], r["title"], r["text"]) for r in articles.collect()}
    assert got == {"2": (2, "", "Article 2", "Scope & more", long), "3gb": (3, "gb", "Article 3gb", "", long), "5": (5, "", "Article 5", "", long)}
    assert sorted((r["art"], r["reason"]) for r in dropped.collect()) == [("4", "empty body"), ("99", "above limit"), ("x", "number format")]
    assert [r["art"] for r in chunks.first_n(articles, 2).orderBy("num").collect()] == ["2", "3gb"]


def test_cache_decisions(spark):
    at = lambda minutes: NOW - timedelta(minutes=minutes)
    history = spark.createDataFrame([("fresh", 2, at(10)), ("edge", 2, at(30)), ("old", 2, at(120)), ("one", 1, at(1))], "k string, rows long, newest_at timestamp")
    quotes = spark.createDataFrame([("edge", 79.0), ("old", None), ("one", None), ("new", 80.0)], "k string, spot double")
    got = {r["k"]: (r["status"], r["is_live"]) for r in market.cache_decision(history, quotes, F.lit(NOW), ["k"]).collect()}
    assert got == {"fresh": ("cached", True), "edge": ("fetched", True), "old": ("stale", False), "one": ("unavailable", False), "new": ("fetched", True)}


def test_closes_and_upsert(spark):
    days = [(date(2026, 8, d), 74.0 + d, NOW + timedelta(hours=d), d) for d in range(1, 7)]
    prices = spark.createDataFrame([("x", *d) for d in days], "k string, price_date date, close double, fetched_at timestamp, tie int")
    assert market.recent_closes(prices, ["k"]).first()["closes"] == [76.0, 77.0, 78.0, 79.0, 80.0]
    newer = spark.createDataFrame([("x", date(2026, 8, 6), 99.0, NOW + timedelta(days=9), 1)], prices.schema)
    after = market.upsert(prices, newer, ["k", "price_date"], "fetched_at", "tie")
    assert after.count() == 6 and after.filter("close = 99").count() == 1
    change = market.with_day_change(prices, ["k"]).orderBy("price_date").collect()
    assert change[0]["day_change_pct"] is None and round(change[1]["day_change_pct"], 4) == round(100 / 75, 4)


def test_failover(spark):
    rows = [("a", 1, "p", 10.0), ("a", 2, "q", 81.99), ("a", 3, "r", 82.0), ("b", 1, "p", None), ("b", 2, "q", float("nan"))]
    got = {r["k"]: (r["provider"], r["spot"], r["attempts"], r["is_live"]) for r in market.first_provider(spark.createDataFrame(rows, "k string, priority int, provider string, spot double"), ["k"]).collect()}
    assert got == {"a": ("q", 81.99, ["p"], True), "b": (None, None, ["p", "q"], False)}


def test_alert_states(spark):
    register = lambda *rows: spark.createDataFrame(list(rows), "key string, target double, spot double")
    state = spark.createDataFrame([], "key string, target double, status string")
    state = alerts.state_step(state, register(("a", 80.0, 80.0), ("b", 70.0, 75.0), ("c", 60.0, None), ("bad", -1.0, 1.0)), None)
    assert {r["key"]: r["status"] for r in state.collect()} == {"a": "sending", "b": "pending", "c": "pending"}
    state = alerts.delivered(state, spark.createDataFrame([("a", False)], "key string, ok boolean"))
    state = alerts.state_step(state, register(("b", 70.0, 1.0)), 70.0)
    assert {r["key"]: r["status"] for r in state.collect()} == {"a": "failed", "b": "sending", "c": "pending"}
    state = alerts.delivered(state, spark.createDataFrame([("b", True)], "key string, ok boolean"))
    state = alerts.state_step(state, register(("a", 80.0, 90.0), ("b", 70.0, 1.0)), None)
    assert {r["key"]: r["status"] for r in state.collect()} == {"a": "pending", "b": "sent", "c": "pending"}
    emails = spark.createDataFrame([(" A@b.co ",), ("a@b",), ("a b@c.de",)], "e string")
    assert [r[0] for r in emails.select(alerts.is_email(F.col("e"))).collect()] == [True, False, False]


def test_stream_fires_as_the_batch_does(spark, tmp_path):
    start = datetime(2026, 1, 1)
    made = [(f"k{i}|x", 60.0 + i, start + timedelta(minutes=7 * i)) for i in range(12)]
    quotes = [(start + timedelta(minutes=13 * i), i, 75.0 - (i * 7) % 13) for i in range(30)]
    registrations = spark.createDataFrame(made, "key string, target double, registered_at timestamp")
    ticks = alerts.polled(spark.createDataFrame(quotes, "ts timestamp, tie int, spot double"))
    batch = {r["key"]: r["spot"] for r in alerts.fires(registrations, ticks).collect() if r["fired_at"] is not None}
    dealt = registrations.select("key").distinct().crossJoin(ticks).select("key", F.lit("quote").alias("kind"), F.col("tick").alias("ts"), F.lit(None).cast("double").alias("target"), "spot")
    changes = registrations.select("key", F.lit("register").alias("kind"), F.col("registered_at").alias("ts"), "target", F.lit(None).cast("double").alias("spot")).unionByName(dealt)
    changes.write.parquet(str(tmp_path / "in"))
    got = stream.watched(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")))
    q = got.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["key"]: r["spot"] for r in spark.sql("select * from fired").collect()} == batch
    assert batch


def test_watcher_batches(spark, tmp_path):
    schema = "key string, target double, spot double"
    spark.createDataFrame([("a", 80.0, None), ("b", 60.0, None)], schema).write.parquet(str(tmp_path / "in"))
    stream_in = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.run_batches(stream_in, str(tmp_path / "alerts"), str(tmp_path / "cp"), lambda: 70.0, lambda due: due.select("key", F.lit(True).alias("ok")), availableNow=True)
    q.awaitTermination(120)
    assert {r["key"]: r["status"] for r in spark.read.parquet(str(tmp_path / "alerts/v=0")).collect()} == {"a": "sent", "b": "pending"}


def _zip(**entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data in entries.items():
            z.writestr(name.replace("__", "/").replace("_X", ".xml"), data)
    return held.getvalue()


def test_files(spark):
    section = lambda t: f"<sec><p><run><t>{t}</t></run></p><p> </p><tbl><p><t>in</t><p><t>ner</t></p></p></tbl></sec>"
    rows = [
        ("a.txt", " 항만 \n x".encode()), ("b.txt", b"\xff\xfe"), ("c.md", b"# t"), ("d.hwp", b"x"), ("e.xlsx", b"x"), ("f.docx", b"no zip"), ("g.txt", b""),
        ("h.docx", _zip(word__document_X="<d><p><t>one</t></p><tbl><p><t>two</t></p></tbl></d>")),
        ("i.hwpx", _zip(Contents__section10_X=section("ten"), Contents__section2_X=section("two"))),
        ("j.hwpx", _zip(Contents__section0_X="<!DOCTYPE x><p/>")), ("k.pdf", b"%PDF-1.4"), ("l.hwpx", _zip(other="x")),
    ]
    got = {r["path"]: (r["text"], r["status"]) for r in files.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.txt"] == (" 항만 \n x", "ok") and got["c.md"] == ("# t", "ok")
    assert got["h.docx"] == ("one\ntwo", "ok") and got["i.hwpx"] == ("two\ninner\nten\ninner", "ok")
    assert {k: v[1] for k, v in got.items() if v[0] is None} == {
        "b.txt": "parse error", "d.hwp": "hwp", "e.xlsx": "unsupported", "f.docx": "bad magic", "g.txt": "empty", "j.hwpx": "parse error", "k.pdf": "no pdf reader", "l.hwpx": "parse error",
    }


def test_seeds(spark):
    assert {(r["role"], r["ets_applies"]): r["count"] for r in seeds.ports(spark).groupBy("role", "ets_applies").count().collect()} == {("origin", False): 18, ("destination", True): 30, ("destination", False): 2}
    assert {r["route_key"]: r["status"] for r in seeds.routes(spark).collect()} == {"A": "limited", "B": "blocked", "D": "limited", "C": "best"}
    assert seeds.hazard_zones(spark).filter("level = 'SAFE'").count() == 1


def test_watcher_ticks_when_only_the_price_moves(spark, tmp_path):
    """No registration comes after the first batch; the price falls, and the alert is sent once. A batch that runs again doesn't send again."""
    import time

    schema = "key string, target double, spot double"
    spark.createDataFrame([("a", 80.0, None)], schema).write.parquet(str(tmp_path / "in"))
    prices, sent = iter([90.0, 85.0, 79.0]), []

    def send(due):
        sent.extend(r["key"] for r in due.collect())
        return due.select("key", F.lit(True).alias("ok"))

    ticks = stream.clock(spark)
    q = stream.run_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "alerts"), str(tmp_path / "cp"), lambda: next(prices, 70.0), send, ticks=ticks, processingTime="1 second")
    until = time.time() + 90
    while not sent and time.time() < until and q.isActive:
        time.sleep(0.5)
    time.sleep(4)
    q.stop()
    assert sent == ["a"]


def test_claims_of_a_broken_batch_are_not_sent_again(spark, tmp_path):
    schema, calls = "key string, target double, spot double", []
    spark.createDataFrame([("a", 80.0, None)], schema).write.parquet(str(tmp_path / "in"))

    def breaks(due):
        calls.append([r["key"] for r in due.collect()])
        raise RuntimeError("down")

    def works(due):
        calls.append([r["key"] for r in due.collect()])
        return due.select("key", F.lit(True).alias("ok"))

    for send in (breaks, works):
        q = stream.run_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "alerts"), str(tmp_path / "cp"), lambda: 70.0, send, availableNow=True)
        try:
            q.awaitTermination(120)
        except Exception as e:  # the first run's failure
            assert "down" in str(e)
    assert calls == [["a"]] and spark.read.parquet(str(tmp_path / "alerts/v=0")).first()["status"] == "sending"


def test_failed_keys_in_the_stream(spark, tmp_path):
    t = lambda m: NOW + timedelta(minutes=m)
    rows = [("k", "register", t(0), 80.0, 90.0), ("k", "quote", t(1), None, 79.0), ("k", "failed", t(2), None, None), ("k", "quote", t(3), None, 60.0), ("k", "register", t(4), 80.0, 90.0), ("k", "quote", t(5), None, 70.0)]
    spark.createDataFrame(rows, "key string, kind string, ts timestamp, target double, spot double").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = stream.watched(spark.readStream.schema("key string, kind string, ts timestamp, target double, spot double").parquet(str(tmp_path / "in")))
    q = got.writeStream.format("memory").queryName("failures").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["spot"] for r in spark.sql("select * from failures").collect()] == [79.0, 70.0]


def test_damaged_files(spark):
    nested = _zip(word__document_X="<d><p><t>outer</t><box><p><t>inner</t></p></box></p></d>")
    good = bytearray(_zip(word__document_X="<d>" + "<p><t>x</t></p>" * 50 + "</d>"))
    encrypted, method = bytearray(good), bytearray(good)
    for at in (6, good.index(b"PK\x01\x02") + 8):
        encrypted[at] |= 1
    for at in (8, good.index(b"PK\x01\x02") + 10):
        method[at] = 77
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<d>" + " " * (files.MAX_UNPACKED + 1) + "</d>")
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<d>" + "<p><t>abc</t></p>" * 500 + "</d>")
    broken = bytearray(deflated.getvalue())
    broken[60:90] = b"\xff" * 30
    rows = [("a.docx", nested), ("b.docx", bytes(encrypted)), ("c.docx", bytes(method)), ("d.docx", held.getvalue()), ("e.docx", bytes(broken)), ("f.docx", bytes(good))]
    got = {r["path"]: (r["status"], r["text"]) for r in files.extract_text(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.docx"] == ("ok", "outer\ninner") and got["f.docx"][0] == "ok"
    assert [got[f"{k}.docx"][0] for k in "bcde"] == ["parse error"] * 4


def test_repeated_articles_are_not_dropped(spark):
    body = "The obligation applies to ships above five thousand gross tonnage."
    part = lambda art, text: f'<div class="eli-subdivision" id="art_{art}"><p>{text}</p></div>'
    html = part("2", "gone") + part("2", body) + part("2", "empty again") + part("2", body) + part("99", body) + part("99", body)
    articles, dropped = chunks.chunk(spark.createDataFrame([("D", html)], "doc_key string, html string"), spark.createDataFrame([("D", 33)], "doc_key string, max_article int"))
    assert [r["place"] for r in articles.collect()] == [1]
    assert sorted((r["art"], r["reason"]) for r in dropped.collect()) == [("2", "empty body"), ("99", "above limit"), ("99", "above limit")]


def test_cached_answers(spark):
    at = lambda minutes: NOW - timedelta(minutes=minutes)
    entries = spark.createDataFrame([("a", "old", at(10)), ("b", "old", at(90)), ("c", "old", at(90))], "k string, value string, stored_at timestamp")
    loaded = spark.createDataFrame([("a", "new", None), ("b", "new", None), ("c", None, "HTTP 500"), ("d", None, "HTTP 404"), ("e", "new", None)], "k string, new_value string, error string")
    got = {r["k"]: tuple(r)[1:] for r in market.cached_answer(entries, loaded, F.lit(NOW), ["k"], 3600, F.lit("fixed")).collect()}
    assert got == {"a": ("old", "cached", True, None), "b": ("new", "loaded", True, None), "c": ("old", "stale", False, "HTTP 500"), "d": ("fixed", "fallback", False, "HTTP 404"), "e": ("new", "loaded", True, None)}
    rows = spark.createDataFrame([(1, 3), (2, 9), (3, 9)], "id int, day int")
    assert market.latest_overall(rows, "day", "id").first()["id"] == 3 and market.latest_overall(rows.limit(0), "day", "id").count() == 0
