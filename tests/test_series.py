"""Long series cut into stretches, against loops over the whole; cuts of texts and scanned files."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.operators import series
from kelpline.sources import files

START = datetime(2026, 1, 1)


def test_as_of(spark):
    rng = random.Random(1)
    at = lambda: START + timedelta(minutes=30 * rng.randrange(2000))
    right = [(rng.choice("abc"), at(), i, rng.choice([None, float(i)])) for i in range(300)] + [("d", START, 1, 1.0), ("a", None, 2, 2.0)]
    left = [(i, rng.choice("abcde"), at()) for i in range(300)] + [(900, "d", START), (901, "d", START - timedelta(days=9)), (902, "a", None)]
    l, r = spark.createDataFrame(left, "id long, k string, at timestamp"), spark.createDataFrame(right, "k string, at timestamp, tie long, v double")
    got = {x["id"]: (x["v"], x["tie"]) for x in series.as_of(l, r, ["k"], "at", F.to_date("at"), "tie", ["v", "tie"]).collect()}
    for key, k, t in left:
        seen = sorted((x[1], x[2], x[3]) for x in right if x[0] == k and x[1] is not None and t is not None and x[1] <= t)
        assert got[key] == ((seen[-1][2], seen[-1][1]) if seen else (None, None)), key
    assert len(got) == len(left)


def test_variance_over_stretches(spark):
    rng = random.Random(2)
    rows = [(k, START + timedelta(days=3 * i), round(rng.uniform(50, 90), 2)) for k in "ab" for i in range(70)] + [("one", START, 5.0), ("a", START + timedelta(days=1), -1.0), ("a", None, 7.0)]
    df = spark.createDataFrame(rows, "k string, at timestamp, close double")
    for stretch in (F.date_format("at", "yyyy-MM"), F.to_date("at"), F.lit(0)):
        got = {(r["k"], r["at"]): r["variance"] for r in series.ewma_variance(df, "k", "at", "close", stretch).collect()}
        for k in "ab":
            own = sorted((t, c) for x, t, c in rows if x == k and t is not None and c > 0)
            v = None
            for (_, before), (t, c) in zip(own, own[1:]):
                r2 = math.log(c / before) ** 2
                v = r2 if v is None else series.DECAY * v + (1 - series.DECAY) * r2
                assert abs(got.pop((k, t)) - v) < 1e-12
        assert not got


def test_bands_and_verdicts(spark):
    df = spark.createDataFrame([(100.0, 0.0001)], "close double, variance double")
    r = series.price_bands(df, "close", "1m").first()
    assert round(r["low_80"], 4) == round(100 * math.exp(-1.2815515655446004 * math.sqrt(0.0021)), 4) and r["low_95"] < r["low_80"] < 100 < r["high_80"] < r["high_95"]
    rows = [(1, 5, 1.0, 2.0, 1.5), (6, 5, 1.0, 2.0, 1.5), (5, 5, 1.0, 2.0, 2.0), (1, 5, 1.0, 2.0, 2.1), (1, 5, 1.0, 2.0, None)]
    got = [x["verdict"] for x in series.range_breaches(spark.createDataFrame(rows, "at int, deadline int, low double, high double, spot double").coalesce(1)).collect()]
    assert got == ["valid", "undecidable", "valid", "recalculate", "undecidable"]


def test_cuts(spark):
    df = spark.createDataFrame([("é" * 13000,), (None,)], "t string").coalesce(1)
    assert [[len(r[0]), len(r[1])] for r in df.select(T.cut(F.col("t"), T.MESSAGE_MAX), T.cut(F.col("t"), T.QUESTION_MAX)).collect()] == [[12000, 500], [0, 0]]


def test_scanned_files(spark):
    def reader(data):
        if b"broken" in data:
            raise ValueError("damaged")
        return data.decode().removeprefix("%PDF-")

    df = spark.createDataFrame([("a.pdf", b"%PDF-text"), ("b.PDF", b"%PDF- \n"), ("c.pdf", b"%PDF-broken"), ("d.pdf", b"no"), ("e.txt", b"  ")], "path string, content binary")
    got = {r["path"]: (r["text"], r["status"]) for r in files.extract_text(df, reader).collect()}
    assert got == {"a.pdf": ("text", "ok"), "b.PDF": (" \n", "scanned"), "c.pdf": (None, "parse error"), "d.pdf": (None, "bad magic"), "e.txt": ("  ", "ok")}
    assert {r["status"] for r in files.extract_text(df).collect()} == {"no pdf reader", "bad magic", "ok"}

