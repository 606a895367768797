import pytest
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.functions import vectors as V
from kelpline.operators import market, retrieval, routes
from kelpline.plans.queries import glossary_terms, weighted_terms


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_tokens(spark):
    assert value(spark, T.tokenize(F.lit("The État of EU-ETS, a x 항만 " + "y" * 33))) == ["tat", "eu", "ets", "항만"]
    assert value(spark, T.tokenize(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>A &amp;lt;b&amp;gt;</p><br/>c", "A <b>\nc"),
        ("<script>x</p></script>a&nbsp;b<!-- c -->", "a b"),
        ("&#x41;&#66;&#x1F600;&unknown;z", "AB😀 z"),
        ("&#x110000;q", "q"),
        ("a\u00a0\t b", "a b"),
        (None, ""),
    ],
)
def test_html_text(spark, html, text):
    assert value(spark, T.html_text(F.lit(html).cast("string"))) == text


def test_model_answers(spark):
    assert value(spark, T.cited_numbers(F.lit("[2] x [1] [9] [2] [0]"), F.lit(4))) == [1, 2]
    assert value(spark, T.used_numbers(F.array(*[F.lit(x) for x in (1, 99, -1, None, 1)]), F.lit(2))) == [1]
    assert value(spark, T.salvage_json(F.lit('say {"a": 1} ok'))) == '{"a": 1}'
    assert value(spark, T.salvage_json(F.lit("{no json}"))) is None
    assert value(spark, T.normal_refusal(F.lit("x " + T.NOT_FOUND + " y"))) == T.NOT_FOUND
    assert value(spark, T.clean_query(F.lit('\n  Query: "port of call"\nmore'), F.lit("q"))) == 'port of call'
    assert value(spark, T.citation_excerpt(F.lit("x" * 401))) == "x" * 400 + "…"
    assert value(spark, T.citation_excerpt(F.lit(None).cast("string"))) == ""
    assert value(spark, T.allowed_id(F.lit("made-up"), ["report"])) is None


def test_glossary(spark):
    assert value(spark, glossary_terms(F.lit("모니터링 계획 ETS"))) == ["monitoring", "plan", "ets"]
    got = value(spark, weighted_terms(F.lit("배출권"), F.lit("allowances price")))
    assert [(r["term"], r["weight"]) for r in got] == [("allowances", 1.0), ("price", 0.1)]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0))
    assert value(spark, V.dot(a, b)) == 3.0
    assert value(spark, V.unit(a)) == [0.6, 0.8]
    assert value(spark, V.unit(F.array(F.lit(0.0)))) == [0.0]
    assert value(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert value(spark, V.blend(a, F.lit(None).cast("array<double>"))) == [3.0, 4.0]


def test_min_max(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0), ("b", 0.5), ("b", 0.5), ("c", 0.0), ("c", 1e-12)], "q string, x double")
    got = [tuple(r) for r in rows.select("q", "x", retrieval.min_max(F.col("x"), ["q"], 0.0).alias("n"), retrieval.min_max(F.col("x"), ["q"], 1.0).alias("s")).collect()]
    assert sorted(got) == [("a", 10.0, 0.0, 0.0), ("a", 20.0, 0.5, 0.5), ("a", 30.0, 1.0, 1.0), ("b", 0.5, 0.0, 1.0), ("b", 0.5, 0.0, 1.0), ("c", 0.0, 0.0, 0.0), ("c", 1e-12, 0.0, 1.0)]
    assert value(spark, retrieval.fuse(F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)
    assert [value(spark, retrieval.clamp_k(F.lit(k).cast("int"))) for k in (None, 0, 3, 99, -2)] == [4, 4, 3, 10, 1]


def test_numbers_and_dates(spark):
    assert [value(spark, market.number(F.lit(x))) for x in ("€1,234.5", "81.99s", "1e5", "1-2", "")] == [1234.5, 81.99, 15.0, None, None]
    assert [value(spark, market.delay_minutes(F.lit(x))) for x in ("delayed_streaming_600", "streaming", "odd")] == [10, 0, None]
    assert value(spark, market.short_date(F.lit("08/13/26"))) == "2026-08-13"
    assert value(spark, market.utc_text(F.lit(0))) is None
    assert value(spark, market.utc_text(F.lit(86400), False)) == "1970-01-02"
    assert value(spark, market.rfc_date(F.lit("Sun, 09 Aug 2026 00:00:02 +0000"))) == "09 Aug 2026"
    usd, krw = market.cross_rates(F.lit("0.8659527500000001").cast("decimal(18,16)"), F.lit("1412.35").cast("decimal(18,8)"))
    assert float(value(spark, usd)) == pytest.approx(1.15479741, abs=1e-6)
    assert float(value(spark, krw)) == pytest.approx(1630.98, abs=0.01)
    assert value(spark, market.cross_rates(F.lit(0).cast("decimal(18,16)"), F.lit(1).cast("decimal(18,8)"))[0]) is None
    assert value(spark, market.day_change_pct(F.lit(80.0), F.lit(0.0))) is None
    assert value(spark, market.resolved_change(F.lit(5.0), F.lit(1.0), F.lit(101.0))) == pytest.approx(1.0)
    assert value(spark, market.resolved_change(F.lit(0.02), F.lit(None).cast("double"), F.lit(101.0), "derived")) == pytest.approx(2.0)
    pairs = market.zipped_closes(F.array(*map(F.lit, (1, 2, 3))), F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)))
    assert [tuple(p) for p in value(spark, pairs)] == [(1, 1.0), (3, 3.0)]


def test_points_and_lanes(spark):
    assert not value(spark, routes.valid_point(F.lit(999.0), F.lit(1.0)))
    assert not value(spark, routes.valid_point(F.lit(float("nan")), F.lit(1.0)))
    assert not value(spark, routes.valid_restrictions(F.array(F.lit("nowhere"))))
    assert value(spark, routes.lat_lng(F.array(F.array(F.lit(10.0), F.lit(53.5))))) == [[53.5, 10.0]]
    trips = spark.createDataFrame([(1, 129.04, 35.1, 10.0, 53.55), (2, 999.0, 0.0, 0.0, 0.0)], "trip_id long, from_lng double, from_lat double, to_lng double, to_lat double")
    got = {}
    for r in routes.legs(trips).collect():
        got.setdefault((r["trip_id"], r["lane"]), []).append(r["leg"])
    assert {k: len(v) for k, v in got.items()} == {(1, "A"): 2, (1, "B"): 1, (1, "C"): 1, (1, "D"): 3}
    totals = spark.createDataFrame([(1, "A", 5.0), (1, "A", 6.0), (1, "B", None)], "trip_id long, lane string, nm double")
    assert sorted((r["lane"], r["nm"], r["status"], r["all_failed"]) for r in routes.lane_totals(totals).collect()) == [("A", 11.0, "ok", False), ("B", None, "no_route", False)]


def test_shortest_paths(spark):
    edges = [("a", "b", 1.0, None), ("b", "c", 1.0, "suez"), ("a", "c", 5.0, None)]
    asked = spark.createDataFrame([(1, "a", "c", []), (2, "a", "c", ["suez"]), (3, "a", "z", [])], "request_id long, source string, target string, restrictions array<string>")
    assert {r["request_id"]: (r["nm"], r["path"]) for r in routes.shortest_paths(asked, edges).collect()} == {1: (2.0, ["a", "b", "c"]), 2: (5.0, ["a", "c"]), 3: (None, None)}
