import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import feeds, model_calls
from kelpline.operators.chunks import DOCUMENTS
from kelpline.plans import index_build


def test_to_fixed(spark):
    got = spark.createDataFrame([(1.005,), (0.125,), (-0.125,), (81.99,), (float("nan"),), (None,)], "x double").select(feeds.to_fixed(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [1.0, 0.13, -0.13, 81.99, None, None]


def test_quotes(spark):
    screen = lambda **k: {"data": [{"screen_data": {"pairs_data": [k]}}]}
    rows = [
        ("chart", {"close": 81.99, "change": -0.55, "change_abs": -0.45, "currency": "eur", "update_time": 86400, "update_mode": "delayed_streaming_600"}),
        ("chart", {"close": "81.99", "change": -0.0055, "change_abs": -0.45}),
        ("chart", {"close": 81.99, "currency": "USD"}),
        ("chart", {"close": 130}),
        ("screen", screen(last="81.99", change_percent_val="-0.55%", point_value="1 = €1000", last_timestamp=86400)),
        ("screen", screen(last="81.99", change_val="-0.45", point_value="1 = $1")),
        ("contract", {"data": [{"contractName": "ICE eua Futures", "tradeTime": "08/13/26", "raw": {"lastPrice": 81.99, "priceChange": -0.45}}]}),
        ("contract", {"data": [{"contractName": "Coal", "raw": {"lastPrice": 81.99}}]}),
        ("contract", {"data": [{"lastPrice": "81.99s", "percentChange": -0.0055}]}),
        ("other", {}),
    ]
    df = spark.createDataFrame([(i, p, json.dumps(j)) for i, (p, j) in enumerate(rows)], "i int, provider string, payload string")
    got = {r["i"]: (r["spot"], r["day_change_pct"] and round(r["day_change_pct"], 2), r["as_of"], r["delay_minutes"], r["reason"]) for r in feeds.quotes(df).collect()}
    assert got[0] == (81.99, -0.55, "1970-01-02 00:00", 10, None)
    assert got[1][:2] == (81.99, -0.55) and got[2][4] == "wrong product" and got[3][4] == "out of range"
    assert got[4] == (81.99, -0.55, "1970-01-02 00:00", None, None) and got[5][4] == "wrong product"
    assert got[6] == (81.99, -0.55, "2026-08-13", None, None) and got[7][4] == "wrong product"
    assert got[8][:2] == (81.99, -0.55) and got[9][4] == "unknown provider"


def test_currency_payloads(spark):
    good = {"result": "success", "base_code": "USD", "time_last_update_utc": "Sun, 09 Aug 2026 00:00:02 +0000", "rates": {"EUR": 0.86595275, "KRW": 1412.35}}
    bad = [good | {"result": "error"}, good | {"rates": None}, good | {"rates": {"KRW": 1}}, good | {"rates": {"EUR": 1}}, good | {"rates": {"EUR": 0, "KRW": 1}}, good | {"time_last_update_utc": "x"}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate([good, *bad])] + [(9, "no json")], "i int, payload string")
    got = {r["i"]: r for r in feeds.fx_rows(df).collect()}
    assert float(got[0]["usd_per_eur"]) == pytest.approx(1 / 0.86595275, abs=1e-6) and got[0]["as_of"] == "09 Aug 2026" and got[0]["reason"] is None
    assert [got[i]["reason"] for i in (1, 2, 3, 4, 5, 6, 9)] == ["no success", "no rates", "no EUR", "no KRW", "EUR is 0", "no date", "no success"]


def test_currency_answers(spark):
    now = datetime(2026, 8, 9)
    log = lambda base, hours: [(base, q, r, now - timedelta(hours=hours)) for q, r in (("USD", 1.15), ("KRW", 1630.5))]
    rates = spark.createDataFrame(log("fresh", 1) + log("fresh", 99) + log("old", 48) + log("new", 48)[:1], "base string, quote string, rate double, fetched_at timestamp")
    fetched = spark.createDataFrame([("fresh", 9.0, 9.0), ("old", None, None), ("new", 1.2, 1700.0), ("none", None, None)], "base string, usd_per_eur double, krw_per_eur double")
    got = {r["base"]: (r["usd"], r["krw"], r["status"]) for r in feeds.fx_answer(rates, fetched, F.lit(now)).collect()}
    assert got == {"fresh": (1.15, 1630.5, "cached"), "old": (1.15, 1630.5, "stale"), "new": (1.2, 1700.0, "fetched"), "none": (1.1548, 1630.83, "fallback")}


def test_compare_requests(spark):
    ok = ("A", "limited", "why", 2916.0)
    rows = [(0, [ok, ("B", "blocked", "why", 3085.0)]), (1, [ok]), (2, [ok, (" ", "best", "x", 1.0)]), (3, [ok, ("B", "odd", "x", 1.0)]), (4, [ok, ("B", "best", " ", 1.0)]), (5, None)]
    df = spark.createDataFrame(rows, "i int, routes array<struct<key:string,status:string,status_reason:string,total_usd:double>>")
    got = {r["i"]: r for r in df.select("i", model_calls.compare_problem(F.col("routes")).alias("p"), model_calls.masked_routes(F.col("routes")).alias("m")).collect()}
    assert [got[i]["p"] for i in range(6)] == [None, "not two routes", "no key", "unknown status", "no reason", "not two routes"]
    assert [r["total_usd"] for r in got[0]["m"]] == [2916.0, None]
    block = df.filter("i = 0").select(model_calls.route_block(F.lit("odd"), F.lit(None).cast("double"), F.lit(2840.5), F.lit(67.4), F.lit(None).cast("double"))).first()[0]
    assert block == "- 상태: 운항 불가\n- 총비용: 산출 안 함(운항 불가)\n- 기본운임: $2841\n- 탄소비용(EU ETS): $67\n- 전쟁위험보험료: 산출 안 함"


def test_routed_answers(spark):
    raw = ['x {"route":"lookup","lookup":{"targetId":"made-up","why":"w"}} y', '{"route":"lookup","lookup":{"targetId":"report"}}', '{"route":"answer","answer":{"text":"t"}}', '{"route":"analysis"}', '{"route":"odd"}', "none"]
    got = [r["r"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").orderBy("i").select(model_calls.routed(F.col("raw")).alias("r")).collect()]
    assert [(r["text"], r["target"], r["problem"]) for r in got] == [("w", None, None), ("", "report", None), ("t", None, None), (None, None, "no risk engine"), (None, None, "unknown way"), (None, None, "no JSON")]
    answer = spark.createDataFrame([('{"answer":"a","used":[1,99,-1],"caveat":" "}',)], "raw string").select(model_calls.cited_answer(F.col("raw"), F.lit(2), "default").alias("r")).first()["r"]
    assert (answer["answer"], answer["used"], answer["caveat"]) == ("a", [1], "default")
    history = spark.createDataFrame([([(f"q{i}", f"a{i}") for i in range(1, 7)],), (None,)], "h array<struct<q:string,a:string>>").select(model_calls.history_block(F.col("h")).alias("t")).collect()
    assert [r["t"].split("\n")[0] for r in history] == ["Q: q3 / A: a3", ""]


def test_model_calls(spark):
    def broken(system, message, temperature):
        return {"error": "quota"} if message != "empty" else {}

    def works(system, message, temperature):
        if message == "json":
            return {"content": '{"a": 1}' if temperature == 0 else '{"a": '}
        return {"content": None if message == "empty" else message.upper()}

    asked = spark.createDataFrame([(1, "s", "hello"), (2, "s", "empty"), (3, "s", "json")], "request_id int, system string, message string").coalesce(1)
    got = {r["request_id"]: (r["content"], r["error"]) for r in model_calls.complete(asked, [broken, works]).collect()}
    assert got[1] == ("HELLO", None) and got[2][0] is None and got[3][0] == '{"a": '
    got = {r["request_id"]: (r["content"], r["error"]) for r in model_calls.complete(asked, [works], as_json=True).collect()}
    assert got[3] == ('{"a": 1}', None) and got[1][0] is None and got[1][1].startswith("no JSON")


def test_index(spark, tmp_path):
    body = "Shipping companies shall surrender allowances for each tonne emitted."
    html = "".join(f'<div class="eli-subdivision" id="art_{a}"><p class="oj-ti-art">Article {a}</p><p class="oj-sti-art">T{a}</p><p>{body}</p></div>' for a in ("3a", "3", "40", "10"))
    pages = spark.createDataFrame([("MRV", html)], "doc_key string, html string")
    documents = spark.createDataFrame(DOCUMENTS, "doc_key string, celex string, cite_base string, max_article int")
    index, report = index_build.build_index(pages, documents, lambda texts: [None if "Article 10" in t else [3.0, 4.0] for t in texts], 2)
    index_build.write_index(index, str(tmp_path / "index"))
    got = {r["art"]: r for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert set(got) == {"3", "3a"} and got["3a"]["id"] == "32015R0757#art3a" and got["3"]["cite"] == "Regulation (EU) 2015/757, Article 3"
    assert np.allclose(got["3"]["vec"], [0.6, 0.8])
    assert {(r["reason"], r["n"]) for r in report.collect()} == {("kept", 3), ("above limit", 1)}
    with pytest.raises(Exception, match="dimensions"):
        index_build.embed(spark.createDataFrame([("x", "t")], "id string, text string"), lambda t: [[0.0, 0.0]], 2).collect()


def test_rates_keep_their_digits(spark, tmp_path):
    from decimal import Context, Decimal

    payload = '{"result":"success","base_code":"USD","time_last_update_utc":"Sun, 09 Aug 2026 00:00:02 +0000","rates":{"EUR":0.8659527500000001,"KRW":1412.35}}'
    rows = feeds.fx_rows(spark.createDataFrame([("EUR", payload)], "base string, payload string"))
    r = rows.first()
    context = Context(prec=34)
    assert r["usd_per_eur"] == context.divide(Decimal(1), Decimal("0.8659527500000001")) and r["krw_per_eur"] == context.divide(Decimal("1412.35"), Decimal("0.8659527500000001"))
    now = datetime(2026, 8, 9)
    feeds.log_rates(rows, F.lit(now), str(tmp_path / "log"))
    feeds.log_rates(rows, F.lit(now + timedelta(hours=1)), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 4 and {x["quote"] for x in log.collect()} == {"USD", "KRW"}
    none = spark.createDataFrame([("EUR", None, None)], "base string, usd_per_eur double, krw_per_eur double")
    assert feeds.fx_answer(log, none, F.lit(now + timedelta(hours=2))).first()["status"] == "cached"


def test_quotes_are_rounded_and_dated(spark):
    rows = [("chart", '{"close": 81.99, "change_abs": -0.45}'), ("chart", '{"close": 81.99, "change": -0.5459, "change_abs": -0.45, "currency": "", "currency_id": "EUR"}'), ("screen", '{"data": []}'), (None, "{}")]
    got = feeds.quotes(spark.createDataFrame(rows, "provider string, payload string"), F.lit(datetime(2026, 8, 13))).collect()
    assert [(r["spot"], r["day_change_pct"], r["as_of"], r["reason"]) for r in got] == [
        (81.99, None, "2026-08-13", None), (81.99, -0.55, "2026-08-13", None), (None, None, None, "out of range"), (None, None, None, "unknown provider"),
    ]


def test_prompt_blocks(spark):
    df = spark.createDataFrame([(("A", "East", "odd", "why", None, 2840.5, 67.4, None, 0.1, 32, True, 11258.91),)], "r struct<key:string,name:string,status:string,status_reason:string,total_usd:double,freight_usd:double,carbon_usd:double,war_risk_usd:double,war_risk_rate_pct:double,lead_time_days:int,meets_deadline:boolean,distance_nm:double>")
    lines = df.select(model_calls.route_report(F.col("r")).alias("t")).first()["t"].split("\n")
    assert lines[0] == "[항로 A] East" and lines[1] == "- 상태: 운항 불가" and lines[6] == "- 전쟁위험보험료: 산출 안 함 (요율 0.1%)" and lines[7:] == ["- 해상 리드타임: 32일 / 납기 충족: 예", "- 항로 거리: 11258.91nm"]
    kinds = {f: "double" for line in model_calls.SNAPSHOT for _, f, _ in line}
    values = [float("nan") if f == "spot" else None if f == "asset" else 1.5 for f in kinds]
    schema = "s struct<" + ",".join(f"{f}:double" for f in kinds) + ">"
    text = spark.createDataFrame([(tuple(values),)], schema).select(model_calls.risk_snapshot(F.col("s"), kinds).alias("t")).first()["t"].split("\n")
    assert text[0] == "[리스크 스냅샷]" and text[1] == "- 자산: 제공되지 않음 / 현재가: 제공되지 않음 / 기준일: 1.5" and text[2] == "- 일간 변동성: 1.5 / 연율 변동성: 1.5%"
    assert text[3] == "- 80% 구간: 1.5 ~ 1.5 / 95% 구간: 1.5 ~ 1.5" and len(text) == 7


def test_failing_models_and_embedders(spark):
    def silent(system, message, temperature):
        return {"content": ""}

    asked = spark.createDataFrame([(1, "s", "m")], "request_id int, system string, message string")
    assert model_calls.complete(asked, [silent]).first()["error"] == "no content"
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return [[3.0, 4.0] for _ in texts]

    assert np.allclose(index_build._patiently(flaky, ["a"], 0.001), [[3.0, 4.0]]) and len(calls) == 3
    with pytest.raises(OSError, match="busy"):
        index_build._patiently(lambda t: (_ for _ in ()).throw(OSError("busy")), ["a"], 0.001)
    assert index_build.load_index(spark, "/nowhere/at/all")[1] == {"ready": False, "reason": "no index"}
