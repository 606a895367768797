"""Seeded dimensions: ports, lanes' prices, and hazard zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code | name | country | latitude | longitude | role | emissions trading applies.
PORTS = """
    KRPUS | 부산항 | KR | 35.1 | 129.04 | origin | false
    KRINC | 인천항 | KR | 37.45 | 126.6 | origin | false
    KRKAN | 광양항 | KR | 34.91 | 127.75 | origin | false
    KRUSN | 울산항 | KR | 35.5 | 129.39 | origin | false
    KRPTK | 평택·당진항 | KR | 36.97 | 126.82 | origin | false
    KRMAS | 마산항 | KR | 35.2 | 128.58 | origin | false
    CNSHA | 상하이항 | CN | 31.23 | 121.49 | origin | false
    CNNGB | 닝보항 | CN | 29.87 | 121.55 | origin | false
    CNSZX | 선전항 | CN | 22.54 | 113.93 | origin | false
    CNTAO | 칭다오항 | CN | 36.07 | 120.38 | origin | false
    CNNSA | 광저우(난사)항 | CN | 22.6 | 113.6 | origin | false
    CNTXG | 톈진항 | CN | 38.98 | 117.7 | origin | false
    JPTYO | 도쿄항 | JP | 35.65 | 139.77 | origin | false
    JPYOK | 요코하마항 | JP | 35.44 | 139.64 | origin | false
    JPOSA | 오사카항 | JP | 34.65 | 135.43 | origin | false
    JPUKB | 고베항 | JP | 34.69 | 135.18 | origin | false
    JPNGO | 나고야항 | JP | 35.08 | 136.88 | origin | false
    SGSIN | 싱가포르항 | SG | 1.29 | 103.85 | origin | false
    DEHAM | 함부르크항 | DE | 53.55 | 10 | destination | true
    DEBRE | 브레멘항 | DE | 53.08 | 8.8 | destination | true
    DEBRV | 브레머하펜항 | DE | 53.54 | 8.58 | destination | true
    NLRTM | 로테르담항 | NL | 51.92 | 4.48 | destination | true
    NLAMS | 암스테르담항 | NL | 52.37 | 4.9 | destination | true
    BEANR | 앤트워프항 | BE | 51.22 | 4.4 | destination | true
    BEZEE | 제브뤼헤항 | BE | 51.33 | 3.2 | destination | true
    FRLEH | 르아브르항 | FR | 49.49 | 0.11 | destination | true
    FRMRS | 마르세유항 | FR | 43.3 | 5.37 | destination | true
    ESVLC | 발렌시아항 | ES | 39.45 | -0.32 | destination | true
    ESALG | 알헤시라스항 | ES | 36.13 | -5.45 | destination | true
    ITGOA | 제노바항 | IT | 44.41 | 8.93 | destination | true
    ITSPE | 라스페치아항 | IT | 44.1 | 9.82 | destination | true
    GRPIR | 피레우스항 | GR | 37.94 | 23.63 | destination | true
    PLGDN | 그단스크항 | PL | 54.35 | 18.65 | destination | true
    SEGOT | 예테보리항 | SE | 57.7 | 11.97 | destination | true
    PTSIE | 시네스항 | PT | 37.95 | -8.87 | destination | true
    DKAAR | 오르후스항 | DK | 56.15 | 10.22 | destination | true
    FIHEL | 헬싱키항 | FI | 60.17 | 24.95 | destination | true
    IEDUB | 더블린항 | IE | 53.35 | -6.22 | destination | true
    HRRJK | 리예카항 | HR | 45.33 | 14.44 | destination | true
    SIKOP | 코페르항 | SI | 45.55 | 13.73 | destination | true
    MTMAR | 마르사슬록항 | MT | 35.84 | 14.54 | destination | true
    CYLMS | 리마솔항 | CY | 34.65 | 33.04 | destination | true
    ROCND | 콘스탄차항 | RO | 44.17 | 28.65 | destination | true
    BGVAR | 바르나항 | BG | 43.2 | 27.92 | destination | true
    LVRIX | 리가항 | LV | 56.95 | 24.1 | destination | true
    LTKLJ | 클라이페다항 | LT | 55.71 | 21.14 | destination | true
    EETLL | 탈린항 | EE | 59.44 | 24.75 | destination | true
    NOOSL | 오슬로항 | NO | 59.91 | 10.75 | destination | true
    GBFXT | 펠릭스토우항 | GB | 51.96 | 1.35 | destination | false
    GBLON | 런던항 | GB | 51.5 | 0.05 | destination | false
"""
#: Lane, status, days, nautical miles, freight in dollars, war-risk rate.
ROUTES = """
    A | limited | 32 | 11400 | 2840 | 0.00100
    B | blocked | 25 | 11200 | 2950 | 0.00750
    D | limited | 35 | 11700 | 2900 | 0.00600
    C | best | 52 | 14500 | 3200 | 0.00000
"""
#: Zone, latitude and longitude of its centre, radius in km, level.
HAZARD_ZONES = """
    red_sea | 19 | 40 | 600 | CRITICAL
    hormuz | 26.5 | 56.5 | 350 | HIGH
    malacca | 3 | 100.5 | 220 | MEDIUM
    cape | -34.4 | 18.5 | 0 | SAFE
"""


def _table(spark: SparkSession, lines: str, schema: str) -> DataFrame:
    """A small table of one literal; (row number from 0, then the columns of ``schema``)."""
    rows = spark.range(1).select(F.posexplode(F.split(F.lit(lines.strip()), r"\n\s*")).alias("place", "line"))
    cells = F.split("line", r" \| ")
    columns = [c.strip().split(" ") for c in schema.split(";")]
    return rows.select("place", *[F.get(cells, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])


def ports(spark: SparkSession) -> DataFrame:
    return _table(spark, PORTS, "unlocode string; name string; country_code string; lat decimal(9,6); lng decimal(9,6); role string; ets_applies boolean")


def routes(spark: SparkSession) -> DataFrame:
    return _table(spark, ROUTES, "route_key string; status string; lead_time_days int; distance_nm decimal(10,2); base_other_usd decimal(12,2); war_risk_rate decimal(6,5)")


def hazard_zones(spark: SparkSession) -> DataFrame:
    return _table(spark, HAZARD_ZONES, "zone_key string; center_lat decimal(9,6); center_lng decimal(9,6); radius_km decimal(8,2); level string")
