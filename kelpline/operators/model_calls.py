"""What comes before and after a language model: checked requests, prompt blocks, routed answers, and calls through an injected function."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions.text import CAVEAT, MISSING, allowed_id, salvage_json, used_numbers
from kelpline.operators.routes import masked_total

#: States of a lane, ways that a question can go, and screens that an answer may point to.
STATUSES = ("best", "limited", "blocked")
WAYS = ("analysis", "lookup", "answer")
SCREENS = (
    "route-kpi", "route-map", "route-table", "route-compare", "route-incoterm", "hedge-chart", "hedge-target", "hedge-scenario", "hedge-track", "hedge-regulation",
    "scm-leadtime", "scm-compare", "scm-carrier", "scm-latest", "report",
)
#: Fixed value: turns of a conversation that are passed on.
HISTORY = 4


def compare_problem(routes: Column) -> Column:
    """Why a comparison can't be made; null if it can. routes: array of structs with key, status and status_reason."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return (
        F.when(routes.isNull() | (F.size(routes) != 2), "not two routes")
        .when(F.exists(routes, lambda r: blank(r["key"])), "no key")
        .when(F.exists(routes, lambda r: r["status"].isNull() | ~r["status"].isin(*STATUSES)), "unknown status")
        .when(F.exists(routes, lambda r: blank(r["status_reason"])), "no reason")
    )


def masked_routes(routes: Column, total: str = "total_usd") -> Column:
    """The routes with the total of a blocked one left out."""
    return F.transform(routes, lambda r: r.withField(total, masked_total(r["status"], r[total])))


#: Labels of the lines about a lane, of its states, and of what is missing.
LANE_LABELS = {"status": "상태", "reason": "상태 사유", "total": "총비용", "freight": "기본운임", "carbon": "탄소비용(EU ETS)", "war_risk": "전쟁위험보험료", "days": "해상 리드타임", "distance": "항로 거리"}
STATUS_LABELS, BLOCKED, NONE, NONE_BLOCKED = {"best": "추천", "limited": "제한적"}, "운항 불가", "산출 안 함", "산출 안 함(운항 불가)"
LANE, RATE, DEADLINE, YES, NO = "항로", "요율", "납기 충족", "예", "아니오"


def _line(key: str, *text: Column) -> Column:
    return F.concat(F.lit(f"- {LANE_LABELS[key]}: "), *text)


def _status_label(status: Column) -> Column:
    """Any state but the two known ones reads as blocked."""
    known = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(known[status], F.lit(BLOCKED))


def _dollars(amount: Column) -> Column:
    """Whole dollars, halves up."""
    return F.when(amount.isNull(), F.lit(NONE)).otherwise(F.concat(F.lit("$"), F.floor(amount.cast("double") + 0.5).cast("long").cast("string")))


def _total(total: Column) -> Column:
    return F.when(total.isNull(), F.lit(NONE_BLOCKED)).otherwise(F.concat(F.lit("$"), total.cast("string")))


def route_block(status: Column, total: Column, freight: Column, carbon: Column, war_risk: Column) -> Column:
    """Lines of a prompt about one lane's costs."""
    return F.concat_ws("\n", _line("status", _status_label(status)), _line("total", _total(total)), *[_line(k, _dollars(c)) for k, c in (("freight", freight), ("carbon", carbon), ("war_risk", war_risk))])


def route_report(route: Column) -> Column:
    """All lines about one lane: a struct of key, name, status, status_reason, total_usd, freight_usd, carbon_usd, war_risk_usd, war_risk_rate_pct, lead_time_days, meets_deadline, distance_nm."""
    text = lambda name: route[name].cast("string")
    risk = F.concat(_dollars(route["war_risk_usd"]), F.lit(f" ({RATE} "), text("war_risk_rate_pct"), F.lit("%)"))
    days = F.concat(text("lead_time_days"), F.lit(f"일 / {DEADLINE}: "), F.when(route["meets_deadline"], YES).otherwise(NO))
    return F.concat_ws(
        "\n", F.concat(F.lit(f"[{LANE} "), route["key"], F.lit("] "), route["name"]), _line("status", _status_label(route["status"])), _line("reason", route["status_reason"]), _line("total", _total(route["total_usd"])),
        _line("freight", _dollars(route["freight_usd"])), _line("carbon", _dollars(route["carbon_usd"])), _line("war_risk", risk), _line("days", days), _line("distance", text("distance_nm"), F.lit("nm")),
    )


#: The risk snapshot, line by line: label, field and unit.
SNAPSHOT_TITLE = "[리스크 스냅샷]"
SNAPSHOT = (
    (("자산", "asset", ""), ("현재가", "spot", ""), ("기준일", "as_of", "")),
    (("일간 변동성", "daily_vol", ""), ("연율 변동성", "annual_vol_pct", "%")),
    (("80% 구간", "lo80", ""), ("~", "hi80", ""), ("95% 구간", "lo95", ""), ("~", "hi95", "")),
    (("목표가", "target", ""), ("도달확률", "hit_prob", ""), ("기간", "horizon_business_days", "영업일")),
    (("도달확률 근거", "evidence", ""),),
    (("선대 예산 기준", "budget", ""), ("최악", "worst", ""), ("초과분", "exceedance", "")),
)


def risk_snapshot(values: Column, kinds: dict[str, str]) -> Column:
    """The snapshot of a struct as text; null and NaN say that a value wasn't provided. kinds: the type of each field."""
    lines = [F.lit(SNAPSHOT_TITLE)]
    for line in SNAPSHOT:
        parts = []
        for i, (label, field, unit) in enumerate(line):
            value = values[field]
            missing = value.isNull() | (F.isnan(value) if kinds[field] in ("double", "float") else F.lit(False))
            shown_value = F.when(missing, F.lit(MISSING)).otherwise(F.concat(value.cast("string"), F.lit(unit)))
            parts += [F.lit(("- " if not i else " " if label == "~" else " / ") + label + (" " if label == "~" else ": ")), shown_value]
        lines.append(F.concat(*parts))
    return F.concat_ws("\n", *lines)


def history_block(history: Column) -> Column:
    """The last four (q, a) of an array as text; empty for none."""
    last = F.slice(history, F.greatest(F.size(history) - HISTORY + 1, F.lit(1)), F.lit(HISTORY))
    lines = F.array_join(F.transform(last, lambda h: F.concat(F.lit("Q: "), h["q"], F.lit(" / A: "), h["a"])), "\n")
    return F.when(F.coalesce(F.size(history), F.lit(0)) > 0, lines).otherwise(F.lit(""))


#: What stands around the last turns in a prompt.
HISTORY_TITLE, HISTORY_NOTE = "[직전 대화]", '(생략된 주어는 위 맥락에서 채워라. 예: "그럼 콜롬보는?")'


def history_prompt(history: Column) -> Column:
    """``history_block`` with its title and note; empty for none."""
    block = history_block(history)
    return F.when(block == "", block).otherwise(F.concat(F.lit(f"\n{HISTORY_TITLE}\n"), block, F.lit(f"\n{HISTORY_NOTE}\n")))


def routed(raw: Column) -> Column:
    """struct(way, text, target, problem) of a router's answer: an unknown way is a problem, an invented target is dropped."""
    body = salvage_json(raw)
    way = F.get_json_object(body, "$.route")
    text = F.when(way == "answer", F.coalesce(F.get_json_object(body, "$.answer.text"), F.lit(""))).when(way == "lookup", F.coalesce(F.get_json_object(body, "$.lookup.why"), F.lit("")))
    problem = F.when(body.isNull(), "no JSON").when(way.isNull() | ~way.isin(*WAYS), "unknown way").when(way == "analysis", "no risk engine")
    target = F.when(way == "lookup", allowed_id(F.get_json_object(body, "$.lookup.targetId"), list(SCREENS)))
    return F.struct(way.alias("way"), text.alias("text"), target.alias("target"), problem.alias("problem"))


def cited_answer(raw: Column, hits: Column, caveat: str = CAVEAT) -> Column:
    """struct(answer, used, caveat) of a model's JSON: numbers out of range go, a blank caveat becomes the default."""
    parsed = F.from_json(salvage_json(raw), "answer string, used array<int>, caveat string")
    return F.struct(parsed["answer"].alias("answer"), used_numbers(F.coalesce(parsed["used"], F.array().cast("array<int>")), hits).alias("used"), F.coalesce(F.nullif(F.trim(parsed["caveat"]), F.lit("")), F.lit(caveat)).alias("caveat"))


class _Caller:
    """Models in turn, beginning with the one that answered last."""

    def __init__(self, models: list[Callable[[str, str, float], dict]]):
        self.models = list(models)

    def ask(self, system: str, message: str, temperature: float) -> tuple[str | None, str | None]:
        problems = ["no model"]
        for model in tuple(self.models):
            try:
                content, problem = _usable(model(system, message, temperature))
            except Exception as raised:  # a model may fail in any way; the next one is asked
                content, problem = None, str(raised)
            if problem is None:
                self.models.remove(model)
                self.models.insert(0, model)
                return content, None
            problems.append(problem)
        return None, problems[-1]


def _usable(body: dict | None) -> tuple[str | None, str | None]:
    """(content, problem): an error in the body is a failure whatever the transport said, and so is an empty answer."""
    if not body or body.get("error") is not None:
        return None, f"error in body: {body['error']}" if body else "empty body"
    return (body["content"], None) if body.get("content") else (None, "no content")


def _holds_json(text: str) -> bool:
    try:
        return json.loads(text[text.index("{") : text.rindex("}") + 1]) is not None
    except ValueError:
        return False


#: Temperature of a call, and of the one more that an answer which is no JSON gets.
TEMPERATURE, AGAIN = 0.2, 0.0
#: Fixed value: characters of an answer that its error shows.
SHOWN = 200


def complete(requests: DataFrame, models: list[Callable[[str, str, float], dict]], as_json: bool = False) -> DataFrame:
    """(request_id, content, error) of (request_id, system, message), from the first model that answers; where JSON is wanted, an answer without is asked for once more."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller(models)

        def answer(system: str, message: str) -> tuple[str | None, str | None]:
            content, error = caller.ask(system, message, TEMPERATURE)
            if as_json and content and not _holds_json(content):
                content, error = caller.ask(system, message, AGAIN)
            return (None, f"no JSON: {content[:SHOWN]}") if as_json and content and not _holds_json(content) else (content, error)

        for pdf in filter(len, batches):
            answers = [answer(s, m) for s, m in zip(pdf["system"], pdf["message"], strict=True)]
            yield pdf[["request_id"]].assign(content=[c for c, _ in answers], error=[e for _, e in answers])

    return requests.mapInPandas(run, f"request_id {dict(requests.dtypes)['request_id']}, content string, error string")
