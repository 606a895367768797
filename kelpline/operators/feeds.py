"""Payloads of price and currency feeds to typed rows, with the reason where one is refused."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators import market
from kelpline.sources import keyed

def _fixed(value: pd.Series, digits: pd.Series) -> pd.Series:
    """A whole batch at once; only values within rounding error of a tie are looked at digit by digit."""
    x = value.to_numpy(np.float64, na_value=np.nan)
    n = digits.to_numpy(np.int64)
    shifted = np.abs(x) * 10.0**n
    whole = np.floor(shifted)
    up = shifted - whole >= 0.5
    near = np.flatnonzero(np.isfinite(x) & (np.abs(shifted - whole - 0.5) < 1e-6 * np.maximum(shifted, 1)))
    out = np.sign(x) * (whole + up) / 10.0**n
    for i in near:
        out[i] = float(Decimal(float(x[i])).quantize(Decimal(1).scaleb(-int(n[i])), ROUND_HALF_UP))
    return pd.Series(np.where(np.isfinite(x), out, np.nan)).astype(object).where(np.isfinite(x), None)


def to_fixed(value: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties away from zero; null, NaN and infinities are null. No built-in rounds this way."""
    return F.pandas_udf(_fixed, "double")(value, F.lit(digits))


class Feed(NamedTuple):
    """A provider as data: its payload's schema, where its fields are, and its rules."""

    schema: str
    fields: dict[str, tuple[str, ...]]  # paths in order; the first that is there counts
    names_product: str  # what the text of ``product`` must match, if there is one
    change: str  # the rule of market.resolved_change


_PAIR = "struct<last:string,change_percent_val:string,change_precent_raw:string,change_val:string,point_value:string,last_timestamp:string>"
_RAW = "lastPrice:string,priceChange:string,percentChange:string,contractName:string,tradeTime:string"
_P, _R = "data[0].screen_data.pairs_data[0].", "data[0]."
#: Feeds in the order in which they are asked, the names of their fields (one is misspelt there), and the day change's decimals.
FEEDS = {
    "chart": Feed(
        "close string, change string, change_abs string, currency string, currency_id string, update_time string, update_mode string",
        {"spot": ("close",), "pct": ("change",), "absolute": ("change_abs",), "product": ("nullif(currency, '')", "currency_id"), "seconds": ("update_time",), "mode": ("update_mode",)},
        "(?i)^EUR$", "crossed",
    ),
    "screen": Feed(
        f"data array<struct<screen_data:struct<pairs_data:array<{_PAIR}>>>>",
        {"spot": (_P + "last",), "pct": (_P + "change_percent_val", _P + "change_precent_raw"), "absolute": (_P + "change_val",), "product": (_P + "point_value",), "seconds": (_P + "last_timestamp",)},
        "€", "stated",
    ),
    "contract": Feed(
        f"data array<struct<raw:struct<{_RAW}>,{_RAW}>>",
        {
            "spot": (_R + "raw.lastPrice", _R + "lastPrice"), "pct": (_R + "raw.percentChange", _R + "percentChange"), "absolute": (_R + "raw.priceChange", _R + "priceChange"),
            "product": (_R + "contractName", _R + "raw.contractName"), "day": (_R + "tradeTime",), "seconds": (_R + "raw.tradeTime", _R + "tradeTime"),
        },
        "(?i)EUA", "derived",
    ),
}
PROVIDERS = tuple(FEEDS)
CHANGE_DIGITS = 2
_NUMBERS = ("spot", "pct", "absolute")


def _fields(name: str, feed: Feed) -> Column:
    """A struct of the fields of one provider's payload, as text; the payload is parsed once."""
    parsed = F.from_json("payload", feed.schema)

    def pick(x: Column) -> Column:
        found = []
        for key in ("spot", "pct", "absolute", "product", "day", "seconds", "mode"):
            paths = [_at(x, path) for path in feed.fields.get(key, ())]
            # Where a contract has a raw part, its numbers come from there alone.
            if name == "contract" and key in (*_NUMBERS, "seconds"):
                paths = [F.coalesce(paths[0], F.when(_at(x, "data[0].raw").isNull(), paths[1]))]
            found.append((F.coalesce(*paths) if paths else F.lit(None)).cast("string").alias(key))
        return F.struct(*found)

    return F.get(F.transform(F.array(parsed), pick), F.lit(0))


def _at(x: Column, path: str) -> Column:
    if path.startswith("nullif("):
        return F.nullif(x[path[7:].split(",")[0]], F.lit(""))
    for step in path.split("."):
        name, _, index = step.partition("[")
        x = x[name]
        x = F.get(x, F.lit(int(index[:-1]))) if index else x
    return x


def quotes(payloads: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows (…, provider, payload) with priority, spot, day_change_pct, as_of, delay_minutes and reason. An unknown provider is refused.

    A quote without a time of its own has the day of ``now``. The spot of a refused quote is null, and so is all else of it.
    """
    provider = F.col("provider")

    def by_feed(of: Callable[[Feed], Column]) -> Column:
        chosen = F.when(F.lit(False), of(FEEDS["chart"]))
        for name, feed in FEEDS.items():
            chosen = chosen.when(provider == name, of(feed))
        return chosen

    fields = F.when(F.lit(False), _fields("chart", FEEDS["chart"]))
    for name, feed in FEEDS.items():
        fields = fields.when(provider == name, _fields(name, feed))
    rest = [c for c in payloads.columns if c != "payload"]
    # One row each; the explode keeps later expressions from parsing the payload again.
    read = payloads.select(*rest, F.explode(F.array(fields)).alias("_f"))
    spot, pct, absolute = (market.number(F.col(f"_f.{k}")) for k in _NUMBERS)
    read = read.select(*rest, "_f", spot.alias("_spot"), pct.alias("_pct"), absolute.alias("_abs"))
    sane = F.coalesce(F.col("_spot").between(market.SPOT_LOW, market.SPOT_HIGH) & ~F.isnan("_spot"), F.lit(False))
    product = F.coalesce("_f.product", F.lit(""))
    wrong = (product != "") & ~by_feed(lambda feed: product.rlike(feed.names_product))
    reason = F.when(~F.coalesce(provider.isin(*PROVIDERS), F.lit(False)), "unknown provider").when(~sane, "out of range").when(wrong, "wrong product")
    change = by_feed(lambda feed: market.resolved_change(F.col("_pct"), F.col("_abs"), F.col("_spot"), feed.change))
    seconds = F.col("_f.seconds").try_cast("long")
    told = F.when(provider == "contract", F.coalesce(market.short_date(F.col("_f.day")), market.utc_text(seconds, False))).otherwise(market.utc_text(seconds))
    as_of = F.coalesce(told, F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd"))
    ok = F.col("reason").isNull()
    priority = F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), provider)
    return read.withColumn("reason", reason).select(
        *rest, priority.alias("priority"), F.when(ok, F.col("_spot")).alias("spot"), to_fixed(F.when(ok, change), CHANGE_DIGITS).alias("day_change_pct"),
        F.when(ok, as_of).alias("as_of"), F.when(ok, market.delay_minutes(F.col("_f.mode"))).alias("delay_minutes"), "reason",
    )


RATES = "result string, time_last_update_utc string, rates map<string,string>"
#: Digits that a stated rate keeps.
RATE_TYPE = "decimal(38,20)"


def fx_rows(payloads: DataFrame) -> DataFrame:
    """Rows (…, payload) with usd_per_eur, krw_per_eur, as_of and the reason where a payload is refused. Rates keep all their digits: they aren't read as doubles."""
    rest = [c for c in payloads.columns if c != "payload"]
    read = payloads.select(*rest, F.explode(F.array(F.struct(F.from_json("payload", RATES).alias("p"), F.try_parse_json("payload").alias("v")))).alias("_f"))
    p = F.col("_f.p")
    eur, krw = (F.try_variant_get(F.col("_f.v"), f"$.rates.{name}", RATE_TYPE) for name in ("EUR", "KRW"))
    read = read.select(*rest, p["result"].alias("_result"), p["rates"].alias("_rates"), market.rfc_date(p["time_last_update_utc"]).alias("_as_of"), eur.alias("_eur"), krw.alias("_krw"))
    reason = (
        F.when(F.coalesce(F.col("_result") != "success", F.lit(True)), "no success").when(F.col("_rates").isNull(), "no rates").when(F.col("_eur").isNull(), "no EUR")
        .when(F.col("_krw").isNull(), "no KRW").when(F.col("_eur") == 0, "EUR is 0").when(F.col("_as_of").isNull(), "no date")
    )
    ok = F.col("reason").isNull()
    usd_per_eur, krw_per_eur = market.cross_rates(F.when(ok, F.col("_eur")), F.when(ok, F.col("_krw")))
    return read.withColumn("reason", reason).select(*rest, usd_per_eur.alias("usd_per_eur"), krw_per_eur.alias("krw_per_eur"), F.when(ok, F.col("_as_of")).alias("as_of"), "reason")


def _logged(fetched: DataFrame, fetched_at: Column) -> DataFrame:
    pair = F.array(*[F.struct(F.lit(q).alias("quote"), F.col(c).cast("decimal(38,30)").alias("rate")) for q, c in (("USD", "usd_per_eur"), ("KRW", "krw_per_eur"))])
    return fetched.filter("reason is null").select("base", fetched_at.alias("fetched_at"), F.inline(pair)).select("base", "quote", "rate", "fetched_at")


def log_rates(fetched: DataFrame, fetched_at: Column, path: str) -> None:
    """Appends two rows (base, quote, rate, fetched_at) for each row (base, usd_per_eur, krw_per_eur, reason) that wasn't refused. A job that is run again appends again; ``log_rates_once`` doesn't."""
    _logged(fetched, fetched_at).write.mode("append").parquet(path)


def log_rates_once(fetched: DataFrame, fetched_at: Column, path: str, token: str) -> bool:
    """The same into a keyed table with a part for each day, of which an append writes the day's again; nothing (False) if the token's rows are in the log already."""
    return keyed.merge(_logged(fetched, fetched_at), path, F.to_date("fetched_at"), DataFrame.unionByName, token)


def fx_answer(rates: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """(base, usd, krw, status): both stored rates fresh, else the fetched pair, else both stored ones, else none, then constants.

    rates: (base, quote, rate, fetched_at), an append-only log; fetched: (base, usd_per_eur, krw_per_eur), null where the feed failed.
    """
    latest = market.latest_per_key(rates.select("base", "quote", "rate", "fetched_at"), ["base", "quote"], "fetched_at", "rate")
    pair = latest.groupBy("base").agg(*[F.max(F.when(F.col("quote") == q, F.col(c))).alias(f"{q}_{c}") for q in ("USD", "KRW") for c in ("rate", "fetched_at")])
    both = pair.join(fetched, "base", "full_outer")
    fresh = market.is_fresh(F.col("USD_fetched_at"), now, market.RATE_TTL_S) & market.is_fresh(F.col("KRW_fetched_at"), now, market.RATE_TTL_S)
    held = F.col("USD_rate").isNotNull() & F.col("KRW_rate").isNotNull()
    status = F.when(fresh, "cached").when(F.col("usd_per_eur").isNotNull() & F.col("krw_per_eur").isNotNull(), "fetched").when(held, "stale").otherwise("fallback")
    pick = lambda stored, new, fixed: F.when(F.col("status").isin("cached", "stale"), F.col(stored).cast("double")).when(F.col("status") == "fetched", F.col(new).cast("double")).otherwise(F.lit(fixed))
    return both.withColumn("status", status).select("base", pick("USD_rate", "usd_per_eur", market.FALLBACK_RATES["EUR/USD"]).alias("usd"), pick("KRW_rate", "krw_per_eur", market.FALLBACK_RATES["EUR/KRW"]).alias("krw"), "status")
