"""Market data: latest per key, day change, last closes, upsert, freshness, failover between feeds, currency pairs."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.sources import keyed
from kelpline.sources.shared import checkpointed

#: Ages below which prices and rates are fresh, in seconds; bounds of a sane spot; closes that are shown.
PRICE_TTL_S, RATE_TTL_S = 30 * 60, 24 * 60 * 60
SPOT_LOW, SPOT_HIGH = 60.0, 120.0
RECENT = 5
#: Rates that are used when no feed answers.
FALLBACK_RATES = {"EUR/USD": 1.1548, "EUR/KRW": 1630.83, "USD/KRW": 1412.2}
#: Fixed value: how far a stated day change may be from the derived one.
CHANGE_TOLERANCE = 0.05


#: Parts of a table of prices, by hash of the key.
PARTS = 64


def is_fresh(fetched_at: Column, now: Column, ttl_s: int) -> Column:
    """Strictly younger than the limit; null is stale. The clock is an argument."""
    return F.coalesce((now.cast("timestamp").cast("double") - fetched_at.cast("timestamp").cast("double")) < ttl_s, F.lit(False))


def latest_per_key(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key, the greatest ``tie`` among equals: a partial aggregation, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def latest_overall(rows: DataFrame, at: str, tie: str) -> DataFrame:
    """The newest row of all, the greatest ``tie`` among equals: one row, or none."""
    return rows.orderBy(F.desc(at), F.desc(tie)).limit(1)


def daily_closes(ticks: DataFrame, keys: list[str], at: str, value: str, tie: str) -> DataFrame:
    """(keys, price_date, close): the last value of each day."""
    return ticks.filter(F.col(value).isNotNull()).groupBy(*keys, F.to_date(at).alias("price_date")).agg(F.max_by(value, F.struct(at, tie)).alias("close"))


def day_change_pct(spot: Column, previous: Column) -> Column:
    """(spot - previous) / previous * 100, not rounded; a previous close of 0 has no answer."""
    return F.when(previous != 0, (spot - previous) / previous * 100)


def with_day_change(closes: DataFrame, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("price_date")
    previous = F.lag("close").over(order)
    return closes.withColumn("previous_close", previous).withColumn("day_change_pct", day_change_pct(F.col("close"), F.col("previous_close")))


def recent_closes(closes: DataFrame, keys: list[str], n: int = RECENT) -> DataFrame:
    """(keys, closes): the last n closes, oldest first. Cut to n a key before they are gathered."""
    order = Window.partitionBy(*keys).orderBy(F.desc("price_date"))
    last = closes.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n)
    gathered = F.array_sort(F.collect_list(F.struct("price_date", "close")))
    return last.groupBy(*keys).agg(F.transform(gathered, lambda x: x["close"]).alias("closes"), F.max("price_date").alias("last_date"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The table with the newest version of each key."""
    return latest_per_key(table.unionByName(rows), keys, version, tie)


def cache_decision(history: DataFrame, quotes: DataFrame, now: Column, keys: list[str], ttl_s: int = PRICE_TTL_S) -> DataFrame:
    """What a read-through cache does for each key: ``cached``, ``fetched``, ``stale`` or ``unavailable``.

    history: (keys, rows, newest_at); quotes: (keys, spot), null where the feed failed. Cached needs two rows and a fresh newest one.
    """
    both = history.join(quotes, keys, "full_outer")
    rows = F.coalesce("rows", F.lit(0))
    status = (
        F.when((rows >= 2) & is_fresh(F.col("newest_at"), now, ttl_s), "cached")
        .when(F.col("spot").isNotNull(), "fetched").when(rows >= 2, "stale").otherwise("unavailable")
    )
    return both.withColumn("status", status).withColumn("is_live", F.col("status").isin("cached", "fetched"))


PRICES = "key string, price_date date, close double, fetched_at timestamp"


def price_answers(quotes: DataFrame, path: str, now: Column, token: str, ttl_s: int = PRICE_TTL_S) -> DataFrame:
    """(key, spot, day_change_pct, as_of, closes, status, is_live) of each key that is stored or quoted, and the table at ``path`` with what was fetched.

    quotes: (key, times, closes), the parallel arrays of a chart, oldest first, null where the feed failed. ``cached`` needs two stored days of which the last was fetched less than ``ttl_s`` ago;
    else the quote is taken (``fetched``), and its last close stored for its day in UTC; else two stored days answer, not live (``stale``); else nothing does (``unavailable``), as where the close before is 0.
    Closes are the last five, oldest first. Answers are those of the table before the merge; run again with its token, a job finds its own prices stored, as a later call does.
    """
    spark = quotes.sparkSession
    held = keyed.load(spark, path)
    held = spark.createDataFrame([], PRICES) if held is None else held
    order = Window.partitionBy("key").orderBy(F.desc("price_date"))
    last = held.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= RECENT)
    days = F.array_sort(F.collect_list(F.struct("price_date", "close", "fetched_at"))).alias("days")  # five a key
    pairs = zipped_closes(F.col("times"), F.col("closes"))
    offers = quotes.select("key", pairs.alias("pairs"))
    both = last.groupBy("key").agg(days).join(offers, "key", "full_outer").withColumn("n", F.coalesce(F.size("days"), F.lit(0)))
    at = lambda c, i: F.get(c, F.size(c) + i)  # noqa: E731  (counted from the end)
    newest = at("days", -1)["fetched_at"]
    status = F.when((F.col("n") >= 2) & is_fresh(newest, now, ttl_s), "cached").when(F.size("pairs") >= 2, "fetched").when(F.col("n") >= 2, "stale").otherwise("unavailable")
    decided = both.withColumn("status", status)
    stored, quoted = F.col("status").isin("cached", "stale"), F.col("status") == "fetched"
    closes = F.when(stored, F.col("days.close")).when(quoted, F.transform("pairs", lambda x: x["c"]))
    as_of = F.when(stored, at("days", -1)["price_date"]).when(quoted, F.to_date(F.timestamp_seconds(at("pairs", -1)["t"])))
    found = decided.select("key", "status", closes.alias("all"), as_of.alias("as_of")).withColumn("before", at("all", -2))
    # Written before the merge: one row a key, of the table as it was.
    found = checkpointed(found.withColumn("status", F.when(F.col("before") == 0, "unavailable").otherwise(F.col("status"))))
    bought = found.filter("status = 'fetched'").select("key", F.col("as_of").alias("price_date"), at("all", -1).alias("close"), now.cast("timestamp").alias("fetched_at"))
    keyed.merge(bought, path, F.pmod(F.xxhash64("key"), F.lit(PARTS)), lambda old, new: upsert(old, new, ["key", "price_date"], "fetched_at", "close"), token, ["key", "price_date"])
    known = F.col("status") != "unavailable"
    spot = F.when(known, at("all", -1))
    return found.select(
        "key", spot.alias("spot"), day_change_pct(spot, F.col("before")).alias("day_change_pct"), F.when(known, F.col("as_of")).alias("as_of"), F.when(known, F.slice("all", -F.least(F.size("all"), F.lit(RECENT)), RECENT)).alias("closes"),
        "status", F.col("status").isin("cached", "fetched").alias("is_live"),
    )


def cached_answer(entries: DataFrame, loaded: DataFrame, now: Column, keys: list[str], ttl_s: int, fallback: Column) -> DataFrame:
    """(keys, value, status, is_live, reason): a fresh entry, else what was loaded, else the stale entry, else the fallback.

    entries: (keys, value, stored_at); loaded: (keys, new_value, error), new_value null where the loader failed. A stale entry isn't dated again, so every later
    call loads anew. ``reason`` is the loader's error where its value was wanted.
    """
    both = entries.join(loaded, keys, "full_outer")
    held = F.col("value").isNotNull()
    status = F.when(held & is_fresh(F.col("stored_at"), now, ttl_s), "cached").when(F.col("new_value").isNotNull(), "loaded").when(held, "stale").otherwise("fallback")
    answer = F.when(F.col("status").isin("cached", "stale"), F.col("value")).when(F.col("status") == "loaded", F.col("new_value")).otherwise(fallback)
    failed = F.col("status").isin("stale", "fallback")
    return both.withColumn("status", status).select(*keys, answer.alias("value"), "status", (~failed).alias("is_live"), F.when(failed, F.coalesce("error", F.lit("no answer"))).alias("reason"))


def first_provider(offers: DataFrame, keys: list[str]) -> DataFrame:
    """The valid offer of least priority of each key; failed and later ones are listed in ``attempts`` up to it.

    offers: (keys, priority, provider, spot), spot null or out of bounds where a provider failed. A key without a valid offer has a null row.
    """
    sane = F.col("spot").between(SPOT_LOW, SPOT_HIGH) & ~F.isnan("spot")
    marked = offers.withColumn("_ok", F.coalesce(sane, F.lit(False)))
    best = F.min(F.when(F.col("_ok"), F.struct("priority", "provider", "spot"))).alias("b")
    failed = F.array_sort(F.collect_list(F.when(~F.col("_ok"), F.struct("priority", "provider")))).alias("f")
    got = marked.groupBy(*keys).agg(best, failed)
    before = F.filter("f", lambda x: F.col("b").isNull() | (x["priority"] < F.col("b.priority")))
    return got.select(*keys, "b.provider", "b.spot", F.transform(before, lambda x: x["provider"]).alias("attempts"), F.col("b").isNotNull().alias("is_live"))


def number(value: Column) -> Column:
    """A number of dirty text: commas go, then all but digits, points and signs; what is then no number is null."""
    return F.regexp_replace(F.replace(value, F.lit(","), F.lit("")), "[^0-9.+-]", "").try_cast("double")


def resolved_change(pct: Column, absolute: Column, spot: Column, rule: str = "checked") -> Column:
    """Day change in percent from a stated one and an absolute one.

    checked: the stated one unless it is off the derived one by more than the tolerance. crossed: the same, but nothing where none is stated.
    stated: stated, then derived. derived: derived, then the stated one, which is a fraction if it is 1 at most.
    """
    derived = F.when(spot - absolute > 0, absolute / (spot - absolute) * 100)
    if rule in ("checked", "crossed"):
        return F.when(pct.isNull(), derived if rule == "checked" else F.lit(None)).when(derived.isNotNull() & (F.abs(pct - derived) > CHANGE_TOLERANCE), derived).otherwise(pct)
    if rule == "stated":
        return F.coalesce(pct, derived)
    return F.coalesce(derived, F.when(F.abs(pct) <= 1, pct * 100).otherwise(pct))


def utc_text(epoch_s: Column, with_time: bool = True) -> Column:
    """Seconds since 1970 as UTC text; null for 0 and below. The session's time zone is UTC."""
    return F.when(epoch_s > 0, F.date_format(F.timestamp_seconds(epoch_s), "yyyy-MM-dd HH:mm" if with_time else "yyyy-MM-dd"))


def delay_minutes(mode: Column) -> Column:
    """delayed_streaming_600 is 10; streaming and realtime are 0; anything else is unknown."""
    seconds = F.regexp_extract(mode, r"delayed_streaming_(\d+)", 1)
    return F.when(seconds != "", F.round(seconds.cast("double") / 60).cast("int")).when(mode.isin("streaming", "realtime"), F.lit(0))


def short_date(text: Column) -> Column:
    """MM/DD/YY to 20YY-MM-DD; null if it isn't that."""
    return F.when(text.rlike(r"^\d{2}/\d{2}/\d{2}$"), F.regexp_replace(text, r"^(\d{2})/(\d{2})/(\d{2})$", "20$3-$1-$2"))


def zipped_closes(timestamps: Column, closes: Column) -> Column:
    """Pairs of a chart's parallel arrays without null ones; null if lengths differ or fewer than two are left."""
    pairs = F.filter(F.arrays_zip(timestamps.alias("t"), closes.alias("c")), lambda x: x["t"].isNotNull() & x["c"].isNotNull())
    return F.when((F.size(timestamps) == F.size(closes)) & (F.size(pairs) >= 2), pairs)


#: Fixed value: significant digits of a rate's division.
DIGITS = 34


def _divided(a: pd.Series, b: pd.Series) -> pd.Series:
    context = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN)
    return pd.Series([None if x is None or y is None or not y else context.divide(x, y) for x, y in zip(a, b, strict=True)], dtype=object)


def cross_rates(eur_per_usd: Column, krw_per_usd: Column) -> tuple[Column, Column]:
    """(dollars a euro, won a euro) to 34 significant digits; null for a missing or zero euro rate.

    Spark's own division of decimals keeps fewer digits; there are two of these a refresh.
    """
    divide = {scale: F.pandas_udf(_divided, f"decimal(38,{scale})") for scale in (33, 30)}
    return divide[33](F.lit(1).cast("decimal(38,20)"), eur_per_usd), divide[30](krw_per_usd, eur_per_usd)


def rfc_date(text: Column) -> Column:
    """'Sun, 09 Aug 2026 00:00:02 +0000' to '09 Aug 2026'; null if it isn't such a date."""
    return F.date_format(F.try_to_timestamp(F.regexp_replace(text, r"^\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss Z")), "dd MMM yyyy")
