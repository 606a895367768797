"""Once-per-key threshold alerts: registrations against a polled quote, as a batch join and as a state step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: minutes between polls.
POLL_MINUTES = 10


def alert_key(email: Column, target: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(email)), target.cast("double").cast("string"))


#: Fixed value: what an address looks like.
ADDRESS = r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$"


def is_email(text: Column) -> Column:
    return F.trim(text).rlike(ADDRESS)


def polled(quotes: DataFrame) -> DataFrame:
    """(tick, spot): the last quote before each poll. As many rows as the time span has polls, however many quotes there are. quotes: (ts, tie, spot)."""
    width = POLL_MINUTES * 60
    tick = F.timestamp_seconds((F.floor(F.col("ts").cast("double") / width) + 1) * width)
    return quotes.filter(F.col("spot").isNotNull()).groupBy(tick.alias("tick")).agg(F.max_by("spot", F.struct("ts", "tie")).alias("spot"))


def fires(registrations: DataFrame, ticks: DataFrame) -> DataFrame:
    """(key, target, registered_at, fired_at, spot): the first poll after the registration at or below the target; null if none.

    Of registrations with one key the first counts. A registration looks at its own day's polls and at the first later day whose least quote
    reaches the target, which it finds in one array of daily minima; so it meets two days of polls, not the whole series.
    """
    first = registrations.filter((F.col("target") > 0) & F.col("key").isNotNull()).groupBy("key").agg(F.min("registered_at").alias("registered_at"), F.min("target").alias("target"))
    dated = ticks.withColumn("day", F.to_date("tick"))
    days = dated.groupBy("day").agg(F.min("spot").alias("low")).agg(F.array_sort(F.collect_list(F.struct("day", "low"))).alias("days"))  # a row a day of the series
    own = F.to_date("registered_at")
    later = F.get(F.filter("days", lambda d: (d["day"] > own) & (d["low"] <= F.col("target"))), F.lit(0))["day"]
    looked = first.crossJoin(F.broadcast(days)).select("key", "target", "registered_at", F.explode(F.array_compact(F.array(own, later))).alias("day"))
    hit = looked.join(dated, "day").filter((F.col("tick") > F.col("registered_at")) & (F.col("spot") <= F.col("target")))
    best = hit.groupBy("key").agg(F.min(F.struct("tick", "spot")).alias("b"))
    return first.join(best, "key", "left").select("key", "target", "registered_at", F.col("b.tick").alias("fired_at"), F.col("b.spot").alias("spot"))


def state_step(state: DataFrame, registrations: DataFrame, spot: float | None) -> DataFrame:
    """The alert table (key, target, status) after one batch of registrations and one quote.

    A registration with its own spot at or below the target fires at once; else it waits. ``sent`` never changes; ``failed`` is taken up by a new
    registration only. Without a quote nothing that waits changes.
    """
    new = registrations.filter(F.col("target") > 0).groupBy("key").agg(F.min("target").alias("target"), F.min("spot").alias("own_spot"))
    both = state.withColumnRenamed("target", "old_target").join(new, "key", "full_outer").select("key", F.coalesce("old_target", "target").alias("target"), "status", "own_spot", F.col("target").isNotNull().alias("again"))
    registered = F.when((F.col("status").isNull() | (F.col("status") == "failed")) & F.col("again"), F.when(F.col("own_spot") <= F.col("target"), "sending").otherwise("pending")).otherwise(F.col("status"))
    after = both.select("key", "target", registered.alias("status"))
    if spot is None:
        return after
    return after.withColumn("status", F.when((F.col("status") == "pending") & (F.lit(spot) <= F.col("target")), "sending").otherwise(F.col("status")))


def delivered(state: DataFrame, results: DataFrame) -> DataFrame:
    """After sending: (key, ok) turns ``sending`` to ``sent`` or ``failed``."""
    done = state.join(results, "key", "left")
    status = F.when(F.col("status") == "sending", F.when(F.col("ok"), "sent").when(~F.col("ok"), "failed").otherwise("sending")).otherwise(F.col("status"))
    return done.select("key", "target", status.alias("status"))


def send_results(answers: DataFrame) -> DataFrame:
    """(key, ok) of a mail service's answers (key, body): sent only if the body has an id."""
    return answers.select("key", (F.coalesce(F.get_json_object("body", "$.id"), F.lit("")) != "").alias("ok"))
