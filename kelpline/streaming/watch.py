"""The alert watcher as a stateful processor: keys that wait lie in groups by their target, and timers poll the newest quote.

A group is a range of targets and a salt, so a quote goes to as many rows as there are groups, never to keys, and a target that a third of all keys share is spread over ``SALTS`` groups.
A group holds the newest quote, its waiting keys, and what is known of every key: pending, sending, sent or failed, one way, but that a failed key may register again. A timer
of processing time looks every ten minutes: a group whose range begins above the quote has all its keys due, one that ends below it none; only in between keys are compared.
State lies in the state store and outlives a restart; what is known of a key may be given a time to live, after which the key could be sent again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kelpline.operators.alerts import POLL_MINUTES

#: Width of a range of targets, the number of the last range, which holds all above, and groups that share a range.
WIDTH, LAST, SALTS = 4.0, 63, 4
#: The state store that such processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "key string, target double, spot double"


def _range(target: Column) -> Column:
    return F.least(F.floor(target / WIDTH), F.lit(LAST)).cast("int")


def dealt(registrations: DataFrame, quotes: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Rows of groups: (range, salt, kind, ts, key, target, spot).

    registrations: (key, target, spot, ts), spot being the price at that time or null; quotes: (ts, spot); answers: (key, target, ok, ts), what the mail service said.
    """
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt")
    columns = ["range", "salt", "kind", "ts", "key", "target", "spot"]
    valid = registrations.filter(F.col("key").isNotNull() & (F.col("target") > 0))
    made = valid.select(_range(F.col("target")).alias("range"), salt, F.lit("register").alias("kind"), "ts", "key", F.col("target").cast("double").alias("target"), F.col("spot").cast("double").alias("spot"))
    groups = F.explode(F.array(*[F.struct(F.lit(r).alias("range"), F.lit(s).alias("salt")) for r in range(LAST + 1) for s in range(SALTS)])).alias("g")
    seen = quotes.filter("spot is not null").select("ts", F.col("spot").cast("double").alias("spot"), groups)
    rows = made.select(*columns).unionByName(seen.select("g.range", "g.salt", F.lit("quote").alias("kind"), "ts", F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("target"), "spot"))
    if answers is None:
        return rows
    said = answers.select(_range(F.col("target")).alias("range"), salt, F.when(F.col("ok"), "sent").otherwise("failed").alias("kind"), "ts", "key", F.col("target").cast("double").alias("target"), F.lit(None).cast("double").alias("spot"))
    return rows.unionByName(said)


class Watcher(StatefulProcessor):
    """The state of one group."""

    def __init__(self, poll_ms: int, ttl_ms: int | None):
        self.poll_ms, self.ttl_ms = poll_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.quote = handle.getValueState("quote", "spot double, ts timestamp")
        self.waiting = handle.getMapState("waiting", "key string", "target double")
        self.known = handle.getMapState("known", "key string", "status string", self.ttl_ms)

    def _status(self, key: str) -> str | None:
        return self.known.getValue((key,))[0] if self.known.containsKey((key,)) else None

    def _poll_later(self, timers) -> None:
        if next(iter(self.waiting.keys()), None) is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.poll_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = []
        for row in pd.concat([r for r in rows if len(r)] or [pd.DataFrame(columns=["ts", "kind"])], ignore_index=True).sort_values("ts", kind="stable").itertuples(index=False):
            if row.kind == "quote":
                if not self.quote.exists() or self.quote.get()[1] <= row.ts:
                    self.quote.update((float(row.spot), row.ts))
            elif row.kind == "register":
                if self._status(row.key) in (None, "failed"):
                    at_once = pd.notna(row.spot) and row.spot <= row.target
                    self.known.updateValue((row.key,), ("sending" if at_once else "pending",))
                    if at_once:
                        due.append((row.key, float(row.target), float(row.spot)))
                    else:
                        self.waiting.updateValue((row.key,), (float(row.target),))
            elif self._status(row.key) == "sending":
                self.known.updateValue((row.key,), (row.kind,))
        self._poll_later(timerValues)
        yield pd.DataFrame(due, columns=["key", "target", "spot"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = []
        spot = self.quote.get()[0] if self.quote.exists() else None
        low, high = key[0] * WIDTH, float("inf") if key[0] == LAST else (key[0] + 1) * WIDTH
        if spot is not None and spot < high:
            due = [(k, t, spot) for (k,), (t,) in list(self.waiting.iterator()) if spot <= low or spot <= t]
        for k, _, _ in due:
            self.waiting.removeKey((k,))
            self.known.updateValue((k,), ("sending",))
        self._poll_later(timerValues)
        yield pd.DataFrame(due, columns=["key", "target", "spot"])

    def close(self) -> None:
        pass


def due_alerts(rows: DataFrame, poll_ms: int = POLL_MINUTES * 60_000, ttl_ms: int | None = None) -> DataFrame:
    """(key, target, spot) of a stream of ``dealt`` rows: each key once, when its price is reached, by its own registration or at a poll. Sessions need ``PROVIDER`` as their state store."""
    return rows.groupBy("range", "salt").transformWithStateInPandas(Watcher(poll_ms, ttl_ms), DUE, "Append", "ProcessingTime")
