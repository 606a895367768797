"""The alert watcher as a stream: registrations and quotes in, once-per-key firings out; and as micro-batches over a stored table that outlives its stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpline.operators import alerts
from kelpline.sources import keyed

STATE = "status string, target double"
FIRED = "key string, target double, status string, spot double"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """new -> pending -> sent, one way. Registrations with their own spot at or below the target fire at once; a null spot waits.

    A ``failed`` row, the sender's answer, turns ``sent`` into ``failed``, which only a new registration takes up again.
    """
    status, target = state.get if state.exists else (None, None)
    out = []
    rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame(columns=["ts", "target", "spot", "kind"])], ignore_index=True).sort_values(["ts", "kind"], kind="stable")
    for row in rows.itertuples(index=False):
        if row.kind == "register" and status in (None, "failed"):
            status, target = "pending", float(row.target)
        elif row.kind == "failed" and status == "sent":
            status = "failed"
        if status == "pending" and pd.notna(row.spot) and row.spot <= target:
            status = "sent"
            out.append((key[0], target, status, float(row.spot)))
    if status is not None:
        state.update((status, target))
    if out:
        yield pd.DataFrame(out, columns=["key", "target", "status", "spot"])


def watched(changes: DataFrame) -> DataFrame:
    """Firings of a stream of (key, kind, ts, target, spot): kind is ``register``, ``quote`` or ``failed``, quotes already dealt to the keys they concern.

    ``run_batches`` needs no dealing: it looks at the keys that wait.
    """
    return changes.groupBy("key").applyInPandasWithState(_advance, FIRED, STATE, "append", GroupStateTimeout.NoTimeout)


def clock(spark: SparkSession) -> DataFrame:
    """A stream that always has a row for the next batch, so that batches come by the clock and not only with registrations."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("key", "string"), ("target", "double"), ("spot", "double"))]
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(*empty)


#: Parts of a table of alerts, by hash of the key.
PARTS = 64
_ROW = "key string, target double, status string"


def _newest(held: DataFrame, rows: DataFrame) -> DataFrame:
    return held.join(rows.select("key"), "key", "left_anti").unionByName(rows)


def _store(rows: DataFrame, path: str, token: str) -> bool:
    """Puts rows into the table of alerts. Those that wait lie together, by target, so a quote's filter skips the rest of a part."""
    return keyed.merge(rows, path, F.pmod(F.xxhash64("key"), F.lit(PARTS)), _newest, token, ["status", "target"])


def _changes(held: DataFrame, registrations: DataFrame, spot: float | None) -> DataFrame:
    """The rows that a batch of registrations and a quote change: only keys that register, and those that wait at or above the quote, are looked at."""
    asked = registrations.select("key").distinct()
    concerned = held.join(asked, "key", "left_semi")
    if spot is not None:
        concerned = concerned.unionByName(held.filter((F.col("status") == "pending") & (F.col("target") >= spot)).join(asked, "key", "left_anti"))
    after = alerts.state_step(concerned, registrations, spot)
    return after.join(concerned.select("key", F.col("status").alias("was")), "key", "left").filter(~F.col("status").eqNullSafe(F.col("was"))).select("key", "target", "status")


def run_batches(
    registrations: DataFrame, path: str, checkpoint: str, quote: Callable[[], float | None], send: Callable[[DataFrame], DataFrame], ticks: DataFrame | None = None, sends_once: bool = False, **trigger
):
    """Micro-batches over a table of alerts at ``path``: each takes the batch's registrations (key, target, spot) and one quote, sends, and merges what changed.

    Batches come every ten minutes whether anyone registers or not: ``ticks``, by default ``clock``, is a second input. With another trigger there is none unless given.
    What is due is claimed in a written folder before it is sent. A batch that is run again after a failure finds its claims and doesn't send them a second time, as the first run may have:
    they stay ``sending``. Only a sender that knows repeated keys itself (``sends_once``) gets them again. The table outlives the stream: batches are known by the stream's own name, which
    lies in its checkpoint, so with a new checkpoint the table goes on where it was, and claims that no batch has come back for are taken in as ``sending`` before anything is sent.
    """
    spark: SparkSession = registrations.sparkSession
    asked = registrations.select("key", "target", "spot")
    if ticks is None and not trigger:
        ticks = clock(spark)
    state = keyed.Folder(spark, checkpoint)
    if not state.exists("watcher"):
        state.write("watcher", uuid.uuid4().hex)
    stream, folder = state.read("watcher"), keyed.Folder(spark, path)

    def claims(token: str) -> DataFrame | None:
        """A batch's claims that were written whole."""
        return spark.read.schema(_ROW).parquet(f"{path}/claims/{token}") if folder.exists(f"claims/{token}/_SUCCESS") else None

    def step(batch: DataFrame, number: int) -> None:
        own = f"{stream}-{number}"
        for token in folder.names("claims"):
            left = claims(token)
            if token != own and left is not None:
                _store(left, path, token)
            if token != own:
                folder.delete(f"claims/{token}")
        if keyed.is_done(spark, path, own):
            return
        claimed = claims(own)
        again = claimed is not None
        if not again:
            held = keyed.load(spark, path)
            held = spark.createDataFrame([], _ROW) if held is None else held
            _changes(held, batch.filter("key is not null"), quote()).write.mode("overwrite").parquet(f"{path}/claims/{own}")
            claimed = claims(own)
        due = claimed.filter("status = 'sending'").select("key", "target")
        results = send(due) if not again or sends_once else spark.createDataFrame([], "key string, ok boolean")
        changed = alerts.delivered(claimed, results)
        if not claimed.isEmpty():
            _store(changed, path, own)
        folder.delete(f"claims/{own}")

    source = asked if ticks is None else asked.unionByName(ticks.select("key", "target", "spot"))
    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{alerts.POLL_MINUTES} minutes"})).start()


def deduplicated(registrations: DataFrame, horizon: str = "30 days") -> DataFrame:
    """Registrations (email, target, ts) of a stream, the first of each key within the horizon, which bounds the state; later ones meet the key's own state in the watcher."""
    keyed = registrations.withColumn("key", alerts.alert_key(F.col("email"), F.col("target")))
    return keyed.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["key"])
