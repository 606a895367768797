"""Sea lanes: fan-out to legs, passage rules, masking of blocked lanes, and shortest paths over an edge table."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of passages that can be blocked.
PASSAGES = (
    "suez", "panama", "gibraltar", "babelmandeb", "babalmandab", "bosporus", "ormuz", "malacca", "sunda", "dover", "kiel", "corinth", "bering",
    "magellan", "cape_horn", "northwest", "northeast",
)
#: Lanes with their way points (longitude, latitude) and blocked passages.
LANES = (
    ("A", ((103.85, 1.28),), ()),
    ("B", (), ()),
    ("C", (), ("suez", "babelmandeb", "panama")),
    ("D", ((103.85, 1.28), (79.85, 6.9)), ()),
)


def valid_point(lng: Column, lat: Column) -> Column:
    return F.coalesce(~F.isnan(lng) & ~F.isnan(lat) & lng.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def valid_restrictions(names: Column) -> Column:
    return F.size(F.array_except(names, F.array(*[F.lit(p) for p in PASSAGES]))) == 0


def lanes(spark: SparkSession) -> DataFrame:
    """(lane, via, restrictions): four rows, from literals."""
    rows = []
    for key, via, blocked in LANES:
        points = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in via]).cast("array<struct<lng:double,lat:double>>")
        rows.append(F.struct(F.lit(key).alias("lane"), points.alias("via"), F.array(*[F.lit(b) for b in blocked]).cast("array<string>").alias("restrictions")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def legs(trips: DataFrame) -> DataFrame:
    """(trip_id, lane, leg, from_lng, from_lat, to_lng, to_lat, restrictions) of valid trips (trip_id, from_*, to_*): every trip on every lane."""
    ok = trips.filter(valid_point(F.col("from_lng"), F.col("from_lat")) & valid_point(F.col("to_lng"), F.col("to_lat")))
    point = lambda side: F.array(F.struct(F.col(f"{side}_lng").cast("double").alias("lng"), F.col(f"{side}_lat").cast("double").alias("lat")))
    # Four lanes, whatever the number of trips.
    fanned = ok.crossJoin(F.broadcast(lanes(trips.sparkSession))).withColumn("points", F.concat(point("from"), F.col("via"), point("to")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct((i + 1).alias("leg"), F.get("points", i).alias("a"), F.get("points", i + 1).alias("b")))
    return fanned.select("trip_id", "lane", "restrictions", F.explode(pairs).alias("p")).select(
        "trip_id", "lane", F.col("p.leg").alias("leg"), F.col("p.a.lng").alias("from_lng"), F.col("p.a.lat").alias("from_lat"), F.col("p.b.lng").alias("to_lng"), F.col("p.b.lat").alias("to_lat"), "restrictions"
    )


def lane_totals(leg_distances: DataFrame) -> DataFrame:
    """(trip_id, lane, nm, status): a lane with a leg that failed has no distance; a trip whose lanes all failed is told by ``all_failed``."""
    lane = leg_distances.groupBy("trip_id", "lane").agg(F.when(F.count("nm") == F.count(F.lit(1)), F.sum("nm")).alias("nm"))
    ok = lane.groupBy("trip_id").agg((F.count("nm") == 0).alias("all_failed"))
    return lane.join(ok, "trip_id").withColumn("status", F.when(F.col("nm").isNull(), "no_route").otherwise("ok"))


def masked_total(status: Column, total: Column) -> Column:
    """A blocked lane has no total; its parts stay."""
    return F.when(status != "blocked", total)


def lat_lng(path: Column) -> Column:
    """A path of [lng, lat] as [lat, lng]."""
    return F.transform(path, lambda p: F.array(F.get(p, F.lit(1)), F.get(p, F.lit(0))))


#: Edges of a network that is shared with every task at most.
MAX_EDGES = 1_000_000


def distance_status(distances: DataFrame) -> DataFrame:
    """Rows (lng, lat, restrictions, snapped, nm, path, …) with ``status``: ok, invalid (400), too far from the network (400), no route (422), or error (500) for half an answer."""
    valid = valid_point(F.col("lng"), F.col("lat")) & valid_restrictions(F.coalesce("restrictions", F.array().cast("array<string>")))
    status = (
        F.when(~valid, 400).when(~F.coalesce("snapped", F.lit(False)), 400).when(F.col("nm").isNull() & F.col("path").isNull(), 422).when(F.col("nm").isNull() | F.col("path").isNull(), 500).otherwise(200)
    )
    kind = F.when(~valid, "invalid").when(status == 400, "too far").when(status == 422, "no route").when(status == 500, "error").otherwise("ok")
    return distances.withColumns({"code": status, "status": kind})


def shortest_paths(requests: DataFrame, edges: DataFrame | list[tuple[str, str, float, str | None]]) -> DataFrame:
    """(request_id, nm, path) of (request_id, source, target, restrictions) over a given network: (from, to, nm, passage) edges, both ways.

    The network is small, which is checked, and shared with every task; requests are dealt out. No way: nm and path are null.
    """
    if isinstance(edges, DataFrame):
        edges = [tuple(r) for r in edges.limit(MAX_EDGES + 1).collect()]
    if len(edges) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges")
    shared = requests.sparkSession.sparkContext.broadcast(edges)

    def solve(batches):
        near: dict[str, list[tuple[str, float, str | None]]] = {}
        for a, b, nm, passage in shared.value:
            near.setdefault(a, []).append((b, nm, passage))
            near.setdefault(b, []).append((a, nm, passage))
        for pdf in filter(len, batches):
            rows = []
            for key, a, b, closed in pdf[["request_id", "source", "target", "restrictions"]].itertuples(index=False, name=None):
                shut, seen, queue = set(closed if closed is not None else ()), {}, [(0.0, a, None)]
                while queue and b not in seen:
                    d, n, back = heapq.heappop(queue)
                    if n not in seen:
                        seen[n] = (d, back)
                        for m, nm, passage in near.get(n, ()):
                            if m not in seen and passage not in shut:
                                heapq.heappush(queue, (d + nm, m, n))
                way, n = [], b if b in seen else None
                while n is not None:
                    way.append(n)
                    n = seen[n][1]
                rows.append((key, seen[b][0] if b in seen else None, way[::-1] or None))
            yield pd.DataFrame(rows, columns=["request_id", "nm", "path"]).astype({"nm": "float64"})

    return requests.mapInPandas(solve, f"request_id {dict(requests.dtypes)['request_id']}, nm double, path array<string>")
