"""Shortest ways over a network of any size: distances by joins, a hop further in each round, and ways from pointers to the node before.

Requests share work: those with one start and one set of closed passages are one source. In a round the nodes whose distance fell in the last one meet their edges, and one grouping
keeps the least distance of each source and node; the table of distances is written after each round, so a lost executor repeats one round only. It ends when no distance falls. The ways come from the
nodes before by doubling: in each round every way is joined with that of the node it has got back to, so as many rounds are needed as the longest way has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.operators.routes import valid_restrictions
from kelpline.sources.shared import checkpointed

SOURCE = ["closed", "source"]


def closed_passages(restrictions: Column) -> Column:
    """Closed passages in one order, once each; a name that is no passage is an error."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(restrictions, F.array().cast("array<string>")))))
    return F.when(valid_restrictions(names), names).otherwise(F.raise_error(F.concat(F.lit("unknown passage among "), F.array_join(names, ","))).cast("array<string>"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, nm, passage) of edges in both directions; of several between two nodes through one passage the shortest. A length below 0 is an error."""
    checked = F.when(F.col("nm") >= 0, F.col("nm")).otherwise(F.raise_error(F.lit("an edge needs a length of 0 or more")).cast("double"))
    one = edges.select("a", "b", checked.cast("double").alias("nm"), "passage")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "nm", "passage")).groupBy("a", "b", "passage").agg(F.min("nm").alias("nm"))


def distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(closed, source, node, nm, before) of all nodes within reach of (closed, source); of equal ways to a node that with the smallest node before it."""
    roads = checkpointed(both_ways(edges))
    kind = dict(edges.dtypes)["a"]
    best = F.struct("nm", "before", "falls")
    start = sources.select(*SOURCE).distinct().select(*SOURCE, F.col("source").cast(kind).alias("node"), F.lit(0.0).alias("nm"), F.lit(None).cast(kind).alias("before"), F.lit(1).alias("falls"))
    reached = checkpointed(start)
    while not reached.filter("falls = 1").isEmpty():
        front = reached.filter("falls = 1").select(*SOURCE, F.col("node").alias("a"), F.col("nm").alias("so_far"))
        open_ = F.col("passage").isNull() | ~F.array_contains("closed", F.col("passage"))
        further = front.join(roads, "a").filter(open_).select(*SOURCE, F.col("b").alias("node"), (F.col("so_far") + F.col("nm")).alias("nm"), F.col("a").alias("before"), F.lit(1).alias("falls"))
        # A row that was there before wins where all else is equal, so what ``falls`` is new or shorter. Null sorts first: the start keeps no node before it.
        met = reached.withColumn("falls", F.lit(0)).unionByName(further).groupBy(*SOURCE, "node").agg(F.min(best).alias("best"))
        reached = checkpointed(met.select(*SOURCE, "node", "best.nm", "best.before", "best.falls"))
    return reached.drop("falls")


def ways(reached: DataFrame) -> DataFrame:
    """(closed, source, node, nm, path) of rows of ``distances``: the nodes from the source on."""
    held = reached.select(*SOURCE, "node", "nm", F.col("before").alias("back"), F.array("node").alias("path"))
    while not held.filter("back is not null").isEmpty():
        earlier = held.select(*SOURCE, F.col("node").alias("back"), F.col("back").alias("further_back"), F.col("path").alias("first"))
        joined = held.join(earlier, [*SOURCE, "back"], "left")
        held = checkpointed(joined.select(*SOURCE, "node", "nm", F.col("further_back").alias("back"), F.when(F.col("first").isNull(), F.col("path")).otherwise(F.concat("first", "path")).alias("path")))
    return held.drop("back")


def shortest_ways(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request_id, nm, path) of requests (request_id, points, restrictions): from the first of two or more nodes by the others to the last.

    edges: (a, b, nm, passage), open in both directions unless their passage is closed. nm and path are null where a leg has no way; fewer than two points are an error.
    """
    points = F.when(F.size("points") >= 2, F.col("points")).otherwise(F.raise_error(F.lit("a way needs two points")).cast(dict(requests.dtypes)["points"]))
    asked = checkpointed(requests.select("request_id", points.alias("points"), closed_passages(F.col("restrictions")).alias("closed")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("points") - 2), lambda i: F.struct(i.alias("leg"), F.get("points", i).alias("source"), F.get("points", i + 1).alias("node")))
    legs = asked.select("request_id", "closed", F.explode(pairs).alias("p")).select("request_id", "closed", "p.leg", "p.source", "p.node")
    found = ways(distances(legs, edges))
    met = legs.join(found, [*SOURCE, "node"], "left")
    # A request has as many legs as it has points.
    by_request = met.groupBy("request_id").agg(F.count("nm").alias("n"), F.count(F.lit(1)).alias("legs"), F.array_sort(F.collect_list(F.struct("leg", "nm", "path"))).alias("held"))
    total = F.aggregate("held", F.lit(0.0), lambda s, x: s + x["nm"])
    # A leg starts where the one before ends.
    path = F.flatten(F.transform("held", lambda x: F.when(x["leg"] == 0, x["path"]).otherwise(F.slice(x["path"], 2, F.greatest(F.size(x["path"]) - 1, F.lit(0))))))
    whole = F.col("n") == F.col("legs")
    return by_request.select("request_id", F.when(whole, total).alias("nm"), F.when(whole, path).alias("path"))
