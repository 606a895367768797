"""Shortest ways by joins against Dijkstra's loop."""

import heapq
import random

import pytest

from kelpline.operators import network

REQUESTS = "request_id long, points array<string>, restrictions array<string>"
EDGES = "a string, b string, nm double, passage string"


def plain(edges, source, target, closed):
    near = {}
    for a, b, nm, passage in edges:
        if passage not in closed:
            near.setdefault(a, []).append((b, nm))
            near.setdefault(b, []).append((a, nm))
    seen, queue = {}, [(0.0, source)]
    while queue:
        d, n = heapq.heappop(queue)
        if n not in seen:
            seen[n] = d
            for m, nm in near.get(n, ()):
                heapq.heappush(queue, (d + nm, m))
    return seen.get(target)


def test_random_networks(spark):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(nodes), rng.choice(nodes), float(rng.randrange(1, 30)), rng.choice([None, None, "suez", "panama"])) for _ in range(70)] + [("n1", "n2", 5.0, None), ("n1", "n2", 3.0, None)]
    requests = [(i, [rng.choice(nodes) for _ in range(rng.choice([2, 2, 3, 4]))], rng.choice([None, [], ["suez"], ["panama", "suez", "suez"]])) for i in range(60)] + [(90, ["n1", "n1"], []), (91, ["n1", "nowhere"], []), (92, ["nowhere", "nowhere"], [])]
    got = {r["request_id"]: r for r in network.shortest_ways(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(edges, EDGES)).collect()}
    assert len(got) == len(requests)
    for key, points, closed in requests:
        legs = [plain(edges, a, b, closed or ()) for a, b in zip(points, points[1:])]
        r = got[key]
        if None in legs:
            assert r["nm"] is None and r["path"] is None
            continue
        assert r["nm"] == sum(legs) and r["path"][0] == points[0] and r["path"][-1] == points[-1]
        steps = [min(nm for x, y, nm, p in edges if {x, y} == {a, b} and p not in (closed or ())) for a, b in zip(r["path"], r["path"][1:]) if a != b]
        assert sum(steps) == r["nm"] and set(points) <= set(r["path"])


def test_a_blocked_passage_is_sailed_around(spark):
    edges = [("busan", "singapore", 2500.0, None), ("singapore", "aden", 3600.0, None), ("aden", "port said", 1400.0, "suez"), ("port said", "hamburg", 3700.0, None), ("singapore", "cape", 5600.0, None), ("cape", "hamburg", 6300.0, None)]
    requests = [(1, ["busan", "hamburg"], None), (2, ["busan", "hamburg"], ["suez"]), (3, ["busan", "singapore", "hamburg"], []), (4, ["busan", "port said"], ["suez"])]
    got = {r["request_id"]: (r["nm"], r["path"]) for r in network.shortest_ways(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(edges, EDGES)).collect()}
    by_suez = (11200.0, ["busan", "singapore", "aden", "port said", "hamburg"])
    assert got[1] == got[3] == by_suez and got[2] == (14400.0, ["busan", "singapore", "cape", "hamburg"]) and got[4][0] == 14400.0 + 3700.0
    none = network.shortest_ways(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([], EDGES))
    assert {(r["nm"], r["path"]) for r in none.collect()} == {(None, None)}


def test_long_ways(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}", 1.0, None) for i in range(37)]
    got = network.shortest_ways(spark.createDataFrame([(1, ["037", "000"], [])], REQUESTS), spark.createDataFrame(edges, EDGES)).first()
    assert got["nm"] == 37.0 and got["path"] == [f"{i:03d}" for i in range(37, -1, -1)]


@pytest.mark.parametrize(("points", "closed", "nm", "why"), [(["a"], [], 1.0, "two points"), (["a", "b"], ["not-a-passage"], 1.0, "unknown passage"), (["a", "b"], [], -1.0, "length")])
def test_errors(spark, points, closed, nm, why):
    with pytest.raises(Exception, match=why):
        network.shortest_ways(spark.createDataFrame([(1, points, closed)], REQUESTS), spark.createDataFrame([("a", "b", nm, None)], EDGES)).collect()
