"""Embedding near-dedup by spherical-cap filters.

The filter directions are random product codes: after a seeded rotation the dimensions are cut into two blocks, each with its own random
unit code words, and every pair of code words is a direction; several rotations even out how many directions a vector exceeds. A vector is list-decoded to all directions whose inner product
exceeds the cap's height, without looking at those that cannot reach it: only code words that some partner can lift over it are combined. Vectors that share a filter meet and are compared by cosine in double precision; none is reported unverified.

The height of the caps comes from the number of vectors, so that a filter holds about ``FILLED`` of them whatever the corpus; the number of filters follows, so that
a pair at the threshold still shares as many.

Equal vectors are one class from the start, with a size. A pair that shares several filters is counted in the first of them alone, so
links are summed where they are found and pairs are never written out. A filter with many vectors is cut into blocks whose pairs are groups
of their own. A vector that exceeds no filter goes to its best one.

Defined cases: null and zero vectors and those with null or non-finite components have no links and are their own component; vectors of
different lengths never link; a row without an id links with nothing; rows of one id are vectors of their own: equal ones link, others are compared; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_groups, n_partitions
from .components import components

COSINE = 0.9
#: Rotations, vectors that a filter holds on average, and bounds of the caps' height (an inner product of unit vectors, for 64 dimensions the least is 3 deviations).
ROTATIONS, FILLED, LEAST, MOST = 8, 64, 3.0, 0.75
#: Filters that both of two vectors at the threshold exceed, on average. Product codes are uneven, so some pairs share far fewer.
SHARED = 14.0
#: Vectors of a block of a filter's vectors.
BLOCK = 1024
SEED = 11
#: Points of the sums that stand for integrals over the sphere.
GRID = 4000


def _above(height: np.ndarray | float, dims: int) -> np.ndarray:
    """Part of the unit vectors whose inner product with a fixed one is above each height."""
    x = (np.arange(GRID) + 0.5) / GRID * 2 - 1
    density = (1 - x * x) ** ((max(dims, 2) - 3) / 2)
    tail = np.r_[np.cumsum(density[::-1])[::-1], 0.0] / density.sum()
    return np.interp(height, np.arange(GRID + 1) / GRID * 2 - 1, tail)


def cap_height(n: int, dims: int) -> float:
    """The height that ``FILLED`` of n random vectors exceed, by halving between the bounds."""
    low, high = min(LEAST / math.sqrt(dims), 0.5), MOST
    if n * _above(low, dims) <= FILLED:
        return low
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if n * _above(middle, dims) > FILLED else (low, middle)
    return low


def both_above(height: float, dims: int) -> float:
    """Part of the vectors over a cap whose partner at the threshold is over it too."""
    x = height + (np.arange(GRID) + 0.5) / GRID * (1 - height)
    weight = (1 - x * x) ** ((max(dims, 2) - 3) / 2)
    partner = _above((height - COSINE * x) / np.sqrt((1 - COSINE**2) * (1 - x * x)), dims - 1)
    return float((weight * partner).sum() / weight.sum())


class ProductCode:
    """The filter directions for n vectors of ``dims`` components."""

    def __init__(self, dims: int, n: int = 1):
        rng = np.random.default_rng([SEED, dims])
        self.cap = cap_height(n, dims)
        self.cut = (dims + 1) // 2
        self.words = math.ceil((SHARED / both_above(self.cap, dims) / ROTATIONS / float(_above(self.cap, dims))) ** 0.5)
        self.codes = []
        for _ in range(ROTATIONS):
            rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
            left, right = rng.normal(size=(self.words, self.cut)), rng.normal(size=(self.words, max(dims - self.cut, 1)))
            left, right = (c / np.linalg.norm(c, axis=1, keepdims=True) for c in (left, right))
            # Scores of one block's code words are one product with the vector.
            self.codes.append((rotation[:, : self.cut] @ left.T / math.sqrt(2), rotation[:, self.cut :] @ right[:, : dims - self.cut].T / math.sqrt(2)))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors exceed, by row and filter."""
        found_rows, found = [], []
        best, best_score = np.zeros(len(unit), np.int64), np.full(len(unit), -np.inf)
        for r, (code_a, code_b) in enumerate(self.codes):
            a, b = unit @ code_a, unit @ code_b
            start = r * self.words**2
            row, i = np.nonzero(a >= (self.cap - b.max(1))[:, None])
            k, j = np.nonzero(b[row] >= (self.cap - a[row, i])[:, None])
            found_rows.append(row[k])
            found.append(start + i[k] * self.words + j)
            top = a.max(1) + b.max(1)
            best = np.where(top > best_score, start + a.argmax(1) * self.words + b.argmax(1), best)
            best_score = np.maximum(best_score, top)
        rows, filters = np.concatenate(found_rows), np.concatenate(found)
        none = np.setdiff1d(np.arange(len(unit)), rows)
        rows, filters = np.r_[rows, none], np.r_[filters, best[none]]
        order = np.lexsort((filters, rows))
        return rows[order], filters[order]


def _packed(v: np.ndarray) -> bytes:
    """Single precision where it loses nothing."""
    single = v.astype(np.float32)
    return single.tobytes() if (single == v).all() else v.tobytes()


def _unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, np.float32 if len(data) == 4 * dims else np.float64).astype(np.float64)


def _decoded(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    codes: dict[int, ProductCode] = {}
    for pdf in filter(len, batches):
        dims = pdf["vector"].map(len).to_numpy()
        for d in np.unique(dims):
            code = codes.setdefault(int(d), ProductCode(int(d), n))
            part = pdf[dims == d]
            for a in range(0, len(part), 256):
                some = part.iloc[a : a + 256]
                v = np.stack([np.asarray(x, np.float64) for x in some["vector"]])
                row, found = code.decode(v / np.linalg.norm(v, axis=1, keepdims=True))
                cuts = np.searchsorted(row, np.arange(len(some) + 1))
                yield pd.DataFrame({
                    "id": some["id"].to_numpy(),
                    "size": some["size"].to_numpy(),
                    "dims": np.full(len(some), d, np.int32),
                    "data": [_packed(x) for x in v],
                    "filters": [found[cuts[i] : cuts[i + 1]] for i in range(len(some))],
                })


def _compare(rows: list[tuple], key: tuple) -> pd.DataFrame | None:
    """Links among the vectors of one group: for each end their number, and the least id that it reaches here."""
    dims, filter_id, i, j = key
    ids, sizes, parts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
    v = np.stack([_unpacked(r[3], dims) for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = np.triu(unit @ unit.T >= COSINE, 1)
    if i != j:
        linked &= parts[:, None] != parts[None, :]
    a, b = np.nonzero(linked)
    if not len(a):
        return None
    # A pair that shares an earlier filter was counted there.
    used, place = np.unique(np.r_[a, b], return_inverse=True)
    earlier = [np.asarray(rows[u][4], np.int64) for u in used]
    earlier = [f[f < filter_id] for f in earlier]
    names, at = np.unique(np.concatenate(earlier), return_inverse=True)
    has = np.zeros((len(used), len(names)), np.float32)
    has[np.repeat(np.arange(len(used)), [len(f) for f in earlier]), at] = 1
    pa, pb = place[: len(a)], place[len(a) :]
    new = (has @ has.T)[pa, pb] == 0 if len(names) else np.ones(len(a), bool)
    n = np.zeros(len(used), np.int64)
    np.add.at(n, pa[new], sizes[b[new]])
    np.add.at(n, pb[new], sizes[a[new]])
    # Least id within each component of the group.
    least = ids[used].copy()
    while True:
        low = least.copy()
        np.minimum.at(low, pa, least[pb])
        np.minimum.at(low, pb, least[pa])
        if (low == least).all():
            break
        least = low
    return pd.DataFrame({"id": ids[used], "n": n, "least": least})


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows that are sorted by (dims, filter, i, j); a group holds two blocks at most."""
    key, rows = None, []
    for pdf in filter(len, batches):
        found = []
        cols = [pdf[c].tolist() for c in ("dims", "filter", "i", "j", "id", "size", "part", "data", "filters")]
        for d, f, i, j, *row in zip(*cols, strict=True):
            if (d, f, i, j) != key:
                if len(rows) > 1:
                    found.append(_compare(rows, key))
                key, rows = (d, f, i, j), []
            rows.append(row)
        found = [x for x in found if x is not None]
        if found:
            yield pd.concat(found, ignore_index=True)
    if len(rows) > 1:
        last = _compare(rows, key)
        if last is not None:
            yield last


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(finite & F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("vector"))
    grouped = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"))
    # A class has a number of its own, fixed when it is written; ids may repeat.
    classes = checkpointed(grouped.withColumn("id", F.monotonically_increasing_id()))
    n = classes.count()
    decoded = checkpointed(classes.select("id", "size", "vector").mapInPandas(lambda it: _decoded(it, n), "id long, size long, dims int, data binary, filters array<long>"))
    lists = decoded.select("id", "size", "dims", "data", "filters", F.explode("filters").alias("filter"))
    counts = lists.groupBy("dims", "filter").agg(F.count(F.lit(1)).alias("in_filter")).filter("in_filter > 1").withColumn("blocks", F.ceil(F.col("in_filter") / BLOCK).cast("int"))
    placed = lists.join(counts, ["dims", "filter"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")})
    group = ["dims", "filter", "i", "j"]
    packed = dealt.select(*group, "id", "size", "part", "data", F.col("filters"))
    met = packed.repartition(n_partitions(vectors), *group).sortWithinPartitions(*group)
    found = checkpointed(met.mapInPandas(_groups, "id long, n long, least long"))
    part = checkpointed(components(found.select(F.col("id").alias("a"), F.col("least").alias("b"))))
    # The smallest vec_id of a component; its classes find it in a table of known group sizes.
    least = checkpointed(classes.select("id", "vec_id").join(part, "id").groupBy("component").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    reached = join_groups(part, least, ["component"], "n").select("id", "component_id")
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = checkpointed(
        classes.join(links, "id", "left").join(reached, "id", "left")
        .select("vector", "size", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    )
    out = join_groups(rows.filter("vector is not null"), named, ["vector"], "size").select("vec_id", "n_links", "component_id")
    lone = rows.filter("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
