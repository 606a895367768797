"""MinHash near-dedup by ProbMinHash on weighted word shingles.

Each distinct shingle of a text is an element whose weight is the number of times it occurs. Elements arrive in Poisson processes with
their weights as rates; an arrival falls on a random component, and a component keeps the element that reaches it first. A process
stops as soon as its next arrival is later than every component's (early termination). Two texts then agree in a component with their
probability Jaccard similarity. Components are banded, and candidates are verified exactly by the weighted Jaccard similarity of their shingles.

Texts with the same words are one class from the start (a partial aggregation, so thousands of copies cost no pair). The buckets of one
least member, their hub, are one group; it is cut into blocks of bounded size by a hash, and the hub comes to each of them. In a block all
members are compared, but for those that are already linked through others. So a bucket of one block is done; in one of several blocks, members that
aren't linked to the hub within their block meet the members of all other blocks. No candidate link that would join components is lost.

Defined cases: texts without words form a class only if equal and not blank; null, empty and blank texts are never linked; rows with
the same id and words are one document; rows of one id with other words are compared as texts of their own; a row without an id is kept, and
compared with none; ties in a class go to the smallest id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, join_groups, n_partitions
from .components import components
from .shingles import WIDTH, mixed, shingled, weighted

SIMILARITY = 0.8
#: Members and shingles of a block, about; a task holds two blocks at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
BANDS, BAND_ROWS = 16, 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def prob_minhash(h: np.ndarray, of: np.ndarray, weight: np.ndarray, n_rows: int, m: int = BANDS * BAND_ROWS) -> np.ndarray:
    """n_rows x m elements: who reached each component first. Rows without elements are all 0."""
    first = np.full(n_rows * m, np.inf)
    who = np.zeros(n_rows * m, np.uint64)
    clock = np.zeros(len(h))
    e, row, rate = h, of, 1.0 / weight
    step = 0
    while len(e):
        step += 1
        bits = mixed(e + np.uint64(step * int(_GOLD) % 2**64))
        clock = clock - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) * rate
        cell = row * m + (mixed(bits) % np.uint64(m)).astype(np.int64)
        np.minimum.at(first, cell, clock)
        won = first[cell] == clock
        who[cell[won]] = e[won]
        latest = first.reshape(n_rows, m).max(1)
        on = clock < latest[row]
        e, row, rate, clock = e[on], row[on], rate[on], clock[on]
    return who.reshape(n_rows, m)


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        texts, ids, row_hash = pdf["text"].tolist(), pdf["doc_id"].to_numpy(), pdf["row_hash"].to_numpy()
        for a, n, h, of, count, k1, k2 in shingled(texts):
            element, row, weight = weighted(h, of)
            who = prob_minhash(element, row, weight, n).reshape(n, BANDS, BAND_ROWS)
            bands = np.full((n, BANDS), 1, np.uint64)
            for k in range(BAND_ROWS):
                bands = mixed(bands * _GOLD + who[:, :, k])
            keys = [k1.astype(np.int64), k2.astype(np.int64)]
            for i in np.flatnonzero(count == 0):
                text = (texts[a + i] or "").strip()
                digest = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass") if text else b"\0%d" % ids[a + i])
                keys[0][i], keys[1][i] = np.array([digest & (2**64 - 1), digest >> 64], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": ids[a : a + n], "row_hash": row_hash[a : a + n], "k1": keys[0], "k2": keys[1], "n_words": count, "bands": list(bands.astype(np.int64))})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text), k1 and k2 (the words' hash), n_words, bands (null for texts without words)."""
    rows = _texts(docs).mapInPandas(_sketches, "doc_id long, row_hash long, k1 long, k2 long, n_words long, bands array<long>")
    return rows.withColumn("bands", F.when(F.col("n_words") > 0, F.col("bands")))


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        texts, ids, row_hash = pdf["text"].tolist(), pdf["doc_id"].to_numpy(), pdf["row_hash"].to_numpy()
        for a, n, h, of, _, _, _ in shingled(texts):
            element, row, weight = weighted(h, of)
            cuts = np.r_[0, np.cumsum(np.bincount(row, minlength=n))]
            parts = [slice(cuts[i], cuts[i + 1]) for i in range(n)]
            yield pd.DataFrame({
                "id": ids[a : a + n],
                "row_hash": row_hash[a : a + n],
                "hashes": [element[p].tobytes() for p in parts],
                # Not sent where every shingle occurs once.
                "counts": [None if (weight[p] == 1).all() else weight[p].astype(np.int32).tobytes() for p in parts],
            })


def weighted_jaccard(ha: np.ndarray, ca: np.ndarray, hb: np.ndarray, cb: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger; 0 if both are empty."""
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    either = int(ca.sum()) + int(cb.sum()) - both
    return both / either if either else 0.0


def linked(hashes: list[np.ndarray], counts: list[np.ndarray], part: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """A label for each set, equal where links join them: each set taken up is held against all others not yet reached, in one pass.

    part: only sets of different parts are compared. known: labels of sets that are joined already.
    """
    n = len(hashes)
    total = np.array([int(c.sum()) for c in counts])
    order = np.argsort(total, kind="stable")
    total = total[order]
    sizes = np.array([len(hashes[i]) for i in order])
    starts = np.r_[0, np.cumsum(sizes)]
    place = np.unique(np.concatenate([hashes[i] for i in order]), return_inverse=True)[1]
    times = np.concatenate([counts[i] for i in order])
    own = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int64)
    parts = np.zeros(n, np.int64) if part is None else part[order]
    before = np.arange(n) if known is None else known[order]
    label = np.full(n, -1)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        waiting = np.flatnonzero(before == before[seed]).tolist()
        label[waiting] = seed
        while waiting:
            p = waiting.pop()
            lo, hi = np.searchsorted(total, SIMILARITY * total[p] - 1e-9), np.searchsorted(total, total[p] / SIMILARITY + 1e-9, "right")
            if not (label[lo:hi] < 0).any():
                continue
            mine = slice(starts[p], starts[p + 1])
            own[place[mine]] = times[mine]
            span = slice(starts[lo], starts[hi])
            both = np.add.reduceat(np.minimum(own[place[span]], times[span]), starts[lo:hi] - starts[lo])
            own[place[mine]] = 0
            near = (both >= SIMILARITY * (total[lo:hi] + total[p] - both)) & (label[lo:hi] < 0)
            if part is not None:
                near &= parts[lo:hi] != parts[p]
            for q in np.unique(before[lo:hi][near]):
                more = np.flatnonzero(before == q)
                label[more] = seed
                waiting.extend(more.tolist())
    out = np.empty(n, np.int64)
    out[order] = label
    return out


def _sets_of(rows: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    return hashes, [np.ones(len(h), np.int32) if c is None else np.frombuffer(c, np.int32) for h, c in zip(hashes, rows["counts"], strict=True)]


def _least(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each member the least id of its component, and whether there are others in it."""
    names, at, n = np.unique(label, return_inverse=True, return_counts=True)
    root = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(root, at, ids)
    return root[at], n[at] > 1


STARS = "hub long, blocks int, block int, id long, row_hash long, shingles long, root long"


def _block_stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Streams rows sorted by group, and answers a group when it is whole: each member with the least id that it is linked to."""
    held: list[pd.DataFrame] = []

    def answer() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        held.clear()
        hashes, counts = _sets_of(rows)
        if "root" in rows:  # a second look: blocks are whole, and what is linked in them is known
            label = linked(hashes, counts, rows["block"].to_numpy(), np.unique(rows["root"].to_numpy(), return_inverse=True)[1])
        else:
            label = linked(hashes, counts)
        root, several = _least(rows["id"].to_numpy(), label)
        out = rows[["hub", "blocks", "block", "id", "row_hash"]].assign(shingles=[int(c.sum()) for c in counts], root=root)
        return out[several | ((rows["blocks"] > 1).to_numpy() & ("root" not in rows))]

    last = None
    for pdf in filter(len, batches):
        keys = pdf[["hub", "i", "j"]].to_numpy()
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(pdf)]
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and last != tuple(keys[a]):
                out.append(answer())
            held.append(pdf.iloc[a:b])
            last = tuple(keys[a])
        if out:
            yield pd.concat(out, ignore_index=True)
    if held:
        yield answer()


def _stars(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """The answers of all groups (hub, i, j) of ``dealt``."""
    group = ["hub", "i", "j"]
    met = dealt.join(sets, ["id", "row_hash"])
    return met.repartition(n_partitions(dealt), *group).sortWithinPartitions(*group).mapInPandas(_block_stars, STARS)


def _groups(classes: DataFrame) -> DataFrame:
    """(hub, blocks, block, id, row_hash): the members of each hub's buckets, once each, and the hub in every block."""
    buckets = classes.filter("bands is not null").select("id", "row_hash", F.greatest(F.col("n_words") - (WIDTH - 1), F.lit(1)).alias("shingles"), F.posexplode("bands"))
    buckets = buckets.select(F.xxhash64("pos", "col").alias("bucket"), "id", "row_hash", "shingles")
    sizes = buckets.groupBy("bucket").agg(F.min(F.struct("id", "row_hash")).alias("h"), F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("shingles")).filter("n > 1")
    # A hub has one bucket a band at most, and one number of blocks for all of them.
    of_hub = Window.partitionBy("h")
    blocks = F.ceil(F.greatest(F.max("n").over(of_hub) / BLOCK, F.max("shingles").over(of_hub) / BLOCK_SHINGLES)).cast("int")
    hubs = checkpointed(sizes.select("bucket", "n", "h", blocks.alias("blocks")))
    met = join_groups(buckets.select("bucket", "id", "row_hash"), hubs, ["bucket"], "n").select(F.col("h.id").alias("hub"), F.col("h.row_hash").alias("hub_hash"), "blocks", "id", "row_hash").distinct()
    placed = checkpointed(met.withColumn("block", F.pmod(F.xxhash64("id", "row_hash"), F.col("blocks")).cast("int")))
    is_hub = (F.col("id") == F.col("hub")) & (F.col("row_hash") == F.col("hub_hash"))
    everywhere = F.when(is_hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    return placed.withColumn("block", F.explode(everywhere)).drop("hub_hash")


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, class_id) of the classes that verified links join."""
    dealt = _groups(classes)
    sets = checkpointed(
        _texts(docs).join(dealt.select(F.col("id").alias("doc_id"), "row_hash"), ["doc_id", "row_hash"], "left_semi")
        .mapInPandas(_shingle_sets, "id long, row_hash long, hashes binary, counts binary").dropDuplicates(["id", "row_hash"])
    )
    first = checkpointed(_stars(dealt.withColumns({"i": F.lit(0), "j": F.col("block")}), sets))
    # Of groups of several blocks, what isn't linked to the hub within its block is loose: it meets the other blocks.
    loose = F.col("root") != F.col("hub")
    large = first.filter("blocks > 1")
    sizes = large.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(loose, 1)).alias("loose"), F.sum(F.when(loose, F.col("shingles"))).alias("loose_shingles")).filter("loose > 0")
    parts = checkpointed(sizes.select("hub", "n", F.ceil(F.greatest(F.col("loose") / BLOCK, F.col("loose_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")))
    if parts.isEmpty():
        return _joined(first.select("id", "root"))
    again = join_groups(large, parts, ["hub"], "n").drop("shingles")
    members = again.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"))
    guests = again.filter(loose).select("*", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")).filter("j <> block")
    more = _stars(members.unionByName(guests), sets)
    return _joined(first.select("id", "root").unionByName(more.select("id", "root")))


def _joined(stars: DataFrame) -> DataFrame:
    """(id, class_id) of (id, root) rows. Ids that are no root are leaves: only their roots are handed to the search for components."""
    nodes = checkpointed(stars.groupBy("id").agg(F.min("root").alias("least"), F.collect_set("root").alias("roots")))
    edges = nodes.select(F.explode("roots").alias("a"), F.col("least").alias("b")).filter("a <> b")
    if edges.isEmpty():
        return nodes.select("id", F.col("least").alias("class_id"))
    # Rows of one root are as many as its members, so the join is by groups of known size.
    members = nodes.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    roots = checkpointed(members.join(components(edges).withColumnRenamed("id", "least"), "least", "left").select("least", "n", F.coalesce("component", "least").alias("class_id")))
    return join_groups(nodes.select("id", "least"), roots, ["least"], "n").select("id", "class_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id of its near-duplicate group), kept: one row for each row of ``docs``."""
    lone = docs.filter("doc_id is null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    docs = docs.filter("doc_id is not null")
    rows = checkpointed(sketches(docs))
    least = F.min(F.struct("doc_id", "row_hash")).alias("h")
    classes = checkpointed(
        rows.groupBy("k1", "k2").agg(least, F.min_by("bands", "doc_id").alias("bands"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n"))
        .select("k1", "k2", F.col("h.doc_id").alias("id"), F.col("h.row_hash").alias("row_hash"), "bands", "n_words", "n")
    )
    groups = checkpointed(classes.select("k1", "k2", "id", "n").join(links(classes, docs), "id", "left").select("k1", "k2", "n", F.coalesce("class_id", "id").alias("class_id")))
    out = join_groups(rows.select("doc_id", "k1", "k2"), groups, ["k1", "k2"], "n")
    return out.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")).unionByName(lone)
