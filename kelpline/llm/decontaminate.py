"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame functions only.

Words are longest runs of letters and numbers, lower-cased; shingles are five words. A window of a document has as many shingles as an
item, or fewer where the text ends. Where windows have to be looked at comes from a join with the items' shingles: a window whose weighted Jaccard
similarity with an item of n shingles is 0.8 or more has at least 0.8 n positions with a shingle of the item. (Only windows of n shingles have
1.6 / 1.8 n; one that the text's end cuts may be 0.8 n shared ones.) This leaves no such window out, and names no item.

Each of these windows gets a SimHash fingerprint, and is looked up by its blocks among the fingerprints of all items of its size: of ``RADIUS`` + 1 blocks any two
fingerprints within the radius share one. At similarity 0.8 a bit differs with probability 0.15, so fingerprints differ in 19 of 124 bits with a deviation of 4: the radius
is five and a half deviations above that, and almost four below the 62 bits of unrelated ones, of which 1 in 10,000 gets through. What is
within the radius is verified by the exact weighted similarity of the shingles.

Defined cases: null, empty and shorter documents have no windows and are clean; items of fewer than five words, which any text may hold,
are not looked for; of rows with one id any contaminated row marks the id; a document with several items has them all in ``item_ids``; ties
for ``item_id`` go to the smallest; empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SIMILARITY = 0.8
WIDTH = 5
#: A fingerprint is two halves, numbers of ``HALF`` bits, each cut into blocks of three bits (and a last one of two).
HALF, BLOCK_BITS = 62, 3
BLOCKS = 2 * -(-HALF // BLOCK_BITS)
RADIUS = BLOCKS - 1
#: Bytes of a table that may be broadcast; larger ones are joined by a shuffle.
MAX_BROADCAST = 64 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(word: Column) -> Column:
    """Hashes of all runs of five words, in order; none of fewer. The words are bound to a variable, so they are found once a text."""
    def of(w: Column) -> Column:
        at = F.when(F.size(w) >= WIDTH, F.sequence(F.lit(0), F.size(w) - WIDTH)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WIDTH)]))

    return F.get(F.transform(F.array(word), of), F.lit(0))


def simhash(shingled: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, print0, print1) of rows with an array of shingle hashes: each bit is the majority of that bit over all shingles, repeated ones counted as often as they occur.

    Bits are counted by sums over the exploded shingles, which a task adds up before anything is shuffled. A sum holds two counters of 31 bits.
    """
    half = HALF // 2
    low = (1 << half) - 1
    each = shingled.select(*keys, F.explode(column).alias("h0")).withColumn("h1", F.xxhash64("h0"))
    sums = [F.array(*[F.expr(f"sum(shiftrightunsigned(h{h}, {k}) & {low + 2}L)") for k in range(half)]).alias(f"sums{h}") for h in (0, 1)]
    bits = "transform(sums{0}, (c, k) -> if(2 * (c & {1}L) > total, shiftleft(1L, k), 0L) | if(2 * shiftrightunsigned(c, {2}) > total, shiftleft(1L, k + {2}), 0L))"
    prints = [F.expr(f"aggregate({bits.format(h, low, half)}, 0L, (a, x) -> a | x)").alias(f"print{h}") for h in (0, 1)]
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *sums).select(*keys, *prints)


def blocks() -> Column:
    """(block, value) for every block of (print0, print1), as one number each."""
    size, last = 1 << BLOCK_BITS, BLOCKS // 2 - 1
    of = [f"transform(sequence(0, {last}), k -> cast(shiftrightunsigned(print{h}, {BLOCK_BITS} * k) & {size - 1}L as int) + {size} * (k + {h * (last + 1)}))" for h in (0, 1)]
    return F.expr(f"concat({', '.join(of)})")


def hamming(a: str, b: str) -> Column:
    halves = [F.bit_count(F.col(f"{a}.print{half}").bitwiseXOR(F.col(f"{b}.print{half}"))) for half in (0, 1)]
    return halves[0] + halves[1]


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as bags. Only what both have several times is counted; all else is a set operation."""
    def several(bag: Column) -> Column:
        again = F.transform(F.array(F.array_sort(bag)), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x))))
        return F.get(again, F.lit(0))

    def times(bag: Column, x: Column) -> Column:
        return F.size(F.filter(bag, lambda y: y == x))

    both = F.aggregate(F.array_intersect(several(a), several(b)), F.size(F.array_intersect(a, b)), lambda n, x: n + F.least(times(a, x), times(b, x)) - 1)
    return both / (F.size(a) + F.size(b) - both)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, to be broadcast if it has been counted to be small enough."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST else df


def candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a window and an item of its size whose fingerprints are within the radius, found by their blocks.

    windows: (doc_id, row_hash, n, start, window); items: (item_id, n, item).
    """
    index = simhash(items, ["item_id", "n"], "item").withColumn("block", F.explode(blocks()))
    keys = ["doc_id", "row_hash", "n", "start"]
    asked = simhash(windows, keys, "window").withColumn("block", F.explode(blocks()))
    near = asked.alias("w").join(_small(index, 64).alias("i"), ["n", "block"]).withColumn("hamming", hamming("w", "i")).filter(F.col("hamming") <= RADIUS)
    return near.select(*keys, "item_id", "hamming").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, hamming: the best window of each pair of a document and an item that it holds."""
    items = checkpointed(
        benchmark.filter("item_id is not null").select("item_id", shingles(words(F.col("text"))).alias("item")).filter(F.size("item") > 0)
        .withColumn("n", F.size("item")).withColumn("need", F.ceil(F.col("n") * SIMILARITY - 1e-9).cast("int"))
    )
    index = items.select("item_id", "n", "need", F.explode(F.array_distinct("item")).alias("shingle"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("row_hash"))
    hits = (
        texts.select("doc_id", "row_hash", F.posexplode(shingles(words(F.col("text")))).alias("pos", "shingle"))
        .join(_small(index, 64), "shingle")
        .groupBy("doc_id", "row_hash", "item_id", "n", "need")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
        .filter(F.size("at") >= F.col("need"))
    )
    # Runs of `need` hits that fit into one window, and the places where such a window can start.
    first = F.filter(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda j: F.get(F.col("at"), j + F.col("need") - 1) - F.get(F.col("at"), j) < F.col("n"))
    starts = F.flatten(F.transform(first, lambda j: F.sequence(F.greatest(F.lit(0), F.get(F.col("at"), j + F.col("need") - 1) - F.col("n") + 1), F.get(F.col("at"), j))))
    places = hits.select("doc_id", "row_hash", "n", F.array_distinct(starts).alias("starts")).filter(F.size("starts") > 0)
    spots = checkpointed(places.groupBy("doc_id", "row_hash", "n").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts")))
    wanted = _small(spots.select("doc_id", "row_hash").distinct(), 64)
    held = checkpointed(texts.join(wanted, ["doc_id", "row_hash"], "left_semi").dropDuplicates(["doc_id", "row_hash"]).select("doc_id", "row_hash", shingles(words(F.col("text"))).alias("all")))
    windows = (
        spots.join(held, ["doc_id", "row_hash"]).select("doc_id", "row_hash", "n", F.explode("starts").alias("start"), "all")
        .select("doc_id", "row_hash", "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("window"))
    )
    near = candidates(windows, items.select("item_id", "n", "item"))
    found = (
        near.join(held, ["doc_id", "row_hash"]).join(items.select("item_id", "item"), "item_id")
        .withColumn("similarity", weighted_similarity(F.slice("all", F.col("start") + 1, F.col("n")), F.col("item")))
        .filter(F.col("similarity") >= SIMILARITY)
    )
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("far"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.far")).alias("hamming"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated document: doc_id, n_links, its best item, that similarity, and all items."""
    best = F.max(F.struct("similarity", (-F.col("item_id")).alias("minus"), "hamming")).alias("best")
    return leaks(docs, benchmark).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_links"), best, F.sort_array(F.collect_list("item_id")).alias("item_ids")).select(
        "doc_id", "n_links", (-F.col("best.minus")).alias("item_id"), "best.similarity", "best.hamming", "item_ids"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the contaminated documents; rows without an id stay."""
    return docs.join(contaminated(docs, benchmark).select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
