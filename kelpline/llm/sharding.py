"""Sharding by fixed virtual slots.

A record is hashed by its id into one of thousands of virtual slots, the bytes of every slot are summed, and a versioned
map sends slots to shards. Only the map is edited when shards are added or sizes drift; records keep their slot for ever.
Rows without an id, or of one id, would fill one slot: they are hashed by their text as well, and of equal rows each has a number of its own that is hashed too.

Law: ``bytes``. Shard sizes are near equal: off by at most one slot's bytes, or one record's where a record is larger.

Defined cases: a null text counts no bytes (only the fixed overhead) and has a null CRC; equal texts and repeated ids are separate
records; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, utf8_size

#: Virtual slots; a power of two, far above any shard count, fixed for the life of a corpus.
N_SLOTS = 8192
#: Repeated ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Bytes that a record takes besides its text.
OVERHEAD = 16


def virtual_slot(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot: at most ``N_SLOTS`` rows, summed before the shuffle."""
    return records.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def assign_slots(sizes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """The first map: slots from the largest down, each to the least filled shard. ``n_slots`` entries, whatever the corpus."""
    heap = [(0, s) for s in range(n_shards)]
    shard_of = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda k: (-sizes.get(k, 0), k)):
        filled, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (filled + sizes.get(slot, 0), shard))
    return shard_of


def rebalance(shard_of: list[int], sizes: dict[int, int], n_shards: int) -> list[int]:
    """The next version of a map: moves slots only from shards above the new mean to those below it, the fewest bytes that level them.

    Adding a shard moves slots into that shard only, as the others start at or above the new mean or stay below it untouched.
    """
    out = list(shard_of)
    filled = [0] * n_shards
    for slot, shard in enumerate(out):
        filled[shard] += sizes.get(slot, 0)
    mean = sum(filled) / n_shards
    for slot in sorted(range(len(out)), key=lambda k: (-sizes.get(k, 0), k)):
        size, here = sizes.get(slot, 0), out[slot]
        there = min(range(n_shards), key=lambda s: (filled[s], s))
        if size and filled[here] - size >= mean > filled[there] and filled[there] + size <= filled[here]:
            out[slot] = there
            filled[here] -= size
            filled[there] += size
    return out


def map_frame(spark: SparkSession, shard_of: list[int], version: int = 1) -> DataFrame:
    """A map as a table (version, vslot, shard): ``len(shard_of)`` rows, made from one literal."""
    shards = F.split(F.lit(",".join(map(str, shard_of))), ",")
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(shards).alias("vslot", "shard")).withColumn("shard", F.col("shard").cast("int"))


def save_map(shard_map: DataFrame, path: str) -> None:
    """Adds a version to the stored maps; old versions stay readable, and a version that is written again replaces itself."""
    shard_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    maps = spark.read.parquet(path)
    if version is None:
        return maps.join(F.broadcast(maps.agg(F.max("version").alias("version"))), "version")
    return maps.filter(F.col("version") == version)


def as_list(shard_map: DataFrame) -> list[int]:
    """A stored map, at most ``N_SLOTS`` rows, back as a list."""
    return [r["shard"] for r in shard_map.orderBy("vslot").collect()]


def with_slots(docs: DataFrame) -> DataFrame:
    """Records with their slot: by id where it is the only row of its id, else by id, text and the row's number among equal ones.

    Equal rows are numbered without meeting: each task numbers its own, and what is added is the number of equal rows of the tasks before it.
    """
    rows = checkpointed(docs.select("doc_id", (utf8_size(F.col("text")) + OVERHEAD).alias("size"), F.crc32("text").alias("text_crc32")).withColumn("_part", F.spark_partition_id()))
    several = checkpointed(rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("_again")))
    few = several.count() <= MAX_BROADCAST
    marked = rows.join(F.broadcast(several) if few else several, "doc_id", "left").withColumn("_again", F.coalesce("_again", F.col("doc_id").isNull()))
    alone = marked.filter("not _again").select("doc_id", "size", "text_crc32", virtual_slot(F.col("doc_id")).alias("vslot"))
    same = ["doc_id", "text_crc32", "size"]
    again = checkpointed(marked.filter("_again").withColumn("_number", F.row_number().over(Window.partitionBy("_part", *same).orderBy(F.lit(1)))))
    counts = again.groupBy("_part", *same).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    met = [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("_part", *same)]
    numbered = again.alias("a").join(starts.alias("s"), met).select(*[f"a.{c}" for c in same], (F.col("_start") + F.col("_number")).alias("_number"))
    return alone.unionByName(numbered.select("doc_id", "size", "text_crc32", virtual_slot(F.xxhash64(*same, "_number")).alias("vslot")))


def shard_records(docs: DataFrame, n_shards: int, map_path: str | None = None, version: int = 1) -> tuple[DataFrame, list[int], dict[int, int]]:
    """Each record with its shard and its gapless position there; also the map and the bytes of each slot.

    The map is stored as ``version`` at ``map_path``, by default a new folder in the session's checkpoint folder (so a later call leaves earlier results alone), and read from there. The position is the slot's offset in its shard, a running sum over the slots alone, plus the record's place within its slot.
    So no window ever holds a shard: the largest holds one slot.
    """
    spark = docs.sparkSession
    records = checkpointed(with_slots(docs))
    stats = slot_sizes(records).collect()  # at most N_SLOTS rows
    sizes = {r["vslot"]: r["slot_bytes"] for r in stats}
    shard_of = assign_slots(sizes, n_shards)
    rows = {r["vslot"]: r["slot_rows"] for r in stats}
    offsets, ends = [], [0] * n_shards
    for slot, shard in enumerate(shard_of):
        offsets.append(ends[shard])
        ends[shard] += rows.get(slot, 0)
    starts = F.split(F.lit(",".join(map(str, offsets))), ",")
    path = map_path or f"{spark.sparkContext.getCheckpointDir()}/shard_maps-{uuid.uuid4().hex}"
    save_map(map_frame(spark, shard_of, version), path)
    placed = load_map(spark, path, version).withColumn("slot_start", F.element_at(starts, F.col("vslot") + 1).cast("long"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    out = (
        records.withColumn("place", F.row_number().over(within))
        .join(F.broadcast(placed), "vslot")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot_start") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"))
    )
    return out, shard_of, sizes
