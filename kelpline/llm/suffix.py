"""Suffix-array dedup: removes every byte covered by a 200-byte string that also starts anywhere else in the corpus.

Suffixes are sharded by content, so equal strings meet. Of each 200-byte string the least hashed run of ``SEED`` bytes in it is its anchor, and
equal strings have equal anchors at the same place. Anchors that occur once are done; so are those whose whole surroundings (all strings
that could be anchored there) occur again. The others send their surroundings, ``SIDE`` bytes on each side, to the shard of their seed. There a
suffix array of all surroundings is built by Larsson-Sadakane refinement: suffixes start in one class for each seed and place, and only
classes that are still unsorted are sorted again, by pairs of ranks at doubled depth. Kasai's scan gives the common prefixes of neighbours in it, and
strings of neighbours that have ``SIDE`` bytes in common are the same.

Seeds with very many surroundings are cut into sub-shards. Each builds its own suffix array; what is single there is listed, sorted by
hash, cut into ranges, and the lists of all sub-shards are merged by binary search.

Defined cases: a null text is empty; texts shorter than 200 bytes lose nothing; rows with the same id are documents of their own, so equal ones
remove each other; a row without an id is answered, but not compared; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, n_partitions, slices
from .shingles import mixed

LENGTH, SEED = 200, 112
SIDE = LENGTH - SEED
#: Bytes of text, and suffixes, that one numpy pass holds.
PIECE, SUFFIXES = 1 << 20, 1 << 21
#: Occurrences of a seed from which it is cut into sub-shards of about so many.
HOT = 20_000
#: Hash ranges that the lists of a cut seed are merged in.
RANGES = 16
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` bytes from those of single bytes."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = h[:-step] * _GOLD + (h[step:] ^ (h[step:] >> np.uint64(29)))
        done += step
    return mixed(h)


def _slid(x: np.ndarray, width: int, least: np.ufunc) -> np.ndarray:
    """Least (or greatest) of all ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = least(x[:-step], x[step:])
        done += step
    return x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, seed hash) of the anchors of all 200-byte strings of the texts."""
    sizes = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(sizes)]
    if starts[-1] < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = _doubled(_BYTES[np.frombuffer(b"".join(texts), np.uint8)], SEED)
    least = _slid(h, SIDE + 1, np.minimum)
    # Strings that would cross into the next text have no anchor.
    change = np.zeros(len(least) + 1, np.int64)
    whole = sizes >= LENGTH
    np.add.at(change, starts[:-1][whole], 1)
    np.add.at(change, (starts[:-1] + sizes - LENGTH + 1)[whole], -1)
    least = np.where(np.cumsum(change)[:-1] > 0, least, np.uint64(0))
    pad = np.zeros(SIDE, np.uint64)
    at = np.flatnonzero(_slid(np.r_[pad, least, pad], SIDE + 1, np.maximum) == h)
    text = np.searchsorted(starts, at, "right") - 1
    return text, at - starts[text], h[at]


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        texts, ids, crcs = _encoded(pdf["text"].tolist()), pdf["doc_id"].to_numpy(), pdf["crc"].to_numpy()
        for a, b in slices([len(t) for t in texts], PIECE):
            text, pos, seed = anchors(texts[a:b])
            digest = xxhash.xxh3_64_intdigest
            around = [digest(texts[a + t][max(0, p - SIDE) : p + LENGTH], min(p, SIDE)) for t, p in zip(text.tolist(), pos.tolist(), strict=True)]
            ctx = np.array(around, np.uint64)
            once, own = _gathered(text, pos, seed, ctx)
            text, pos, seed, ctx = text[once], pos[once], seed[once], ctx[once]
            yield pd.DataFrame({"seed": seed.astype(np.int64), "ctx": ctx.astype(np.int64), "doc_id": ids[a + text], "crc": crcs[a + text], "pos": pos, "own": own})


def _gathered(text: np.ndarray, pos: np.ndarray, seed: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One anchor for each kind of surroundings of a text, and the byte ranges of those that it holds several times (None for others).

    So a text that repeats itself thousands of times sends one row for all of them.
    """
    key = mixed(mixed(mixed(seed) + ctx) + text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.r_[starts, len(key)])
    once = order[starts]
    own = np.full(len(once), None, object)
    for k in np.flatnonzero(times > 1):
        at = pos[order[starts[k] : starts[k] + times[k]]]
        own[k] = np.array(_merge(at - SIDE, at + LENGTH, int(at.max()) + LENGTH), np.int32).tobytes()
    back = np.argsort(once)
    return once[back], own[back]


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        out = []
        for text, seed, at, sub, lone, doc, crc in zip(pdf["text"], pdf["seed"], pdf["at"], pdf["sub"], pdf["lone"], pdf["doc_id"], pdf["crc"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for s, p, b, one in zip(seed, at, sub, lone, strict=True):
                left, right = data[max(0, p - SIDE) : p], data[p + SEED : p + LENGTH]
                out.append((s, b, doc, crc, p, one, SIDE - len(left), len(right), left.rjust(SIDE, b"\0") + right.ljust(SIDE, b"\0")))
        yield pd.DataFrame(out, columns=["seed", "sub", "doc_id", "crc", "pos", "lone", "lo", "hi", "around"])


def suffix_ranks(around: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of all rows, those of one place of one group together and in the order of their bytes; equal exactly for equal ones.

    around: rows of 2 * SIDE bytes; group: a number for each row. Larsson-Sadakane: only classes that hold several suffixes are sorted again, by the rank of what
    follows at the depth that is sorted, which then doubles.
    """
    rows, width = around.shape
    padded = np.concatenate([around, np.zeros((rows, 8), np.uint8)], 1)
    text = sum(padded[:, k : k + width].astype(np.uint64) << np.uint64(8 * (3 - k)) for k in range(4)).ravel()
    place = np.tile(np.arange(width), rows)
    key = (np.repeat(np.unique(group, return_inverse=True)[1].astype(np.uint64), width) * np.uint64(width) + place.astype(np.uint64)) << np.uint64(32) | text
    rank = np.empty(rows * width, np.int64)
    active, base = np.arange(rows * width), np.zeros(rows * width, np.int64)  # base: where the class of each active suffix starts
    depth = 4
    while True:
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_base = key[order], base[order]
        new = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | (sorted_base[1:] != sorted_base[:-1])]
        new_class = np.r_[True, sorted_base[1:] != sorted_base[:-1]]
        at = np.arange(len(order))
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank[active[order]] = sorted_base + start - class_start
        active = active[order[~(new & np.r_[new[1:], True])]]
        # Suffixes of one place are equally long: what is sorted to the row's end is equal, and stays so.
        active = active[place[active] + depth < width]
        if not len(active):
            return rank.reshape(rows, width)
        base = rank[active]
        key = (base.astype(np.uint64) << np.uint64(32)) | rank[active + depth].astype(np.uint64)
        depth *= 2


def common_prefixes(around: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Kasai: bytes that each suffix at a place up to SIDE has in common with the one before it in the suffix array.

    before: the row of that suffix, at the same place, or -1. Of a row's next suffix at least one byte less is common, so only further bytes are compared; all
    rows take their places in step.
    """
    rows, places = before.shape
    width = around.shape[1]
    out = np.zeros((rows, places), np.int64)
    common = np.zeros(rows, np.int64)
    for k in range(places):
        own = np.flatnonzero(before[:, k] >= 0)
        common = np.maximum(common - 1, 0)
        common[before[:, k] < 0] = 0
        other = before[own, k]
        while len(own):
            further = k + common[own] < width
            own, other = own[further], other[further]
            same = around[own, k + common[own]] == around[other, k + common[own]]
            own, other = own[same], other[same]
            common[own] += 1
        out[:, k] = common
    return out


def _marks(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The rows, which of their strings are whole, and which of those occur again: by the common prefixes of neighbours in the suffix array."""
    around = np.frombuffer(b"".join(rows["around"]), np.uint8).reshape(-1, 2 * SIDE)
    group = np.unique(rows["seed"].to_numpy(), return_inverse=True)[1]
    rank = suffix_ranks(around, group)[:, : SIDE + 1]
    place = np.arange(SIDE + 1)
    # The string at place k starts SIDE - k bytes before the anchor and ends k bytes after the seed.
    whole = (place >= rows["lo"].to_numpy()[:, None]) & (place <= rows["hi"].to_numpy()[:, None])
    # The suffix array of all places up to SIDE: rows in order, one place of one group after the other.
    array = np.argsort(rank.ravel(), kind="stable")
    at_row, at_place = np.divmod(array, SIDE + 1)
    neighbours = np.r_[False, (group[at_row[1:]] == group[at_row[:-1]]) & (at_place[1:] == at_place[:-1])]
    before = np.full(len(array), -1)
    before[array] = np.where(neighbours, np.r_[-1, at_row[:-1]], -1)
    common = common_prefixes(around, before.reshape(-1, SIDE + 1))
    # Neighbours alike in SIDE bytes are one class of strings; one that has two whole ones is a repeat.
    name = np.cumsum(common.ravel()[array] < SIDE)
    times = np.bincount(name, whole.ravel()[array])
    again = np.zeros(whole.size, bool)
    again[array] = times[name] > 1
    return rows, whole, again.reshape(whole.shape) & whole


def _runs(rows: pd.DataFrame, again: np.ndarray) -> pd.DataFrame:
    """Removed byte ranges, one for each run of places whose strings occur again."""
    edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    pos = rows["pos"].to_numpy()[row]
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[row], "crc": rows["crc"].to_numpy()[row], "lo": pos - SIDE + first, "hi": pos - SIDE + last + LENGTH, "own": np.full(len(pos), None, object)})


def _sharded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffix arrays of one shard's rows, sorted by seed, in pieces of whole seeds."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in filter(len, batches):
        seeds = pdf["seed"].to_numpy()
        last = int(np.searchsorted(seeds, seeds[-1], "left")) if seeds[0] <= seeds[-1] else 0
        head, tail = pdf.iloc[:last], pdf.iloc[last:]
        if held and held[-1]["seed"].iloc[-1] != seeds[0] and n * 2 * SIDE > SUFFIXES:
            yield from _piece(held)
            held, n = [], 0
        if len(head):
            held.append(head)
            n += len(head)
            if n * 2 * SIDE > SUFFIXES:
                yield from _piece(held)
                held, n = [], 0
        held.append(tail)
        n += len(tail)
    if held:
        yield from _piece(held)


def _piece(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = pd.concat(parts, ignore_index=True)
    cuts = np.flatnonzero(np.r_[True, rows["seed"].to_numpy()[1:] != rows["seed"].to_numpy()[:-1]])
    ends = np.r_[cuts[1:], len(rows)]
    start = 0
    for k, end in enumerate(ends):
        if k + 1 == len(ends) or (ends[k + 1] - start) * 2 * SIDE > SUFFIXES:
            some, _, again = _marks(rows.iloc[start:end])
            found = _runs(some, again & some["lone"].to_numpy()[:, None])
            if len(found):
                yield found
            start = end


def _listed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorted hashes of a sub-shard's strings, by range."""
    rows, whole, _ = _marks(pdf)
    h = _string_hashes(rows)[whole]
    h = np.unique(h)
    cut = np.searchsorted(h, np.arange(RANGES + 1, dtype=np.float64) * (2.0**64 / RANGES))
    return pd.DataFrame({"seed": key[0], "sub": key[1], "range": np.arange(RANGES), "hashes": [h[cut[i] : cut[i + 1]].tobytes() for i in range(RANGES)]})


def _string_hashes(rows: pd.DataFrame) -> np.ndarray:
    return np.array([[xxhash.xxh3_64_intdigest(x[k : k + SIDE], k) for k in range(SIDE + 1)] for x in rows["around"]], np.uint64)


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of each sub-shard's hashes another sub-shard has too, by binary search in its sorted list."""
    lists = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    out = []
    for i, own in enumerate(lists):
        both = np.zeros(len(own), bool)
        for j, other in enumerate(lists):
            if i != j and len(other) and len(own):
                at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                both |= other[at] == own
        out.append(own[both].tobytes())
    return pd.DataFrame({"seed": pdf["seed"], "sub": pdf["sub"], "hashes": out})


def _cut_marks(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Runs of one sub-shard: strings that occur again in it, or elsewhere."""
    if not len(left):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc_id", "crc", "lo", "hi")} | {"own": np.zeros(0, object)})
    rows, whole, again = _marks(left)
    elsewhere = np.sort(np.frombuffer(b"".join(right["hashes"]), np.uint64))
    again |= whole & np.isin(_string_hashes(rows), elsewhere)
    return _runs(rows, again & rows["lone"].to_numpy()[:, None])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, crc, lo, hi, own): byte ranges to remove; they may overlap; own, where there is one, holds them instead. docs: doc_id, crc, text."""
    found = docs.mapInPandas(_found, "seed long, ctx long, doc_id long, crc long, pos int, own binary")
    times = F.when(F.col("own").isNull(), 1).otherwise(2)  # more than one, if it is not 1
    seeds = checkpointed(found.groupBy("seed").agg(F.sum(times).alias("n")).filter("n > 1").select("seed", F.ceil(F.col("n") / HOT).cast("int").alias("subs")))
    cut = seeds.filter("subs > 1").limit(1).count() > 0
    # Sub-shard of a seed; -1 for a seed that isn't cut.
    sub = F.when(F.col("subs") > 1, F.pmod(F.xxhash64("doc_id", "pos"), F.col("subs"))).otherwise(-1).cast("int")
    met = found.join(seeds, "seed").withColumn("sub", sub if cut else F.lit(-1))
    keys = ["seed", "sub"] if cut else ["seed"]
    same = Window.partitionBy(*keys, "ctx")
    counted = met.withColumns({"same": F.sum(times).over(same), "place": F.row_number().over(same.orderBy("doc_id", "pos"))})
    whole = counted.filter("same > 1 and subs > 0").select("doc_id", "crc", (F.col("pos") - SIDE).cast("long").alias("lo"), (F.col("pos") + LENGTH).cast("long").alias("hi"), "own")
    # One of each kind of surroundings is enough; seeds with one kind have nothing to compare.
    kinds = counted.filter("place = 1").withColumns({"kinds": F.count(F.lit(1)).over(Window.partitionBy(*keys)), "lone": F.col("same") == 1})
    # ``own`` is read here and ``subs`` above, so that both branches ask for the same columns and the anchors are found and shuffled once for both.
    lists = [F.collect_list(c).alias(to) for c, to in (("seed", "seed"), ("pos", "at"), ("sub", "sub"), ("lone", "lone"))]
    asked = kinds.filter("kinds > 1 or subs > 1").groupBy("doc_id", "crc").agg(*lists, F.count("own").alias("n_own"))
    sent = asked.join(docs, ["doc_id", "crc"]).mapInPandas(_surroundings, "seed long, sub int, doc_id long, crc long, pos int, lone boolean, lo int, hi int, around binary")
    schema = "doc_id long, crc long, lo long, hi long, own binary"
    shards = sent.filter("sub < 0").repartition(n_partitions(docs), "seed").sortWithinPartitions("seed")
    found_again = whole.unionByName(shards.mapInPandas(_sharded, schema))
    if not cut:
        return found_again
    hot = sent.filter("sub >= 0")
    lists = hot.groupBy("seed", "sub").applyInPandas(_listed, "seed long, sub int, range int, hashes binary")
    shared = lists.groupBy("seed", "range").applyInPandas(_merged, "seed long, sub int, hashes binary")
    return found_again.unionByName(hot.groupBy("seed", "sub").cogroup(shared.groupBy("seed", "sub")).applyInPandas(_cut_marks, schema))


def _merge(lo: np.ndarray, hi: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Disjoint removed ranges, in order."""
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(np.maximum(lo[order], 0).tolist(), np.minimum(hi[order], size).tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        out = []
        for doc, text, ranges in zip(pdf["doc_id"], pdf["text"], pdf["ranges"], strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            gone: list[tuple[int, int]] = []
            if ranges is not None and len(ranges):
                pairs = np.concatenate([np.array([(r["lo"], r["hi"])]) if r["own"] is None else np.frombuffer(r["own"], np.int32).reshape(-1, 2) for r in ranges]).astype(np.int64)
                gone = _merge(pairs[:, 0], pairs[:, 1], len(data))
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            out.append((doc, len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
        yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    texts = docs.select("doc_id", F.coalesce(F.crc32("text"), F.lit(0)).alias("crc"), "text")
    # Both joins with the texts read one exchange: the same rows, with an id, by the same keys.
    known = texts.filter("doc_id is not null")
    ranges = repeats(known).groupBy("doc_id", "crc").agg(F.collect_list(F.struct("lo", "hi", "own")).alias("ranges"))
    unknown = texts.filter("doc_id is null").withColumn("ranges", F.lit(None).cast("array<struct<lo:bigint,hi:bigint,own:binary>>"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    # Apart, as pandas would turn the ids of a batch with a null one into floating-point numbers.
    return known.join(ranges, ["doc_id", "crc"], "left").mapInPandas(_digests, schema).unionByName(unknown.mapInPandas(_digests, schema))
