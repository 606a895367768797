"""Filter interaction audit: what each quality filter removes, alone and after others, in every order of them.

One pass over the bytes of the texts measures all that the filters ask. It is a transducer by table: a byte has a class, the state is whether a word is
open, and (state, class) looks up the next state and what is emitted: word begins, word ends, capital, code point, symbol. A continuation byte of UTF-8
emits nothing and keeps the state, so texts are never decoded. The spans of the words go into an open-addressing hash table of all texts of a piece, each probe of which
is verified byte by byte (in 8-byte pieces), so no collision of hashes merges two words.

Copies are found table-wide by a digest of 128 bits: a row fails where a smaller id has its text, removed or not. Rows of one text are counted by part and
label before they meet, and large groups of copies are met by ``join_groups``, so no task holds a group. What the filters do to one part is a table of 32 counts, by
the set of filters that a row fails, from which all orders are computed at once.

Defined cases: a null text is empty; a text without words fails the least number of words only (and may be a copy); a null source is the empty string; a row without an id has no smaller id
with its text and no label; rows with one id are rows of their own, none smaller than another; of contradicting labels of one id, 1 counts; an empty table has no parts
and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, checkpointed, join_groups, slices

#: Bytes of texts that one pass holds; a longer text is a pass of its own.
PIECE = 1 << 22
SYMBOLS = "#$%&*|"
#: The letter of the filter that asks the table: a copy of the text of a smaller id.
COPY = "E"

# Classes of bytes, states, and what a step emits.
_SPACE, _CAPITAL, _SYMBOL, _LETTER, _CONTINUES = range(5)
_OUTSIDE, _INSIDE = 0, 1
_BEGINS, _ENDS, _IS_CAPITAL, _IS_POINT, _IS_SYMBOL = 1, 2, 4, 8, 16


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of a byte, state after a class, what is emitted by state and class)."""
    kind = np.full(256, _LETTER, np.uint8)
    kind[np.frombuffer(ASCII_SPACE.encode(), np.uint8)] = _SPACE
    kind[ord("A") : ord("Z") + 1] = _CAPITAL
    kind[np.frombuffer(SYMBOLS.encode(), np.uint8)] = _SYMBOL
    kind[0x80:0xC0] = _CONTINUES
    after = np.array([_OUTSIDE, _INSIDE, _INSIDE, _INSIDE, _INSIDE], np.uint8)
    own = np.array([_IS_POINT, _IS_POINT | _IS_CAPITAL, _IS_POINT | _IS_SYMBOL, _IS_POINT, 0], np.uint8)
    emits = np.stack([own, own])
    emits[_OUTSIDE, 1:] |= _BEGINS
    emits[_INSIDE, _SPACE] |= _ENDS
    return kind, after, emits


_KIND, _AFTER, _EMITS = _tables()
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts, nulls being empty."""
    column = column.cast(pa.large_string()).fill_null("")
    held, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def _distinct(packed: np.ndarray, first: np.ndarray, n_packed: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """Distinct words of each row. Every span is put into one table, into the first slot that is free or holds the same word of the same row."""
    if not len(row):
        return np.zeros(n_rows, np.int64)
    place = np.arange(len(packed)) - np.repeat(first, n_packed)
    hashes = np.add.reduceat(_spread(packed ^ (place.astype(np.uint64) * _M1)), first)
    hashes = _spread(hashes + n_packed.astype(np.uint64) + row.astype(np.uint64) * _M1)
    mask = (1 << (2 * len(row)).bit_length()) - 1
    slot = (hashes & np.uint64(mask)).astype(np.int64)
    table = np.full(mask + 1, -1, np.int64)

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = (hashes[a] == hashes[b]) & (row[a] == row[b]) & (n_packed[a] == n_packed[b])
        equal[equal] = packed[first[a[equal]]] == packed[first[b[equal]]]
        long = np.flatnonzero(equal & (n_packed[a] > 1))
        if len(long):
            n = n_packed[a[long]] - 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            differs = packed[np.repeat(first[a[long]], n) + step] != packed[np.repeat(first[b[long]], n) + step]
            equal[long] = np.add.reduceat(differs, np.cumsum(n) - n, dtype=np.int64) == 0
        return equal

    waiting = np.arange(len(row))
    while len(waiting):
        at = slot[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]
        waiting = waiting[~same(waiting, table[at])]
        slot[waiting] = (slot[waiting] + 1) & mask
    return np.bincount(row[table[table >= 0]], minlength=n_rows)


def measured(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, n_distinct, n_capitals, n_code_points, n_symbols of texts in UTF-8."""
    out = {name: np.zeros(len(offsets) - 1, np.int64) for name in ("n_words", "n_distinct", "n_capitals", "n_code_points", "n_symbols")}
    for a, b in slices(np.diff(offsets).tolist(), PIECE):
        low = offsets[a]
        ends = offsets[a + 1 : b + 1] - low
        # A blank after each text closes its last word; eight more let the last word be read in whole pieces.
        text = np.r_[np.insert(data[low : offsets[b]], ends, 32), np.full(8, 32, np.uint8)]
        ends = ends + np.arange(1, b - a + 1)
        starts = np.r_[0, ends[:-1]]
        kind = _KIND[text[: ends[-1]]]
        emitted = _EMITS[np.r_[np.uint8(_OUTSIDE), _AFTER[kind[:-1]]], kind]
        begin, end = np.flatnonzero(emitted & _BEGINS), np.flatnonzero(emitted & _ENDS)
        row = np.searchsorted(ends, begin, "right")
        n_packed = (end - begin + 7) >> 3
        first = np.cumsum(n_packed) - n_packed
        place = np.arange(n_packed.sum()) - np.repeat(first, n_packed)
        eights = np.ndarray((len(text) - 7,), "<u8", np.ascontiguousarray(text), strides=(1,))
        packed = eights[np.repeat(begin, n_packed) + 8 * place]
        if len(begin):
            packed[first + n_packed - 1] &= _LOW_BYTES[end - begin - 8 * (n_packed - 1)]
        out["n_words"][a:b] = np.bincount(row, minlength=b - a)
        out["n_distinct"][a:b] = _distinct(packed, first, n_packed, row, b - a)
        for name, bit in (("n_capitals", _IS_CAPITAL), ("n_code_points", _IS_POINT), ("n_symbols", _IS_SYMBOL)):
            out[name][a:b] = np.add.reduceat((emitted & bit) != 0, starts, dtype=np.int64)
        out["n_code_points"][a:b] -= 1  # the blank
    return out


_MEASURES = "n_words long, n_distinct long, n_capitals long, n_code_points long, n_symbols long, h1 long, h2 long"


def profiles(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and the measures of every row's whole text, with a digest of 128 bits (h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_of(batch.column("text"))
            counts = measured(data, offsets)
            held = memoryview(data)
            digests = b"".join(xxhash.xxh3_128_digest(held[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            h = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
            columns = [batch.column("doc_id"), batch.column("part"), *map(pa.array, counts.values()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", *counts, "h1", "h2"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id long, part string, {_MEASURES}")


def text_filters() -> dict[str, Column]:
    """Letter to whether a row of ``profiles`` fails: too few words, too repetitive, too many capitals, symbols of markup or tables."""
    return {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 2 * F.col("n_code_points"),
        "D": F.col("n_symbols") > 0,
    }


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail (bit i for letter i), and how many of them are labelled good and toxic."""
    mask = sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(text_filters().values())), F.lit(0))
    rows = profiles(docs.filter("doc_id is not null"), part).select("doc_id", "part", mask.alias("mask"), "h1", "h2")
    one = [F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c) for c in ("quality", "toxic")]
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*one)
    # Exact repeats are folded before the shuffle; rows without an id never meet the others.
    folded = rows.groupBy("doc_id", "part", "mask", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    marked = folded.join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"])
    kinds = marked.groupBy("h1", "h2", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("n_low"))
    kinds = checkpointed(kinds)
    texts = kinds.groupBy("h1", "h2").agg(F.min("low").alias("first"), F.count(F.lit(1)).alias("size"))
    met = join_groups(kinds, texts, ["h1", "h2"], "size")
    firsts = F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    copy = 1 << len(text_filters())
    cells = F.explode(F.array(F.struct(F.col("mask"), firsts.alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - firsts).alias("n"))))
    counted = met.select("part", "quality", "toxic", cells.alias("c")).select("part", "quality", "toxic", "c.mask", "c.n").filter("n > 0")
    lone = profiles(docs.filter("doc_id is null"), part).select("part", mask.alias("mask")).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit(0).alias("quality"), F.lit(0).alias("toxic"), "mask", "n")
    sums = [F.sum(c).alias(name) for c, name in ((F.col("n"), "n"), (F.col("n") * F.col("quality"), "good"), (F.col("n") * F.col("toxic"), "toxic"))]
    return counted.unionByName(lone).groupBy("part", "mask").agg(*sums)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _orders(letters: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(order, step, bits of the filters before, bit of the filter) of every step of every order."""
    orders = ["".join(p) for p in permutations(letters)]
    bits = np.array([[1 << letters.index(x) for x in o] for o in orders])
    before = np.cumsum(bits, axis=1) - bits
    return [o for o in orders for _ in letters], np.tile(np.arange(1, len(letters) + 1), len(orders)), before.ravel(), bits.ravel()


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, filter_order and step with the long counts of ``COUNTS``."""
    letters = "".join(text_filters()) + COPY
    n_masks = 1 << len(letters)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, step, before, bit = _orders(letters)
        mask = np.arange(n_masks)[:, None]
        passes, fails = mask & before == 0, mask & bit != 0
        weights = {"kept": passes & ~fails, "removed": passes & fails, "redundant": ~passes & fails, "unique_fails": np.broadcast_to(mask == bit, passes.shape)}
        own = np.array([np.flatnonzero(bit == b) for b in bit])
        for pdf in filter(len, batches):
            for name, cells in zip(pdf["part"], pdf["cells"], strict=True):
                n = np.zeros((3, n_masks), np.int64)
                for c in cells:
                    n[:, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = {k: n[0] @ w.astype(np.int64) for k, w in weights.items()}
                lost = weights["removed"].astype(np.int64)
                got |= {"good_lost": n[1] @ lost, "toxic_lost": n[2] @ lost, "shapley": got["removed"][own].sum(1)}
                yield pd.DataFrame({"part": name, "filter_order": names, "step": step.astype(np.int32), **{c: got[c] for c in COUNTS}})

    # At most one cell for each set of filters.
    cells = failures(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return cells.mapInPandas(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")
