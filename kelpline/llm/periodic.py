"""Periodic runs of words: found on a grammar of the text, each rule looked at once.

The words of a text become numbers, and Re-Pair builds a grammar over them: pairs of neighbouring symbols that occur again are replaced by a new symbol, in rounds. A round
replaces every pair that is more frequent than the pairs it overlaps (ties by a hash), so texts of a batch and pairs of a text advance together in numpy, and a
pair that occurs once is a border for good, at which arrays are cut. What is left at the top is joined by a balanced tree, so every place between two words is the inner boundary of
exactly one kind of node: a rule of the grammar, with all its derivation positions, or a node of the tree.

For every node the runs that cross its boundary are computed once, at its first position. Of a run of at least max(24, 3 q) words, one side of the boundary has half or more,
so at least four words at the boundary come again q words further (or earlier): only such distances are tried. How far both copies agree is asked of tables of equal
blocks of 2^k words, which are exact numbers and no hashes. The runs found are translated to all positions of their node and intervals of one period that overlap by the
period or more are merged. Every maximal run lies in the lowest node that holds it and crosses its boundary, so it is among them as a whole.

Defined cases: a null or empty text has no words; a text shorter than 24 words has no run; rows with one id are rows of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Least words of a run, and least repeats of its period.
MIN_LENGTH, MIN_REPEATS = 24, 3
#: Words that have to come again at a boundary: a run's longer side has max(12, 1.5 q) words, q of them before the copy.
_SEED_LEVEL = 2
_SEED = 1 << _SEED_LEVEL
#: Characters that one pass holds; a longer text is a pass of its own.
PIECE = 1 << 21
_NO_RUNS = np.zeros((0, 3), np.int64)


def _hashed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the different ones, how often each of these occurs)."""
    _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
    return number, times


class Nodes:
    """Nodes of the grammar: interval [start, end) of the first position, boundary, and all positions as (node, start) rows."""

    def __init__(self, start: np.ndarray, middle: np.ndarray, end: np.ndarray, node: np.ndarray, position: np.ndarray):
        self.start, self.middle, self.end = start, middle, end
        order = np.argsort(node, kind="stable")
        self.position = position[order]
        self.first = np.searchsorted(node[order], np.arange(len(start) + 1))


def grammar(words: np.ndarray, bounds: np.ndarray) -> Nodes:
    """Re-Pair of the texts words[bounds[i]:bounds[i + 1]], and a balanced tree over what is left of each."""
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    symbol, _ = _ranks(text * (int(words.max(initial=0)) + 1) + words)  # a symbol belongs to one text
    symbol = symbol.astype(np.int64)
    at, size = np.arange(n), np.ones(n, np.int64)
    linked = np.zeros(n, bool)  # whether the pair with the next symbol may occur again
    if n:
        linked[:-1] = text[1:] == text[:-1]
    inside = np.zeros(n + 1, bool)  # boundaries within a rule
    starts, middles, ends, nodes, positions = [], [], [], [], []
    n_nodes, n_symbols = 0, int(symbol.max(initial=-1)) + 1
    while linked.any():
        pairs = np.flatnonzero(linked)
        number, times = _ranks(symbol[pairs] * n_symbols + symbol[pairs + 1])
        again = times[number] > 1
        linked[pairs[~again]] = False
        # Symbols without a pair that occurs again are left out for good.
        keep = linked.copy()
        keep[1:] |= linked[:-1]
        kept = np.flatnonzero(keep)
        place = np.cumsum(keep) - 1
        pairs, number = place[pairs[again]], number[again]
        symbol, at, size, linked = symbol[kept], at[kept], size[kept], linked[kept]
        if not len(pairs):
            break
        # In a row of one symbol every other pair is a candidate, so that candidates of one kind don't overlap.
        same = np.zeros(len(pairs), bool)
        same[1:] = (pairs[1:] == pairs[:-1] + 1) & (number[1:] == number[:-1])
        index = np.arange(len(pairs))
        odd = (index - np.maximum.accumulate(np.where(same, 0, index))) % 2 == 1
        pairs, number = pairs[~odd], number[~odd]
        count = np.bincount(number)
        rank = np.full(len(symbol) + 2, -1, np.int64)  # order of the pairs by frequency, then hash; -1 is no candidate
        by_rank = np.empty(len(count), np.int64)
        by_rank[np.lexsort((_hashed(np.arange(len(count)) + n_symbols), count))] = np.arange(len(count))
        by_rank[count < 2] = -1
        rank[pairs + 1] = by_rank[number]
        own = rank[pairs + 1]
        wins = (own >= 0) & (own > rank[pairs]) & (own > rank[pairs + 2])
        wins &= np.bincount(number[wins], minlength=len(count))[number] > 1
        pairs, number = pairs[wins], number[wins]
        if not len(pairs):
            break
        new, _ = _ranks(number)
        size_of = size[pairs] + size[pairs + 1]
        firsts = np.full(int(new.max()) + 1, len(pairs))
        np.minimum.at(firsts, new, np.arange(len(pairs)))
        starts.append(at[pairs[firsts]])
        middles.append(at[pairs[firsts] + 1])
        ends.append(at[pairs[firsts]] + size_of[firsts])
        nodes.append(new + n_nodes)
        positions.append(at[pairs])
        inside[at[pairs + 1]] = True
        symbol[pairs], size[pairs], linked[pairs] = new + n_symbols, size_of, linked[pairs + 1]
        stays = np.ones(len(symbol), bool)
        stays[pairs + 1] = False
        symbol, at, size, linked = symbol[stays], at[stays], size[stays], linked[stays]
        n_nodes, n_symbols = n_nodes + len(firsts), n_symbols + len(firsts)
        # Pairs are counted within 62 bits.
        if n_symbols >= 1 << 31:
            raise OverflowError("more than 2^31 symbols in one pass")
    # The tree: boundary i of a text's top symbols, i odd times 2^k, splits those from i - 2^k to i + 2^k.
    top = np.flatnonzero(~inside[:n])
    low = np.searchsorted(top, bounds[:-1])
    of = text[top]
    i = np.arange(len(top)) - low[of]
    split = np.flatnonzero(i > 0)
    reach = i[split] & -i[split]
    last = np.searchsorted(top, bounds[1:])[of[split]]
    till = np.r_[top, n]
    up = np.minimum(split + reach, last)
    starts.append(top[split - reach])
    middles.append(top[split])
    ends.append(np.where(up == last, bounds[1:][of[split]], till[up]))
    nodes.append(np.arange(len(split)) + n_nodes)
    positions.append(top[split - reach])
    return Nodes(*(np.concatenate(x) for x in (starts, middles, ends, nodes, positions)))


class Blocks:
    """Numbers of the blocks of 2^k words at every place, equal for equal blocks; how far two places agree."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.left = bounds[1:][np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] - np.arange(len(words))  # words to the text's end
        self.level = [words.astype(np.int64)]

    def at_level(self, k: int) -> np.ndarray:
        """Numbers of blocks of 2^k words; -1 where the text ends before."""
        while len(self.level) <= k:
            half, low = 1 << (len(self.level) - 1), self.level[-1]
            place = np.flatnonzero(self.left >= 2 * half)
            number = np.full(len(low), -1, np.int64)
            if len(place):
                number[place] = _ranks(low[place] * (int(low.max()) + 1) + low[place + half])[0]
            self.level.append(number)
        return self.level[k]

    def agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """Words that agree from a and b on, ``most`` at most; or before a and b."""
        done = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            number, step = self.at_level(k), 1 << k
            fits = np.flatnonzero(most - done >= step)
            shift = -done[fits] - step if backwards else done[fits]
            done[fits] += np.where(number[a[fits] + shift] == number[b[fits] + shift], step, 0)
        return done


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, number) of all numbers from low[index] to high[index], exclusive."""
    n = np.maximum(high - low, 0)
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _tried(nodes: Nodes, seeds: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(backwards, node, period) of all distances at which the words at a node's boundary come again within a third of its first position."""
    n = len(seeds)
    # Places in the order of their seeds: those of one seed are a range of ascending places.
    key = (seeds + 1) * (n + 1) + np.arange(n)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    large = np.flatnonzero(nodes.end - nodes.start >= MIN_LENGTH)
    for backwards in (False, True):
        s, m, e = nodes.start[large], nodes.middle[large], nodes.end[large]
        widest = (e - s) // MIN_REPEATS
        if backwards:
            seed_at = m - _SEED
            ok = seed_at >= s
            reach = np.minimum(widest, seed_at - s)
        else:
            seed_at = m
            ok = m + _SEED <= e
            reach = np.minimum(widest, e - m - _SEED)
        ok &= reach > 0
        node, seed_at, reach = large[ok], seed_at[ok], reach[ok]
        base = (seeds[seed_at] + 1) * (n + 1)
        if backwards:
            low, high = np.searchsorted(ranked, base + seed_at - reach), np.searchsorted(ranked, base + seed_at)
        else:
            low, high = np.searchsorted(ranked, base + seed_at, "right"), np.searchsorted(ranked, base + seed_at + reach, "right")
        which, spot = _expanded(low, high)
        yield backwards, node[which], np.abs(order[spot] - seed_at[which])


def _crossing(nodes: Nodes, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(node, start, end, period) of runs that cross the boundary of a node within its first position."""
    tried = list(_tried(nodes, Blocks(words, bounds).at_level(_SEED_LEVEL)))
    # Blocks of all sizes are numbered for texts with something to try only.
    text = lambda place: np.searchsorted(bounds, place, "right") - 1
    some = np.zeros(len(bounds) - 1, bool)
    for _, node, _ in tried:
        some[text(nodes.start[node])] = True
    size = np.where(some, np.diff(bounds), 0)
    own = np.r_[0, np.cumsum(size)]
    blocks = Blocks(words[np.repeat(some, np.diff(bounds))], own)
    found = []
    for backwards, node, q in tried:
        s, m, e = nodes.start[node], nodes.middle[node], nodes.end[node]
        shift = own[text(s)] - bounds[text(s)]
        c = m + shift
        if backwards:
            # Words m - q and m agree from there on, and those before them backwards.
            end, start = m + blocks.agree(c - q, c, e - m), m - q - blocks.agree(c - q, c, m - q - s, True)
        else:
            end, start = m + q + blocks.agree(c, c + q, e - m - q), m - blocks.agree(c, c + q, m - s, True)
        good = end - start >= np.maximum(MIN_LENGTH, MIN_REPEATS * q)
        found.append(np.stack([node, start, end, q], axis=1)[good])
    return np.unique(np.concatenate(found), axis=0)


def maximal(intervals: np.ndarray) -> np.ndarray:
    """(start, end, period) with those of one period that overlap by it or more merged; of equal intervals the smallest period."""
    if not len(intervals):
        return intervals
    x = intervals[np.lexsort((intervals[:, 1], intervals[:, 0], intervals[:, 2]))]
    # Ends so far within a period, by a running maximum over periods laid one after another.
    span = int(x[:, 1].max()) + 1
    _, group = np.unique(x[:, 2], return_inverse=True)
    upto = np.maximum.accumulate(x[:, 1] + group * span) - group * span
    new = np.ones(len(x), bool)
    new[1:] = (group[1:] != group[:-1]) | (x[1:, 0] > upto[:-1] - x[1:, 2])
    first = np.flatnonzero(new)
    merged = np.stack([x[first, 0], np.maximum.reduceat(x[:, 1], first), x[first, 2]], axis=1)
    merged = merged[np.lexsort((merged[:, 2], merged[:, 1], merged[:, 0]))]
    return merged[np.r_[True, (merged[1:, 0] != merged[:-1, 0]) | (merged[1:, 1] != merged[:-1, 1])]]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """For each text words[bounds[i]:bounds[i + 1]] its runs (start, length, period), by start, then period. Words are numbers, equal ones for equal words."""
    none = [_NO_RUNS] * (len(bounds) - 1)
    if not len(words):
        return none
    nodes = grammar(words, bounds)
    crossing = _crossing(nodes, words, bounds)
    if not len(crossing):
        return none
    which, spot = _expanded(nodes.first[crossing[:, 0]], nodes.first[crossing[:, 0] + 1])
    shift = nodes.position[spot] - nodes.start[crossing[which, 0]]
    intervals = maximal(np.unique(crossing[which, 1:] + np.stack([shift, shift, np.zeros_like(shift)], axis=1), axis=0))
    of = np.searchsorted(bounds, intervals[:, 0], "right") - 1
    out = []
    for i in range(len(bounds) - 1):
        a, b = np.searchsorted(of, [i, i + 1])
        start, end, q = intervals[a:b].T
        own = np.stack([start - bounds[i], end - start, q], axis=1)
        out.append(own[np.lexsort((own[:, 2], own[:, 0]))])
    return out


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length over period; ties by start, then period."""
    if not len(runs):
        return None
    ratio = runs[:, 1] / runs[:, 2]
    near = runs[ratio >= ratio.max() * (1 - 1e-12)]  # exact among those
    return min(map(tuple, near.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words a run repeats: all of a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: what ASCII white space parts."""
    return (text or "").encode("utf-8", "surrogatepass").split()


Reorder = Callable[[int | None, int], "np.ndarray | None"]


def _found(keys: list[int | None], texts: list[str | None], reorder: Reorder | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text's words and runs, texts being looked at together in pieces."""
    for a, b in slices([len(t or "") + 1 for t in texts], PIECE):
        held: dict[bytes, int] = {}
        words, ids = [], []
        for key, text in zip(keys[a:b], texts[a:b], strict=True):
            w = words_of(text)
            places = reorder(key, len(w)) if reorder is not None else None
            if places is not None:
                w = [w[p] for p in places.tolist()]
            words.append(w)
            ids.extend(held.setdefault(x, len(held)) for x in w)
        bounds = np.cumsum([0, *map(len, words)])
        yield from zip(words, runs_of(np.array(ids, np.int64), bounds), strict=True)


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, reorder: Reorder | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period) by start, then period, and the collapsed text (words that no run repeats, joined by blanks) of every row.

    reorder: (doc_id, n) to the places of the words that are looked at instead of a text's own n words; None keeps them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, collapsed = [], [], []
            for w, found in _found(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), reorder):
                counts.append(len(w))
                runs.append(found)
                if len(found):
                    w = [w[i] for i in np.flatnonzero(~repeated(found, len(w))).tolist()]
                collapsed.append(b" ".join(w))
            flat = np.concatenate([_NO_RUNS, *runs])
            parts = pa.StructArray.from_arrays([pa.array(flat[:, i].copy()) for i in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), parts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), lists, pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a text in which, by its id's checksum, a tail is replaced by repeats of a stretch; None for nine texts of ten and those without an id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run with its exponent in thousandths, and SHA-256 of the list of runs and of the collapsed text, of rows of ``periodic_runs``."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            flat = np.stack([lists.values.field(i).to_numpy() for i in range(3)], axis=1)
            rows = []
            for a, b, text in zip(lists.offsets[:-1].to_pylist(), lists.offsets[1:].to_pylist(), batch.column("collapsed").to_pylist(), strict=True):
                own = flat[a:b]
                best = strongest(own)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in own.tolist())
                rows.append((b - a, *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in schema.split(", ")])

    return found.mapInArrow(run, schema)
