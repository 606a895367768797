"""Periodic runs against a search over all periods, and their digests."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from kelpline.llm import periodic


def plain_runs(w):
    """All runs of a list, by comparing it with itself at every distance; the smallest period of each interval."""
    found = {}
    for q in range(1, len(w) // 3 + 1):
        at = 0
        while at + q < len(w):
            if w[at] != w[at + q]:
                at += 1
                continue
            end = at
            while end + q < len(w) and w[end] == w[end + q]:
                end += 1
            if end + q - at >= max(24, 3 * q):
                found.setdefault((at, end + q), q)
            at = end + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def runs(*texts):
    ids = {}
    flat = np.array([ids.setdefault(x, len(ids)) for t in texts for x in t], np.int64)
    return [list(map(tuple, r.tolist())) for r in periodic.runs_of(flat, np.cumsum([0, *map(len, texts)]))]


def random_text(rng):
    """Repeats of repeats, with noise between and within them."""
    def piece(depth):
        if depth == 0:
            return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 9))]
        inner = piece(depth - 1) + (piece(depth - 1) if rng.random() < 0.4 else [])
        out = inner * rng.randrange(1, 7)
        out = out[: rng.randrange(len(out)) + 1]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = rng.randrange(60)
        return out

    return [x for _ in range(rng.randrange(1, 5)) for x in piece(rng.randrange(4))][:600]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    texts = [random_text(rng) for _ in range(150)] + [[], [0]]
    assert runs(*texts) == [plain_runs(t) for t in texts]


def test_runs_of_words_with_structure():
    fibonacci, other = [0], [0, 1]
    while len(other) < 900:
        fibonacci, other = other, other + fibonacci
    thue_morse = [bin(i).count("1") % 2 for i in range(1024)]
    lines = [x for i in range(200) for x in (1, 2, 3, 4, 1000 + i)]
    twice = list(range(400)) * 2
    texts = [other, thue_morse, thue_morse * 4, lines, twice, [7] * 700, [7] * 23, [7] * 24, [1, 2] * 12, list(range(8)) * 3, (list(range(9)) * 3)[:-1], list(range(9)) * 3]
    assert runs(*texts) == [plain_runs(t) for t in texts]
    assert runs([7] * 700)[0] == [(0, 700, 1)] and runs(list(range(9)) * 3)[0] == [(0, 27, 9)]


def test_every_boundary_is_in_one_kind_of_node():
    rng = random.Random(9)
    texts = [random_text(rng) for _ in range(40)]
    bounds = np.cumsum([0, *map(len, texts)])
    words = np.array([x for t in texts for x in t])
    nodes = periodic.grammar(words, bounds)
    seen = []
    for i in range(len(nodes.start)):
        positions = nodes.position[nodes.first[i] : nodes.first[i + 1]]
        size = nodes.end[i] - nodes.start[i]
        assert nodes.start[i] in positions
        for p in positions:
            assert np.array_equal(words[p : p + size], words[nodes.start[i] : nodes.end[i]])
            seen.append(p + nodes.middle[i] - nodes.start[i])
    inner = np.setdiff1d(np.arange(bounds[-1]), bounds)
    assert sorted(seen) == inner.tolist()


def plain_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(w)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [None, "", *(" ".join(f"w{x}" for x in random_text(rng)) for _ in range(40))]
    whole = [(w, r.tolist()) for w, r in periodic._found([None] * len(texts), texts, None)]
    monkeypatch.setattr(periodic, "PIECE", 100)
    assert [(w, r.tolist()) for w, r in periodic._found([None] * len(texts), texts, None)] == whole


def test_digests(spark):
    rng = random.Random(5)
    texts = [" ".join(f"wört{x}" for x in random_text(rng)) for _ in range(60)]
    rows = [(i, texts[i % 60]) for i in range(150)] + [(1, "a b " * 40), (1, "a b " * 40), (None, "x\t" * 30), (200, None), (201, ""), (202, " \n "), (203, "word " * 5000 + "end " + "a b c\n" * 500)]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, start long, runs string").repartition(3)
    got = lambda: sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(docs, periodic.planted)).collect()), key=str)
    want = sorted(((d, *plain_digest(d, t)) for d, t in rows), key=str)
    assert got() == want
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).count() == 0


def test_runs_and_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "see " + "la  la\n" * 20 + "end")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], row["collapsed"]) == (42, "see la end")
    assert [tuple(r) for r in row["runs"]] == [(1, 40, 1)]
