"""The filter audit against a plain version, and its word table against sets."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from kelpline.llm import audit

WORD = r"[^\x20\x09-\x0D]+"


def plain_audit(rows, labels):
    """Counts by part, order and step of (doc_id, text, source) rows, by applying the filters one after another."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    quality = {d: max(q for e, q, _ in labels if e == d) for d, _, _ in labels}
    toxic = {d: max(t for e, _, t in labels if e == d) for d, _, t in labels}
    parts = {}
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(WORD, text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and doc_id > first[text],
        }
        parts.setdefault(source or "", []).append((fails, quality.get(doc_id) == 1, toxic.get(doc_id) == 1))
    out = {}
    for part, docs in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                failing = sum(d[0][f] for d in docs)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone)]
    total = {}
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] = total.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got_by_step(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in audit.COUNTS) for r in df.collect()}


def texts(rng, n):
    vocabulary = ["a", "Bee", "straße", "日本語", "x" * 8, "x" * 9, "x" * 17, "é", "#tag", "😀 ", "tab\tbed", "50%", " ", " wide"]
    out = ["", " \t\n", None, "one"]
    for _ in range(n):
        words = rng.choices(vocabulary[: rng.randrange(1, 15)], k=rng.choice([0, 3, 150, 199, 200, 230])) + [str(rng.randrange(10**12)) for _ in range(rng.choice([0, 60, 250]))]
        out.append(rng.choice([" ", "\n", " \x0b "]).join(words))
    return out


def test_audit(spark):
    rng = random.Random(3)
    held = texts(rng, 60)
    rows = [(i, rng.choice(held), rng.choice(["s1", "s2", None, ""])) for i in range(180)] + [(7, "again", "s1"), (7, "again", "s1"), (3, "again", "s2"), (7, "again", "s9"), (None, "again", "s1"), (None, None, None)]
    labels = [(i, rng.choice([0, 1]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(4, 0, 0), (4, 1, 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, part string, n long")
    marks = spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert got_by_step(audit.audit(docs, marks)) == plain_audit(rows, labels)
    unlabelled = audit.audit(docs, marks.limit(0))
    assert got_by_step(unlabelled) == plain_audit(rows, [])
    assert audit.audit(docs.limit(0), marks).count() == 0


def test_audit_of_one_text_everywhere(spark):
    rows = [(i, "same words " * 150, f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got_by_step(audit.audit(docs, labels)) == plain_audit(rows, [])


@pytest.mark.parametrize("piece", [64, 1 << 22])
def test_measures(piece, monkeypatch):
    monkeypatch.setattr(audit, "PIECE", piece)
    held = texts(random.Random(4), 50) + [" ".join(str(i % 700) for i in range(30000))]
    data, offsets = audit.utf8_of(pa.array(["skipped", *held])[1:])
    got = audit.measured(data, offsets)
    for i, text in enumerate(t or "" for t in held):
        words = re.findall(WORD, text)
        want = [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]
        assert [int(v[i]) for v in got.values()] == want


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(audit, "_spread", lambda x: np.zeros_like(x))
    words = [f"{'w' * 9}{i % 90}" for i in range(400)]
    data, offsets = audit.utf8_of(pa.array([" ".join(words), " ".join(words[:50])]))
    assert audit.measured(data, offsets)["n_distinct"].tolist() == [90, 50]
