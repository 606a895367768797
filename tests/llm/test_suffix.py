import hashlib
import random
from collections import Counter

import pytest

from kelpline.llm import suffix


def expected(texts):
    data = [(t or "").encode() for t in texts]
    times = Counter(b[k : k + suffix.LENGTH] for b in data for k in range(len(b) - suffix.LENGTH + 1))
    out = []
    for b in data:
        gone = [k for k in range(len(b) - suffix.LENGTH + 1) if times[b[k : k + suffix.LENGTH]] > 1]
        mark = bytearray(len(b))
        for k in gone:
            mark[k : k + suffix.LENGTH] = b"\1" * suffix.LENGTH
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(33))
    texts = [None, "", "short", passage, passage, "x" * 700, "ab" * 300]
    for k in range(40):
        own = [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(3)]
        texts.append(own[0] + (passage if k % 3 else passage[: 100 + 7 * k]) + own[1] + (line if k % 2 else "") + own[2] + (own[2] * 2 if k == 9 else ""))
    texts += texts[10:14]
    return texts


@pytest.mark.parametrize("hot", [suffix.HOT, 4])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, crc string")
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix.removed(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_repeated_ids_and_empty(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400)) + "z"
    rows = [(1, text), (1, text), (1, "other " * 5)]
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(30, 0), (401, 401), (401, 401)]
    assert suffix.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
