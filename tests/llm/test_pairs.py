"""Near duplicates, leaks, lines and embeddings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from plain import bag, classes, similarity

from kelpline.llm import decontaminate, embeddings, lines, minhash
from kelpline.llm.components import components

VOCABULARY = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "klmnp"]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    want = classes(edges, 140)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in ends}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prob_minhash_estimates_probability_jaccard():
    h = np.arange(1, 301, dtype=np.uint64)
    weights = np.random.default_rng(2).integers(1, 9, 300).astype(float)
    other = weights.copy()
    other[:60] = 0
    a = minhash.prob_minhash(h, np.zeros(300, np.int64), weights, 1, 4096)
    b = minhash.prob_minhash(h[60:], np.zeros(240, np.int64), other[60:], 1, 4096)
    exact = sum(1 / sum(max(weights[j] / weights[i], other[j] / other[i]) for j in range(300)) for i in range(60, 300))
    assert abs((a == b).mean() - exact) < 0.03


@pytest.mark.parametrize("block", [minhash.BLOCK, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    texts = [None, "", "  ", "one two", "One, two!", "%%% ###", "%%% ###", "&&&"]
    for _ in range(12):
        words = prose(rng, rng.randrange(5, 300)).split()
        for k in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(k // 2):
                copy[rng.randrange(len(copy))] = "zzz"
            texts.append(" ".join(copy) if k % 3 else "\n".join(copy).upper())
    texts.append(prose(rng, 30000))
    texts.append("tail " + texts[-1])
    bags = [bag(t) for t in texts]
    exact = {}
    for i, t in enumerate(texts):
        if not bags[i] and t and t.strip():
            exact.setdefault(t.strip(), []).append(i)
    found = [(i, j) for i in range(len(texts)) for j in range(i) if bags[i] and bags[j] and similarity(bags[i], bags[j]) >= 0.8] + [(v[0], x) for v in exact.values() for x in v]
    want = classes(found, len(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "one two", "x")], "doc_id long, text string, id string")
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: r["class_id"] for r in rows} == dict(enumerate(want))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (5, 14, 36, 36, 59)] + ["four words are few", None]
    texts = [None, "", prose(rng, 400)]
    for item in items[:5]:
        w = item.split()
        texts += [prose(rng, 50) + " " + item.upper() + ". " + prose(rng, 9), item, " ".join(w[: len(w) // 2])]
        if len(w) >= 36:
            texts += [" ".join([*w[:-1], "edge"]), prose(rng, 3) + " " + " ".join([*w[1:], "edge"]), " ".join(w[:7] + ["no"] + w[7:20] + ["no"] + w[20:])]
    texts.append(" ".join(items[:4]) + " " + items[2])
    texts.append("four words are few")
    want = set()
    for d, t in enumerate(texts):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        run = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for i, item in enumerate(items):
            target = bag(item) if item and len(item.split()) >= 5 else None
            if target and run:
                n = sum(target.values())
                if max(similarity(Counter(run[k : k + n]), target) for k in range(len(run))) >= 0.8:
                    want.add((d, i))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, texts[4], 1), (None, "x", 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    got = {(r["doc_id"], i) for r in rows for i in r["item_ids"]}
    want |= {(1, 0)} if (4, 0) in want else set()
    assert got == want and all(r["n_links"] == len(r["item_ids"]) and r["similarity"] >= 0.8 for r in rows)
    bad = {d for d, _ in want}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=lambda x: -1 if x is None else x) == [None, *[i for i in range(len(texts)) if i not in bad]]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 == decontaminate.contaminated(docs.limit(0), bench).count()


def test_decontamination_of_cut_items(spark):
    """Documents that end with, or are, a part of an item: the last window is shorter than the item."""
    rng = random.Random(16)
    items = [prose(rng, n) for n in (9, 24, 59, 104)]
    texts, want = [], {}
    for i, item in enumerate(items):
        w, n = item.split(), len(item.split()) - 4
        for shared in range(int(0.7 * n), n + 1):
            for text in (" ".join(w[: shared + 4]), prose(rng, 30) + " " + " ".join(w[: shared + 4]), " ".join(w[-shared - 4 :])):
                if 10 * shared >= 8 * n:
                    want[len(texts)] = (i, round(shared / n, 9))
                texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = decontaminate.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["item_id"], round(r["similarity"], 9)) for r in rows} == want


def test_lines(spark):
    rng = random.Random(8)
    pool = [" Shared LINE number %d\t" % k for k in range(9)] + ["short", "", "é" * 10, "shared line number 1"]
    texts = [None, "", "\n\n"] + ["\n".join(rng.choice(pool) if rng.random() < 0.6 else prose(rng, 4) for _ in range(rng.randrange(1, 30))) for _ in range(50)]
    first = {}
    for i, t in enumerate(texts):
        for k in lines.line_keys(t):
            if len(k) >= 10:
                first.setdefault(k, i)
    want = {}
    for i, t in enumerate(texts):
        kept = [x for x, k in zip((t or "").split("\n"), lines.line_keys(t), strict=True) if not (len(k) >= 10 and first[k] != i)]
        want[i] = ((t or "").count("\n") + 1, (t or "").count("\n") + 1 - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(40, texts[40], 5)], "doc_id long, text string, at int")
    rows = lines.line_digests(docs).collect()
    assert len(rows) == len(texts) + 1
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows} == want
    assert lines.line_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [embeddings.BLOCK, 4])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(9)
    vectors = []
    for _ in range(40):
        base = rng.normal(size=64)
        vectors += [base + rng.normal(size=64) * rng.choice([0.02, 0.2, 0.6]) for _ in range(rng.integers(1, 12))]
    vectors += [vectors[0] * 3.0, vectors[5], vectors[5]]
    v = np.array(vectors)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    n = len(v)
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [1.0, 0.0, 0.0], [1.0, 0.1, 0.0]]
    rows = [(i, [float(x) for x in row], 1) for i, row in enumerate(v)] + [(n + i, x, 1) for i, x in enumerate(odd)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")).collect()}
    want = classes([(int(a), int(b)) for a, b in zip(*np.nonzero(linked))], n)
    assert len(got) == n + len(odd)
    assert sum(got[i]["n_links"] for i in range(n)) >= 0.99 * linked.sum()
    assert all(got[i]["n_links"] <= linked[i].sum() for i in range(n))
    assert np.mean([got[i]["component_id"] == want[i] for i in range(n)]) > 0.98
    assert [(got[n + i]["n_links"], got[n + i]["kept"]) for i in range(6)] == [(0, True)] * 6
    assert [got[n + i]["component_id"] for i in (6, 7)] == [n + 6, n + 6]
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_fingerprints_against_plain_simhash(spark):
    from pyspark.sql import functions as F

    rng = random.Random(21)
    bags = [[rng.getrandbits(64) - 2**63 for _ in range(rng.randrange(1, 40))] * rng.randrange(1, 3) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(bags)), "k long, bag array<long>")
    second = {r["h"]: r["x"] for r in df.select(F.explode("bag").alias("h")).distinct().withColumn("x", F.xxhash64("h")).collect()}

    def plain(hashes):
        return sum(1 << b for b in range(decontaminate.HALF) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = decontaminate.simhash(df, ["k"], "bag").withColumn("blocks", decontaminate.blocks()).collect()
    for r in rows:
        assert (r["print0"], r["print1"]) == (plain(bags[r["k"]]), plain([second[h] for h in bags[r["k"]]]))
        assert len(set(r["blocks"])) == decontaminate.BLOCKS == decontaminate.RADIUS + 1
        assert r["blocks"][22] == 8 * 22 + (r["print1"] >> 3 & 7) and r["blocks"][20] == 8 * 20 + (r["print0"] >> 60)


def test_candidates_come_through_the_fingerprints(spark, monkeypatch):
    """Windows name no item: all items of their size are looked up, and the radius leaves the right ones. Without it all of them would stay."""
    rng = random.Random(22)
    items = [[rng.getrandbits(64) - 2**63 for _ in range(40)] for _ in range(60)]
    windows = [[*item[:-3], *(rng.getrandbits(64) - 2**63 for _ in range(3))] for item in items[:30]] + [[rng.getrandbits(64) - 2**63 for _ in range(40)] for _ in range(30)]
    w = spark.createDataFrame([(i, 1, 40, 0, x) for i, x in enumerate(windows)], "doc_id long, row_hash long, n int, start int, window array<long>")
    it = spark.createDataFrame([(i, 40, x) for i, x in enumerate(items)], "item_id long, n int, item array<long>")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.candidates(w, it).collect()}
    assert {(i, i) for i in range(30)} <= got and len(got) <= 35
    monkeypatch.setattr(decontaminate, "RADIUS", 124)
    assert decontaminate.candidates(w, it).count() > 1000


def test_weighted_similarity_of_bags(spark):
    from pyspark.sql import functions as F

    rng = random.Random(23)
    rows = [([rng.randrange(9) for _ in range(rng.randrange(1, 20))], [rng.randrange(9) for _ in range(rng.randrange(1, 20))]) for _ in range(50)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select("a", "b", decontaminate.weighted_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r["s"] - similarity(Counter(r["a"]), Counter(r["b"]))) < 1e-12 for r in got)


def test_embeddings_of_one_id(spark):
    """Rows of one id with other vectors are vectors of their own: they neither share links nor join what isn't near."""
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (9, [1.0, 0.1, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.0]), (12, [0.0, 0.0, 1.0, 0.1]), (20, [0.0, 1.0, 0.0, 0.0])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(5, 1, 5), (5, 1, 5), (9, 1, 5), (12, 1, 5), (20, 0, 20)]
    far = [(7, rows[0][1]), (9, rows[1][1]), (5, rows[2][1]), (12, rows[3][1])]
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()}
    assert got == {7: 7, 9: 7, 5: 5, 12: 5}


def test_cap_height_follows_the_number_of_vectors():
    heights = [embeddings.cap_height(n, 64) for n in (1000, 10**6, 10**8)]
    assert heights[0] == 3 / 8 and heights == sorted(set(heights))
    for n, height in zip((10**6, 10**8), heights[1:], strict=True):
        assert abs(n * float(embeddings._above(height, 64)) / embeddings.FILLED - 1) < 0.01
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1000, 64))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert abs(float(embeddings._above(0.25, 64)) - (np.abs(u @ u[0])[1:] > 0.25).mean() / 2) < 0.01
    other = rng.normal(size=u.shape)
    other -= (other * u).sum(1, keepdims=True) * u
    w = 0.9 * u + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1, keepdims=True)
    for n in (1000, 10**6):
        code = embeddings.ProductCode(64, n)
        a, b = (set(zip(*(x.tolist() for x in code.decode(m)), strict=True)) for m in (u, w))
        assert len({r for r, _ in a & b}) > 0.98 * 1000
