"""The stored index: searches against loops over the texts, a build of several blocks, broken builds, states of a table."""

import contextlib
import io
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelpline.functions.text import STOP_WORDS
from kelpline.operators import inverted, retrieval


def tokens(text):
    return [t for t in re.split("[^a-z0-9가-힣]+", (text or "").lower()) if 2 <= len(t) <= 32 and t not in STOP_WORDS]


def plain_bm25(texts, asked):
    counts = {d: Counter(tokens(t)) for d, t in texts.items()}
    average = sum(sum(c.values()) for c in counts.values()) / len(counts)
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for query, term, weight in asked:
        for d, c in counts.items():
            if weight and c[term]:
                idf = math.log(1 + (len(counts) - df[term] + 0.5) / (df[term] + 0.5))
                out[query, d] = out.get((query, d), 0) + weight * idf * c[term] * 2.5 / (c[term] + 1.5 * (0.25 + 0.75 * sum(c.values()) / average))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "가나", "é", "x"]
    texts = {i: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(64)], k=rng.randrange(60))) for i in range(300)}
    asked = [(q, t, rng.choice([1.0, 0.1])) for q in range(12) for t in rng.sample(vocabulary, 6)] + [(3, "nowhere", 1.0), (4, "w1x", 0.0), (50, "nowhere", 1.0)]
    return texts | {400: None, 401: "", 402: "the a x"}, asked


@pytest.fixture
def index(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 40)
    monkeypatch.setattr(inverted, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(inverted, "SLICE", 2)
    rows = [*corpus[0].items(), (None, "w1 w2")]
    # Three documents in several rows.
    for d in (5, 6, 401):
        rows = [r for r in rows if r[0] != d] + [(d, x) for x in (corpus[0][d] or " ").split(" ", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    inverted.build(docs, str(tmp_path / "i"))
    return inverted.load(spark, str(tmp_path / "i"))


def test_tables(index, corpus):
    counts = {d: Counter(tokens(t)) for d, t in corpus[0].items()}
    assert (index.n_docs, index.total) == (len(counts), sum(sum(c.values()) for c in counts.values()))
    assert {r["doc_id"]: r["dl"] for r in index.documents.collect()} == {d: sum(c.values()) for d, c in counts.items()}
    held = {}
    for r in index.postings.collect():
        assert r["docs"] == sorted(r["docs"]) and len(r["docs"]) <= 40
        for d, tf, dl in zip(r["docs"], r["tfs"], r["dls"]):
            assert (r["term"], d) not in held and dl == sum(counts[d].values())
            held[r["term"], d] = tf
    assert held == {(t, d): n for d, c in counts.items() for t, n in c.items()}
    assert {r["term"]: (r["df"], r["cf"]) for r in index.terms.collect()} == {t: (sum(t in c for c in counts.values()), sum(c[t] for c in counts.values())) for t in {t for t, _ in held}}


def test_postings_are_written_where_they_lie(index):
    files, sorted_blocks = {}, {}
    for r in index.postings.select("term", "bucket", "block", F.input_file_name().alias("file")).collect():
        files.setdefault(r["file"], set()).add(r["block"] >> 32)
        sorted_blocks.setdefault((r["file"], r["block"]), []).append(r["term"])
    assert len({task for tasks in files.values() for task in tasks}) > 1 and all(len(tasks) == 1 for tasks in files.values())
    assert all(terms == sorted(terms) for terms in sorted_blocks.values())


def shuffled(spark):
    """Bytes that this session's stages have shuffled so far."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("n_repeated", [0, 1])
def test_a_build_shuffles_neither_texts_nor_postings(spark, tmp_path, n_repeated):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(rng.sample(vocabulary, 400))) for i in range(1500)]
    docs = spark.createDataFrame(rows + rows[:n_repeated], "doc_id long, text string")
    before = shuffled(spark)
    inverted.build(docs, str(tmp_path / "i"))
    assert shuffled(spark) - before < 300_000  # the postings alone have more than 1 MB
    index = inverted.load(spark, str(tmp_path / "i"))
    assert (index.n_docs, index.total, index.postings.agg(F.sum(F.size("docs"))).first()[0]) == (1500, 400 * (1500 + n_repeated), 600_000)


def test_searches(spark, index, corpus, monkeypatch):
    want = plain_bm25(*corpus)
    terms = spark.createDataFrame(corpus[1], "query_id long, term string, weight double")
    got = {(r["query_id"], r["doc_id"]): r["kw"] for r in inverted.bm25(index, terms).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    only = spark.createDataFrame(list(want)[::7], "query_id long, doc_id long")
    assert {(r["query_id"], r["doc_id"]) for r in inverted.bm25(index, terms, only).collect()} == set(list(want)[::7])
    for group in (256, 3):
        monkeypatch.setattr(inverted, "QUERY_GROUP", group)
        best = retrieval.top_k(inverted.bm25_best(index, terms, 5), 5, "kw")
        for q in {q for q, _ in want}:
            expected = sorted(((-s, d) for (p, d), s in want.items() if p == q))[:5]
            assert [(r["doc_id"]) for r in best.filter(f"query_id = {q}").orderBy("rank").collect()] == [d for _, d in expected]
        assert best.filter("query_id in (4, 50)").count() == min(5, sum(q == 4 for q, _ in want))
    assert inverted.bm25(index, terms.limit(0)).count() == 0 and inverted.bm25_best(index, terms.limit(0), 5).count() == 0


def test_only_asked_buckets_are_read(spark, index):
    terms = spark.createDataFrame([(1, "w3", 1.0)], "query_id long, term string, weight double")
    bucket = spark.range(1).selectExpr(f"pmod(xxhash64('w3'), {inverted.BUCKETS})").first()[0]
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        inverted.bm25(index, terms).explain("formatted")
    scans = re.findall(r"PartitionFilters: \[(.*)\]", plan.getvalue())
    assert len(scans) == 2 and all(re.search(rf"\(bucket#\d+L? = {bucket}\)", s) for s in scans) and "/documents" not in plan.getvalue()


def test_stored(spark, tmp_path):
    builds = []

    def docs(text="alpha beta"):
        builds.append(1)
        return spark.createDataFrame([(1, text)], "doc_id long, text string")

    folder = str(tmp_path / "f")
    assert inverted.stored(spark, folder, "a", docs).total == 2
    assert inverted.stored(spark, folder, "a", docs).total == 2 and len(builds) == 1
    # A build that broke left no totals; the next one stands beside it.
    whole = next((tmp_path / "f").glob("*-a/*"))
    (whole / "totals" / "_SUCCESS").unlink()
    assert inverted.stored(spark, folder, "a", lambda: docs("gamma")).total == 1 and len(builds) == 2
    assert inverted.stored(spark, folder, "b", docs).total == 2 and len(builds) == 3
    empty = inverted.stored(spark, folder, "none", lambda: docs().limit(0))
    asked = spark.createDataFrame([(1, "alpha", 1.0)], "query_id long, term string, weight double")
    assert (empty.n_docs, empty.total) == (0, 0) and inverted.bm25(empty, asked).count() == 0 and inverted.bm25_best(empty, asked, 3).count() == 0


def test_state_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = inverted.state_of(spark, [path])
    assert inverted.state_of(spark, [path]) == first
    spark.range(5, 6).write.mode("append").parquet(path)
    assert inverted.state_of(spark, [path]) != first


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    asked = spark.createDataFrame([(7, [0.0, 1.0]), (8, [2.0, 0.0, 0.0])], "query_id long, q array<float>").coalesce(1)
    got = {(r["query_id"], r["vec_id"]): r["cosine"] for r in retrieval.vector_scores(vectors, asked).collect()}
    assert got == {(7, 1): 0.0, (7, 3): 1.0, (8, 2): 1.0}
