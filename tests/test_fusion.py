"""Fusion of all documents for all questions: odd rows against the SQL, and the cut of a block against all its scores."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.operators import fusion, inverted
from kelpline.plans.queries import ORACLES, QUERIES, document_index


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randrange(30))) for _ in range(160)]
    texts[20:60] = [texts[20]] * 40  # equal in both signals where they have no vector
    docs = [(i, t) for i, t in enumerate(texts)] + [(160, None), (161, "the a"), (400, "w1 w1 w2")]
    vectors = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(4)]) for i in range(0, 160, 3)] + [(161, None), (900, [1.0, 0.0, 0.0, 1.0])]
    items = [(i, f"w{i} w{i + 1} w{i % 5}") for i in range(12)] + [(100, "w3"), (101, "nowhere"), (102, None), (3, "w20 w4"), (900, "w7 w8"), (None, "w1"), (-7, "w2")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("embeddings", vectors, "vec_id long, embedding array<float>"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("group", [256, 4])
def test_every_item_is_asked(spark, tables, monkeypatch, group):
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 13)
    monkeypatch.setattr(inverted, "QUERY_GROUP", group)
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{tables}/{name}.parquet/*.parquet')")
    got = QUERIES["hybrid_full"](spark, tables)
    want = con.sql(ORACLES["hybrid_full"])
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(tuple(r[i] for i in at) for r in want.fetchall())
    assert {r[0] for r in rows} == {*range(12), 100, 101, 102, 900, -7} and len(rows) == 17 * 10


def test_every_document_lies_in_one_block(spark, tables, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK_DOCS", 13)
    index = document_index(spark, tables)
    assert sorted(r[0] for r in index.blocks.select(F.explode("docs")).collect()) == [*range(162), 400]
    held = index.postings.select("block", F.explode("docs").alias("d")).distinct()
    lying = index.blocks.select("block", F.explode("docs").alias("d"))
    assert held.join(lying, ["block", "d"], "left_anti").count() == 0 and index.blocks.count() > 4


def test_contenders_of_a_block():
    rng = np.random.default_rng(3)
    for case in range(60):
        shape, k = (5, int(rng.integers(1, 60))), 4
        # Few values, values that differ by less than is shown, and a signal without a range.
        vec = rng.choice([0.0, 0.25, 0.5], shape) + rng.choice([0, 1e-10, 3e-7], shape) * (case % 2)
        vec, kw = (np.pad(x, ((0, 0), (0, 40))) for x in (vec, np.zeros(shape) if case % 3 == 0 else rng.choice([0.0, 1.5, 4.25], shape)))
        ends = {f"{n}_{c}": np.round(f(x, axis=1), 9) for c, x in (("vec", vec), ("kw", kw)) for n, f in (("lo", np.min), ("hi", np.max))}
        normal = {}
        for c, x in (("vec", vec), ("kw", kw)):
            low, width = ends[f"lo_{c}"][:, None], (ends[f"hi_{c}"] - ends[f"lo_{c}"])[:, None]
            normal[c] = np.round(np.where(width <= 1e-12, 0.0, (np.round(x, 9) - low) / np.where(width <= 1e-12, 1.0, width)), 6)
        score = np.round(normal["vec"] * 0.6 + normal["kw"] * 0.4, 6)
        i, j = fusion._contenders(vec, kw, ends, k)
        for q in range(5):
            best = np.lexsort((np.arange(score.shape[1]), -score[q]))[:k]
            assert set(best) <= set(j[i == q])
        assert len(i) < vec.size
