"""Steps that hold few rows at a time, and pass over their input once."""

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelpline.functions.batches import CUT, pieces
from kelpline.functions.glossary import _beginnings, contained
from kelpline.operators import chunks, retrieval
from kelpline.plans import answers, index_build
from kelpline.sources import files

DATA = "/root/testdata/sf0.001"


def batch(**columns):
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_hold_few_bytes():
    texts = ["x" * n for n in (CUT, 1, CUT // 2, CUT // 2, CUT // 2, 3 * CUT, 0)] + [None]
    got = [p.column("text").to_pylist() for p in pieces([batch(text=texts), batch(text=pa.array([], pa.string()))])]
    assert [t for p in got for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= CUT for p in got)


def test_blocks_go_out_in_small_batches():
    page = '<div class="eli-subdivision" id="art_{}"><p class="oj-ti-art">Article</p>' + "x" * (CUT // 4) + "</div>"
    pages = ["".join(page.format(i) for i in range(20)), None, page.format(7)]
    got = list(chunks._blocks([batch(doc_key=["a", "b", "c"], html=pages)]))
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_key"], r["place"], r["anchor"]) for r in rows] == [("a", i, f"art_{i}") for i in range(20)] + [("c", 0, "art_7")]
    assert len(got) > 4 and max(b.nbytes for b in got) < 2 * CUT


def test_files_come_out_in_small_batches():
    given = batch(path=[f"{i}.txt" for i in range(40)], kind=["txt"] * 40, content=[b"x" * (CUT // 4)] * 39 + [None], status=[None] * 39 + ["too large"])
    got = list(files._extracted([given]))
    assert len(got) > 8 and [s for b in got for s in b.column("status").to_pylist()] == ["ok"] * 39 + ["too large"]


def test_files_are_read_once(spark):
    rows = spark.createDataFrame([("a.txt", b"x"), ("b.hwp", b"y"), ("c.txt", b"")], "path string, content binary")
    read = files.extract_text(rows)
    assert plan_of(read).count("MapInArrow") == 1 and "Union" not in plan_of(read)
    assert sorted(map(tuple, read.collect())) == [("a.txt", "x", "ok"), ("b.hwp", None, "hwp"), ("c.txt", None, "empty")]


def test_index_build_reads_its_pages_once(spark):
    html = "".join(f'<div class="eli-subdivision" id="art_{i}"><p>{"word " * 20}</p></div>' for i in (1, 2, 2, 9)) + '<div class="eli-subdivision" id="art_x"></div>'
    pages = spark.createDataFrame([("D", html)], "doc_key string, html string")
    known = spark.createDataFrame([("D", "c", "b", 5)], "doc_key string, celex string, cite_base string, max_article int")
    index, report = index_build.build_index(pages, known, lambda texts: [[3.0, 4.0] for _ in texts], 2)
    assert plan_of(index).count("html#") and plan_of(report).count("MapInArrow") == 1 and plan_of(index).count("MapInArrow") == 2
    assert {(r["reason"], r["n"]) for r in report.collect()} == {("kept", 2), ("above limit", 1), ("number format", 1)}
    assert sorted((r["art"], [round(x, 1) for x in r["vec"]]) for r in index.collect()) == [("1", [0.6, 0.8]), ("2", [0.6, 0.8])]


def test_terms_are_counted_where_they_lie(spark):
    rows = [(1, "alpha beta alpha"), (2, "beta, Beta! x"), (2, "beta gamma"), (None, "gamma alpha"), (None, "gamma"), (3, None), (4, "of the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in retrieval.term_stats(docs).collect()} == {("alpha", 2, 3), ("beta", 2, 4), ("gamma", 2, 3)}
    lone = docs.filter("doc_id in (1, 3, 4)")
    assert "MapInArrow" in plan_of(retrieval.term_stats(lone))
    got = [r for b in retrieval._term_counts([batch(text=["aa bb", "bb cc", "aa"])], most=1) for r in b.to_pylist()]
    assert sum(r["cf"] for r in got) == 5 and len(got) == 5


def test_places_where_no_term_begins_make_no_row(spark):
    terms = spark.createDataFrame([("가나", "x"), ("언제", "y")], "ko string, en string")
    asked = spark.createDataFrame([(1, "plain words only " * 40), (2, "plain 언제 words")], "query_id long, question string")
    assert [tuple(r) for r in contained(asked, terms).collect()] == [(2, "언제", "y")]
    assert "sequence(1, length(question" not in plan_of(contained(asked, terms))
    many = list(range(0, 60000, 7))
    pattern = _beginnings(many)
    assert pattern.count("-") <= 64 and spark.range(1).select(F.lit("언").rlike(pattern)).first()[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_texts_are_not_shuffled_to_meet_vectors(spark):
    hits = answers._asked(spark, DATA, "prefilter")[1]
    assert not re.search(r"Join LeftOuter, \(doc_id#", plan_of(hits))
