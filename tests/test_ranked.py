"""The ranked question against loops, with values that a database's own text rank gives."""

import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpline.functions.stems import STOP_WORDS, stem
from kelpline.operators import ranked
from kelpline.plans import answers as plans

DATA = "/root/testdata/sf0.001"

STEMS = """consistently consist, consistency consist, consolations consol, conspirators conspir, knackeries knackeri, knavish knavish, knives knive, generate generat, general general, hopping hop, hoping hope, ties tie,
cries cri, gas gas, gaps gap, by by, say say, agreed agre, feed feed, luxuriated luxuri, relational relat, happiness happi, decisions decis, adoption adopt, allowances allow, shipping ship, companies compani, emissions emiss,
verification verif, youth youth, flying fli, skies sky, proceeding proceed, communication communic, controlled control, beautifully beauti, rate rate, monitoring monitor, dying die, inning inning, national nation, hopefulness hope"""


@pytest.mark.parametrize("pair", STEMS.replace("\n", " ").split(", "))
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def lexemes(text):
    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower())]
    return [(min(i + 1, 16383), w if any(c.isdigit() for c in w) else stem(w)) for i, w in enumerate(words) if w not in STOP_WORDS]


def plain_rank(body, query):
    """Pair by pair and place by place."""
    wanted = sorted({x for _, x in lexemes(query)})
    places = {x: sorted({p for p, y in lexemes(body) if y == x})[:255] for x in wanted}
    if len(wanted) < 2:
        return sum(0.1 / (j + 1) ** 2 for x in wanted for j in range(len(places[x]))) / 1.64493406685
    rank = -1.0
    for i, a in enumerate(wanted):
        for b in wanted[:i]:
            for p in places[a]:
                for q in places[b]:
                    d = abs(p - q)
                    if d:
                        close = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                        w = math.sqrt(0.1 * 0.1 * close)
                        rank = w if rank < 0 else 1 - (1 - rank) * (1 - w)
    return 1e-20 if rank < 0 else rank


def ranks(spark, bodies, asked):
    b = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query_en string")
    got = {(r["query_id"], r["doc_id"]): r["kw"] for r in ranked.text_rank(b, q, q.select("query_id").crossJoin(b.select("doc_id"))).collect()}
    return [[got[i, j] for j in range(len(bodies))] for i in range(len(asked))]


def test_text_rank(spark):
    bodies = ["The quick brown fox", "a quick fox", "quick quick foxes", "nothing", None, "", "fox", "Company's shipping-companies report emissions, and ships report 12 emissions " * 30, "quick " + "x " * 120 + "fox"]
    asked = ["quick fox", "quick", "the of", "companies' shipping emissions", "quick foxes FOX", "report 12"]
    got = ranks(spark, bodies, asked)
    for i, q in enumerate(asked):
        for j, b in enumerate(bodies):
            assert abs(got[i][j] - plain_rank(b, q)) < 1e-12, (q, b)
    # What the database shows for these.
    assert round(got[0][0], 7) == 0.0985009 and round(got[0][1], 7) == 0.0991032 and round(got[1][0], 7) == 0.0607927
    assert got[0][3] == 1e-20 and got[0][6] == 1e-20 and got[2][0] == 0.0


def test_places_are_bounded(spark):
    body = "alpha " * 400 + "beta " + "x " * 17000 + "alpha beta"
    assert abs(ranks(spark, [body], ["alpha beta"])[0][0] - plain_rank(body, "alpha beta")) < 1e-12


QUESTIONS = "query_id long, question string, query_en string, vec array<float>"
CHUNKS = "doc_id long, doc string, cite string, body string, article_no int, vec array<float>"


def test_order_and_ties(spark):
    questions = spark.createDataFrame([(1, "모니터링?", " monitoring plan ", [1.0, 0.0])], QUESTIONS)
    chunks = spark.createDataFrame([(1, "d", "c1", "monitored " + "plan " * 500, 1, [0.7, 0.714143]), (2, "d", "c2", "nothing here", 2, [0.9, 0.435890]), (3, "d", "c3", "monitoring plan", 90, [0.99, 0.141067]), (4, "d", "c4", None, 1, [0.0, 1.0])], CHUNKS)
    got = ranked.ask_ranked(questions, chunks, 2, max_article=33).orderBy("id").collect()
    # The nearest by vector, article 90 left out; "monitored" and "plan" are next to each other in the second.
    assert [(r["id"], r["doc_id"], r["score"]) for r in got] == [("1", 2, 0.6), ("2", 1, 0.4)]
    assert got[1]["excerpt"].endswith("…") and len(got[1]["excerpt"]) == 401
    # Of a word only the first 255 places count, so here the two never meet: both signals of words are nothing, which is flat.
    far = chunks.filter("doc_id <= 2").withColumn("body", F.when(F.col("doc_id") == 1, "plan " * 500 + "monitored").otherwise(F.col("body")))
    assert [(r["doc_id"], r["score"]) for r in ranked.ask_ranked(questions, far, 2).orderBy("id").collect()] == [(2, 1.0), (1, 0.4)]
    everything = ranked.ask_ranked(questions, chunks, 9).orderBy(F.col("id").cast("int")).collect()
    signals = np.array([[v, plain_rank(b, "monitoring plan")] for b, v in (("monitored " + "plan " * 500, 0.7), ("nothing here", 0.9), ("monitoring plan", 0.99), (None, 0.0))])
    scores = (signals - signals.min(0)) / np.ptp(signals, axis=0) @ [0.6, 0.4]
    assert [r["doc_id"] for r in everything] == (np.argsort(-scores) + 1).tolist() and np.allclose([r["score"] for r in everything], -np.sort(-scores), atol=1e-5)
    assert [r["id"] for r in everything] == ["1", "2", "3", "4"] and everything[-1]["excerpt"] == ""
    flat = spark.createDataFrame([(7, "d", "c", "same", 1, [1.0, 0.0]), (3, "d", "c", "same", 1, [1.0, 0.0])], CHUNKS)
    got = ranked.ask_ranked(questions, flat, 4).orderBy("id").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(3, 1.0), (7, 1.0)]


def test_stable_ties(spark):
    questions = spark.createDataFrame([(1, "alpha beta", None, [1.0, 0.0])], QUESTIONS)
    rows = [(1, "d", "c", "alpha beta", 1, [0.8, 0.6]), (2, "d", "c", "nothing", 1, [1.0, 0.0]), (5, "d", "c", "nothing", 1, [0.9, 0.43588989])]
    got = {r["doc_id"]: r for r in ranked.ask_ranked(questions, spark.createDataFrame(rows, CHUNKS), 3).collect()}
    assert got[2]["score"] == 0.6 and got[1]["score"] == 0.4 and got[2]["id"] == "1"
    both = [(1, "d", "c", "alpha beta", 1, [0.0, 1.0]), (9, "d", "c", "nothing", 1, [0.66666667, 0.74535599]), (4, "d", "c", "x", 1, [1.0, 0.0])]
    got = {r["doc_id"]: r for r in ranked.ask_ranked(questions, spark.createDataFrame(both, CHUNKS), 3).collect()}
    assert got[9]["score"] == got[1]["score"] == 0.4 and (got[4]["id"], got[9]["id"], got[1]["id"]) == ("1", "2", "3")


def test_prompts_and_answers(spark):
    questions = spark.createDataFrame([(1, "alpha?", "alpha", [1.0]), (2, "beta?", None, [1.0]), (3, "gamma?", None, None)], QUESTIONS)
    chunks = spark.createDataFrame([(1, "d", "c1", "alpha beta", 1, [1.0]), (2, "d", "c2", None, 1, [1.0])], CHUNKS)
    cited = ranked.ask_ranked(questions, chunks, 2)
    prompt = {r["query_id"]: r["prompt"] for r in ranked.prompts(questions, cited).collect()}
    assert prompt[1] == f"alpha?\n\n[조문 발췌]\n[1] c1\nalpha beta\n\n[2] c2\n\n\n{ranked.ANSWER_FORM}" and 3 not in prompt
    replies = spark.createDataFrame([(1, '{"answer":"a [2]","used":[2,99,-1,2,1,null],"caveat":"mine"}'), (2, '{"used":null,"caveat":" "}'), (3, "never read")], "query_id long, reply string")
    got = {r["query_id"]: (r["answer"], r["used"], r["caveat"]) for r in ranked.answers(questions, cited, replies).collect()}
    assert got == {1: ("a [2]", [2, 1], "mine"), 2: ("제공된 조문에서는 확인되지 않습니다", [], "법률 자문이 아닙니다"), 3: ("제공된 조문에서는 확인되지 않습니다", [], "법률 자문이 아닙니다")}
    with pytest.raises(Exception, match="no JSON"):
        ranked.answers(questions, cited, spark.createDataFrame([(1, "x")], "query_id long, reply string")).collect()
    with pytest.raises(Exception, match="blank"):
        ranked.ask_ranked(spark.createDataFrame([(1, " ", "x", [1.0])], QUESTIONS), chunks, 2).collect()
    with pytest.raises(ValueError, match="k must be"):
        ranked.ask_ranked(questions, chunks, 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_query(spark):
    questions, chunks = (df.collect() for df in plans.ranked_questions(spark, DATA))
    got = {(r["query_id"], int(r["id"])): r for r in plans.ask_ranked(spark, DATA).collect()}
    assert len(got) == 10 * len(questions) > 0
    unit = lambda v: np.asarray(v, float) / np.linalg.norm(v)
    for q in questions:
        near = sorted(((-round(float(unit(c["vec"]) @ unit(q["vec"])), 6), c["doc_id"], c) for c in chunks), key=lambda x: x[:2])[:10]
        signals = np.array([[float(unit(c["vec"]) @ unit(q["vec"])), plain_rank(c["body"], q["question"])] for _, _, c in near])
        spread = np.ptp(signals, axis=0)
        norms = np.where(spread < 1e-12, 1.0, (signals - signals.min(0)) / np.where(spread < 1e-12, 1, spread))
        scores = norms @ [0.6, 0.4]
        order = sorted(range(10), key=lambda i: (-round(scores[i], 6), i))
        for place, i in enumerate(order, 1):
            r = got[q["query_id"], place]
            assert r["doc_id"] == near[i][1] and abs(r["score"] - scores[i]) < 3e-6 and abs(r["kw_score"] - signals[i, 1]) < 1e-6
    assert Counter(r["query_id"] for r in got.values()).most_common(1)[0][1] == 10
