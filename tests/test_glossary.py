"""Glossaries as tables against looking for every term in every question."""

import random

from kelpline.functions.glossary import GLOSSARY, contained, glossary_table, weighted_term_rows


def test_contained(spark):
    rng = random.Random(1)
    letters = "가나다라마ab "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    terms = [(word(rng.randrange(1, 9)), f"e{i}") for i in range(300)] + [("가나", None), ("", "never"), (None, "never"), ("😀가", "x"), ("가" * 9, "long")]
    questions = [(i, word(rng.randrange(0, 40))) for i in range(200)] + [(900, None), (901, "가" * 20), (902, "a😀가😀")]
    got = [tuple(r) for r in contained(spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame(terms, "ko string, en string")).collect()]
    want = {(q, ko, en) for q, text in questions for ko, en in terms if ko and text and ko in text}
    assert len(got) == len(want) and set(got) == want


def test_weights(spark):
    rows = [(1, "모니터링 계획 plan MRV 언제까지?", "monitoring plan deadline surrender"), (2, "무엇?", None), (3, None, "allowances"), (4, "배출권 제출", "the of")]
    got = {(r["query_id"], r["term"]): r["weight"] for r in weighted_term_rows(spark.createDataFrame(rows, "query_id long, question string, translated string"), glossary_table(spark)).collect()}
    assert {t: w for (q, t), w in got.items() if q == 1} == {"monitoring": 1.0, "plan": 1.0, "mrv": 1.0, "deadline": 1.0, "surrender": 0.1}
    assert {t: w for (q, t), w in got.items() if q in (2, 3)} == {"allowances": 0.1}
    assert {t for q, t in got if q == 4} == {"allowances", "submit", "surrender"}
    assert glossary_table(spark).count() == len(GLOSSARY)
