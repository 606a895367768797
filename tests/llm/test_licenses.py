"""The license scan against plain searches, and expressions against a recursive evaluation."""

import os
import random
import re

import pytest

from kelpline.llm import licenses
from kelpline.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"
SEARCH = licenses.automaton()


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(text):
    """(n_words, n_base, first_word, last_word, base_labels) by comparing every phrase at every word."""
    w = plain_words(text)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def plain_notices(text):
    joined = f" {' '.join(plain_words(text))} "
    return {label for phrase, label in (licenses.NOTICES | licenses.BASE).items() if f" {phrase} " in joined}


def random_text(rng):
    vocabulary = ["GNU", "General", "Public", "License", "Apache", "cc", "by", "MIT", "ü", "mit", "license", "CC-BY", "CC by\ncc", "gnu general\tpublic_license", "Apache  License", "sa", "©", "MITLicense", "0"]
    return rng.choice([" ", "-", "\n", "   ", "!"]).join(rng.choices(vocabulary, k=rng.randrange(120)))


def test_phrases_of_random_texts():
    rng = random.Random(1)
    for text in [random_text(rng) for _ in range(600)] + [None, "", "cc by cc by cc by", "MIT license MIT License", "permission is hereby granted, free of charge"]:
        got = licenses.scan(text, SEARCH)
        assert got[:5] == plain_base(text)
        assert set(filter(None, got.labels.split(","))) == plain_notices(text)
        assert 0 <= got.score <= 1 and (got.score > 0) == bool(got.labels)


def plain_strictness(tokens):
    """Recursive descent over: or := and (OR and)*, and := with (AND with)*, with := atom [WITH name], atom := name | ( or )."""
    rest = [*tokens, None]

    def atom():
        token = rest.pop(0)
        if token == "(":
            value = either()
            if rest.pop(0) != ")":
                raise ValueError
            return value, False
        if token is None or token == ")" or token.lower() in ("and", "or", "with"):
            raise ValueError
        return licenses.family(token)[1], True

    def excepted():
        value, single = atom()
        while rest[0] is not None and rest[0].lower() == "with":
            rest.pop(0)
            _, name = atom()
            if not (single and name):
                raise ValueError
            value, single = max(value - 1, 0), False
        return value

    def both():
        value = excepted()
        while rest[0] is not None and rest[0].lower() == "and":
            rest.pop(0)
            value = max(value, excepted())
        return value

    def either():
        value = both()
        while rest[0] is not None and rest[0].lower() == "or":
            rest.pop(0)
            value = min(value, both())
        return value

    try:
        value = either()
    except (ValueError, IndexError):
        return None
    return value if rest == [None] else None


def test_expressions_of_random_tokens():
    rng = random.Random(2)
    names = ["MIT", "GPL-2.0-or-later", "Apache-2.0", "CC0-1.0", "LicenseRef-x", "LGPL-2.1+", "Classpath-exception-2.0"]
    seen = set()
    for _ in range(20000):
        tokens = [rng.choice([*names, "and", "OR", "WITH", "(", ")"]) for _ in range(rng.randrange(8))]
        if rng.random() < 0.7:  # more likely to be one
            tokens = [x for i in range(rng.randrange(1, 5)) for x in ([rng.choice(["AND", "or"])] if i else []) + rng.choice([[rng.choice(names)], ["(", rng.choice(names), "OR", rng.choice(names), ")"], [rng.choice(names), "with", names[-1]]])]
        want = plain_strictness(tokens)
        assert licenses.strictness(tokens) == want, tokens
        seen.add(want)
    assert seen == {None, 0, 1, 2, 3, 4}


@pytest.mark.parametrize(
    ("line", "expressions", "labels", "strict"),
    [
        ("SPDX-License-Identifier: MIT", ["MIT"], "mit", 1),
        ("# spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND CC-BY-4.0 -->", ["( GPL-2.0-only WITH Classpath-exception-2.0 OR MIT ) AND CC-BY-4.0"], "cc-by,gpl,mit", 1),
        ("SPDX-License-Identifier: Apache-2.0. See MIT", ["Apache-2.0"], "apache", 1),
        ("SPDX-License-Identifier: GPL-3.0+ AND", ["GPL-3.0+ AND"], "gpl", None),
        ("SPDX-License-Identifier:\nMIT", [], "", None),
        ("x SPDX-License-Identifier: Foo-1 */ y\nSPDX-License-Identifier: MIT OR", ["Foo-1", "MIT OR"], "foo-1,mit", 4),
        ('License-Expression = "LGPL-2.1-or-later OR (Apache-2.0"', ["LGPL-2.1-or-later OR ( Apache-2.0"], "apache,lgpl", None),
    ],
)
def test_tags(line, expressions, labels, strict):
    got = licenses.scan(line, SEARCH)
    assert (got.expressions, got.labels, got.strictness) == (expressions, labels, strict)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op12_license_scan"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_cases(spark):
    rows = [(1, None), (1, ""), (None, "MIT license"), (2, "mit license " * 50_000), (2, "mit license " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, labels string, score double")
    got = sorted((tuple(r)[:6] for r in licenses.scans(docs).collect()), key=str)
    assert got == sorted(((d, *plain_base(t)) for d, t in rows), key=str)
    assert licenses.scans(docs.limit(0)).count() == 0
