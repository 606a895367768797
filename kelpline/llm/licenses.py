"""License scan: notice phrases and identifier tags by Aho-Corasick, licence expressions by a shunting-yard parser.

A text is folded in place, by a table over its bytes: A-Z become small letters, other ASCII that is no letter or digit a blank, everything else stays. Its words, joined by single
blanks, are searched by one automaton that holds all phrases and tags between blanks, so a hit is a stretch of whole words whatever parted them; overlapping hits all
count. Behind a tag (``SPDX-License-Identifier:``) the text itself is read to the end of the line: identifiers, ``AND``, ``OR``, ``WITH``, ``+`` and parentheses. Operators wait on a
stack until their operands are there (WITH before AND before OR); what comes out is evaluated from the bottom: how much the expression as a whole asks of who uses the text, an OR being
as free as its freer side, an AND as strict as its stricter one, an exception taking a step off.

Defined cases: a null or empty text has no words and no labels; an expression that is no expression (an operator without operand, an open parenthesis, nothing) gives the labels of the
identifiers in it and no strictness; an identifier that isn't known is a label of its own and as strict as ``UNKNOWN``; rows with one id are rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of notices, as folded words, with their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "licensed under the apache license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Words of the tags that a licence expression follows.
TAGS = ("spdx license identifier", "spdx licence identifier", "license expression", "licence expression")
#: Families of identifiers: what an identifier begins with, its label and strictness, longest beginning first.
FAMILIES = (
    ("cc-by-nc", "cc-by-nc", 4), ("cc-by-nd", "cc-by-nd", 4), ("cc-by-sa", "cc-by-sa", 3), ("apache", "apache", 1), ("cc-by", "cc-by", 1), ("agpl", "agpl", 4), ("lgpl", "lgpl", 2), ("unlicense", "unlicense", 0),
    ("bsd", "bsd", 1), ("bsl", "bsl", 1), ("cc0", "cc0", 0), ("epl", "epl", 2), ("gpl", "gpl", 3), ("isc", "isc", 1), ("mit", "mit", 1), ("mpl", "mpl", 2), ("0bsd", "bsd", 0),
)
#: Strictness of an identifier of no known family.
UNKNOWN = 4
#: How much one kind of evidence says for itself; together they say 1 less the product of what each leaves open.
WEIGHTS = {"base": 0.8, "notice": 0.7, "expression": 0.95, "broken expression": 0.4}

_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.:+-]*")
#: What binds how strongly; WITH takes an exception, no expression, on its right.
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, int]:
    """(label, strictness) of an identifier."""
    name = identifier.lower().rstrip("+")
    for start, label, strict in FAMILIES:
        if name == start or name.startswith(start + "-"):
            return label, strict
    return name, UNKNOWN


def postfix(tokens: list[str]) -> list[str] | None:
    """The tokens of an expression with every operator behind its operands; None if it is no expression. Operators and parentheses are told apart from identifiers by their names."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in tokens:
        name = token.lower()
        if token == "(":
            if not operand_next:
                return None
            waiting.append(token)
        elif token == ")":
            if operand_next:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif name in _BINDS:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[name]:
                out.append(waiting.pop())
            waiting.append(name)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def strictness(tokens: list[str]) -> int | None:
    """What an expression asks: 0 nothing, 1 notices, 2 shared files, 3 shared works, 4 more or unknown. None if it is no expression, or if an exception is given to what is no identifier."""
    ordered = postfix(tokens)
    if ordered is None:
        return None
    values: list[tuple[int, bool]] = []  # (strictness, whether it is an identifier)
    for token in ordered:
        if token not in _BINDS:
            values.append((family(token)[1], True))
            continue
        (right, single), (left, other) = values.pop(), values.pop()
        if token == "with":
            if not (single and other):
                return None
            values.append((max(left - 1, 0), False))
        else:
            values.append((min(left, right) if token == "or" else max(left, right), False))
    return values[0][0]


def expression_tokens(line: bytes) -> list[str]:
    """The tokens of an expression at the start of a line: it ends where an identifier follows another, or at a character that is no part of one."""
    tokens: list[str] = []
    at, open_, operand_next = 0, 0, True
    while at < len(line):
        if line[at : at + 1] in (b" ", b"\t"):
            at += 1
            continue
        hit = _TOKEN.match(line, at)
        if hit is None:
            break
        token = hit.group().decode()
        name = token.lower()
        if (name in _BINDS or token == ")") == operand_next and token != "(":
            break
        if token == "(" and not operand_next or token == ")" and not open_:
            break
        open_ += (token == "(") - (token == ")")
        operand_next = name in _BINDS or token == "("
        tokens.append(token.rstrip(".:-") if token not in "()" else token)
        at = hit.end()
        if not operand_next and token[-1:] in (".", ":", "-"):
            break  # the end of a sentence
    return tokens


def identifiers(tokens: list[str]) -> list[str]:
    """The identifiers of an expression without its exceptions."""
    return [t for i, t in enumerate(tokens) if t not in "()" and t.lower() not in _BINDS and (i == 0 or tokens[i - 1].lower() != "with")]


class Scan(NamedTuple):
    """What a text holds: words, places of base phrases (first and last word of their starts), labels, licence expressions, their strictness (the greatest), how sure it is."""

    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: str
    labels: str
    score: float
    expressions: list[str]
    strictness: int | None


def automaton() -> ahocorasick.Automaton:
    """All phrases and tags, each between blanks, with its kind, label and numbers of characters and words."""
    made = ahocorasick.Automaton()
    for phrases, kind in ((dict.fromkeys(TAGS, ""), "tag"), (NOTICES, "notice"), (BASE, "base")):
        for phrase, label in phrases.items():
            made.add_word(f" {phrase} ", (kind, label, len(phrase) + 2, len(phrase.split())))
    made.make_automaton()
    return made


def _lines_after(data: bytes, folded: bytes, words: list[int]) -> list[bytes]:
    """The rest of the line behind each of the words of these numbers, without a colon."""
    wanted, out = set(words), []
    for i, m in enumerate(re.finditer(rb"[^ ]+", folded)):
        if i in wanted:
            end = data.find(b"\n", m.end())
            out.append(data[m.end() : end if end >= 0 else len(data)].lstrip(b" \t:=\"'"))
    return out


def scan(text: str | None, search: ahocorasick.Automaton) -> Scan:
    """All that a text says of licences."""
    data = (text or "").encode("utf-8", "surrogatepass")
    folded = data.translate(_FOLDED)
    words = folded.split()
    joined = b" ".join([b"", *words, b""]).decode("latin-1")  # a character for each byte: phrases are ASCII
    kinds, labels, base_labels, places, tags = set(), set(), set(), [], []
    counted, word = 0, -1
    for end, (kind, label, size, n_words) in search.iter(joined):
        start = end - size + 1
        if start >= counted:
            word += joined.count(" ", counted, start + 1)
            counted, at = start + 1, word
        else:  # a longer phrase that ends here began before an earlier hit
            at = word - joined.count(" ", start + 1, counted)
        if kind == "tag":
            tags.append(at + n_words - 1)
            continue
        kinds.add(kind)
        labels.add(label)
        if kind == "base":
            base_labels.add(label)
            places.append(at)
    asked, expressions = None, []
    for line in _lines_after(data, folded, tags) if tags else ():
        tokens = expression_tokens(line)
        value = strictness(tokens)
        named = identifiers(tokens)
        labels.update(family(x)[0] for x in named)
        if named:
            expressions.append(" ".join(tokens))
        kinds.add("broken expression" if value is None else "expression")
        if value is not None:
            asked = value if asked is None else max(asked, value)
    open_ = 1.0
    for kind in sorted(kinds):
        open_ *= 1 - WEIGHTS[kind]
    return Scan(len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), round(1 - open_, 6), expressions, asked)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, strictness int"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.int32())


def scans(docs: DataFrame) -> DataFrame:
    """doc_id and the fields of ``Scan`` of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = automaton()
        for batch in batches:
            rows = [scan(text, search) for text in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], names=["doc_id", *Scan._fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
