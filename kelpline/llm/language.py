"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled row: each task folds its rows into one (language x bin) count matrix, matrices are
summed by Spark, and the log probabilities, ``N_BINS`` numbers a language, are broadcast. Scoring gathers the rows of that matrix
for the n-grams that a text has and sums them by document, in numpy, in pieces of bounded size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled row every text is ``und``;
ties go to the language first in code-point order; repeated rows are scored alike; texts of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import CharClass, slices

#: Bins of the hashed n-grams, as a power of two, and code points that one numpy pass holds.
BITS, PIECE = 15, 1 << 19
N_BINS = 1 << BITS
ALPHA = 0.5
UNKNOWN = "und"
_SHIFT = np.uint64(64 - BITS)
_MUL = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]
_LETTER = CharClass(str.isalpha)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, row of each code), texts parted by blanks; a longer text comes in parts that overlap by two code points."""
    sizes = [len(t or "") + 2 for t in texts]
    for a, b in slices(sizes, PIECE):
        if b - a == 1 and sizes[a] > PIECE:
            t = texts[a]
            for k in range(0, len(t), PIECE):
                codes = _codes("  " * (k == 0) + t[max(0, k - 2) : k + PIECE].lower())
                yield codes, np.full(len(codes), a, np.int64)
        else:
            codes = _codes("".join("  " + (t or "").lower() for t in texts[a:b]))
            lengths = [len((t or "").lower()) + 2 for t in texts[a:b]]
            yield codes, np.repeat(np.arange(a, b), lengths)


def _grams(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, row) of the one-, two- and three-grams that end in a letter; every other character counts as a blank."""
    letter = _LETTER(codes)
    c = np.where(letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(letter[2:]) + 2
    one = c[at] * _MUL[0]
    two = one + c[at - 1] * _MUL[1]
    three = two + c[at - 2] * _MUL[2]
    mixed = [((x ^ (x >> np.uint64(29))) * _MUL[0]) >> _SHIFT for x in (one + np.uint64(1), two + np.uint64(2), three + np.uint64(3))]
    return np.stack(mixed, 1).astype(np.int32), rows[at]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for pdf in filter(len, batches):
        for lang, part in pdf.groupby("lang"):
            sums = total.setdefault(lang, np.zeros(N_BINS, np.int64))
            for codes, rows in _pieces(part["text"].tolist()):
                sums += np.bincount(_grams(codes, rows)[0].ravel(), minlength=N_BINS)
    for lang, sums in total.items():
        hit = np.flatnonzero(sums)
        yield pd.DataFrame({"lang": lang, "bin": hit.astype(np.int32), "n": sums[hit]})


class Model:
    """langs in code-point order and a matrix of log probabilities, bins x langs."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score = np.zeros((len(texts), len(self.langs)))
        seen = np.zeros(len(texts), np.int64)
        for codes, rows in _pieces(texts):
            bins, of = _grams(codes, rows)
            if not len(of):
                continue
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            seen[of[starts]] += np.diff(np.r_[starts, len(of)])
            for k in range(len(self.langs)):
                each = self.log_p[k][bins].sum(1, dtype=np.float64)
                score[of[starts], k] += np.add.reduceat(each, starts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = score.argmax(1)
        p = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, seen, strict=True)], np.where(seen > 0, p, 0.0)


def train(labelled: DataFrame) -> Model:
    """The model of (text, lang) rows, all of them; rows without a language or text are left out."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.mapInPandas(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    # At most N_BINS rows a language, whatever the corpus.
    got = counts.toPandas()
    langs = sorted(got["lang"].unique())
    log_p = np.zeros((len(langs), N_BINS), np.float32)
    for k, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        n = np.full(N_BINS, ALPHA)
        n[part["bin"]] += part["n"].to_numpy()
        log_p[k] = np.log(n / n.sum())
    return Model(langs, log_p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; columns of those names are replaced."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.langs, model.log_p))
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            langs, scores = m.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in own])
    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
