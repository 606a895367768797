"""Fusion of all documents for all questions, a block of the stored index at a time, so no row is made for a pair of question and document.

The postings of the terms asked and the vectors of a block's documents meet in one task, which scores the block as two arrays of questions by documents. The extremes of each
question come first, a row for each block; once they are known the blocks are scored again, and the documents that can be among the k best leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.operators import inverted
from kelpline.operators.retrieval import FLAT_RANGE, best_fused, broadcast_if, cosines, fuse, scaled

#: Decimals of the raw signals; what fused scores may differ by and still change places when signals, normal forms and scores are rounded.
DIGITS, NEAR, NEAR_RAW = 9, 4e-6, 2e-9
#: What a row of a block is: all its documents, a question with its vector, a document's vector, the postings of a term.
MEMBERS, QUESTION, VECTOR, TERM = range(4)
ENDS = ["lo_vec", "hi_vec", "lo_kw", "hi_kw"]


def _values(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after another, and where each list ends, with a 0 before."""
    lists = rows.column(name)
    lengths = pa.compute.list_value_length(lists).to_numpy()
    return pa.compute.list_flatten(lists).to_numpy(), np.r_[0, np.cumsum(lengths)].astype(int)


def _of_length(rows: pa.Table, ids: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the rows whose vector has this length, and the vectors."""
    alike = rows.filter(pa.compute.equal(pa.compute.list_value_length(rows.column("vec")), length))
    return _values(alike, ids)[0], _values(alike, "vec")[0].astype(np.float64).reshape(-1, length)


def _signals(rows: pa.Table, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(questions, documents, vec, kw) of a block and a group of questions, the signals as arrays of questions by documents."""
    members, questions, vectors, terms = (rows.filter(pa.compute.equal(rows.column("kind"), kind)) for kind in (MEMBERS, QUESTION, VECTOR, TERM))
    docs, queries = _values(members, "docs")[0], np.unique(_values(questions, "queries")[0])
    vec, kw = np.zeros((len(queries), len(docs))), np.zeros((len(queries), len(docs)))
    for length in filter(None, pa.compute.unique(pa.compute.list_value_length(questions.column("vec"))).to_pylist()):
        (of_q, q), (of_v, v) = _of_length(questions, "queries", length), _of_length(vectors, "docs", length)
        np.add.at(vec, np.ix_(np.searchsorted(queries, of_q), np.searchsorted(docs, of_v)), cosines(q, v))
    if terms.num_rows:
        terms = terms.sort_by("term")
        (held, ends), (of_q, q_ends) = _values(terms, "docs"), _values(terms, "queries")
        at, q_at, weights = np.searchsorted(docs, held), np.searchsorted(queries, of_q)[:, None], _values(terms, "weights")[0]
        parts = inverted.saturation(_values(terms, "tfs")[0].astype(float), _values(terms, "dls")[0], average)
        for a, b, qa, qb in zip(ends, ends[1:], q_ends, q_ends[1:]):
            kw[q_at[qa:qb], at[a:b]] += np.outer(weights[qa:qb], parts[a:b])
    return queries, docs, vec, kw


def _contenders(vec: np.ndarray, kw: np.ndarray, ends: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (question, document) of all that can be among a question's k best. Of documents with equal signals the k first are enough, as ties go to the smaller id."""

    def normal(x: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        low, width = ends[f"lo_{name}"][:, None], (ends[f"hi_{name}"] - ends[f"lo_{name}"])[:, None]
        per = np.where(width <= FLAT_RANGE, 0.0, 1 / np.where(width <= FLAT_RANGE, 1.0, width))
        return (x - low) * per, per

    (a, per_vec), (b, per_kw) = normal(vec, "vec"), normal(kw, "kw")
    score = fuse(a, b)
    # What isn't a number stays.
    low = score < np.partition(score, -k, axis=1)[:, [-k]] - (NEAR + NEAR_RAW * fuse(per_vec, per_kw)) if score.shape[1] > k else np.zeros(score.shape, bool)
    i, j = np.nonzero(~low)
    order = np.lexsort((j, kw[i, j], vec[i, j], i))
    i, j = i[order], j[order]
    v, w = vec[i, j], kw[i, j]
    begins = np.ones(len(i), bool)
    begins[1:] = (i[1:] != i[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
    place = np.arange(len(i))
    first = place - np.maximum.accumulate(np.where(begins, place, 0)) < k
    return i[first], j[first]


def hybrid_full(index: inverted.Index, vectors: DataFrame, queries: DataFrame, query_terms: DataFrame, k: int) -> DataFrame:
    """``retrieval.hybrid`` in its full variant for (query_id, q), a row without a vector being a question of its words alone, and distinct (query_id, term, weight).

    vectors: (vec_id, embedding); those without a document aren't looked at, as documents are what is found.
    """
    n_queries, n_bytes = queries.agg(F.count(F.lit(1)), F.sum(F.coalesce(F.size("q"), F.lit(0)) * 4 + 24)).first()
    n_groups = inverted.groups_of(n_queries)
    groups = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("query_group")
    blocks = index.blocks
    lying = blocks.select("block", F.explode("docs").alias("doc_id"))
    members = blocks.select(F.lit(MEMBERS).alias("kind"), "block", "docs", groups)
    asked = blocks.select("block").crossJoin(broadcast_if(queries.select("query_id", F.col("q").alias("vec")), 2 * (n_bytes or 0)))
    held = vectors.filter("embedding is not null").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")).join(lying, "doc_id")
    kinds = [
        asked.select(F.lit(QUESTION).alias("kind"), "block", inverted.query_group(n_groups), F.array("query_id").alias("queries"), "vec"),
        held.select(F.lit(VECTOR).alias("kind"), "block", F.array("doc_id").alias("docs"), "vec", groups),
        inverted.asked_postings(index, query_terms, n_groups).withColumn("kind", F.lit(TERM)),
    ]
    rows = members
    for kind in kinds:
        rows = rows.unionByName(kind, allowMissingColumns=True)
    by_block = rows.groupBy("block", "query_group")
    average = index.average
    types = dict(queries.dtypes)["query_id"], dict(index.documents.dtypes)["doc_id"]

    def extremes(rows: pa.Table) -> pa.Table:
        found, _, vec, kw = _signals(rows, average)
        return pa.table({"query_id": found, "lo_vec": vec.min(1), "hi_vec": vec.max(1), "lo_kw": kw.min(1), "hi_kw": kw.max(1)})

    def best(rows: pa.Table, ends: pa.Table) -> pa.Table:
        found, docs, vec, kw = _signals(rows, average)
        ends = ends.sort_by("query_id")
        i, j = _contenders(vec, kw, {c: ends.column(c).to_numpy() for c in ENDS}, k)
        return pa.table({"query_id": found[i], "doc_id": docs[j], "vec": vec[i, j], "kw": kw[i, j], **{c: ends.column(c).to_numpy()[i] for c in ENDS}})

    of_blocks = by_block.applyInArrow(extremes, f"query_id {types[0]}, " + ", ".join(f"{c} double" for c in ENDS))
    ends = of_blocks.groupBy("query_id").agg(*[F.round((F.min if c.startswith("lo") else F.max)(c), DIGITS).alias(c) for c in ENDS])
    dealt = blocks.select("block").crossJoin(broadcast_if(ends, 48 * n_queries)).select(F.col("block").alias("of_block"), inverted.query_group(n_groups), "query_id", *ENDS)
    found = by_block.cogroup(dealt.groupBy("of_block", "query_group")).applyInArrow(best, f"query_id {types[0]}, doc_id {types[1]}, vec double, kw double, " + ", ".join(f"{c} double" for c in ENDS))
    signals = found.withColumns({c: F.round(c, DIGITS) for c in ("vec", "kw")})
    return best_fused(signals, [scaled(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), 0.0) for c in ("vec", "kw")], k)
