"""Hybrid retrieval: keyword statistics, BM25, exact vector search, min-max fusion and deterministic top-k."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions import text as T
from kelpline.functions.batches import pieces
from kelpline.functions.text import STOP_WORDS, TOKEN_MAX, TOKEN_MIN, TOKEN_SPLIT, is_token

#: BM25 and fusion weights, and the range below which a signal is flat.
K1, B = 1.5, 0.75
VECTOR_WEIGHT, KEYWORD_WEIGHT = 0.6, 0.4
FLAT_RANGE = 1e-12
#: Query and row vectors of one block: a matrix product at a time.
QUERY_BLOCK, ROW_BLOCK = 256, 1024
#: Bytes that are broadcast at most; what is larger is joined by a shuffle, or dealt to the rows block by block.
MAX_BROADCAST = 128 << 20


def broadcast_if(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= MAX_BROADCAST else df


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, term) of every token; split first and filtered as rows, which is generated code."""
    return docs.select("doc_id", F.explode(T.pieces(F.col("text"))).alias("term")).filter(is_token(F.col("term")))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of (doc_id, text) rows."""
    return tokens(docs).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


#: Terms that a task counts before it hands them on.
MOST_TERMS = 1 << 17


def _term_counts(batches: Iterator[pa.RecordBatch], most: int = MOST_TERMS) -> Iterator[pa.RecordBatch]:
    """(term, df, cf) of the texts of a task, each a document of its own; a term comes again where more than ``most`` were held."""
    split, stops = re.compile(TOKEN_SPLIT).split, frozenset(STOP_WORDS)
    df, cf = Counter(), Counter()

    def out() -> pa.RecordBatch:
        terms = [t for t in df if TOKEN_MIN <= len(t) <= TOKEN_MAX and t not in stops]
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in (df, cf))], names=["term", "df", "cf"])

    for batch in pieces(batches):
        for text in batch.column("text"):
            held = Counter(split((text.as_py() or "").lower()))
            df.update(held.keys())
            cf.update(held)
            if len(df) > most:
                yield out()
                df.clear()
                cf.clear()
    yield out()


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term, and times it occurs.

    Rows with one id are one document, rows without an id one more: only these are shuffled by document. All others are counted where they lie, so what is shuffled are a task's terms.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    nameless = docs.filter("doc_id is null")
    whole, lone = nameless, docs.filter("doc_id is not null")
    if not repeated.isEmpty():
        whole, lone = whole.unionByName(lone.join(repeated, "doc_id", "left_semi")), lone.join(repeated, "doc_id", "left_anti")
    counted = lone.select("text").mapInArrow(lambda batches: _term_counts(batches), "term string, df long, cf long")
    return counted.unionByName(postings(whole).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, dl); documents without tokens count, with length 0."""
    pieces_of = docs.select("doc_id", F.explode(T.pieces(F.col("text"))).alias("term"))  # a split has one piece at least
    return pieces_of.groupBy("doc_id").agg(F.count(F.when(is_token(F.col("term")), 1)).alias("dl"))


def bm25(docs: DataFrame, query_terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, kw) of documents with a term of (query_id, term, weight); of ``only`` (query_id, doc_id), if it is given.

    One pass over the texts: a document's tokens that nobody asks for are counted as one, those asked for by term. Lengths and the corpus' totals
    are sums over these few rows.
    """
    asked = query_terms.filter("weight <> 0").select("query_id", "term", "weight")
    n_terms, n_bytes = asked.agg(F.count(F.lit(1)), F.sum(F.length("term") + 40)).first()
    small = 2 * (n_bytes or 0)
    known = broadcast_if(asked.select("term", F.lit(True).alias("known")).distinct(), small)
    pieces_of = docs.select("doc_id", F.explode(T.pieces(F.col("text"))).alias("term"))
    token = is_token(F.col("term"))
    counted = pieces_of.join(known, "term", "left").groupBy("doc_id", F.when(F.col("known") & token, F.col("term")).alias("term")).agg(F.count(F.when(token, 1)).alias("tf"))
    each = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("hits")
    by_doc = counted.groupBy("doc_id").agg(F.sum("tf").alias("dl"), each)
    corpus = by_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("total"))
    hits = by_doc.select("doc_id", "dl", F.explode("hits").alias("h")).select("doc_id", "dl", "h.term", "h.tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    meant = broadcast_if(asked.join(df, "term"), small)
    # One row of totals for all.
    scored = hits.join(meant, "term").crossJoin(F.broadcast(corpus))
    if only is not None:
        scored = scored.join(only.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    average = F.col("total") / F.greatest(F.col("n_docs"), F.lit(1))
    term = F.col("weight") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    return scored.withColumn("part", term).groupBy("query_id", "doc_id").agg(F.sum("part").alias("kw"))


def top_k(scores: DataFrame, k: int, score: str, key: str = "doc_id") -> DataFrame:
    """The k best rows of each query, ties by key, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def checked_k(k: Column, default: int = 4) -> Column:
    """Missing means the default; below 1 is an error; nothing caps it."""
    return F.when(k.isNull(), F.lit(default)).when(k < 1, F.raise_error(F.lit("k must be 1 or more")).cast("int")).otherwise(k.cast("int"))


def clamp_k(k: Column, low: int = 1, high: int = 10, default: int = 4) -> Column:
    """Missing, 0 and values that aren't numbers mean the default; others are clamped."""
    number = k.try_cast("int") if hasattr(k, "try_cast") else k.cast("int")
    return F.when(number.isNull() | (number == 0), F.lit(default)).otherwise(F.least(F.greatest(number, F.lit(low)), F.lit(high)))


def _packs(id_col: str, vec_col: str, size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            for dims, alike in pdf.groupby(pdf[vec_col].map(len)):  # a block holds vectors of one length
                for a in range(0, len(alike), size):
                    part = alike.iloc[a : a + size]
                    m = np.stack([np.asarray(x, np.float64) for x in part[vec_col]])
                    yield pd.DataFrame({"ids": [part[id_col].to_numpy(np.int64).tobytes()], "dims": [dims], "data": [m.tobytes()]})

    return pack


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows of q by rows of v; 0 where one has no length."""
    scale = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(v, axis=1))
    return np.divide(q @ v.T, scale, out=np.zeros_like(scale), where=scale > 0)


def vector_scores(vectors: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, vec_id, cosine) of every vector against every query, or of the k best of each block and query.

    Both sides (vec_id, embedding) and (query_id, q) are packed into blocks; each pair of blocks is one matrix product. The query blocks are
    broadcast if they have been counted to be few.
    """
    schema = "ids binary, dims int, data binary"
    rows = vectors.filter("embedding is not null").select("vec_id", "embedding").mapInPandas(_packs("vec_id", "embedding", ROW_BLOCK), schema)
    asked = queries.filter("q is not null").select("query_id", "q").mapInPandas(_packs("query_id", "q", QUERY_BLOCK), schema).toDF("q_ids", "q_dims", "q_data")
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in filter(len, batches):
            for ids, dims, data, q_ids, q_dims, q_data in pdf.itertuples(index=False, name=None):
                if dims != q_dims:
                    continue
                s = cosines(np.frombuffer(q_data).reshape(-1, dims), np.frombuffer(data).reshape(-1, dims))
                i, j = np.nonzero(np.ones_like(s, bool))
                if k is not None and s.shape[1] > k:
                    # Ties of the rounded score are decided later by id, so the cut keeps all of them.
                    near = np.round(s, 6)
                    i, j = np.nonzero(near >= np.partition(near, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]])
                yield pd.DataFrame({"query_id": np.frombuffer(q_ids, np.int64)[i], "vec_id": np.frombuffer(ids, np.int64)[j], "cosine": s[i, j]})

    return rows.crossJoin(broadcast_if(asked, 8 * n * (dims or 0))).mapInPandas(run, "query_id long, vec_id long, cosine double")


def scaled(score: Column, low: Column, high: Column, flat: float) -> Column:
    """(x - min) / (max - min) within a query. A flat signal is ``flat``: 0 in the full variant, 1 in the prefilter one.

    At a range of exactly 1e-12 the full variant is flat and the other isn't.
    """
    is_flat = (high - low <= FLAT_RANGE) if flat == 0.0 else (high - low < FLAT_RANGE)
    return F.when(is_flat, F.lit(flat)).otherwise((score - low) / (high - low))


def min_max(score: Column, by: list[str], flat: float) -> Column:
    """``scaled`` between the extremes of each group of few rows, such as the k best of a query."""
    window = Window.partitionBy(*by)
    return scaled(score, F.min(score).over(window), F.max(score).over(window), flat)


def fuse(vec: Column | np.ndarray, kw: Column | np.ndarray) -> Column | np.ndarray:
    return vec * VECTOR_WEIGHT + kw * KEYWORD_WEIGHT


def _first_unhit(docs: DataFrame, hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id) of the k smallest ids without a hit of each query, of every task at least: a list of the queries that hit it goes to each document."""
    by_doc = hits.groupBy("doc_id").agg(F.collect_set("query_id").alias("hit_by"))
    marked = docs.select("doc_id").join(by_doc, "doc_id", "left").sortWithinPartitions("doc_id")
    # The ids of what is asked, sent to each task once.
    every = docs.sparkSession.sparkContext.broadcast([r[0] for r in queries.select("query_id").distinct().collect()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = dict.fromkeys(every.value, k)
        for pdf in filter(len, batches):
            out = []
            for doc_id, hit_by in zip(pdf["doc_id"], pdf["hit_by"], strict=True):
                hit = set() if hit_by is None else set(hit_by)
                for q in [q for q in left if q not in hit]:
                    out.append((q, doc_id))
                    left[q] -= 1
                    if not left[q]:
                        del left[q]
                if not left:
                    break
            if out:
                yield pd.DataFrame(out, columns=["query_id", "doc_id"])
            if not left:
                break

    return marked.mapInPandas(run, "query_id long, doc_id long")


def hybrid(vec: DataFrame, kw: DataFrame, docs: DataFrame, queries: DataFrame, k: int, variant: str = "full") -> DataFrame:
    """(query_id, doc_id, vec, kw, vec_score, kw_score, score, rank): the signals, their normal forms and the fused score.

    full: all documents are fused, a missing score is 0, a flat signal 0. Only documents with a score are rows; of those without one, which score 0 in both,
    the k first ids are enough. prefilter: only the k best by vector are fused, flat is 1. Extremes of a query are a partial aggregation, so no
    window holds all its documents; top-k is cut per task first.
    """
    flat = 0.0 if variant == "full" else 1.0
    if variant == "full":
        zero = F.lit(0.0)
        hits = vec.select("query_id", "doc_id", "vec", zero.alias("kw")).unionByName(kw.select("query_id", "doc_id", zero.alias("vec"), "kw")).groupBy("query_id", "doc_id").agg(F.sum("vec").alias("vec"), F.sum("kw").alias("kw"))
        without = _first_unhit(docs, hits, queries, k).select("query_id", "doc_id", zero.alias("vec"), zero.alias("kw"))
        both = hits.unionByName(without)
    else:
        best = top_k(vec.withColumn("_v", F.round("vec", 6)), k, "_v").drop("rank", "_v")
        both = best.join(kw, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("vec", F.lit(0.0)).alias("vec"), F.coalesce("kw", F.lit(0.0)).alias("kw"))
    if variant == "full":
        ends = both.groupBy("query_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("vec", "kw") for f, n in ((F.min, "lo"), (F.max, "hi"))])
        both = both.join(broadcast_if(ends, 48 * queries.count()), "query_id")
        norms = [scaled(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), flat) for c in ("vec", "kw")]
    else:
        norms = [min_max(F.col(c), ["query_id"], flat) for c in ("vec", "kw")]
    return best_fused(both, norms, k)


def best_fused(signals: DataFrame, norms: list[Column], k: int) -> DataFrame:
    """The k best of each query by the fused score of the normal forms of vec and kw, with both and the rank."""
    scores = signals.select("query_id", "doc_id", "vec", "kw", *[F.round(n, 6).alias(f"{c}_score") for n, c in zip(norms, ("vec", "kw"), strict=True)])
    return top_k(scores.withColumn("score", F.round(fuse(F.col("vec_score"), F.col("kw_score")), 6)), k, "score")
