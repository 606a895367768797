"""The composed question: blended vectors, weighted terms, fusion, evidence and the answer that is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.functions import text as T
from kelpline.functions import vectors as V
from kelpline.functions.glossary import weighted_terms
from kelpline.operators import inverted, retrieval

#: Decimals of the scores that are shown, and what is said to a blank question.
SHOWN_DIGITS, BLANK = 4, "질문이 비어 있습니다."


def article_texts(articles: DataFrame) -> DataFrame:
    """(doc_id, text) as articles are indexed: the title counts twice."""
    return articles.select("doc_id", T.field_text(F.col("heading"), F.col("title"), F.col("text")).alias("text"))


def ask(questions: DataFrame, articles: DataFrame, index: inverted.Index, k: int = 4, variant: str = "full", vectors: DataFrame | None = None) -> DataFrame:
    """Hits (query_id, rank, doc_id, cite, excerpt, score, vec_score, kw_score, evidence), k of each question.

    questions: (query_id, question, query_en, vec, vec_en), query_en and vec_en null where nothing was translated; articles: (doc_id, heading, title, cite, text,
    vec), or without vec where ``vectors`` (doc_id, vec) has those of articles, so that no text is shuffled to meet them; index: that of ``article_texts``. The signals shown are raw, the score is that of the fused normal ones; equal scores go to the
    smaller id in both variants (``ranked.ask_ranked`` keeps those of its nearest in the order of the vectors). Blank questions have no hits.
    """
    asked = questions.filter(F.trim("question") != "")
    english = F.coalesce("query_en", "question")
    terms = asked.select("query_id", F.explode(weighted_terms(F.col("question"), english)).alias("t")).select("query_id", "t.term", "t.weight")
    double = lambda c: F.col(c).cast("array<double>")
    blended = asked.select("query_id", V.blend(double("vec"), double("vec_en")).alias("q"))
    rows = (articles if vectors is None else vectors).select(F.col("doc_id").alias("vec_id"), F.col("vec").alias("embedding"))
    vec = retrieval.vector_scores(rows, blended, k if variant == "prefilter" else None).select("query_id", F.col("vec_id").alias("doc_id"), F.round("cosine", 9).alias("vec"))
    only = None
    if variant == "prefilter":
        vec = retrieval.top_k(vec.withColumn("_v", F.round("vec", 6)), k, "_v").drop("rank", "_v")
        only = vec
    kw = inverted.bm25(index, terms, only).withColumn("kw", F.round("kw", 9))
    fused = retrieval.hybrid(vec, kw, index.documents.select("doc_id"), asked.select("query_id"), k, variant).select("query_id", "doc_id", "score", "rank", "vec", "kw")
    # k rows for each question.
    hits = retrieval.broadcast_if(fused, 64 * k * questions.count())
    raw = articles.drop("vec").join(hits, "doc_id")
    shown = [F.round(F.coalesce(c, F.lit(0.0)), SHOWN_DIGITS).alias(name) for name, c in (("score", F.col("score")), ("vec_score", F.col("vec")), ("kw_score", F.col("kw")))]
    return raw.select("query_id", "rank", "doc_id", "cite", T.excerpt(F.col("text")).alias("excerpt"), *shown, T.evidence(F.col("rank"), F.col("cite"), F.col("heading"), F.col("title"), F.col("text")).alias("evidence"))


def evidence_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, n_hits, evidence): the pieces of each question in the order of their ranks; k a question."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))), lambda x: x["evidence"])
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(pieces, T.EVIDENCE_SEPARATOR).alias("evidence"))


def answers(questions: DataFrame, blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, answer, used, caveat) of each question: a blank one is told so, one without hits is refused without a model's reply (query_id, reply), a refusal uses nothing."""
    both = questions.select("query_id", "question").join(blocks.select("query_id", "n_hits"), "query_id", "left").join(replies, "query_id", "left")
    none = F.array().cast("array<int>")
    reply = T.refused(F.trim("reply"), T.cited_numbers(F.col("reply"), F.col("n_hits").cast("int")))
    fixed = lambda text: F.struct(F.lit(text).alias("answer"), none.alias("used"))
    said = F.when(F.trim("question") == "", fixed(BLANK)).when(F.col("n_hits").isNull() | F.col("reply").isNull(), fixed(T.NOT_FOUND)).otherwise(reply)
    return both.select("query_id", said.alias("_a")).select("query_id", "_a.answer", "_a.used", F.lit(T.CAVEAT).alias("caveat"))
