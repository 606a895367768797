"""The question as the service over a database asks it: the k chunks nearest to the translated question, ranked again by their stemmed words.

The nearest are found first, so only their bodies are cut into words; every different word of these is stemmed once, and the stems go back to their places. How close a chunk's words
stand is then one number for each question and chunk: two lexemes of the question at a distance of d words count ``WEIGHT`` times the root of 1 / (1.005 + 0.05 exp(d / 1.5 - 2)), and
nothing beyond ``FAR`` words; all pairs of places are combined as chances are. A question of one lexeme counts its places by 1, 1/4, 1/9, … Words are runs of letters and digits: addresses and
hyphenated words have no lexeme of their own beside those of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions import text as T
from kelpline.functions.stems import STOP_WORDS, stem
from kelpline.operators import retrieval

#: Weight of a word of a body, limit of the sum of 1/n², distance beyond which words don't meet, and the rank where no two lexemes do.
WEIGHT, ONE_LEXEME, FAR, NOTHING = 0.1, 1.64493406685, 100, 1e-20
#: Places kept of one lexeme of a text, and the last place that is told apart.
MAX_PLACES, LAST_PLACE = 255, 16383
#: What a prompt says before its excerpts and at its end.
EXCERPTS = "[조문 발췌]"
ANSWER_FORM = 'JSON 형식으로만 답하라: {"answer":"2~5문장","used":[사용한 근거 번호],"caveat":"한 줄"}'
_NO_WORD = r"[^\p{L}\p{N}]+"


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, word) of all words, stop words keep their places; places from 1, the last one is ``LAST_PLACE`` for all beyond."""
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _NO_WORD), lambda w: w != "")
    return texts.select(key, F.posexplode(parts).alias("at", "word")).select(key, F.least(F.col("at") + 1, F.lit(LAST_PLACE)).alias("place"), "word")


def with_lexemes(held: DataFrame) -> DataFrame:
    """Rows with a column ``word`` with its ``lexeme``; rows of stop words go. Every different word is stemmed once. Words with other than ASCII letters, or digits, are their own lexemes where no suffix fits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "lexeme": [w if any(c.isdigit() for c in w) else stem(w) for w in pdf["word"]]})

    kept = held.filter(~F.col("word").isin(*sorted(STOP_WORDS)))
    return kept.join(kept.select("word").distinct().mapInPandas(run, "word string, lexeme string"), "word").drop("word")


def closeness(places: list[np.ndarray], n_lexemes: int) -> float:
    """The rank of a text with the places of those lexemes of a question that it has, of ``n_lexemes`` that the question has."""
    if n_lexemes == 0:
        return 0.0
    if n_lexemes == 1:
        return sum(WEIGHT / (j + 1) ** 2 for p in places for j in range(len(p))) / ONE_LEXEME
    left, met = 1.0, False
    for i, a in enumerate(places):
        for b in places[:i]:
            d = np.abs(a[:, None] - b[None, :]).ravel()
            d = d[d > 0]
            met = met or len(d) > 0
            near = d[d <= FAR]
            left *= np.prod(1 - WEIGHT * np.sqrt(1 / (1.005 + 0.05 * np.exp(near / 1.5 - 2))))
    return float(1 - left) if met else NOTHING


def text_rank(bodies: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, doc_id, kw) of every pair (query_id, doc_id). bodies: (doc_id, body), asked: (query_id, query_en)."""
    terms = with_lexemes(words(asked, "query_id", "query_en")).select("query_id", "lexeme").distinct()
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lexemes"))
    meant = bodies.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    held = with_lexemes(words(meant, "doc_id", "body"))
    placed = held.groupBy("doc_id", "lexeme").agg(F.slice(F.array_sort(F.collect_set("place")), 1, MAX_PLACES).alias("places"))
    met = pairs.select("query_id", "doc_id").join(terms, "query_id").join(placed, ["doc_id", "lexeme"]).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("lexeme", "places"))).alias("found"))
    rows = pairs.select("query_id", "doc_id").join(sizes, "query_id", "left").join(met, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("n_lexemes", F.lit(0)).alias("n_lexemes"), F.col("found.places").alias("places"))

    @F.pandas_udf("double")
    def rank(places: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([closeness([np.asarray(x, np.int64) for x in ([] if p is None else p)], int(m)) for p, m in zip(places, n, strict=True)], dtype=float)

    return rows.select("query_id", "doc_id", rank("places", "n_lexemes").alias("kw"))


def ask_ranked(questions: DataFrame, chunks: DataFrame, k: int = 4, max_article: int = 0) -> DataFrame:
    """Citations (query_id, id, doc_id, doc, cite, score, vec_score, kw_score, excerpt), k of each question at most.

    questions: (query_id, question, query_en, vec), vec being that of the translation alone; chunks: (doc_id, doc, cite, body, article_no, vec). max_article: last article
    that is looked at, 0 for all. Signals are scaled between the k; one that is flat is 1. Equal scores stay in the order of the vectors, whose ties go to the smaller id. ``id`` is the rank as text.
    A question that is blank, or k below 1, is an error; a translation that is missing or blank is the question itself.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    said = F.trim(F.coalesce("query_en", F.lit("")))
    asked = questions.select("query_id", "vec", F.when(blank, F.raise_error(F.lit("the question is blank"))).when(said != "", said).otherwise(F.col("question")).alias("query_en"))
    own = chunks if not max_article else chunks.filter(F.col("article_no") <= max_article)
    scores = retrieval.vector_scores(own.select(F.col("doc_id").alias("vec_id"), F.col("vec").alias("embedding")), asked.select("query_id", F.col("vec").alias("q")), k)
    nearest = retrieval.top_k(scores.select("query_id", F.col("vec_id").alias("doc_id"), F.round("cosine", 9).alias("vec")).withColumn("_v", F.round("vec", 6)), k, "_v").withColumnRenamed("rank", "place").drop("_v")
    few = retrieval.broadcast_if(nearest, 40 * k * asked.count())
    bodies = own.drop("vec").join(few, "doc_id")
    kw = text_rank(own.select("doc_id", "body"), asked.select("query_id", "query_en"), nearest)
    both = bodies.join(kw, ["query_id", "doc_id"])
    norms = [F.round(retrieval.min_max(F.col(c), ["query_id"], 1.0), 6) for c in ("vec", "kw")]
    scored = both.withColumn("score", F.round(retrieval.fuse(*norms), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "place"))
    return scored.select("query_id", rank.cast("string").alias("id"), "doc_id", "doc", "cite", "score", F.col("vec").alias("vec_score"), F.col("kw").alias("kw_score"), T.citation_excerpt(F.col("body")).alias("excerpt"))


def prompts(questions: DataFrame, citations: DataFrame) -> DataFrame:
    """(query_id, prompt) of questions with citations: the question, the excerpts in order, what an answer has to look like."""
    number = F.col("id").cast("int").alias("number")
    piece = F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("cite"), F.lit("\n"), F.col("excerpt"), F.lit("\n\n")).alias("piece")
    blocks = citations.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(number, piece))).alias("held"))
    text = F.concat(F.col("question"), F.lit(f"\n\n{EXCERPTS}\n"), F.array_join(F.col("held.piece"), ""), F.lit(ANSWER_FORM))
    return questions.join(blocks, "query_id").select("query_id", text.alias("prompt"))


def answers(questions: DataFrame, citations: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, answer, used, caveat): without citations nothing is confirmed and no reply is looked at; else the reply's (query_id, reply) own fields, numbers out of range dropped, in the order given.

    A reply that is no JSON is an error, as it is to the service.
    """
    hits = citations.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_hits"))
    both = questions.select("query_id").join(hits, "query_id", "left").join(replies, "query_id", "left")
    shape = "answer string, used array<int>, caveat string"
    parsed = F.when(F.try_parse_json("reply").isNull(), F.raise_error(F.lit("the reply is no JSON"))).otherwise(F.col("reply"))
    read = both.withColumn("said", F.when(F.col("n_hits").isNotNull(), F.from_json(parsed, shape)))
    caveat = F.when(F.trim(F.coalesce("said.caveat", F.lit(""))) == "", F.lit(T.CAVEAT)).otherwise(F.col("said.caveat"))
    return read.select("query_id", F.coalesce("said.answer", F.lit(T.NOT_FOUND)).alias("answer"), F.coalesce(T.used_numbers(F.col("said.used"), F.col("n_hits")), F.array().cast("array<int>")).alias("used"), caveat.alias("caveat"))
