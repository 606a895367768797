"""Registered queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions import text as T
from kelpline.functions import vectors as V
from kelpline.functions.batches import pieces
from kelpline.functions.glossary import GLOSSARY, glossary_table, glossary_terms, weighted_term_rows, weighted_terms  # noqa: F401  (also imported from here)
from kelpline.operators import alerts, chunks, feeds, fusion, inverted, market, retrieval, routes
from kelpline.sources import files, seeds
from kelpline.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '{T.TOKEN_SPLIT}'), lambda t: length(t) BETWEEN 2 AND 32 AND NOT list_contains({STOP_SQL}, t))"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Keyword statistics and search


def stored_index(spark: SparkSession, sf_dir: str, name: str, docs: Callable[[], DataFrame]) -> inverted.Index:
    """The stored index of texts made from the documents of ``sf_dir``, built by the first query of a state of that table; ``name`` tells what the texts are."""
    state = inverted.state_of(spark, [f"{sf_dir}/documents.parquet"])
    return inverted.stored(spark, f"{shared_folder(spark)}/kelpline", f"{name}-{state}", docs)


def document_index(spark: SparkSession, sf_dir: str) -> inverted.Index:
    return stored_index(spark, sf_dir, "documents", lambda: table(spark, sf_dir, "documents").select("doc_id", "text"))


POSTINGS_SQL = f"""
tokens AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
postings AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY ALL),
lens AS (SELECT d.doc_id, count(t.term) AS dl FROM documents d LEFT JOIN tokens t USING (doc_id) GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, sum(dl) AS total FROM lens)
"""
BM25_SQL = """
bm25 AS (
  SELECT query_id, doc_id, sum(weight * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / (CAST(total AS DOUBLE) / greatest(n_docs, 1))))) AS kw
  FROM asked JOIN postings USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id), corpus GROUP BY ALL
)
"""


@query(f"WITH {POSTINGS_SQL} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM postings GROUP BY term")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_stats(table(spark, sf_dir, "documents"))


def query_terms_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("query_id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"), F.lit(1.0).alias("weight"))


@query(
    f"""WITH {POSTINGS_SQL}, asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term, 1.0::DOUBLE AS weight FROM benchmark), {BM25_SQL},
rounded AS (SELECT query_id, doc_id, round(kw, 6) AS score FROM bm25)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rounded QUALIFY rank <= 10"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asked of all documents."""
    scored = inverted.bm25_best(document_index(spark, sf_dir), query_terms_of(table(spark, sf_dir, "benchmark"), "item_id"), 10)
    return retrieval.top_k(scored.select("query_id", "doc_id", F.round("kw", 6).alias("score")), 10, "score")


COSINE_SQL = "list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


@query(
    f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({COSINE_SQL}, 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = retrieval.vector_scores(vectors, asked, 10).select("query_id", "vec_id", F.round("cosine", 6).alias("score"))
    return retrieval.top_k(scored, 10, "score", "vec_id")


# Hybrid search: benchmark items, with the vector of their number; all of them over all documents, every hundredth over the ten best by vector


def hybrid_sql(items: str) -> str:
    return f"""{POSTINGS_SQL},
asked AS (SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term, 1.0::DOUBLE AS weight FROM {items}), {BM25_SQL},
qs AS (SELECT DISTINCT item_id AS query_id FROM {items}),
vecs AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round({COSINE_SQL}, 9) AS vec FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT query_id FROM qs) AND v.vec_id IN (SELECT doc_id FROM documents))
"""


FUSED_SQL = """
ends AS (SELECT query_id, min(vec) AS lv, max(vec) AS hv, min(kw) AS lk, max(kw) AS hk FROM cand GROUP BY 1),
norm AS (SELECT query_id, doc_id, round(CASE WHEN hv - lv {op} 1e-12 THEN {flat} ELSE (vec - lv) / (hv - lv) END, 6) AS vec_score,
  round(CASE WHEN hk - lk {op} 1e-12 THEN {flat} ELSE (kw - lk) / (hk - lk) END, 6) AS kw_score FROM cand JOIN ends USING (query_id)),
fused AS (SELECT *, round(vec_score * 0.6 + kw_score * 0.4, 6) AS score FROM norm)
SELECT query_id, doc_id, vec_score, kw_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused QUALIFY rank <= 10
"""


@query(
    f"WITH {hybrid_sql('benchmark')}, cand AS (SELECT q.query_id, d.doc_id, coalesce(v.vec, 0.0) AS vec, coalesce(round(b.kw, 9), 0.0) AS kw FROM qs q CROSS JOIN documents d LEFT JOIN vecs v ON v.query_id = q.query_id AND v.doc_id = d.doc_id LEFT JOIN bm25 b ON b.query_id = q.query_id AND b.doc_id = d.doc_id), "
    + FUSED_SQL.format(op="<=", flat="0.0")
)
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asked of all documents, all fused; a document without a vector scores 0 there."""
    items, vectors = table(spark, sf_dir, "benchmark").filter("item_id is not null"), table(spark, sf_dir, "embeddings")
    ids = items.select(F.col("item_id").alias("query_id")).distinct()
    own = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).join(F.broadcast(ids), "query_id")
    best = fusion.hybrid_full(document_index(spark, sf_dir), vectors, ids.join(own, "query_id", "left"), query_terms_of(items, "item_id").distinct(), 10)
    return best.select("query_id", "doc_id", "vec_score", "kw_score", "score", "rank")


@query(
    f"WITH {hybrid_sql('benchmark WHERE item_id % 100 = 0')}, best AS (SELECT * FROM vecs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(vec, 6) DESC, doc_id) <= 10), cand AS (SELECT v.query_id, v.doc_id, v.vec, coalesce(round(b.kw, 9), 0.0) AS kw FROM best v LEFT JOIN bm25 b USING (query_id, doc_id)), "
    + FUSED_SQL.format(op="<", flat="1.0")
)
def hybrid_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by vector, then fused."""
    index, vectors = document_index(spark, sf_dir), table(spark, sf_dir, "embeddings")
    docs = index.documents.select("doc_id")
    items = table(spark, sf_dir, "benchmark").filter("item_id % 100 = 0")
    own = vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = vectors.join(F.broadcast(items.select(F.col("item_id").alias("vec_id"))), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    k = 10
    vec = retrieval.vector_scores(own, asked, k).select("query_id", F.col("vec_id").alias("doc_id"), F.round("cosine", 9).alias("vec"))
    vec = retrieval.top_k(vec.withColumn("_v", F.round("vec", 6)), k, "_v").drop("rank", "_v")
    kw = inverted.bm25(index, query_terms_of(items, "item_id"), vec).withColumn("kw", F.round("kw", 9))
    return retrieval.hybrid(vec, kw, docs, items.select(F.col("item_id").alias("query_id")), k, "prefilter").select("query_id", "doc_id", "vec_score", "kw_score", "score", "rank")


@query(
    """WITH e AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)
SELECT event_id, round(CASE WHEN hi - lo <= 1e-12 THEN 0.0 ELSE (value - lo) / (hi - lo) END, 6) AS full_score, round(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (value - lo) / (hi - lo) END, 6) AS prefilter_score
FROM events JOIN e USING (event_type)"""
)
def minmax_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both normalisations, per event type; extremes are aggregated, not windowed."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    ends = events.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scores = [F.round(retrieval.scaled(F.col("value"), F.col("lo"), F.col("hi"), flat), 6).alias(name) for flat, name in ((0.0, "full_score"), (1.0, "prefilter_score"))]
    return events.join(F.broadcast(ends), "event_type").select("event_id", *scores)


@query(
    """WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1),
m AS (SELECT *, CASE WHEN y IS NULL THEN x ELSE list_transform(list_zip(x, y), lambda z: z[1] * 0.65 + z[2] * (1 - 0.65)) END AS mix FROM p)
SELECT vec_id, round(list_inner_product(mix, x) / CASE WHEN y IS NULL THEN 1.0 ELSE sqrt(list_inner_product(mix, mix)) END, 6) AS with_original FROM m"""
)
def query_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector blended with its successor, against itself."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    mixed = vectors.join(other, "vec_id", "left").withColumn("mix", V.blend(F.col("embedding").cast("array<double>"), F.col("other").cast("array<double>")))
    return mixed.select("vec_id", F.round(V.dot(F.coalesce("mix", F.col("embedding").cast("array<double>")), F.col("embedding")), 6).alias("with_original"))


def glossary_sql(question: str) -> str:
    """Tokens of the phrases of all terms that a question contains, and its own ASCII tokens, as a list in DuckDB."""
    pairs = ", ".join(f"{{'ko': '{ko}', 'en': {T.tokens_of(en)}}}" for ko, en in GLOSSARY)
    own = f"list_filter({tokens_sql(question)}, lambda t: regexp_full_match(t, '[a-z0-9]+'))"
    return f"list_distinct(list_concat(flatten(list_transform(list_filter([{pairs}], lambda g: contains({question}, g.ko)), lambda g: g.en)), {own}))"


def korean(number: F.Column) -> F.Column:
    """The glossary's term of a number, in a short question."""
    return F.concat(F.element_at(F.array(*[F.lit(ko) for ko, _ in GLOSSARY]), (number % len(GLOSSARY) + 1).cast("int")), F.lit(" 언제까지? "))


def korean_sql(number: str) -> str:
    return f"([{', '.join(repr(ko) for ko, _ in GLOSSARY)}][CAST(({number}) % {len(GLOSSARY)} + 1 AS INTEGER)] || ' 언제까지? ')"


QUERY_TERMS_SQL = (
    f"""WITH q AS (SELECT a.conv_id, a.turn, {korean_sql('a.conv_id + a.turn')} || a.text AS question, b.text AS translated FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1),
p AS (SELECT conv_id, turn, {glossary_sql('question')} AS sure, {tokens_sql('translated')} AS more FROM q),
t AS (SELECT DISTINCT conv_id, turn, unnest(sure) AS term, 1.0::DOUBLE AS weight FROM p UNION ALL SELECT DISTINCT conv_id, turn, unnest(list_filter(more, lambda x: NOT list_contains(sure, x))) AS term, 0.1::DOUBLE AS weight FROM p)
SELECT conv_id, turn, term, weight FROM t"""
)


@query(QUERY_TERMS_SQL)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted terms of each turn, asked with a term of the glossary, with the next turn in the part of its translation."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.explode(weighted_terms(F.col("question"), F.col("translated"))).alias("t")).select("conv_id", "turn", "t.term", "t.weight")


@query(QUERY_TERMS_SQL)
def query_terms_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a join with the glossary as a table."""
    turns = _turns(spark, sf_dir).withColumn("query_id", F.struct("conv_id", "turn"))
    return weighted_term_rows(turns, glossary_table(spark)).select("query_id.conv_id", "query_id.turn", "term", "weight")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions that begin with a term of the glossary, the next turn standing in for the translation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("translated"))
    asked = turns.withColumn("question", F.concat(korean(F.col("conv_id") + F.col("turn")), F.col("text")))
    return asked.join(following, ["conv_id", "turn"], "left").select("conv_id", "turn", "question", "translated")


# Pages

_STRIP = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)</(p|div|tr|li|h[1-6]|td|th)>', chr(10), 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"""
_DECODE = r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;|&apos;', '''', 'g'), '(?i)&[a-z]+;', ' ', 'g')"""


def html_sql(column: str) -> str:
    text = _DECODE.format(_STRIP.format(f"coalesce({column}, '')"))
    return f"array_to_string(list_filter(list_transform(string_split(regexp_replace({text}, '[ \\t\\x{{00A0}}]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), chr(10))"


@query(f"SELECT page_id, {html_sql('html')} AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


#: Last article that the chunk queries accept.
MAX_ARTICLE = 8


def regulation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as regulation markup: paragraph n becomes article n, inside a div of its own."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_key"), F.split("html", "</p>").alias("parts"))
    article = F.transform("parts", lambda x, i: F.concat(F.lit('<div class="eli-subdivision" id="art_'), (i + 1).cast("string"), F.lit('"><p class="oj-ti-art">Article '), (i + 1).cast("string"), F.lit('</p><div><p class="oj-normal">'), F.regexp_replace(x, "(?i)</?div[^>]*>", ""), F.lit("</p></div></div>")))
    return pages.select("doc_key", F.array_join(article, "\n").alias("html"))


_CHUNK_SQL = f"""WITH a AS (SELECT page_id, unnest(string_split(html, '</p>')) AS part, generate_subscripts(string_split(html, '</p>'), 1) AS num FROM pages),
b AS (SELECT page_id, num, {html_sql("' ' || '<div><p>' || regexp_replace(part, '(?i)</?div[^>]*>', '', 'g') || '</p></div>'")} AS body FROM a),
c AS (SELECT *, CASE WHEN num > {MAX_ARTICLE} THEN 'above limit' WHEN length(regexp_replace(body, '\\s', '', 'g')) < 40 THEN 'empty body' END AS reason FROM b)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = regulation_pages(spark, sf_dir)
    return chunks.chunk(pages, pages.select("doc_key", F.lit(MAX_ARTICLE).alias("max_article")))


@query(_CHUNK_SQL + "SELECT page_id, num, 'Article ' || num AS heading, substring(body, 1, 6000) AS text, substring(replace(body, chr(10), ' '), 1, 320) AS excerpt FROM c WHERE reason IS NULL")
def chunk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)[0].select(F.col("doc_key").alias("page_id"), "num", "heading", "text", "excerpt")


@query(_CHUNK_SQL + "SELECT reason, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM c WHERE reason IS NOT NULL GROUP BY 1")
def dropped_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_key").alias("n_pages"))


# Market: events as ticks, a series for each event type

_CLOSES_SQL = "WITH closes AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS price_date, arg_max(value, (ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY ALL)"


def _closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.daily_closes(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "event_id").withColumn("price_date", F.col("price_date").cast("string"))


@query(_CLOSES_SQL + ", p AS (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY price_date) AS previous_close FROM closes) SELECT event_type, price_date, close, previous_close, CASE WHEN previous_close <> 0 THEN round((close - previous_close) / previous_close * 100, 6) END AS day_change_pct FROM p")
def day_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.with_day_change(_closes(spark, sf_dir), ["event_type"]).withColumn("day_change_pct", F.round("day_change_pct", 6))


@query(_CLOSES_SQL + ", n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY price_date DESC) AS k FROM closes) SELECT event_type, string_agg(printf('%.4f', close), ',' ORDER BY price_date) AS closes, max(price_date) AS last_date FROM n WHERE k <= 5 GROUP BY 1")
def recent_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = market.recent_closes(_closes(spark, sf_dir), ["event_type"])
    return recent.withColumn("closes", F.array_join(F.transform("closes", lambda x: F.format_string("%.4f", x)), ","))


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return market.latest_per_key(events, ["user_id", "event_type"], "ts", "event_id")


@query(
    """WITH d AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS price_date, event_id, ts AS fetched_at, value AS price, event_id % 2 AS half FROM events),
a AS (SELECT event_type, price_date, event_id, fetched_at, price FROM d QUALIFY row_number() OVER (PARTITION BY event_type, price_date, half ORDER BY fetched_at DESC, event_id DESC) = 1)
SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY event_type, price_date ORDER BY fetched_at DESC, event_id DESC) = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of even events, upserted with those of odd ones."""
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").cast("string").alias("price_date"), "event_id", F.col("ts").alias("fetched_at"), F.col("value").alias("price"))
    keys = ["event_type", "price_date"]
    held = market.latest_per_key(rows.filter("event_id % 2 = 0"), keys, "fetched_at", "event_id")
    return market.upsert(held, rows.filter("event_id % 2 = 1"), keys, "fetched_at", "event_id")


@query(
    """WITH now AS (SELECT max(ts) AS now FROM events), h AS (SELECT user_id, count(*) AS rows, max(ts) AS newest_at FROM events GROUP BY 1),
q AS (SELECT user_id, max(value) AS spot FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id, status, status IN ('cached', 'fetched') AS is_live FROM (SELECT h.user_id, CASE WHEN rows >= 2 AND epoch(now) - epoch(newest_at) < 86400 THEN 'cached' WHEN spot IS NOT NULL THEN 'fetched' WHEN rows >= 2 THEN 'stale' ELSE 'unavailable' END AS status FROM h LEFT JOIN q USING (user_id), now)"""
)
def cache_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a read-through cache does for each user at the last event's time; a feed answers for users who bought."""
    events = table(spark, sf_dir, "events")
    history = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("newest_at"))
    quotes = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("value").alias("spot"))
    now = events.agg(F.max("ts")).first()[0]  # the clock
    decided = market.cache_decision(history, quotes, F.lit(now), ["user_id"], market.RATE_TTL_S)
    return decided.select("user_id", "status", "is_live")


@query(
    """WITH o AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type AS provider, length(event_type) * 10 + ascii(event_type) AS priority, max(value) AS spot FROM events GROUP BY ALL),
m AS (SELECT *, coalesce(spot BETWEEN 60 AND 120, false) AS ok FROM o), b AS (SELECT user_id, day, min(priority) FILTER (WHERE ok) AS p FROM m GROUP BY ALL)
SELECT m.user_id, m.day, max(provider) FILTER (WHERE ok AND priority = p) AS provider, max(spot) FILTER (WHERE ok AND priority = p) AS spot,
coalesce(string_agg(provider, ',' ORDER BY priority, provider) FILTER (WHERE NOT ok AND (p IS NULL OR priority < p)), '') AS attempts, p IS NOT NULL AS is_live
FROM m JOIN b ON b.user_id = m.user_id AND b.day = m.day GROUP BY m.user_id, m.day, p"""
)
def provider_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as feeds in a fixed order; the first with a sane spot answers for a user's day."""
    events = table(spark, sf_dir, "events")
    offers = events.groupBy("user_id", F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("provider")).agg(F.max("value").alias("spot")).withColumn("priority", F.length("provider") * 10 + F.ascii("provider"))
    return market.first_provider(offers, ["user_id", "day"]).withColumn("attempts", F.array_join("attempts", ","))


@query(
    """WITH k AS (SELECT event_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events), d AS (SELECT *, CASE WHEN value - k / 100 > 0 THEN k / 100 / (value - k / 100) * 100 END AS derived FROM k)
SELECT event_id, k, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS as_of, round(CASE WHEN derived IS NOT NULL AND abs(k / 100 - derived) > 0.05 THEN derived ELSE k / 100 END, 6) AS change FROM d"""
)
def quote_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of event properties: a number of dirty text, a UTC time, and the day change cross-checked."""
    events = table(spark, sf_dir, "events")
    k = market.number(F.concat(F.lit("€"), F.from_json("props", "k string")["k"]))
    rows = events.select("event_id", "ts", "value", k.alias("k"))
    change = market.resolved_change(F.col("k") / 100, F.col("k") / 100, F.col("value"))
    return rows.select("event_id", "k", market.utc_text(F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long")).alias("as_of"), F.round(change, 6).alias("change"))


def registrations_and_ticks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sign-ups register an alert at their value; the values of all other events are quotes."""
    events = table(spark, sf_dir, "events")
    key = alerts.alert_key(F.concat(F.lit(" User"), F.col("user_id"), F.lit("@Example.com ")), F.round("value", 2))
    made = events.filter("event_type = 'signup'").select(key.alias("key"), F.round("value", 2).alias("target"), F.col("ts").cast("timestamp").alias("registered_at"))
    ticks = alerts.polled(events.filter("event_type <> 'signup'").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("value").alias("spot")))
    return made, ticks


@query(
    """WITH r AS (SELECT user_id, round(value, 2) AS target, min(ts) AS registered_at FROM events WHERE event_type = 'signup' AND round(value, 2) > 0 GROUP BY ALL),
t AS (SELECT make_timestamp(CAST((floor(epoch(ts) / 600) + 1) * 600 AS BIGINT) * 1000000) AS tick, arg_max(value, (ts, event_id)) AS spot FROM events WHERE event_type <> 'signup' AND value IS NOT NULL GROUP BY 1)
SELECT user_id, target, registered_at, min(tick) AS fired_at, arg_min(spot, tick) AS spot FROM r LEFT JOIN t ON tick > registered_at AND spot <= target GROUP BY ALL"""
)
def alert_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, ticks = registrations_and_ticks(spark, sf_dir)
    fired = alerts.fires(made, ticks)
    return fired.select(F.regexp_extract("key", r"^user(\d+)@", 1).cast("long").alias("user_id"), "target", "registered_at", "fired_at", "spot")


# Lanes: orders as shipments

_LANES_SQL = "(VALUES (0, 'A', 'limited', 32, CAST(2840 AS DOUBLE), CAST(0.001 AS DOUBLE)), (1, 'B', 'blocked', 25, 2950.0, 0.0075), (2, 'D', 'limited', 35, 2900.0, 0.006), (3, 'C', 'best', 52, 3200.0, 0.0)) AS l(place, route_key, status, lead_time_days, freight, rate)"


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order on every lane: freight, carbon and war-risk parts in dollars."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lanes = seeds.routes(spark).select("route_key", "status", "lead_time_days", F.col("base_other_usd").cast("double").alias("freight"), F.col("war_risk_rate").cast("double").alias("rate"))
    priced = orders.crossJoin(F.broadcast(lanes))  # four lanes
    return priced.withColumns({"carbon": F.round(F.col("o_totalprice") * 0.001, 6), "war_risk": F.round(F.col("o_totalprice") * F.col("rate"), 6)}).withColumn("total", F.round(F.col("freight") + F.col("carbon") + F.col("war_risk"), 6))


_PRICED_SQL = f"WITH p AS (SELECT o_orderkey, route_key, status, lead_time_days, freight, round(o_totalprice * 0.001, 6) AS carbon, round(o_totalprice * rate, 6) AS war_risk FROM orders, {_LANES_SQL}), m AS (SELECT *, round(freight + carbon + war_risk, 6) AS total FROM p)"


@query(_PRICED_SQL + " SELECT o_orderkey, route_key, status, freight, carbon, war_risk, CASE WHEN status <> 'blocked' THEN total END AS total FROM m")
def mask_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("o_orderkey", "route_key", "status", "freight", "carbon", "war_risk", routes.masked_total(F.col("status"), F.col("total")).alias("total"))


@query(_PRICED_SQL + " SELECT o_orderkey, route_key, total, row_number() OVER (PARTITION BY o_orderkey ORDER BY total, lead_time_days, route_key) AS rank FROM m WHERE status <> 'blocked'")
def route_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_orderkey").orderBy("total", "lead_time_days", "route_key")
    return _priced(spark, sf_dir).filter("status <> 'blocked'").select("o_orderkey", "route_key", "total", F.row_number().over(order).alias("rank"))


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trips between two seeded ports, picked by their keys."""
    ports = seeds.ports(spark).select("place", F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat"))
    ends = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 18).cast("int").alias("a"), (F.col("o_orderkey") % 32 + 18).cast("int").alias("b"))
    start, end = (ports.select(F.col("place").alias(p), F.col("lng").alias(f"{s}_lng"), F.col("lat").alias(f"{s}_lat")) for p, s in (("a", "from"), ("b", "to")))
    return ends.join(F.broadcast(start), "a").join(F.broadcast(end), "b")


_PORT_SQL = ", ".join("({}, '{}', {}, {}, '{}', {})".format(i, c[0], c[3], c[4], c[5], c[6]) for i, c in enumerate([x.strip().split(" | ") for x in seeds.PORTS.strip().splitlines()]))


@query(
    f"""WITH ports(place, unlocode, lat, lng, role, ets) AS (VALUES {_PORT_SQL}), lanes(lane, n_via, x1, y1, x2, y2) AS (VALUES ('A', 1, 103.85, 1.28, NULL, NULL), ('B', 0, NULL, NULL, NULL, NULL), ('C', 0, NULL, NULL, NULL, NULL), ('D', 2, 103.85, 1.28, 79.85, 6.9)),
t AS (SELECT o_orderkey AS trip_id, f.lng AS flng, f.lat AS flat, g.lng AS glng, g.lat AS glat FROM orders JOIN ports f ON f.place = o_custkey % 18 JOIN ports g ON g.place = o_orderkey % 32 + 18),
p AS (SELECT trip_id, lane, n_via, [flng, x1, x2, glng] AS xs, [flat, y1, y2, glat] AS ys FROM t, lanes),
q AS (SELECT trip_id, lane, list_filter(xs, lambda x: x IS NOT NULL) AS xs, list_filter(ys, lambda y: y IS NOT NULL) AS ys FROM p), g AS (SELECT *, unnest(generate_series(1, len(xs) - 1)) AS leg FROM q)
SELECT trip_id, lane, CAST(leg AS INTEGER) AS leg, CAST(xs[leg] AS DOUBLE) AS from_lng, CAST(ys[leg] AS DOUBLE) AS from_lat, CAST(xs[leg + 1] AS DOUBLE) AS to_lng, CAST(ys[leg + 1] AS DOUBLE) AS to_lat FROM g"""
)
def lane_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.legs(_trips(spark, sf_dir)).drop("restrictions")


@query(
    f"""WITH ports(place, unlocode, lat, lng, role, ets) AS (VALUES {_PORT_SQL})
SELECT role, ets AS ets_applies, count(DISTINCT place) AS n_ports, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN ports ON place = s_suppkey % 50 GROUP BY ALL"""
)
def ports_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers at the seeded ports, by role and emissions trading."""
    at = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).cast("int").alias("place"), "s_acctbal")
    return at.join(F.broadcast(seeds.ports(spark)), "place").groupBy("role", "ets_applies").agg(F.count_distinct("place").alias("n_ports"), F.count(F.lit(1)).alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


# Conversations and model answers


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)")
def last_four_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("_n", F.row_number().over(newest)).filter("_n <= 4").drop("_n")
    return last.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


@query(
    """WITH a AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || '] [9] [' || (turn + 1) || '] [0] [' || (length(text) % 7) || ']' AS answer FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\\[(\\d{1,9})\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 4))), ','), '') AS cited FROM a"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation numbers of four hits in answers made of the turns' texts."""
    turns = table(spark, sf_dir, "conversations")
    mark = lambda c: F.concat(F.lit(" ["), c.cast("string"), F.lit("]"))
    answer = F.concat(F.col("text"), mark(F.col("turn") + 1), F.lit(" [9]"), mark(F.col("turn") + 1), F.lit(" [0]"), mark(F.length("text") % 7))
    return turns.select("conv_id", "turn", F.array_join(T.cited_numbers(answer, F.lit(4)), ",").alias("cited"))


@query("SELECT d.n AS documents, d.langs, v.n AS vectors, v.dims, d.n > 0 AND v.n > 0 AS ready FROM (SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents) d, (SELECT count(*) AS n, max(len(embedding)) AS dims FROM embeddings) v")
def corpus_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("lang").alias("langs"))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("vectors"), F.max(F.size("embedding")).cast("long").alias("dims"))
    return docs.crossJoin(vectors).withColumn("ready", (F.col("documents") > 0) & (F.col("vectors") > 0))


def _as_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        paths, contents = [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            kind, text = ("txt", "docx", "hwpx")[doc_id % 3], text.as_py() or ""
            data = text.encode()
            if kind != "txt":
                name = "word/document.xml" if kind == "docx" else "Contents/section0.xml"
                body = "".join(f"<p><run><t>{escape(x)}</t></run></p>" for x in text.split("\n"))
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(name, f"<doc>{body}</doc>")
                data = held.getvalue()
            paths.append(f"{doc_id}.{kind}")
            contents.append(data)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])


@query(
    r"""WITH l AS (SELECT doc_id, doc_id % 3 AS kind, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS lines FROM documents)
SELECT doc_id || '.' || ['txt', 'docx', 'hwpx'][kind + 1] AS path, CASE WHEN kind = 0 AND text = '' THEN NULL WHEN kind = 0 THEN text WHEN kind = 1 THEN trim(text, chr(32) || chr(9) || chr(10) || chr(13)) ELSE array_to_string(list_filter(lines, lambda x: x <> ''), chr(10)) END AS text,
CASE WHEN kind = 0 AND text = '' THEN 'empty' ELSE 'ok' END AS status FROM l"""
)
def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed as TXT, DOCX and HWPX files, and read back."""
    packed = table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(_as_files, "path string, content binary")
    return files.extract_text(packed)


@query(
    """WITH q AS (SELECT event_id, ts, value, event_id % 3 AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS k FROM events),
d AS (SELECT *, value BETWEEN 60 AND 120 AND NOT (kind = 0 AND event_id % 7 = 0) AS ok, CASE WHEN value - k > 0 THEN k / (value - k) * 100 END AS derived FROM q)
SELECT event_id, CASE kind WHEN 0 THEN 'chart' WHEN 1 THEN 'screen' ELSE 'contract' END AS provider, CASE WHEN ok THEN value END AS spot,
CASE WHEN NOT ok THEN NULL WHEN kind = 0 THEN round(CASE WHEN derived IS NOT NULL AND abs(derived - k) > 0.05 THEN derived ELSE k END, 2) WHEN kind = 1 THEN round(k, 2) ELSE round(derived, 2) END AS day_change_pct,
CASE WHEN NOT ok THEN NULL WHEN event_id % 2 = 1 THEN '2026-08-13' WHEN kind = 2 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS as_of,
CASE WHEN ok AND kind = 0 THEN CASE event_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 0 END END AS delay_minutes,
CASE WHEN ok THEN NULL WHEN NOT (value BETWEEN 60 AND 120) THEN 'out of range' ELSE 'wrong product' END AS reason FROM d"""
)
def feed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payloads of the three feeds, each in its own shape; every seventh event of the first is in the wrong currency, every other one has no time."""
    return _quotes(spark, sf_dir).select("event_id", "provider", "spot", "day_change_pct", "as_of", "delay_minutes", "reason")


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", (F.from_json("props", "k double")["k"] / 100).alias("k"))
    timed = F.col("event_id") % 2 == 0
    seconds = F.when(timed, F.floor(F.col("ts").cast("timestamp").cast("double")).cast("long"))
    mode = F.when(F.col("event_id") % 4 == 0, "delayed_streaming_600").when(F.col("event_id") % 4 == 1, "streaming")
    chart = F.struct(F.col("value").alias("close"), F.col("k").alias("change"), F.col("k").alias("change_abs"), F.when(F.col("event_id") % 7 == 0, "USD").otherwise("eur").alias("currency"), seconds.alias("update_time"), mode.alias("update_mode"))
    pair = F.struct(F.format_string("%,.2f", "value").alias("last"), F.concat(F.col("k").cast("string"), F.lit("%")).alias("change_percent_val"), F.lit("1 = €1000").alias("point_value"), seconds.alias("last_timestamp"))
    screen = F.struct(F.array(F.struct(F.struct(F.array(pair).alias("pairs_data")).alias("screen_data"))).alias("data"))
    day = F.when(timed, F.date_format("ts", "MM/dd/yy"))
    contract = F.struct(F.array(F.struct(F.struct(F.col("value").alias("lastPrice"), F.col("k").alias("priceChange")).alias("raw"), F.lit("EUA Futures").alias("contractName"), day.alias("tradeTime"))).alias("data"))
    kind = F.col("event_id") % 3
    payload = F.when(kind == 0, F.to_json(chart)).when(kind == 1, F.to_json(screen)).otherwise(F.to_json(contract))
    provider = F.when(kind == 0, "chart").when(kind == 1, "screen").otherwise("contract")
    return feeds.quotes(events.select("event_id", "ts", "user_id", provider.alias("provider"), payload.alias("payload")), F.lit("2026-08-13").cast("date"))


@query(
    """WITH q AS (SELECT event_id, user_id, event_id % 3 AS kind, value, value BETWEEN 60 AND 120 AND NOT (event_id % 3 = 0 AND event_id % 7 = 0) AS ok FROM events),
o AS (SELECT user_id, kind, max(value) FILTER (WHERE ok) AS spot FROM q GROUP BY ALL), n AS (SELECT *, ['chart', 'screen', 'contract'][kind + 1] AS name FROM o),
b AS (SELECT user_id, min(kind) FILTER (WHERE spot IS NOT NULL) AS first FROM n GROUP BY 1)
SELECT user_id, max(name) FILTER (WHERE kind = first) AS provider, max(spot) FILTER (WHERE kind = first) AS spot, coalesce(string_agg(name, ',' ORDER BY kind) FILTER (WHERE spot IS NULL AND (first IS NULL OR kind < first)), '') AS attempts, first IS NOT NULL AS is_live
FROM n JOIN b USING (user_id) GROUP BY user_id, first"""
)
def feed_failover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user's quotes the best one of a feed; then the first feed, in the feeds' own order, that has one."""
    best = _quotes(spark, sf_dir).groupBy("user_id", "priority", "provider").agg(F.max("spot").alias("spot"))
    return market.first_provider(best, ["user_id"]).withColumn("attempts", F.array_join("attempts", ","))


from kelpline.plans import answers as _answers  # noqa: E402, F401  (registers its queries; it builds on the helpers above)
