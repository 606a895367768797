"""Registered queries of stored tables, the watcher, texts cut for a model, long series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpline.functions import text as T
from kelpline.operators import alerts, chunks, feeds, model_calls, series
from kelpline.plans import index_build
from kelpline.plans.answers import _ARTICLE_SQL, _index
from kelpline.plans.queries import _CLOSES_SQL, _closes, query, table
from kelpline.sources import keyed
from kelpline.sources.shared import shared_folder
from kelpline.streaming import alerts as stream


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/kelpline/{name}-{uuid.uuid4().hex}"


@query(_ARTICLE_SQL + "SELECT CAST(doc_id AS VARCHAR) AS doc, art, 'Regulation ' || doc_id || ', Article ' || art AS cite, 2 AS dims, true AS ready FROM r WHERE reason IS NULL")
def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index build written and loaded again, with its status."""
    path = _new_folder(spark, "index")
    index_build.write_index(_index(spark, sf_dir)[0].withColumn("doc", F.pmod(F.xxhash64("doc"), F.lit(16)).cast("string")), path)
    index, status = index_build.load_index(spark, path)
    return index.select(F.regexp_extract("cite", r"^Regulation (\d+)", 1).alias("doc"), "art", "cite", F.size("vec").alias("dims"), F.lit(status["ready"]).alias("ready"))


@query(
    _ARTICLE_SQL
    + """, g AS (SELECT doc_id % 100 AS doc, doc_id, num, suffix FROM r WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY doc_id % 100, art ORDER BY doc_id) = 1)
SELECT CAST(doc AS VARCHAR) AS doc_key, num, suffix, row_number() OVER (PARTITION BY doc ORDER BY num, suffix) AS place FROM g QUALIFY place <= 3"""
)
def first_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three articles, by number and suffix, of regulations of all documents with the same last two digits; of equal articles the first counts."""
    docs = table(spark, sf_dir, "documents")
    art = F.concat((F.col("doc_id") % 40 + 1).cast("string"), F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("gb")), (F.col("doc_id") % 3 + 1).cast("int")))
    block = F.concat(F.lit('<div class="eli-subdivision" id="art_'), art, F.lit('"><p class="oj-ti-art">x</p><p>'), F.coalesce("text", F.lit("")), F.lit('</p></div><div class="eli-subdivision" id="art_'), art, F.lit('.1"><p>a part of it</p></div>'))
    # Each document is a page with a limit of its own; regulations gather what stays of them.
    pages = docs.select(F.col("doc_id").cast("string").alias("doc_key"), block.alias("html"))
    limits = docs.select(F.col("doc_id").cast("string").alias("doc_key"), F.when(F.col("doc_id") % 2 == 0, 33).otherwise(0).alias("max_article"))
    number = F.col("doc_key").cast("long")
    kept = chunks.chunk(pages, limits)[0].withColumn("group", (number % 100).cast("string")).groupBy("group", "art", "num", "suffix").agg(F.min(number).alias("first"))
    return chunks.first_n(kept.select(F.col("group").alias("doc_key"), "num", "suffix"), 3).withColumn("place", F.row_number().over(Window.partitionBy("doc_key").orderBy("num", "suffix")))


@query(
    """WITH r AS (SELECT 'u' || user_id AS key, min(round(value, 2)) AS target, min(round(value, 2)) AS own FROM events WHERE event_type = 'signup' AND round(value, 2) > 0 GROUP BY 1)
SELECT key, target, CASE WHEN target >= 40 THEN CASE WHEN CAST(substring(key, 2) AS BIGINT) % 5 = 0 THEN 'failed' ELSE 'sent' END ELSE 'pending' END AS status FROM r"""
)
def alert_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watcher as a stream over sign-ups, with a quote of 40 and a mail service that refuses every fifth user; restarted once with a new checkpoint, which changes nothing."""
    folder = _new_folder(spark, "watch")
    made = table(spark, sf_dir, "events").filter("event_type = 'signup'").select(F.concat(F.lit("u"), F.col("user_id")).alias("key"), F.round("value", 2).alias("target"))
    made.filter("target > 0").groupBy("key").agg(F.min("target").alias("target")).select("key", "target", F.lit(None).cast("double").alias("spot")).write.parquet(f"{folder}/in")

    def send(due: DataFrame) -> DataFrame:
        return due.select("key", (F.substring("key", 2, 20).cast("long") % 5 != 0).alias("ok"))

    for checkpoint in ("first", "second"):
        arriving = spark.readStream.schema("key string, target double, spot double").parquet(f"{folder}/in")
        stream.run_batches(arriving, f"{folder}/alerts", f"{folder}/{checkpoint}", lambda: 40.0, send, availableNow=True).awaitTermination()
    found = keyed.load(spark, f"{folder}/alerts")
    return (spark.createDataFrame([], "key string, target double, status string") if found is None else found).select("key", "target", "status")


@query(
    """WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(0.5 + (event_id % 400) / 1000.0 AS DECIMAL(10, 3)) AS eur FROM events WHERE event_id % 11 <> 0)
SELECT day, count(*) * 2 AS n_rows, round(sum(1 / CAST(eur AS DOUBLE)), 4) AS usd FROM e GROUP BY 1"""
)
def rates_logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all events appended to the log day by day in one job that runs twice: the log holds each once."""
    eur = (0.5 + (F.col("event_id") % 400) / 1000).cast("decimal(10,3)").cast("string")
    payload = F.concat(F.lit('{"result":"'), F.when(F.col("event_id") % 11 == 0, "error").otherwise("success"), F.lit('","base_code":"USD","time_last_update_utc":"Sun, 09 Aug 2026 00:00:02 +0000","rates":{"EUR":'), eur, F.lit(',"KRW":1400}}'))
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("base"), F.col("ts").cast("timestamp").alias("ts"), payload.alias("payload"))
    got, path = feeds.fx_rows(events), _new_folder(spark, "rates")
    for _ in range(2):
        feeds.log_rates_once(got, F.col("ts"), path, "refresh")
    log = keyed.load(spark, path)
    usd = F.round(F.sum(F.when(F.col("quote") == "USD", F.col("rate").cast("double"))), 4)
    return log.groupBy(F.date_format("fetched_at", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), usd.alias("usd"))


@query("SELECT doc_id, md5(substring(coalesce(text, ''), 1, 12000)) AS terms_md5, md5(substring(coalesce(text, ''), 1, 500)) AS question_md5, md5(substring(coalesce(text, ''), 1, 400)) AS sentence_md5 FROM documents")
def message_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a message, cut for each of the prompts that take one."""
    cuts = {"terms": T.MESSAGE_MAX, "question": T.QUESTION_MAX, "sentence": T.SENTENCE_MAX}
    return table(spark, sf_dir, "documents").select("doc_id", *[F.md5(T.cut(F.col("text"), n)).alias(f"{name}_md5") for name, n in cuts.items()])


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[\s,;:()<>]+')) AS word FROM documents)
SELECT doc_id, count(*) AS n_at, count(*) FILTER (WHERE regexp_full_match(word, '[^\s@]+@[^\s@]+\.[^\s@]{2,}')) AS n_emails, count(DISTINCT lower(word) || '|' || '80.0') FILTER (WHERE regexp_full_match(word, '[^\s@]+@[^\s@]+\.[^\s@]{2,}')) AS n_keys
FROM w WHERE contains(word, '@') GROUP BY 1"""
)
def alert_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with an @ of every document as addresses that register at 80: how many would be taken, and how many alerts they are."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), r"[\s,;:()<>]+")).alias("word")).filter(F.contains("word", F.lit("@")))
    ok = alerts.is_email(F.col("word"))
    return words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_at"), F.count(F.when(ok, 1)).alias("n_emails"), F.count_distinct(F.when(ok, alerts.alert_key(F.col("word"), F.lit(80)))).alias("n_keys"))


@query(
    """WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations)
SELECT conv_id, turn, CASE WHEN n % 3 <> 2 THEN 'so {"n": ' || n || '}' END AS content, CASE WHEN n % 3 = 2 THEN 'no JSON: ' || substring(text || ' [0.0]', 1, 200) END AS error FROM t"""
)
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asked of two models for JSON: the first has no quota left; the second answers in JSON at once, when asked again, or never, by the length of the text."""

    def first(system: str, message: str, temperature: float) -> dict:
        return {"error": "quota"}

    def second(system: str, message: str, temperature: float) -> dict:
        kind = len(message) % 3
        return {"content": f'so {{"n": {len(message)}}}' if kind == 0 or kind == 1 and temperature == 0 else f"{message} [{temperature}]"}

    turns = table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn")).alias("request_id"), F.lit("s").alias("system"), F.coalesce("text", F.lit("")).alias("message"))
    got = model_calls.complete(turns, [first, second], as_json=True)
    return got.select(F.from_json("request_id", "conv_id long, turn long").alias("r"), "content", "error").select("r.conv_id", "r.turn", "content", "error")


@query(
    _CLOSES_SQL
    + f""", n AS (SELECT event_type, price_date, close, row_number() OVER (PARTITION BY event_type ORDER BY price_date) AS i, pow(ln(close / lag(close) OVER (PARTITION BY event_type ORDER BY price_date)), 2) AS r2 FROM closes WHERE close > 0),
v AS (SELECT event_type, price_date, close, i, r2, list(r2) OVER (PARTITION BY event_type ORDER BY i) AS seen FROM n WHERE r2 IS NOT NULL),
w AS (SELECT event_type, price_date, close, list_reduce(seen, lambda a, x: {series.DECAY} * a + (1 - {series.DECAY}) * x, seen[1]) AS variance FROM v)
SELECT event_type, price_date, close, round(variance, 8) AS variance, {', '.join(f"round(close * exp({sign} * {z} * sqrt(variance * 5)), 2) AS {side}_{name}" for name, z in series.BANDS.items() for side, sign in (('low', -1), ('high', 1)))} FROM w"""
)
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of a week for the daily closes of each event type (of the specification only), a month being a stretch."""
    variances = series.ewma_variance(_closes(spark, sf_dir), "event_type", "price_date", "close", F.substring("price_date", 1, 7))
    bands = series.price_bands(variances, "close", "1w")
    return bands.withColumns({"variance": F.round("variance", 8)} | {f"{side}_{name}": F.round(f"{side}_{name}", 2) for name in series.BANDS for side in ("low", "high")})


@query(
    """WITH p AS (SELECT user_id % 50 AS market, ts, max(event_id) AS event_id, arg_max(value, event_id) AS spot FROM events WHERE event_type <> 'signup' AND value IS NOT NULL GROUP BY ALL),
s AS (SELECT event_id AS saved_id, user_id % 50 AS market, ts + INTERVAL 3 DAY AS ts, ts + to_days(CAST(1 + event_id % 5 AS INTEGER)) AS deadline, value * 0.5 AS low, value * 1.5 AS high FROM events WHERE event_type = 'signup')
SELECT saved_id, spot, CASE WHEN s.ts > deadline OR spot IS NULL THEN 'undecidable' WHEN spot BETWEEN low AND high THEN 'valid' ELSE 'recalculate' END AS verdict FROM s ASOF LEFT JOIN p ON p.market = s.market AND p.ts <= s.ts"""
)
def range_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-ups as saved queries with a range and a deadline, each checked three days later against the price as of then (of the specification only)."""
    events = table(spark, sf_dir, "events").withColumn("market", F.col("user_id") % 50).withColumn("ts", F.col("ts").cast("timestamp"))
    prices = events.filter("event_type <> 'signup' and value is not null").select("market", "ts", "event_id", F.col("value").alias("spot"))
    days = lambda n: F.make_dt_interval(days=n)
    saved = events.filter("event_type = 'signup'").select(
        F.col("event_id").alias("saved_id"), "market", (F.col("ts") + days(F.lit(3))).alias("ts"), (F.col("ts") + days((1 + F.col("event_id") % 5).cast("int"))).alias("deadline"), (F.col("value") * 0.5).alias("low"), (F.col("value") * 1.5).alias("high")
    )
    checks = series.as_of(saved, prices, ["market"], "ts", F.to_date("ts"), "event_id", ["spot"])
    return series.range_breaches(checks.withColumnRenamed("ts", "at")).select("saved_id", "spot", "verdict")
