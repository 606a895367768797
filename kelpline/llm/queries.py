"""The numbered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, decontaminate, embeddings, extraction, language, licenses, lines, minhash, mixing, periodic, quality, sharding, suffix
from .common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def id_fold(folds: int) -> F.Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels.filter(id_fold(5) != 0))
    return quality.score(docs, net).select("doc_id", (id_fold(5) == 0).alias("held_out"), "score", "predicted")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(id_fold(3) != 1))
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_fold(3) == 1).alias("held_out"), "lang_pred", "score")


@query("op3_html_extraction")
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removed(table(spark, sf_dir, "documents"))


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), 40)[0]


@query("op6_embedding_near_dedup")
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_minhash_near_dedup")
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op9_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), marked AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


@query(
    "op10_mixing",
    r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substring(md5('mix-1:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS draw FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST) AS k FROM sources WHERE source_size > 0
), levels AS (
  SELECT k, cap / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ranked
), level AS (
  SELECT k, rest, weights FROM levels WHERE rest / weights <= ratio ORDER BY k LIMIT 1
), targets AS (
  SELECT s.source, s.source_size, CASE WHEN s.source_size = 0 THEN 0.0 WHEN l.k IS NULL OR r.k < l.k THEN r.cap ELSE l.rest * s.weight / l.weights END AS target
  FROM sources s LEFT JOIN ranked r ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN level l ON true
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), placed AS (
  SELECT d.*, p.source_size, p.target, p.whole, greatest(p.target - p.whole * p.source_size, 0.0) AS part, d.draw % 4096 AS cell,
         sum(size) OVER (PARTITION BY d.source ORDER BY d.draw % 4096 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_cell,
         sum(size) OVER (PARTITION BY d.source, d.draw % 4096) AS cell_size,
         sum(size) OVER (PARTITION BY d.source ORDER BY d.draw % 4096, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source
), drawn AS (
  SELECT *, whole + CASE WHEN upto_cell - cell_size < part AND upto_cell > part THEN CASE WHEN upto - size / 2.0 <= part THEN 1 ELSE 0 END WHEN upto_cell <= part THEN 1 ELSE 0 END AS repeats FROM placed
)
SELECT doc_id, size, source_size, target, CAST(size * repeats AS BIGINT) AS taken, source, CAST(repeats AS BIGINT) AS repeats FROM drawn
""",
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


@query(
    "op11_filter_audit",
    r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copy FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS quality, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), cells AS (
  SELECT part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END + CASE WHEN 100 * capitals > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN copy THEN 16 ELSE 0 END AS mask, count(*) AS n, sum(coalesce(quality, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM w LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(list_filter(bits, lambda x, i: i < step)), 0) AS INTEGER) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE (mask & (before | bit)) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE (mask & before) = 0 AND (mask & bit) > 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE (mask & before) > 0 AND (mask & bit) > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE (mask & before) = 0 AND (mask & bit) > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE (mask & before) = 0 AND (mask & bit) > 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_license_scan")
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scans(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(table(spark, sf_dir, "documents"), periodic.planted))
