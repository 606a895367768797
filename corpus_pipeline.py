"""The corpus pipeline: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import decontaminate, language, minhash, mixing, sharding
from kelpline.llm.common import checkpointed, table

#: Least posterior of the predicted language; below it a document could be any of several.
MIN_LANGUAGE_SCORE = 0.5
N_SHARDS = 40
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one. Those without letters, null or undecided go."""
    model = language.train(docs)
    kept = language.predict(docs, model).filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest id. Rows with one id are one document; rows without an id stay."""
    keep = minhash.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(keep, "doc_id").select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: each document as many times as it is taken, 0 to 2, with or without an id."""
    return mixing.mixture(docs).select(*COLUMNS)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every row of the mixture."""
    return sharding.shard_records(docs, N_SHARDS)[0]


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


#: Language, hashing and sampling stages have no SQL twin; tests hold them against brute force.
ORACLE_SQL = None
