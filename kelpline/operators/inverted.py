"""A stored inverted index: texts are cut into terms once, questions are answered from postings.

Written below a folder, as tables of Parquet files:

- ``documents``: the length of each document and its terms with their counts; documents without terms too.
- ``postings``: a row for each term and block of documents, with the arrays of the documents, how often they hold the term, and their lengths; parted by ``bucket``, a hash of the
  term, and sorted by term within a block, so a search opens the buckets of the terms asked. A block is a stretch of the ``documents`` table of at most ``BLOCK_DOCS`` documents,
  inverted and written where it lies: each task writes to all buckets at once, so nothing is shuffled, sorted or spilled, and no row grows with the corpus, however common its term.
  The folder behind the last bucket has a row for each block with all its documents, those without terms too.
- ``terms``: df and cf of each term, parted alike.
- ``totals``: documents and tokens, one row. It is written last: an index without it is not whole and isn't read.

Every build has a folder of its own, so one that breaks, or two at once, harm no reader.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.functions.batches import pieces
from kelpline.functions.text import STOP_WORDS, TOKEN_MAX, TOKEN_MIN, TOKEN_SPLIT
from kelpline.operators.retrieval import K1, B, broadcast_if

#: Documents and postings of a block at most; a document with more postings is a block of its own.
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 19
#: Documents that go to a Python task, and come back, at a time: their texts lie in buffers beside the heap.
BATCH = 1000
#: Folders of postings by hash of the term; blocks whose postings of one folder make a file, about, where each task has that many.
BUCKETS, SLICE = 32, 64
#: Bytes that a task holds for a file of postings before it writes them.
ROW_GROUP = 8 << 20
#: Queries that are scored together against a block of documents.
QUERY_GROUP = 256
#: What scores may differ by and still change places when they are rounded.
NEAR = 1e-5
#: Raised when the layout changes, so that older indexes aren't read.
LAYOUT = 3


class Index(NamedTuple):
    """The tables of a stored index, and its totals."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    blocks: DataFrame
    n_docs: int
    total: int

    @property
    def average(self) -> float:
        return self.total / max(self.n_docs, 1)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's terms with their counts, and how many tokens that makes."""
    split, stops = re.compile(TOKEN_SPLIT).split, frozenset(STOP_WORDS)
    for batch in pieces(batches):
        lengths, ends, terms, tfs = [], [0], [], []
        for text in batch.column("text"):
            held = Counter(split((text.as_py() or "").lower()))
            own = {t: n for t, n in held.items() if TOKEN_MIN <= len(t) <= TOKEN_MAX and t not in stops}
            terms.extend(own)
            tfs.extend(own.values())
            ends.append(len(terms))
            lengths.append(sum(own.values()))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=["doc_id", "dl", "terms", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch], most_docs: int, most_postings: int) -> Iterator[pa.Table]:
    """The rows of a task in blocks."""
    held, n_docs, n_postings = [], 0, 0
    for batch in batches:
        sizes = pa.compute.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        start = 0
        for i, n in enumerate(sizes.tolist()):
            if n_docs and (n_docs == most_docs or n_postings + n > most_postings):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, n_docs, n_postings, start = [], 0, 0, i
            n_docs, n_postings = n_docs + 1, n_postings + n
        held.append(batch.slice(start))
    if n_docs:
        yield pa.Table.from_batches(held)


def _inverted(batches: Iterator[pa.RecordBatch], most_docs: int, most_postings: int) -> Iterator[pa.RecordBatch]:
    """Postings of each block of a task's documents, by term, and all documents of the block under an empty term. A block's number is that of its task and its own."""
    task = TaskContext.get().partitionId()
    for number, block in enumerate(_blocks(batches, most_docs, most_postings)):
        block = block.sort_by("doc_id").combine_chunks()
        docs, dl = block.column("doc_id").combine_chunks(), block.column("dl").to_numpy().astype(np.int32)
        lists, counts = (block.column(c).combine_chunks() for c in ("terms", "tfs"))
        of = np.repeat(np.arange(len(docs)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        by_term = pa.compute.sort_indices(coded.dictionary)
        code = np.argsort(by_term.to_numpy())[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")
        ends = pa.array(np.r_[0, len(docs) + np.r_[0, np.cumsum(np.bincount(code, minlength=len(by_term)))]], pa.int32())
        every = pa.array(np.zeros(len(docs), np.int32))
        values = pa.concat_arrays([docs, docs.take(pa.array(of[order]))]), pa.concat_arrays([every, counts.flatten().take(pa.array(order))]), pa.array(np.r_[dl, dl[of[order]]])
        columns = [pa.concat_arrays([pa.array([""]), coded.dictionary.take(by_term)]), pa.array(np.full(len(by_term) + 1, (task << 32) | number))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(ends, v) for v in values)], names=["term", "block", "docs", "tfs", "dls"])


def build(docs: DataFrame, path: str) -> None:
    """Writes the index of (doc_id, text) rows to a new folder. Rows with one id are one document; a row without an id isn't indexed, as nothing names it."""
    spark = docs.sparkSession
    # With as many open files as buckets, Spark doesn't sort a task's rows by bucket before it writes them.
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.maxConcurrentOutputFileWriters": BUCKETS + 2}
    before = {setting: spark.conf.get(setting) for setting in settings}
    try:
        for setting, value in settings.items():
            spark.conf.set(setting, str(value))
        _build(docs, path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)


def _build(docs: DataFrame, path: str) -> None:
    spark = docs.sparkSession
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    schemas = _schemas(dict(docs.dtypes)["doc_id"])
    cores = spark.sparkContext.defaultParallelism
    if named.rdd.getNumPartitions() < cores:  # a table of few files: cutting texts takes longer than dealing them out
        named = named.repartition(cores)
    repeated = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    n_bytes = repeated.agg(F.sum(F.length(F.col("doc_id").cast("string")) + 40)).first()[0]
    if n_bytes is None:
        counted = named.mapInArrow(_counted, schemas["documents"])
    else:
        repeated = broadcast_if(repeated, n_bytes)  # a few such ids have no text shuffled
        lone = named.join(repeated, "doc_id", "left_anti").mapInArrow(_counted, schemas["documents"])
        parts = named.join(repeated, "doc_id", "left_semi").mapInArrow(_counted, schemas["documents"])
        # An empty text has a row with no term, so its document stays.
        each = parts.select("doc_id", F.explode_outer(F.arrays_zip("terms", "tfs")).alias("t")).groupBy("doc_id", F.col("t.terms").alias("term")).agg(F.coalesce(F.sum("t.tfs"), F.lit(0)).cast("int").alias("tf"))
        pairs = F.array_compact(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))))
        merged = each.groupBy("doc_id").agg(F.sum("tf").alias("dl"), pairs.alias("p")).select("doc_id", "dl", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
        counted = lone.unionByName(merged)
    counted.write.parquet(f"{path}/documents")
    forward = spark.read.parquet(f"{path}/documents")
    n_docs, total = forward.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n_tasks = max(4 * cores, -(-n_docs // (BLOCK_DOCS * SLICE)))
    invert = partial(_inverted, most_docs=BLOCK_DOCS, most_postings=BLOCK_POSTINGS)
    packed = forward.coalesce(n_tasks).mapInArrow(lambda batches: invert(batches), schemas["postings"].removesuffix(", bucket int")).withColumn("bucket", F.when(F.col("term") == "", BUCKETS).otherwise(_bucket(F.col("term"))))
    packed.write.option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/postings")
    held = spark.read.schema(schemas["postings"]).parquet(f"{path}/postings").filter(F.col("bucket") < BUCKETS)
    times = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    counts = held.groupBy("bucket", "term").agg(F.sum(F.size("tfs")).alias("df"), F.sum(times).alias("cf"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    spark.range(1).select(F.lit(n_docs).cast("long").alias("n_docs"), F.lit(total).cast("long").alias("total")).coalesce(1).write.parquet(f"{path}/totals")


def _schemas(id_type: str) -> dict[str, str]:
    """Columns of the tables; types are stated, as an index of texts without terms has no folder of postings to tell them."""
    return {
        "documents": f"doc_id {id_type}, dl long, terms array<string>, tfs array<int>",
        "postings": f"term string, block long, docs array<{id_type}>, tfs array<int>, dls array<int>, bucket int",
        "terms": "term string, df long, cf long, bucket int",
    }


def load(spark: SparkSession, path: str) -> Index:
    """A whole index."""
    id_type = dict(spark.read.parquet(f"{path}/documents").dtypes)["doc_id"]
    totals = spark.read.parquet(f"{path}/totals").first()
    documents, held, terms = (spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _schemas(id_type).items())
    blocks = held.filter(F.col("bucket") == BUCKETS).select("block", "docs")
    return Index(documents, held.filter(F.col("bucket") < BUCKETS), terms, blocks, totals["n_docs"], totals["total"])


def state_of(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of the files at ``paths``, by name, size and time; their contents aren't read."""
    found = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first() for p in paths]
    return hashlib.sha256(repr([tuple(f) for f in found]).encode()).hexdigest()[:24]


def stored(spark: SparkSession, folder: str, made_from: str, docs: Callable[[], DataFrame]) -> Index:
    """The index of what ``made_from`` names: the newest whole one below ``folder``, or one built now from ``docs``."""
    base = f"{folder}/inverted-{LAYOUT}-{made_from}"
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(root):
        for status in sorted(fs.listStatus(root), key=lambda s: -s.getModificationTime()):
            path = status.getPath().toString()
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")):
                return load(spark, path)
    path = f"{base}/{uuid.uuid4().hex}"
    build(docs(), path)
    return load(spark, path)


def _asked(index: Index, query_terms: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """((query_id, bucket, term, weight with idf) of known terms, postings of their buckets, bytes of the terms asked, queries)."""
    asked = query_terms.filter("weight <> 0").select("query_id", _bucket(F.col("term")).alias("bucket"), "term", "weight")
    # One row: at most BUCKETS numbers.
    n_bytes, n_queries, buckets = asked.agg(F.coalesce(F.sum(F.length("term") + 40), F.lit(0)), F.count_distinct("query_id"), F.collect_set("bucket")).first()
    few = F.col("bucket").isin(buckets)
    idf = F.log(1 + (F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    meant = index.terms.filter(few).join(broadcast_if(asked.drop("bucket"), n_bytes), "term").select("query_id", "bucket", "term", (F.col("weight") * idf).alias("weight"))
    return meant, index.postings.filter(few), n_bytes, n_queries


def saturation(tf: Column | np.ndarray, dl: Column | np.ndarray, average: float) -> Column | np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


def bm25(index: Index, query_terms: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, kw) of documents with a term of (query_id, term, weight); of ``only`` (query_id, doc_id), if it is given. Reads the postings of these terms alone."""
    meant, held, n_bytes, _ = _asked(index, query_terms)
    hits = held.join(broadcast_if(meant, 2 * n_bytes), ["bucket", "term"]).select("query_id", "weight", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p"))
    scored = hits.select("query_id", F.col("p.docs").alias("doc_id"), (F.col("weight") * saturation(F.col("p.tfs"), F.col("p.dls"), index.average)).alias("part"))
    if only is not None:
        scored = scored.join(only.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    return scored.groupBy("query_id", "doc_id").agg(F.sum("part").alias("kw"))


def asked_postings(index: Index, query_terms: DataFrame, n_groups: int | None = None) -> DataFrame:
    """(block, query_group, term, docs, tfs, dls, queries, weights): the postings of the terms asked, a row for each group of queries that asks for them."""
    meant, held, n_bytes, n_queries = _asked(index, query_terms)
    group = query_group(n_groups or groups_of(n_queries))
    by_term = meant.groupBy("bucket", "term", group).agg(F.collect_list("query_id").alias("queries"), F.collect_list("weight").alias("weights"))
    # By term alone, as a join by bucket would prune folders that are known already by a subquery of its own in each use, and rows used twice would be shuffled twice.
    return held.drop("bucket").join(broadcast_if(by_term.drop("bucket"), 2 * n_bytes), "term").select("block", "query_group", "term", "docs", "tfs", "dls", "queries", "weights")


def groups_of(n_queries: int) -> int:
    return max(1, -(-n_queries // QUERY_GROUP))


def query_group(n_groups: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(n_groups)).cast("int").alias("query_group")


def bm25_best(index: Index, query_terms: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, kw): of each block of documents the k best of each query and what is as good but for rounding.

    The postings of a block are scored together against a group of queries, in one array of queries by documents; what leaves the task is k rows for each
    query, not a row for each document with a common term.
    """
    met, average = asked_postings(index, query_terms), index.average
    types = dict(query_terms.dtypes)["query_id"], dict(index.documents.dtypes)["doc_id"]

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("term", kind="stable")
        docs, queries = np.unique(np.concatenate(pdf["docs"].to_numpy())), np.unique(np.concatenate(pdf["queries"].to_numpy()))
        scores = np.zeros((len(queries), len(docs)))
        for d, tf, dl, q, weight in zip(pdf["docs"], pdf["tfs"], pdf["dls"], pdf["queries"], pdf["weights"], strict=True):
            part = np.outer(weight, saturation(tf.astype(float), dl, average))
            scores[np.searchsorted(queries, q)[:, None], np.searchsorted(docs, d)[None, :]] += part
        least = np.partition(scores, -k, axis=1)[:, [-k]] if len(docs) > k else np.zeros((len(queries), 1))
        i, j = np.nonzero((scores > 0) & (scores >= least - NEAR))
        return pd.DataFrame({"query_id": queries[i], "doc_id": docs[j], "kw": scores[i, j]})

    return met.groupBy("block", "query_group").applyInPandas(score, f"query_id {types[0]}, doc_id {types[1]}, kw double")
