"""Index build: regulation pages to articles, vectors and a partitioned index."""

from __future__ import annotations

import random
import time
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from kelpline.functions.text import embedding_input
from kelpline.operators import chunks


#: Fixed value: times that a failed call is made at most.
ATTEMPTS = 6
#: Where an article is shown, and what its address, id and citation put before its number.
ARTICLE_URL, URL_PART, ID_PART, CITE_PART = "https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:", "#art_", "#art", ", Article "
#: Bytes above which an index is worth a warning.
LARGE_INDEX = 20 << 20


def _patiently(embedder: Callable, texts: list[str], pause: float) -> list[list[float] | None]:
    """The embedder's answer, asked again after pauses that double and vary by up to half; its last failure is raised."""
    for attempt in range(ATTEMPTS):
        try:
            return embedder(texts)
        except Exception:  # whatever the client raises
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(pause * 2**attempt * (1 + random.random() / 2))
    return []


def with_vectors(rows: DataFrame, text: str, key: str, embedder: Callable[[list[str]], list[list[float] | None]], dims: int, batch: int = 64, pause: float = 1.0) -> DataFrame:
    """The rows with ``vec``, unit length, of their column ``text`` through an injected embedder, which gets ``batch`` texts at a time. Calls that fail are made again; failed texts give no row; a wrong length or a zero vector is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, batch):
                part = whole.slice(a, batch)
                kept, vectors = [], []
                for i, v in enumerate(_patiently(embedder, part.column(text).to_pylist(), pause)):
                    if v is None:
                        continue
                    x = np.asarray(v, np.float64)
                    n = np.linalg.norm(x)
                    if len(x) != dims or not 0 < n < np.inf:
                        raise ValueError(f"{part.column(key)[i]}: {len(x)} dimensions, norm {n}")
                    kept.append(i)
                    vectors.append((x / n).astype(np.float32))
                if kept:
                    held = part.take(pa.array(kept, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*held.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*held.schema.names, "vec"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("vec", ArrayType(FloatType()))]))


def embed(rows: DataFrame, embedder: Callable[[list[str]], list[list[float] | None]], dims: int, batch: int = 64, pause: float = 1.0) -> DataFrame:
    """(id, vec) of (id, text): ``with_vectors`` without the texts."""
    return with_vectors(rows.select("id", "text"), "text", "id", embedder, dims, batch, pause).select("id", "vec")


def build_index(pages: DataFrame, documents: DataFrame, embedder: Callable, dims: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles with vectors, report). pages: (doc_key, html); documents: (doc_key, celex, cite_base, max_article).

    The report counts articles and dropped blocks of each document by reason. Each of both reads the pages once: vectors are put to the rows of their texts, outcomes are counted together.
    """
    blocks = chunks.marked(pages, documents.select("doc_key", "max_article"))
    articles = blocks.filter(F.col("outcome") == chunks.KEPT)
    if limit:
        articles = chunks.first_n(articles, limit)
    named = (
        articles.join(documents.drop("max_article"), "doc_key")
        .withColumn("id", F.concat("celex", F.lit(ID_PART), "art"))
        .withColumn("cite", F.concat("cite_base", F.lit(CITE_PART), "art"))
        .withColumn("url", F.concat(F.lit(ARTICLE_URL), "celex", F.lit(URL_PART), "art"))
        .withColumn("input", embedding_input(F.col("heading"), F.col("title"), F.col("cite"), F.col("text")))
        .filter("id is not null")
    )
    columns = ["id", F.col("doc_key").alias("doc"), "celex", "art", "cite", "heading", "title", "text", "excerpt", "url"]
    index = with_vectors(named.select(*columns, "input"), "input", "id", embedder, dims).drop("input")
    counted = F.count(F.lit(1)).alias("n")
    if not limit:
        return index, blocks.filter("outcome is not null").groupBy("doc_key", F.col("outcome").alias("reason")).agg(counted)
    kept = articles.groupBy("doc_key").agg(counted).withColumn("reason", F.lit(chunks.KEPT))
    return index, kept.unionByName(blocks.filter(F.col("outcome") != chunks.KEPT).groupBy("doc_key", "reason").agg(counted))


def write_index(index: DataFrame, path: str) -> int:
    """Writes the index, articles in their order within a document, and tells its bytes; a large one is warned of."""
    num = F.regexp_extract("art", r"^(\d+)", 1).cast("long")
    index.repartition("doc").sortWithinPartitions("doc", num, "art").write.mode("overwrite").partitionBy("doc").parquet(path)
    spark = index.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    if size > LARGE_INDEX:
        warnings.warn(f"the index has {size} bytes", stacklevel=2)
    return size


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame | None, dict]:
    """The index and its status: ready, with its articles, documents and dimensions, or not, with a reason."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None, {"ready": False, "reason": "no index"}
    index = spark.read.parquet(path)
    found = index.agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("doc").alias("documents"), F.max(F.size("vec")).alias("dims"), F.min(F.size("vec")).alias("least")).first()
    if not found["articles"] or found["dims"] != found["least"]:
        return None, {"ready": False, "reason": "empty index" if not found["articles"] else "vectors of several lengths"}
    return index, {"ready": True, "articles": found["articles"], "documents": found["documents"], "dims": found["dims"]}
