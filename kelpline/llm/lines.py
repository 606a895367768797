"""Line dedup: range-partitioned line hashes, streamed in order, answered with keep bitmaps.

Every line that counts is hashed to 128 bits. (hash, document, position) rows are range-partitioned over all three, so a line that is in
a third of all documents spans many partitions, and sorted; each partition then streams its rows, knows the first document of each hash
(across the border from a table of the partitions' borders, two rows for each), and drops the rest. What goes back to a document is one
compressed bitmap of the lines to keep; only that is joined with the texts.

Defined cases: a null or empty text is one empty line; lines whose key is shorter than ``MIN_CHARS`` code points stay; rows with the same
id count as one document and never lose lines to each other; a row without an id keeps its lines; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, checkpointed, n_partitions

#: Least code points of a key that is looked at.
MIN_CHARS = 10
_SPACE = ASCII_SPACE.encode()


def _keys(text: str | None) -> list[bytes]:
    """Keys of all lines in UTF-8, where lower-casing and stripping of ASCII bytes touch no other character."""
    return [x.strip(_SPACE) for x in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]


def _counts(key: bytes) -> bool:
    """Whether a key has enough code points."""
    return len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= MIN_CHARS)


def line_keys(text: str | None) -> list[str]:
    """Keys of all lines: ASCII white space stripped at both ends, A-Z lower-cased."""
    return [x.decode("utf-8", "surrogatepass") for x in _keys(text)]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        doc, row, at, digests = [], [], [], []
        for d, r, text in zip(pdf["doc_id"], pdf["row_hash"], pdf["text"], strict=True):
            keys = _keys(text)
            own = [i for i, key in enumerate(keys) if _counts(key)]
            doc.append(np.full(len(own), d, np.int64))
            row.append(np.full(len(own), r, np.int64))
            at.extend(own)
            digests.extend(xxhash.xxh3_128_digest(keys[i]) for i in own)
        pair = np.frombuffer(b"".join(digests), dtype=">i8").reshape(-1, 2).astype(np.int64)
        yield pd.DataFrame({"h1": pair[:, 0], "h2": pair[:, 1], "doc_id": np.concatenate(doc), "row_hash": np.concatenate(row), "at": np.array(at, np.int32)})


def _later(batches: Iterator[pd.DataFrame], first_of: dict[int, tuple[int, int, int]]) -> Iterator[pd.DataFrame]:
    """Rows of one sorted partition whose hash has an earlier document."""
    held = None
    for pdf in filter(len, batches):
        if held is None:
            held = first_of.get(int(pdf["pid"].iloc[0]))
        h1, h2, doc = (pdf[c].to_numpy() for c in ("h1", "h2", "doc_id"))
        new = np.ones(len(pdf), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = doc[np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))].copy()
        if held is not None and (held[0], held[1]) == (h1[0], h2[0]):
            head = int(np.argmax(new[1:]) + 1) if new[1:].any() else len(pdf)
            first[:head] = held[2]
        held = (int(h1[-1]), int(h2[-1]), int(first[-1]))
        drop = doc != first
        yield pdf.loc[drop, ["doc_id", "row_hash", "at"]]


def _keep_bits(gone: np.ndarray) -> np.ndarray:
    """A bit for each line, in whole bytes: 0 where it goes."""
    return np.packbits(np.bincount(gone, minlength=(int(gone.max()) // 8 + 1) * 8) == 0)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        bits = [zlib.compress(_keep_bits(np.asarray(x)).tobytes(), 1) for x in pdf["gone"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "row_hash": pdf["row_hash"], "keep_bits": bits, "n_dropped": [len(x) for x in pdf["gone"]]})


def kept_lines(text: str | None, keep_bits: bytes | None) -> list[str]:
    """Lines that a document keeps; no bitmap keeps all, and so do lines past its end."""
    lines = (text or "").split("\n")
    if keep_bits is None:
        return lines
    keep = np.ones(len(lines), bool)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep_bits), np.uint8)).astype(bool)
    n = min(len(bits), len(lines))
    keep[:n] = bits[:n]
    return [x for x, k in zip(lines, keep, strict=True) if k]


def dropped_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, keep_bits (zlib of a bit for each line up to the last dropped, 0 where it goes), n_dropped of the documents that lose lines."""
    # Kept, as the range partitioning reads its input twice: a hash isn't a border where one line is in a third of all documents.
    rows = checkpointed(docs.filter("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row_hash"), "text").mapInPandas(_hashed, "h1 long, h2 long, doc_id long, row_hash long, at int"))
    order = ["h1", "h2", "doc_id", "row_hash", "at"]
    ranged = checkpointed(rows.repartitionByRange(n_partitions(docs), *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id()))
    # The borders: first and last row of each partition.
    key = F.struct("h1", "h2", "doc_id")
    last = F.max(F.struct("h1", "h2"))
    borders = ranged.groupBy("pid").agg(F.min(key).alias("lo"), last.alias("hi")).orderBy("pid").collect()
    tails = ranged.join(F.broadcast(ranged.groupBy("pid").agg(last.alias("hi"))), "pid").filter((F.col("h1") == F.col("hi.h1")) & (F.col("h2") == F.col("hi.h2"))).groupBy("pid").agg(F.min("doc_id").alias("first_doc"))
    tail = {r["pid"]: r["first_doc"] for r in tails.collect()}
    first_of: dict[int, tuple[int, int, int]] = {}
    held = None
    for r in borders:
        if held is not None and held[:2] == (r["lo"]["h1"], r["lo"]["h2"]):
            first_of[r["pid"]] = held
        hi = (r["hi"]["h1"], r["hi"]["h2"])
        if not (held is not None and held[:2] == hi):
            held = (*hi, tail[r["pid"]])
    drops = ranged.mapInPandas(lambda it: _later(it, first_of), "doc_id long, row_hash long, at int")
    lists = drops.groupBy("doc_id", "row_hash").agg(F.collect_set("at").alias("gone"))
    return lists.mapInPandas(_packed, "doc_id long, row_hash long, keep_bits binary, n_dropped long")


def with_bitmaps(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text) with keep_bits, null where all lines stay."""
    marks = dropped_bitmaps(docs)
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash")).join(marks, ["doc_id", "row_hash"], "left")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in filter(len, batches):
        texts = ["\n".join(kept_lines(t, b)) for t, b in zip(pdf["text"], pdf["keep_bits"], strict=True)]
        yield pd.DataFrame({
            "doc_id": pdf["doc_id"],
            "n_lines": [(t or "").count("\n") + 1 for t in pdf["text"]],
            "n_dropped": pdf["n_dropped"],
            "kept_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
        })


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    marked = with_bitmaps(docs.filter("doc_id is not null")).withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0)).cast("long"))
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    # Apart, as pandas would turn the ids of a batch with a null one into floating-point numbers.
    lone = docs.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("binary").alias("keep_bits"), F.lit(0).cast("long").alias("n_dropped"))
    return marked.mapInPandas(_digests, schema).unionByName(lone.mapInPandas(_digests, schema))
