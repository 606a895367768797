"""Quality classifier: a byte-level convolutional network in numpy.

A document's bytes are embedded, learned filters run over them, and their answers are max-pooled over chunks of two blocks that overlap
by one block, so every byte of the document is covered. The mean and the maximum of the chunks' features, over the whole document, go
into one logistic unit.

The network is fitted on the driver on a bounded sample of labelled rows with their whole texts: the first ``SAMPLE`` rows in the order of a hash of
the id, as far as they are ``SAMPLE_BYTES`` together; texts of more than ``SAMPLE_TEXT`` bytes aren't drawn. Scoring uses whole texts, in pieces of bounded size.

Defined cases: null and empty texts are scored as one block of padding; without labelled rows every score is the untrained network's;
repeated rows are scored alike, and drawn once; labels other than 0 and 1, or null, and ids with both labels are left out; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

#: Labelled rows that the network is fitted on, their bytes together, and those of one text.
SAMPLE, SAMPLE_BYTES, SAMPLE_TEXT = 4000, 32 << 20, 1 << 20
BLOCK, STRIDE, WIDTH, DIMS, FILTERS = 128, 2, 8, 4, 16
EPOCHS, BATCH, RATE, SEED = 14, 32, 0.01, 7
#: Bytes that one numpy pass holds.
PIECE = 1 << 20
THRESHOLD = 0.3
_PAD = np.zeros(WIDTH, np.uint8)


def blocks_of(data: bytes) -> np.ndarray:
    """The bytes in whole blocks, padded so that no filter reaches the next document."""
    n = (len(data) + WIDTH) // BLOCK + 1
    out = np.zeros(n * BLOCK, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


class Network:
    """Parameters: byte embedding (row 0 is padding), filters, their offsets, output weights for means and maxima, output offset."""

    def __init__(self, params: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(SEED)
        self.p = params or {
            "embed": np.concatenate([np.zeros((1, DIMS)), rng.normal(0, 0.5, (255, DIMS))]).astype(np.float32),
            "filters": rng.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)).astype(np.float32),
            "offsets": np.zeros(FILTERS, np.float32),
            "mean": rng.normal(0, 0.1, FILTERS).astype(np.float32),
            "top": rng.normal(0, 0.1, FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def _pooled(self, data: np.ndarray, after: np.ndarray = _PAD) -> tuple[np.ndarray, np.ndarray]:
        """(inputs of the filters, answers by block x place x filter). after: the bytes that follow, for the last places."""
        x = self.p["embed"][np.r_[data, after]]
        n = len(data) // STRIDE
        view = np.lib.stride_tricks.as_strided(x, (n, WIDTH * DIMS), (STRIDE * DIMS * 4, 4))
        inputs = np.ascontiguousarray(view)
        return inputs, (inputs @ self.p["filters"] + self.p["offsets"]).reshape(-1, BLOCK // STRIDE, FILTERS)

    @staticmethod
    def _chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second block of each chunk, and where each document's chunks start."""
        ends = np.cumsum(counts)
        chunk_counts = np.maximum(counts - 1, 1)
        starts = np.r_[0, np.cumsum(chunk_counts)[:-1]]
        left = np.arange(chunk_counts.sum()) - np.repeat(starts, chunk_counts) + np.repeat(ends - counts, chunk_counts)
        right = np.minimum(left + 1, np.repeat(ends, chunk_counts) - 1)
        return left, right, starts

    def features(self, data: np.ndarray, counts: np.ndarray, after: np.ndarray = _PAD) -> np.ndarray:
        left, right, starts = self._chunks(counts)
        best = self._pooled(data, after)[1].max(1)
        chunk = np.maximum(np.maximum(best[left], best[right]), 0)
        n = np.diff(np.r_[starts, len(left)])
        return np.concatenate([np.add.reduceat(chunk, starts) / n[:, None], np.maximum.reduceat(chunk, starts)], 1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for a, b in slices([len(x) for x in data], PIECE):
            parts = [blocks_of(x) for x in data[a:b]]
            f = self._features_in_parts(parts[0]) if len(parts) == 1 else self.features(np.concatenate(parts), np.array([len(x) // BLOCK for x in parts]))
            out[a:b] = f @ np.r_[self.p["mean"], self.p["top"]].astype(np.float64) + self.p["bias"][0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def _features_in_parts(self, data: np.ndarray) -> np.ndarray:
        """One document of any length: parts overlap by one block, as chunks do."""
        blocks, most = len(data) // BLOCK, PIECE // BLOCK
        if blocks <= most:
            return self.features(data, np.array([blocks]))
        total, top, n = 0.0, 0.0, 0
        for k in range(0, blocks - 1, most):
            part = data[k * BLOCK : min(blocks, k + most + 1) * BLOCK]
            after = data[k * BLOCK + len(part) :][:WIDTH]
            f = self.features(part, np.array([len(part) // BLOCK]), np.r_[after, _PAD[len(after) :]])[0]
            c = len(part) // BLOCK - 1
            total, top, n = total + f[:FILTERS] * c, np.maximum(top, f[FILTERS:]), n + c
        return np.r_[total / n, top][None, :]

    def gradients(self, data: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        left, right, starts = self._chunks(counts)
        inputs, answers = self._pooled(data)
        place, best = answers.argmax(1), answers.max(1)
        use_right = best[right] > best[left]
        raw = np.where(use_right, best[right], best[left])
        chunk = np.maximum(raw, 0)
        n = np.diff(np.r_[starts, len(left)])
        doc = np.repeat(np.arange(len(counts)), n)
        mean, top = np.add.reduceat(chunk, starts) / n[:, None], np.maximum.reduceat(chunk, starts)
        err = (1 / (1 + np.exp(-(mean @ p["mean"] + top @ p["top"] + p["bias"][0]))) - label) / len(label)
        is_top = chunk == top[doc]
        ties = np.add.reduceat(is_top.astype(np.float32), starts)[doc]
        g = err[doc][:, None] * (p["mean"] / n[doc][:, None] + p["top"] * is_top / ties) * (raw > 0)
        block = np.where(use_right, right[:, None], left[:, None])
        spot = block * (BLOCK // STRIDE) + np.take_along_axis(place, block, 0)
        g_filters, g_embed = np.empty_like(p["filters"]), np.zeros_like(p["embed"])
        padded = np.r_[data, np.zeros(WIDTH, np.uint8)]
        for f in range(FILTERS):
            g_filters[:, f] = inputs[spot[:, f]].T @ g[:, f]
            for k in range(WIDTH):
                by_byte = np.bincount(padded[spot[:, f] * STRIDE + k], g[:, f], 256)
                g_embed += np.outer(by_byte, p["filters"][k * DIMS : (k + 1) * DIMS, f])
        g_embed[0] = 0
        return {"embed": g_embed, "filters": g_filters, "offsets": g.sum(0), "mean": mean.T @ err, "top": top.T @ err, "bias": err.sum(keepdims=True)}

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> Network:
        """Adam on the logistic loss, in a seeded order."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        steps = EPOCHS * -(-len(docs) // BATCH)
        t = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                grads = self.gradients(np.concatenate([docs[i] for i in pick]), np.array([len(docs[i]) // BLOCK for i in pick]), labels[pick])
                t += 1
                rate = RATE * (1 - t / (steps + 1))
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits the network to (doc_id, quality) rows. What the driver gets is SAMPLE rows of SAMPLE_BYTES together at most."""
    one = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    drawn = one.select("doc_id", "quality", F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(SAMPLE)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text").filter(size <= SAMPLE_TEXT).join(F.broadcast(drawn), "doc_id").distinct()
    first = rows.orderBy("draw", "doc_id", F.xxhash64("text"), "text").limit(SAMPLE)
    # A running sum over SAMPLE rows at most.
    upto = Window.orderBy("draw", "doc_id", F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    sample = first.withColumn("upto", F.sum(size).over(upto)).filter(F.col("upto") <= SAMPLE_BYTES).select("text", "quality", "upto").collect()
    net = Network()
    if sample:
        net.fit([blocks_of((r["text"] or "").encode("utf-8", "surrogatepass")) for r in sample], np.array([r["quality"] for r in sample], np.float32))
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in batches:
            s = own.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array(s >= THRESHOLD).cast(pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
