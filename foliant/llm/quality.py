"""Quality classifier: hashed word n-gram logistic regression, FTRL-trained.

Features of a text are hashed n-grams of its words: single words, word pairs,
word endings (the last two bytes) and pairs of word shapes (letter case, kind of
the last byte, length class, whether the word repeats the one before).  Each
family's hits count 1/words, so a score is a sparse dot product: the mean of the
weights that the text's n-grams hit, plus a bias.

Training follows the regularised leader on a bounded sample: of the labelled
documents that are not held out, the ``train_rows`` of lowest hash.  That bound
is the only one; its features reach the driver as counted ids (about 10 kB a
document).  The weights (2**bits floats) are broadcast; scoring doesn't shuffle.

Defined results: a text that is null or has no words gets the bias' score; null
labels and labels without a document are ignored; a document labelled more than
once counts with its highest label; without labels all scores are 0.5; repeated
rows get equal scores; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U, fresh, id_crc, mix, segment_sum, text_chunks, words

BITS = 18
FAMILIES = 4

# letter 1, capital 2, digit 3, other ASCII 4, beyond ASCII 1
CLASS = np.full(256, 4, np.uint8)
CLASS[97:123] = CLASS[128:] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature ids, one row per family; word offsets of the documents)."""
    h, s, e, woff = words(buf, off)
    n = len(h)
    if not n:
        return np.zeros((FAMILIES, 0), np.int64), woff
    begins = np.zeros(n, bool)
    begins[woff[:-1][woff[:-1] < n]] = True
    previous = np.concatenate([np.zeros(1, U), h[:-1]])
    previous[begins] = 0
    last = buf[e - 1]
    second = np.where(e - s > 1, buf[np.maximum(e - 2, 0)], 0)
    with np.errstate(over="ignore"):
        shape = CLASS[buf[s]].astype(np.int64) * 5 + CLASS[second]
        shape = (shape * 5 + CLASS[last]) * 4 + np.minimum(3, (e - s) // 4)
        shape = shape * 2 + (h == previous)
        before = np.concatenate([np.zeros(1, np.int64), shape[:-1]])
        before[begins] = 999
        ids = np.stack([h, mix(previous * U(3) + h), mix(last.astype(U) * U(256) + second.astype(U) + U(1 << 20)), mix((before * 1000 + shape).astype(U) + U(1 << 40))])
    return (ids >> U(64 - bits)).astype(np.int64), woff


def sample_features(docs: DataFrame, bits: int) -> DataFrame:
    """label, text -> label, n (words), ids, counts: a text's distinct features."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts, sizes = [], [], []
            for _, n, buf, off in text_chunks(b.column("text")):
                f, woff = features(buf, off, bits)
                for d in range(n):
                    x, c = np.unique(f[:, woff[d] : woff[d + 1]], return_counts=True)
                    ids.append(x.astype(np.int32))
                    counts.append(c.astype(np.int32))
                    sizes.append(woff[d + 1] - woff[d])
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(sizes, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["label", "n", "ids", "counts"])

    return docs.select("label", "text").mapInArrow(emit, "label int, n int, ids array<int>, counts array<int>")


def ftrl(rows: list[tuple[int, int, np.ndarray, np.ndarray]], bits: int, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, scale: float = 4.0) -> tuple[np.ndarray, float]:
    """Per-coordinate FTRL-proximal; (weights, bias)."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for label, words_, ids, counts in rows:
            i = np.append(ids, size - 1)
            x = np.append(counts * (scale / max(1, words_)), 1.0)
            w = weight(i)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
            g = (p - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weight(np.arange(size))
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights from labelled documents that aren't held out: a bounded sample."""
    lab = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id"), 3) != 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # ids and labels of the sample: train_rows of them at most
    lab = docs.sparkSession.createDataFrame(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect(), lab.schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id").select("label", "text", F.xxhash64("doc_id").alias("o"))
    got = sample_features(rows, bits).toArrow()
    data = [(got["label"][i].as_py(), got["n"][i].as_py(), np.asarray(got["ids"][i].values), np.asarray(got["counts"][i].values)) for i in range(len(got))]
    # an order of its own for the updates, whatever the partitions were
    data.sort(key=lambda r: (hash((r[1], int(r[2].sum(dtype=np.int64)) if len(r[2]) else 0)), r[0]))
    return ftrl(data, bits) if data else (np.zeros(1 << bits, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score", bits: int = BITS) -> DataFrame:
    """docs with a column of scores; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats: 1 MB
    (name,) = fresh(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            parts = []
            for _, _, buf, off in text_chunks(b.column(text)):
                f, woff = features(buf, off, bits)
                hit = w[f].sum(0, dtype=np.float64)
                dot = segment_sum(hit, woff) / np.maximum(1, np.diff(woff)) + bias
                parts.append(1 / (1 + np.exp(-np.clip(dot, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=schema.names)

    return docs.mapInArrow(emit, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, train_rows))
    return scored.select("doc_id", (id_crc(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose text scores at least the threshold."""
    scored = score(docs, train(docs, labels))
    name = scored.columns[-1]
    return scored.where(F.col(name) >= threshold).drop(name)
