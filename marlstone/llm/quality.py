"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader (FTRL-proximal) updates and scored as a sparse
dot product.

A text is cut into words (runs of letters, digits and other non-ASCII signs)
and marks (runs of ASCII punctuation), ASCII letters in lower case. Features
are hashed word unigrams and bigrams; a bigram of a word with itself falls in
one shared bucket, so that stuttering text is seen in words never met before.
A feature's value is SCALE times its share of the text's features, which makes
a score a mean of weights and needs no per-text sort.

Defined cases: a null or empty text has no features and scores the bias; rows
with a null label or id don't train; with no training rows all weights are 0
and every score is 0.5; repeated rows count each time; extra columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

#: Buckets of the hashed feature space: the model is BUCKETS + 1 doubles, whatever the corpus.
BUCKETS = 1 << 18
SCALE = 24.0
#: At most so many labelled rows train; a larger labelled set is sampled by a hash of the id.
MAX_TRAIN_ROWS = 8000
EPOCHS = 2

#: 0 white space, 1 words, 2 marks.
_KIND = np.full(256, 1, np.uint8)
_KIND[:128] = 2
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[K.SPACE] = 0


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, texts one after another, and where each text's begin."""
    starts, ends, at = K.runs(_KIND[data], offsets)
    n_rows = len(offsets) - 1
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    h = K.hash_spans(K.prefix(K.byte_values()[K.LOWER[data]]), starts, ends)
    pair = K.mix(h[:-1] * K.U(3) + h[1:])
    pair[h[:-1] == h[1:]] = 0
    row = np.repeat(np.arange(n_rows), np.diff(at))
    inside = np.flatnonzero(row[1:] == row[:-1])
    # each word is followed by the bigram that begins with it; the last of a text has none
    slot = np.arange(len(h)) * 2 - row
    out = np.empty(2 * len(h) - int((np.diff(at) > 0).sum()), np.int64)
    gaps = np.diff(at) == 0
    slot += np.cumsum(gaps)[row]
    out[slot] = (h % K.U(BUCKETS)).astype(np.int64)
    out[slot[inside] + 1] = (pair[inside] % K.U(BUCKETS)).astype(np.int64)
    counts = np.diff(at)
    return out, np.concatenate([[0], np.cumsum(np.maximum(2 * counts - 1, 0))])


def _scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    f, at = features(data, offsets)
    total = np.concatenate([[0.0], np.cumsum(weights[f])])
    n = np.diff(at)
    z = weights[BUCKETS] + SCALE * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.1, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (BUCKETS and the bias) after FTRL-proximal steps over (buckets, values, label)."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def lazy(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = lazy(i)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -40, 40)))
            g = (p - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return lazy(np.arange(BUCKETS + 1))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in K.pieces(batch.column("text")):
            f, at = features(data, offsets)
            for k in range(hi - lo):
                i, count = np.unique(f[at[k] : at[k + 1]], return_counts=True)
                rows.append((np.append(i, BUCKETS), np.append(SCALE * count / max(1, count.sum()), 1.0), int(labels[lo + k])))
    yield pa.RecordBatch.from_pydict({"weights": pa.array([ftrl(rows).astype("<f8").tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> np.ndarray:
    """Weights learnt from labelled texts: docs (doc_id, text), labels (doc_id, label).

    One task trains, on max_rows rows at most, taken in the order of a hash of
    the id: the same for any partitioning of the input.
    """
    order = [F.xxhash64(F.col("doc_id")), F.col("doc_id"), F.col("label")]
    few = labels.select("doc_id", F.col("label").cast("int").alias("label")).dropna().orderBy(*order).limit(max_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # few: max_rows rows of 12 bytes
    sample = sample.orderBy(*order, "text").limit(max_rows).coalesce(1).select("label", "text")
    got = sample.mapInArrow(_train, "weights binary").collect()
    return np.frombuffer(got[0][0], "<f8") if got else np.zeros(BUCKETS + 1)


def _score(batches: Iterator[pa.RecordBatch], weights) -> Iterator[pa.RecordBatch]:
    w = weights.value
    for batch in batches:
        score = [np.zeros(0)] + [_scores(data, offsets, w) for _, _, data, offsets in K.pieces(batch.column("text"))]
        columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True)] + [pa.array(np.concatenate(score))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "quality_score"])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with quality_score, the probability of label 1; the model is BUCKETS + 1 doubles on any corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.drop("quality_score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(partial(_score, weights=shared), f"{fields}, quality_score double")


def fold(doc_id) -> "F.Column":
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and quality_score by a model that never saw fold 1."""
    seen = labels.select("doc_id", F.col("quality").alias("label")).filter(fold(F.col("doc_id")) != 1)
    return score(docs.select("doc_id", "text"), train(docs, seen))
