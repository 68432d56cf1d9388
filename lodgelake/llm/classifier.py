"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and of its hashed character n-grams (N_GRAMS
bytes, within the document), a pair of equal successive words counting as a word of its own; a softmax layer gives P(label 1).  Vectors and layer are trained by minibatch
stochastic gradient descent in numpy.

Training rows are a bounded sample: the SAMPLE labelled documents with the smallest hash of their id, of those
whose id's crc32 mod 5 is not 0.  Executors turn each into bucket counts (at most BUCKETS numbers a row, whatever
the text's length), so what reaches the driver is bounded.  After training each bucket adds one number to a
document's score, so the model that goes to the executors is BUCKETS numbers.  Labels, lang, source and
doc_id are never features; whole texts are scored.

Null or empty text: no feature, so the score is that of the layer's bias.  A null doc_id counts as empty text
in the held-out rule.  Several labels of one document: the lowest counts; null labels are left out.  Of several texts of one id that of the
smallest hash is learned from.  Without
any training row every score is 0.5.  Repeated rows are scored each.  An empty table gives an empty result.
Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import mix, passes, pick, span_hashes, spans, text_bytes

BUCKETS, DIM, N_GRAMS = 1 << 16, 12, (3, 4)
SAMPLE, EPOCHS, BATCH, RATE = 4000, 5, 32, 0.7
THRESHOLD = 0.3
_SAME_WORD = 0x5DEECE66D1234567


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of every word, every n-gram, and every pair of equal successive words (one bucket)."""
    start, end, doc = spans(data, off)
    h = span_hashes(data, start, end)
    same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
    out, of = [mix(h + np.uint64(1)), np.full(len(same), _SAME_WORD, np.uint64)], [doc, doc[same]]
    each = np.repeat(np.arange(len(off) - 1), np.diff(off))
    wide = data.astype(np.uint64)
    code = np.zeros(len(data), np.uint64)
    for k in range(1, max(N_GRAMS) + 1):
        m = len(data) - k + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | wide[k - 1:]
        if k in N_GRAMS:
            own = each[:m] == each[k - 1:]
            out.append(mix((code[own] + np.uint64(k << 56)) * np.uint64(0x9E3779B97F4A7C15)))
            of.append(each[:m][own])
    return (np.concatenate(out) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(of)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for i, j in passes(off):
            own = off[i:j + 1]
            bucket, doc = features(data[own[0]:own[-1]], own - own[0])
            for d in range(j - i):
                u, n = np.unique(bucket[doc == d], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i + d:i + d + 1], batch.column("_label")[i + d:i + d + 1],
                     pa.array([u.astype(np.int32)], pa.list_(pa.int32())),
                     pa.array([n.astype(np.int32)], pa.list_(pa.int32()))],
                    ["doc_id", "_label", "bucket", "n"])


def train(bags: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 5) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias): P(label 1) is the logistic of the mean number of a document plus the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    weight = [(n / n.sum()).astype(np.float32) for _, n in bags]
    steps, step = EPOCHS * -(-len(bags) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([weight[r] @ vectors[bags[r][0]] for r in rows])
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            back = p @ layer.T
            layer -= rate * mean.T @ p / len(rows) * 4
            bias -= rate * p.sum(axis=0) / len(rows)
            for k, r in enumerate(rows):  # buckets of one bag are distinct
                vectors[bags[r][0]] -= rate * 4 * weight[r][:, None] * back[k]
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    lab = pick(labels, {"doc_id": "bigint", "quality": "int"}).where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0))
    lab = lab.groupBy("doc_id").agg(F.min("quality").alias("_label"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bounded sample
    rows = pick(docs, {"doc_id": "bigint", "text": "string"}).join(F.broadcast(chosen), "doc_id") \
        .groupBy("doc_id").agg(F.first("_label").alias("_label"), F.min_by("text", F.xxhash64("text")).alias("text")) \
        .select("doc_id", "_label", "text").mapInArrow(_bags, "doc_id bigint, _label int, bucket array<int>, n array<int>").toArrow()
    bags, label, ids = [], [], []
    cols = [rows.column(c) for c in ("doc_id", "_label", "bucket", "n")]
    for d, y, b, n in zip(*cols, strict=True):
        if len(b.values):
            ids.append(d.as_py())
            label.append(min(max(y.as_py(), 0), 1))
            bags.append((b.values.to_numpy().astype(np.int64), n.values.to_numpy()))
    if not bags:
        return np.zeros(BUCKETS), 0.0
    order = np.lexsort(([int(b[0].sum()) for b in bags], ids))  # whatever order the tasks ended in
    return train([bags[i] for i in order], np.array(label)[order])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents' columns with held_out, score and predicted."""
    number, bias = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            score = np.full(batch.num_rows, bias)
            for i, j in passes(off):
                own = off[i:j + 1]
                bucket, doc = features(data[own[0]:own[-1]], own - own[0])
                n = np.bincount(doc, minlength=j - i)
                score[i:j] += np.bincount(doc, number[bucket], minlength=j - i) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-score)))],
                                             [*batch.schema.names, "score"])

    d = pick(docs)
    return d.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", score double") \
        .withColumn("held_out", fold(F.col("doc_id")) == 0) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see the module for nulls, empty texts and repeats."""
    return classify(docs, labels).select("doc_id", "held_out", "score", "predicted")
