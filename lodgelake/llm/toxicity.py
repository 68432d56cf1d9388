"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is a run of letters, digits and non-ASCII bytes, A-Z lower-cased.  Its subwords are the word itself and its
N_GRAMS-byte grams with a mark before and after it, hashed into BUCKETS vectors; a word is the mean of its subwords, a
document the mean of its words, each distinct one weighing the square root of its count, and of NEUTRAL zero vectors.  A softmax layer gives P(toxic).  Vectors and layer are trained jointly by
minibatch gradient descent with per-parameter steps (Adagrad) in numpy.  In training the word's own bucket is
left out of every second epoch, so the grams carry the meaning and a misspelling never seen scores by those it shares.

Training rows are a bounded sample: the SAMPLE labelled documents with the smallest hash of their id, of those
whose id's crc32 mod 5 is not 0; one text an id (that of the smallest hash).  Executors turn each into its distinct
words and their counts, which is all that the driver gets.  After training each bucket adds one number to a
word, so the model that goes to the executors is BUCKETS numbers; a pass of text looks the subwords of each
of its distinct words up once.  Labels, lang, source and doc_id are never features; whole texts are scored.

Null or empty text, or one without words: no feature, so the score is that of the layer's bias.  A null doc_id counts as
empty text in the held-out rule.  Several labels of one document: toxic if any says so; null labels are left
out.  Without any training row every score is 0.5.  Repeated rows are scored each.  An empty table gives an
empty result.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import LOWER, mix, passes, pick, span_hashes, spans, text_bytes

BUCKETS, DIM, N_GRAMS = 1 << 17, 8, (2, 3, 4, 5)
SAMPLE, EPOCHS, BATCH, RATE = 8000, 5, 64, 0.1
INIT = 1e-6
SCALE = 800.0  # of the mean, so that a word among hundreds can decide
MIN_DOCUMENTS = 10  # of the sample that hold a subword, else it is left out
NEUTRAL = 12  # zero vectors averaged into every document, so that a handful of words is no strong evidence
THRESHOLD = 0.5

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_BEFORE, _AFTER = 2, 3  # marks around a word


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words ``data[start:end]`` and for each the index of its word; a word's own bucket comes first."""
    size = end - start + 2
    off = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(start)), size)
    inner = np.arange(off[-1]) - off[:-1][word]
    edge = (inner == 0) | (inner == size[word] - 1)
    marked = np.where(inner == 0, _BEFORE, _AFTER).astype(np.uint8)
    marked[~edge] = data[(start[word] + inner - 1)[~edge]]
    key, of = [mix(span_hashes(data, start, end) + np.uint64(1))], [np.arange(len(start))]
    wide = marked.astype(np.uint64)
    code = np.zeros(len(wide), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        m = len(wide) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint64(8)) | wide[n - 1:]
        if n in N_GRAMS:
            own = word[:m] == word[n - 1:]
            key.append(mix((code[own] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)))
            of.append(word[:m][own])
    return (np.concatenate(key) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(of)


def distinct_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; start and end of each distinct word; the document and the distinct word of every word."""
    low = LOWER[data]
    start, end, doc = spans(low, off, _GAP)
    _, first, which = np.unique(span_hashes(low, start, end), return_index=True, return_inverse=True)
    return low, start[first], end[first], doc, which


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each document and their counts."""
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for i in range(batch.num_rows):
            own = off[i:i + 2]
            low, start, end, _, which = distinct_words(data[own[0]:own[1]], own - own[0])
            words = [low[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:i + 1], batch.column("_label")[i:i + 1], pa.array([words], pa.list_(pa.binary())),
                 pa.array([np.bincount(which, minlength=len(start))], pa.list_(pa.int32()))],
                ["doc_id", "_label", "words", "n"])


def train(words: tuple[np.ndarray, np.ndarray], docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray,
          seed: int = 3) -> tuple[np.ndarray, float]:
    """(one number per bucket, bias).  ``words``: buckets of all distinct words, word by word, own bucket first, and whose they are;
    ``docs``: each document's words and their weights.  P(toxic) is the logistic of the documents' mean number plus bias."""
    rng = np.random.default_rng(seed)
    bucket, of = words
    at = np.concatenate([[0], np.cumsum(np.bincount(of))])

    def flatten(w: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        size = at[w + 1] - at[w] - skip
        first = at[w] + skip - np.concatenate([[0], np.cumsum(size)[:-1]])
        return bucket[np.repeat(first, size) + np.arange(size.sum())], size

    seen_in = np.zeros(BUCKETS, np.int64)
    for w, _ in docs:
        seen_in[np.unique(flatten(w)[0])] += 1
    known = seen_in >= MIN_DOCUMENTS
    vectors = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) * known[:, None]
    layer, bias = rng.normal(0, 0.05, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    seen_v, seen_l, seen_b = (np.full(shape, INIT, np.float32) for shape in ((BUCKETS, 1), (DIM, 2), 2))
    for epoch in range(EPOCHS):
        skip = epoch % 2  # 1: without the words' own buckets
        turn = rng.permutation(len(docs))
        for low in range(0, len(turn), BATCH):
            rows = turn[low:low + BATCH]
            w = np.concatenate([docs[r][0] for r in rows])
            share = np.concatenate([docs[r][1] / (docs[r][1].sum() + NEUTRAL) for r in rows])
            row = np.repeat(np.arange(len(rows)), [len(docs[r][0]) for r in rows])
            flat, size = flatten(w, skip)
            each = np.repeat(np.arange(len(w)), size)
            weight = (share / np.maximum(size, 1))[each].astype(np.float32)
            weight, flat, each = (x[known[flat]] for x in (weight, flat, each))
            used, slot = np.unique(flat, return_inverse=True)
            bag = np.bincount(row[each] * len(used) + slot, weight, len(rows) * len(used)) \
                .reshape(len(rows), -1).astype(np.float32)
            bag *= SCALE
            mean = bag @ vectors[used]
            logit = mean @ layer + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), label[rows]] -= 1
            p /= len(rows)
            grad_l, grad_b = mean.T @ p, p.sum(axis=0)
            grad_v = bag.T @ (p @ layer.T)
            seen_v[used] += (grad_v ** 2).mean(axis=1, keepdims=True)
            seen_l += grad_l ** 2
            seen_b += grad_b ** 2
            vectors[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            layer -= RATE * grad_l / np.sqrt(seen_l)
            bias -= RATE * grad_b / np.sqrt(seen_b)
    return SCALE * (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def _all_subwords(words: pa.Array, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """``subwords`` of many words, ``step`` of them at a time."""
    bucket, of = [], []
    for a in range(0, len(words), step):
        data, off = text_bytes(words[a:a + step])
        b, w = subwords(data[off[0]:off[-1]], off[:-1] - off[0], off[1:] - off[0])
        order = np.argsort(w, kind="stable")  # a word's own bucket stays first
        bucket.append(b[order].astype(np.int32))
        of.append((w[order] + a).astype(np.int32))
    return np.concatenate(bucket), np.concatenate(of)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    lab = pick(labels, {"doc_id": "bigint", "toxic": "int"}).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("_label"))
    chosen = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the bounded sample
    rows = pick(docs, {"doc_id": "bigint", "text": "string"}).join(F.broadcast(chosen), "doc_id") \
        .groupBy("doc_id").agg(F.first("_label").alias("_label"), F.min_by("text", F.xxhash64("text")).alias("text")) \
        .mapInArrow(_word_counts, "doc_id bigint, _label int, words array<binary>, n array<int>").toArrow()
    rows = rows.sort_by("doc_id").combine_chunks()  # whatever order the tasks ended in
    if not rows.num_rows or not len(words := rows["words"].combine_chunks().flatten()):
        return np.zeros(BUCKETS), 0.0
    words = words.dictionary_encode()
    weight = np.sqrt(rows["n"].combine_chunks().flatten().to_numpy())
    ends = np.cumsum([len(x) for x in rows["n"]])[:-1]
    docs_ = list(zip(np.split(words.indices.to_numpy(), ends), np.split(weight, ends), strict=True))
    full = [k for k, (w, _) in enumerate(docs_) if len(w)]
    return train(_all_subwords(words.dictionary), [docs_[k] for k in full], rows["_label"].to_numpy()[full])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents' columns with held_out, score (P(toxic)) and predicted."""
    number, bias = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            logit = np.full(batch.num_rows, bias)
            for i, j in passes(off):
                own = off[i:j + 1]
                low, start, end, doc, which = distinct_words(data[own[0]:own[-1]], own - own[0])
                if not len(which):
                    continue
                bucket, of = subwords(low, start, end)
                each = np.bincount(of, number[bucket]) / np.bincount(of)
                pair, n = np.unique(doc * len(each) + which, return_counts=True)
                of, weight = pair // len(each), np.sqrt(n)
                logit[i:j] += np.bincount(of, weight * each[pair % len(each)], j - i) \
                    / (np.bincount(of, weight, j - i) + NEUTRAL)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))],
                                             [*batch.schema.names, "score"])

    d = pick(docs)
    return d.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in d.dtypes) + ", score double") \
        .withColumn("held_out", held_out(F.col("doc_id"))) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op11(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; see the module for nulls, empty texts and repeats."""
    return score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
