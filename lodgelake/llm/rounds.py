"""Lookups of chunks of documents in tables of the whole corpus, by two shuffles and without a broadcast.

A chunk is a group of documents of about ``CHUNK_BYTES`` bytes of text.  It asks once for each distinct 64-bit
key it holds: the keys, sorted, are cut into ranges (buckets) and travel packed, by the gaps between them,
with whatever the chunk knows about each.  A bucket sees every chunk's keys of its range, works out the answer
to each and sends these back in the order asked, so the keys don't travel again: the chunk, which can work
out its keys again, meets its answers by a co-group.

So a frequent key costs one entry per chunk and not per occurrence, a bucket holds no text, and no task
holds more than a chunk or a range of keys.  Documents are shuffled once; every round reads that exchange.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 12 << 20

Arrays = list[np.ndarray]
BITS = "bits"  # dtype of an answer of one bit


def text_volume(docs: DataFrame) -> int:
    row = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 32)).first()
    return int(row[0] or 0)


def by_hash(docs: DataFrame, volume: int) -> DataFrame:
    """``docs`` with ``_chunk``, by hash; rows of one id with other texts are spread."""
    n = max(1, math.ceil(volume / CHUNK_BYTES))
    return docs.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as gaps of as few whole bytes as serve best; a gap that doesn't fit stands apart."""
    if not len(keys):
        return b""
    used = int(np.bitwise_or.reduce(keys))
    shift = (used & -used).bit_length() - 1 if used else 0  # low bits that no key uses
    gaps = np.diff(keys >> np.uint64(shift), prepend=np.uint64(0))
    top = np.sort(gaps)
    cost = [(w * len(gaps) + 8 * (len(gaps) - int(np.searchsorted(top, np.uint64((1 << 8 * w) - 1)))), w)
            for w in range(1, 8)]
    w = min([*cost, (8 * len(gaps), 8)])[1]
    if w == 8:
        return bytes([w, shift]) + gaps.astype("<u8").tobytes()
    most = np.uint64((1 << 8 * w) - 1)
    far = gaps >= most
    small = np.where(far, most, gaps).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w]
    return bytes([w, shift]) + small.tobytes() + gaps[far].astype("<u8").tobytes() + int(far.sum()).to_bytes(8, "little")


def unpack_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    w, shift = raw[0], np.uint64(raw[1])
    if w == 8:
        return np.cumsum(np.frombuffer(raw, "<u8", offset=2), dtype=np.uint64) << shift
    n_far = int.from_bytes(raw[-8:], "little")
    n = (len(raw) - 10 - 8 * n_far) // w
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :w] = np.frombuffer(raw, np.uint8, n * w, 2).reshape(n, w)
    gaps = wide.view("<u8").ravel()
    if n_far:
        gaps[gaps == (1 << 8 * w) - 1] = np.frombuffer(raw, "<u8", n_far, 2 + n * w)
    return np.cumsum(gaps, dtype=np.uint64) << shift


def buckets(volume: int) -> int:
    return max(1, math.ceil(volume / BUCKET_BYTES))


def cuts(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall in, and the bounds of each one's keys."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    names, first = np.unique(bucket, return_index=True)
    return names, np.append(first, len(keys))


def ask(chunks: DataFrame, n_buckets: int, request: Callable[..., Arrays], dtypes: list[str] = (),
        replies: DataFrame | None = None) -> DataFrame:
    """Packed requests.  ``request(table)`` gives sorted distinct uint64 keys and, for each, arrays of ``dtypes``;
    with ``replies`` of the round before, ``request(table, replies)``."""
    def pack(chunk: int, arrays: Arrays) -> pa.Table:
        names, at = cuts(arrays[0], n_buckets)
        ranges = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
        out = {"_bucket": pa.array(names, pa.int32()), "_chunk": pa.array([chunk] * len(names), pa.int32()),
               "keys": pa.array([pack_keys(arrays[0][a:b]) for a, b in ranges], pa.binary())}
        for i, (x, t) in enumerate(zip(arrays[1:], dtypes, strict=True)):
            x = x.astype(t)
            out[f"a{i}"] = pa.array([x[a:b].tobytes() for a, b in ranges], pa.binary())
        return pa.table(out)

    schema = "_bucket int, _chunk int, keys binary" + "".join(f", a{i} binary" for i in range(len(dtypes)))
    if replies is None:
        return chunks.groupBy("_chunk").applyInArrow(
            lambda t: pack(t.column("_chunk")[0].as_py(), request(t)), schema)
    return chunks.groupBy("_chunk").cogroup(replies.groupBy("_chunk")).applyInArrow(
        lambda t, r: pack(t.column("_chunk")[0].as_py(), request(t, r)), schema)


def answer(requests: DataFrame, dtypes: list[str], reply: Callable[..., tuple[np.ndarray, dict]], dtype: str,
           extra: tuple[str, ...] = ()) -> DataFrame:
    """``reply(keys, chunk, *arrays)`` sees all entries of a bucket (``chunk``: who asks); it gives an answer to each,
    and the values of ``extra`` for the bucket."""
    def run(t: pa.Table) -> pa.Table:
        chunks = t.column("_chunk").to_numpy()
        keys = [unpack_keys(x.as_py()) for x in t.column("keys")]
        size = [len(x) for x in keys]
        arrays = [np.concatenate([np.frombuffer(x.as_py(), d) for x in t.column(f"a{i}")])
                  for i, d in enumerate(dtypes)]
        got, values = reply(np.concatenate(keys), np.repeat(chunks, size), *arrays)
        got = got.astype(bool if dtype == BITS else dtype)
        at = np.concatenate([[0], np.cumsum(size)]).tolist()
        parts = [got[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        out = {"_chunk": pa.array(chunks, pa.int32()), "_bucket": t.column("_bucket"),
               "answer": pa.array([(np.packbits(x) if dtype == BITS else x).tobytes() for x in parts], pa.binary())}
        for name in extra:  # once per bucket
            out[name] = pa.array([values[name]] + [0] * (len(chunks) - 1), pa.int64())
        return pa.table(out)

    return requests.groupBy("_bucket").applyInArrow(
        run, "_chunk int, _bucket int, answer binary" + "".join(f", {c} bigint" for c in extra))


def answers(replies: pa.Table, keys: np.ndarray, n_buckets: int, dtype: str) -> np.ndarray:
    """A chunk's answers, in the order of its sorted keys."""
    names, at = cuts(keys, n_buckets)
    raw = dict(zip(replies.column("_bucket").to_pylist(), replies.column("answer").to_pylist(), strict=True))
    out = np.zeros(len(keys), bool if dtype == BITS else dtype)
    for name, a, b in zip(names.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        out[a:b] = np.unpackbits(np.frombuffer(raw[name], np.uint8), count=b - a) if dtype == BITS \
            else np.frombuffer(raw[name], dtype)
    return out
