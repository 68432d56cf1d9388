"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Difference-cover blockwise construction, on Spark.  Only the order of suffixes up to LENGTH bytes matters, so two
suffixes tie when their first LENGTH bytes are equal.

* Cover: the places p of a document with p mod PERIOD in COVER, a difference cover.  Any two places i, j have a
  common d < PERIOD with i + d and j + d in the cover.  So two equal LENGTH-byte strings hold, at the same
  offset, two equal cover samples of LENGTH - PERIOD + 1 bytes.  Samples are ranked first; of the ranks only
  this is needed: does the sample stand in another document as well?  A suffix none of whose PERIOD cover
  places does is unique and never sorted.
* Blocks: the suffixes left are dealt to buckets by a range of their first LENGTH bytes' 64-bit fingerprint, which
  stands in for the bytes.  Each bucket sorts its suffixes alone and finds for every tie whether a document of
  a smaller chunk has it.  Chunks are ranges of doc_id, so a chunk's number is enough to compare with.
* Long ties: whole copies are found first by two 64-bit hashes of the text; of the suffixes left, runs of
  successive ones between two whose fingerprints end in zero bits are looked up as one.  A run that a smaller
  doc_id has as a whole is settled, and its suffixes don't travel: the first to have it sends them.

Four rounds of lookups (whole texts, cover samples, runs, suffixes) read one shuffle of the texts; see ``rounds``.  A
bucket holds a range of keys, one entry per chunk for a frequent string; nothing grows with a group of copies.

Null text counts as empty.  Rows that share a doc_id aren't smaller than each other.  A null doc_id is not
compared: nothing is removed from it or because of it.  An empty table gives an empty result.  Extra columns
are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.llm import rounds
from lodgelake.llm.common import mix, passes, pick, span_hashes, text_bytes

LENGTH = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every residue mod 31 is a difference of two of these
SAMPLE = LENGTH - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
SEGMENT = 16
MOST_RANGES = 100_000


def by_range(docs: DataFrame, volume: int) -> DataFrame:
    """``docs`` with ``_chunk``: ranges of doc_id of about as many rows; equal ids share a chunk."""
    n = min(MOST_RANGES, max(1, math.ceil(1.5 * volume / rounds.CHUNK_BYTES)))
    if n == 1:
        return docs.withColumn("_chunk", F.lit(0))
    part = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 20 * n))).first()[0]
    bounds = np.unique(np.array(part or [0], np.int64))

    @F.pandas_udf("int")
    def chunk(doc_id):
        return pd.Series(np.searchsorted(bounds, doc_id.to_numpy(), "right").astype(np.int32))

    return docs.withColumn("_chunk", chunk("doc_id"))


class Chunk:
    """A chunk's documents in order of doc_id."""

    def __init__(self, t: pa.Table):
        order = np.argsort(t.column("doc_id").to_numpy(), kind="stable")
        self.t = t.take(pa.array(order))
        self.doc_id = self.t.column("doc_id").to_numpy()
        self.data, off = text_bytes(self.t.column("text"))
        self.data, self.off = self.data[off[0]:off[-1]], off - off[0]
        raw = self.data.tobytes()
        self.digest = np.frombuffer(b"".join(
            hashlib.blake2b(raw[a:b], digest_size=16).digest()
            for a, b in zip(self.off[:-1].tolist(), self.off[1:].tolist(), strict=True)), "<u8").reshape(-1, 2)

    # round 1: whole texts

    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.digest[:, 0], return_index=True)

    def whole_copies(self, earlier: np.ndarray) -> np.ndarray:
        """Documents whose text a smaller id has; ``earlier``: the answer to each key of ``texts()``."""
        keys, _ = self.texts()
        out = earlier[np.searchsorted(keys, self.digest[:, 0])]
        order = np.lexsort((self.doc_id, self.digest[:, 1], self.digest[:, 0]))
        d, ids = self.digest[order], self.doc_id[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]).any(axis=1)
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1]
        out[order[ids > least]] = True
        return out

    # rounds 2 and 3: strings of one length at chosen places

    def _strings(self, length: int, chosen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, document and place (in the chunk) of the strings that start where ``chosen`` says."""
        keys, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in passes(self.off):
            start, doc = chosen(i, j, self.off[i:j + 1] - self.off[i])
            keys.append(span_hashes(self.data[self.off[i]:self.off[j]], start, start + length))
            docs.append(doc)
            at.append(start + self.off[i])
        return np.concatenate(keys), np.concatenate(docs), np.concatenate(at)

    def samples(self, rows: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        longest = int(np.diff(self.off).max(initial=0))
        cover = np.flatnonzero(np.resize(_IN_COVER, longest))

        def chosen(i, j, own):
            n = np.where(rows[i:j], np.searchsorted(cover, np.diff(own) - SAMPLE, "right"), 0)
            doc = np.repeat(np.arange(j - i), n)
            return own[doc] + cover[np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)], doc + i

        key, doc, at = self._strings(SAMPLE, chosen)
        return key >> np.uint64(shift) << np.uint64(shift), doc, at

    def suspects(self, shared_at: np.ndarray) -> np.ndarray:
        """Places whose string of LENGTH bytes holds a shared sample."""
        return _marked(len(self.data), np.maximum(shared_at - PERIOD + 1, 0), shared_at + 1)

    def suffixes(self, rows: np.ndarray, suspect: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def chosen(i, j, own):
            start = np.flatnonzero(suspect[self.off[i]:self.off[j]])
            doc = np.searchsorted(own, start, "right") - 1
            ok = rows[doc + i] & (start + LENGTH <= own[doc + 1])
            return start[ok], doc[ok] + i

        return self._strings(LENGTH, chosen)


def _segments(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive suffixes from one whose fingerprint ends in zero bits to the next such one: the fingerprint of
    the run, its first and its last suffix.  Equal runs of text are cut alike, wherever they stand."""
    edge = np.flatnonzero(key & np.uint64(SEGMENT - 1) == 0)
    lo, hi = edge[:-1], edge[1:]
    whole = (at[hi] - at[lo] == hi - lo) & (doc[hi] == doc[lo])
    lo, hi = lo[whole], hi[whole]
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key ^ np.uint64(0x2545F4914F6CDD1D)))])
    return mix(total[hi + 1] - total[lo] + (hi - lo).astype(np.uint64)), lo, hi


def _marked(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [lo, hi)."""
    edge = np.bincount(lo, minlength=n + 1).astype(np.int32)
    edge -= np.bincount(hi, minlength=n + 1).astype(np.int32)
    return np.cumsum(edge)[:n] > 0


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def _first_of_chunks(keys: np.ndarray, chunk: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """For each entry: does a smaller chunk have its key (and check)?"""
    order = np.lexsort((chunk, keys) if check is None else (chunk, check, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if check is not None:
        new[1:] |= check[order][1:] != check[order][:-1]
    out = np.zeros(len(k), bool)
    out[order] = ~new
    return out


def _shared(keys: np.ndarray, chunk: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each sample: do several documents have it, in this chunk or over chunks?"""
    u, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    several = n > 1
    several[back[many > 0]] = True
    return several[back]


def _least(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, each row's place among them, and the least and the largest document of each."""
    u, back = np.unique(keys, return_inverse=True)
    least = np.full(len(u), np.iinfo(np.int64).max)
    most = np.full(len(u), -1)
    np.minimum.at(least, back, doc)
    np.maximum.at(most, back, doc)
    return u, back, least, most


def covered(docs: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(table, data, off, removed)`` for every chunk: its rows, their bytes, and which bytes go."""
    d = pick(docs)
    some = d.where(F.col("doc_id").isNotNull())
    volume = rounds.text_volume(some)
    n = rounds.buckets(volume)
    # bits of a sample's fingerprint: enough that one in a thousand is shared by chance
    shift = max(0, 64 - (max(volume, 2).bit_length() + 10))
    chunks = by_range(some, volume)

    def ask_texts(t: pa.Table) -> rounds.Arrays:
        c = Chunk(t)
        keys, first = c.texts()
        return [keys, c.digest[first, 1]]

    def alone(c: Chunk, r: pa.Table) -> np.ndarray:
        return ~c.whole_copies(rounds.answers(_round(r, 1), c.texts()[0], n, rounds.BITS))

    def ask_samples(t: pa.Table, r: pa.Table) -> rounds.Arrays:
        c = Chunk(t)
        key, doc, _ = c.samples(alone(c, r), shift)
        u, _, least, most = _least(key, c.doc_id[doc])
        return [u, least != most]

    def suspect(c: Chunk, rows: np.ndarray, r: pa.Table) -> np.ndarray:
        key, _, at = c.samples(rows, shift)
        u, back = np.unique(key, return_inverse=True)
        return c.suspects(at[rounds.answers(_round(r, 2), u, n, rounds.BITS)[back]])

    def suffixes(t: pa.Table, r: pa.Table):
        c = Chunk(t)
        rows = alone(c, r)
        return c, rows, *c.suffixes(rows, suspect(c, rows, r))

    def ask_segments(t: pa.Table, r: pa.Table) -> rounds.Arrays:
        _, _, *own = suffixes(t, r)
        return [_distinct(_segments(*own)[0])]

    def earlier(c: Chunk, key: np.ndarray, doc: np.ndarray, r: pa.Table, k: int) -> np.ndarray:
        """Which strings a smaller doc_id has: one in the chunk, or a smaller chunk by the answers of round k."""
        ids = c.doc_id[doc]
        u, back, least, _ = _least(key, ids)
        return (ids > least[back]) | rounds.answers(_round(r, k), u, n, rounds.BITS)[back]

    def settled(c: Chunk, key: np.ndarray, doc: np.ndarray, at: np.ndarray, r: pa.Table) -> np.ndarray:
        """Suffixes that lie in a run which a smaller doc_id has as a whole."""
        run, lo, hi = _segments(key, doc, at)
        hit = earlier(c, run, doc[lo], r, 3)
        return _marked(len(key), lo[hit], hi[hit] + 1)

    def ask_suffixes(t: pa.Table, r: pa.Table) -> rounds.Arrays:
        c, _, key, doc, at = suffixes(t, r)
        return [_distinct(key[~settled(c, key, doc, at, r)])]

    def last(t: pa.Table, r: pa.Table) -> pa.Table:
        c, rows, key, doc, at = suffixes(t, r)
        known = settled(c, key, doc, at, r)
        open_ = np.flatnonzero(~known)
        known[open_] = earlier(c, key[open_], doc[open_], r, 4)
        hit = at[known]
        gone = _marked(len(c.data), hit, hit + LENGTH)
        size = np.diff(c.off)
        gone |= np.repeat(~rows & (size >= LENGTH), size)
        return finish(c.t, c.data, c.off, gone)

    bits = (rounds.BITS,)
    first = lambda k, c, *check: (_first_of_chunks(k, c, *check), {})
    one = _tag(rounds.answer(rounds.ask(chunks, n, ask_texts, ["<u8"]), ["<u8"], first, *bits), 1)
    two = _tag(rounds.answer(rounds.ask(chunks, n, ask_samples, ["u1"], one), ["u1"],
                             lambda k, c, x: (_shared(k, c, x), {}), *bits), 2)
    so_far = one.union(two)
    three = _tag(rounds.answer(rounds.ask(chunks, n, ask_segments, [], so_far), [], first, *bits), 3)
    so_far = so_far.union(three)
    four = _tag(rounds.answer(rounds.ask(chunks, n, ask_suffixes, [], so_far), [], first, *bits), 4)
    done = chunks.groupBy("_chunk").cogroup(so_far.union(four).groupBy("_chunk")).applyInArrow(last, schema)

    def untouched(t):
        for batch in t:
            data, off = text_bytes(batch.column("text"))
            part = finish(pa.table(batch), data[off[0]:off[-1]], off - off[0], np.zeros(int(off[-1] - off[0]), bool))
            yield from part.to_batches()

    return done.unionByName(d.where(F.col("doc_id").isNull()).mapInArrow(untouched, schema))


def _tag(replies: DataFrame, k: int) -> DataFrame:
    # dealt by chunk at once: later rounds read this exchange and don't work the answers out again
    return replies.withColumn("_round", F.lit(k)).repartition("_chunk")


def _round(replies: pa.Table, k: int) -> pa.Table:
    return replies.filter(pa.array(replies.column("_round").to_numpy() == k))


def _runs(gone: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and maximal removed runs of each document."""
    total = np.concatenate([[0], np.cumsum(gone)])
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    lo = off[:-1][off[:-1] < off[1:]]
    first[lo] = gone[lo]
    runs = np.concatenate([[0], np.cumsum(first)])
    return total[off[1:]] - total[off[:-1]], runs[off[1:]] - runs[off[:-1]]


def _left(data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> list[bytes]:
    return [data[a:b][~gone[a:b]].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document; see the module for nulls and repeats."""
    def digest(t: pa.Table, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.Table:
        removed, runs = _runs(gone, off)
        return pa.table({
            "doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed),
            "n_spans": pa.array(runs),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _left(data, off, gone)], pa.string())})

    return covered(docs, digest, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; a character of which a byte went goes as a whole."""
    def rest(t: pa.Table, data: np.ndarray, off: np.ndarray, gone: np.ndarray) -> pa.Table:
        text = [x.decode("utf-8", "ignore") for x in _left(data, off, gone)]
        touched = _runs(gone, off)[0] > 0
        old = t.column("text").to_pylist()
        n = t.column("n_chars").to_pylist()
        text = [x if hit else y for x, y, hit in zip(text, old, touched, strict=True)]
        return pa.table({
            "doc_id": t.column("doc_id"), "text": pa.array(text, pa.string()), "lang": t.column("lang"),
            "source": t.column("source"),
            "n_chars": pa.array([len(x) if hit else m for x, m, hit in zip(text, n, touched, strict=True)],
                                pa.int64())})

    return covered(docs, rest, "doc_id bigint, text string, lang string, source string, n_chars bigint")
