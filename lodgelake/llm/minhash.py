"""MinHash near-dedup with odd sketches.

A document's set is its distinct 5-word shingles.  BANDS x ROWS MinHash samples are taken of it.  Documents that
agree in all samples of a band are candidates; at Jaccard 0.85 a pair misses every band with probability
(1 - 0.85^5)^20 < 1e-5.  Folded into an odd sketch (a bitmap where each sample flips one bit) the
samples of two documents differ in a number of bits that estimates their similarity; a candidate under LOW is
dropped, which a pair at 0.85 is by chance less than once in 10^4.  Every link is confirmed on full sets.

Documents with equal sets are one class, which goes on as its smallest doc_id.  Components are asked for, so
not every pair of a band's bucket needs a look, only enough to join what is joined:

1. every member of a bucket is compared with the bucket's pivot (one row per member); of its pivots over all
   bands each document keeps the most similar one, and this link is confirmed.
2. buckets whose members are still in several components are looked at whole: members with a candidate in another
   component are compared exactly, and links between components are found as they are needed.  A bucket is cut
   into blocks of BLOCK members, and pairs of blocks are tasks, so a task is bounded and nothing is dropped.

No step emits pairs within a group: rows are one per member and band (or pair of blocks in a bucket of
more than BLOCK members that are still not joined).

Null or empty text: the empty set, linked with nothing.  Fewer than 5 words: one shingle of all.  Rows that share a
doc_id are one vertex: the classes of their texts are joined, and all have one component.  A null doc_id is not compared: its component is null, and it is kept.  An empty table
gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import LOWER, cut, grams, mix, passes, pick, span_hashes, spans, text_bytes
from lodgelake.llm.graph import components

SHINGLE = 5
BANDS, ROWS = 20, 5
SKETCH_BITS = 512
LOW = 0.68
LINK = 85  # percent
BLOCK = 2048

_RNG = np.random.default_rng(11)
_FACTOR = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every document, one document after the other, and where each starts."""
    low = LOWER[data]
    start, end, doc = spans(low, off)
    h = span_hashes(low, start, end)
    n = len(off) - 1
    words = np.bincount(doc, minlength=n)
    key, at = grams(h, doc, SHINGLE)
    of = doc[at]
    short = np.flatnonzero((words > 0) & (words < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        one = np.zeros(len(short), np.uint64)
        for i in range(SHINGLE - 1):
            has = words[short] > i
            one[has] = one[has] * np.uint64(0xD6E8FEB86659FD93) + h[first[has] + i]
        key = np.concatenate([key, mix(one + words[short].astype(np.uint64))])
        of = np.concatenate([of, short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(n + 1))


def signatures(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every document with shingles: two hashes of the set, the band keys, the odd sketch."""
    full = np.flatnonzero(np.diff(at))
    lo = at[:-1][full]
    k = len(_FACTOR)
    least = np.empty((len(full), k), np.uint64)
    for i in range(k):
        least[:, i] = np.minimum.reduceat(key * _FACTOR[i] ^ _TERM[i], lo)
    set1 = np.add.reduceat(mix(key), lo)
    set2 = np.add.reduceat(mix(key ^ np.uint64(0xA5A5A5A55A5A5A5A)), lo)
    band = np.zeros((len(full), BANDS), np.uint64)
    for i in range(k):
        band[:, i // ROWS] = mix(band[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least[:, i] + np.uint64(i + 1))
    bit = (mix(least + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
           >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    flips = np.bincount((np.arange(len(full))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(full) * SKETCH_BITS)
    sketch = np.packbits((flips & 1).astype(np.uint8).reshape(len(full), SKETCH_BITS), axis=1)
    return full, set1, set2, band, sketch


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from the sketches' XOR population counts."""
    odd = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * BANDS * ROWS) * np.log1p(-share)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for i, j in passes(off):
            own = off[i:j + 1]
            key, at = shingles(data[own[0]:own[-1]], own - own[0])
            full, set1, set2, band, sketch = signatures(key, at)
            m = j - i
            ids = np.zeros((m, 2), np.int64)
            ids[full, 0], ids[full, 1] = set1.view(np.int64), set2.view(np.int64)
            where = np.full(m, -1)
            where[full] = np.arange(len(full))
            bands = band.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[i:j], batch.column("_text")[i:j], pa.array(np.diff(at)), pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                 pa.array([bands[w] if w >= 0 else [] for w in where], pa.list_(pa.int64())),
                 pa.array([sketch[w].tobytes() if w >= 0 else b"" for w in where], pa.binary())],
                ["doc_id", "_text", "n_shingles", "_s1", "_s2", "_bands", "_sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        for i, j in passes(off):
            own = off[i:j + 1]
            key, at = shingles(data[own[0]:own[-1]], own - own[0])
            at = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep")[i:j],
                 pa.array([key[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                ["rep", "_set"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= LINK * (len(both) - common)


def _sketches(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, SKETCH_BITS // 8).view(np.uint64)


def _estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            est = estimate(_sketches(b.column("_sketch")), _sketches(b.column("_pivot_sketch")))
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("pivot"), pa.array(est)], ["rep", "pivot", "est"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64))
              for p, q in zip(b.column("_set"), b.column("_pivot_set"), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("pivot")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


_SLICE = 256


def _crossing(t: pa.Table) -> pa.Table:
    """Members of a bucket that have a candidate in another component."""
    sk = _sketches(t.column("_sketch").combine_chunks())
    comp = t.column("component").to_numpy()
    hit = np.zeros(len(comp), bool)
    for a in range(0, len(comp), _SLICE):
        cand = (estimate(sk[a:a + _SLICE, None], sk[None]) >= LOW) & (comp[a:a + _SLICE, None] != comp[None])
        hit[a:a + _SLICE] |= cand.any(axis=1)
    return t.filter(pa.array(hit)).select(["_key", "_i", "_j", "rep", "component", "_sketch"])


def _joining(t: pa.Table) -> pa.Table:
    """Confirmed links that join the components of a bucket's members."""
    sk = _sketches(t.column("_sketch").combine_chunks())
    rep, comp = t.column("rep").to_numpy(), t.column("component").to_numpy().copy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("_set").to_pylist()]
    out = []
    for a in range(len(rep)):
        cand = np.flatnonzero((comp != comp[a]) & (estimate(sk[a], sk) >= LOW) & (np.arange(len(rep)) > a))
        for b in cand.tolist():
            if comp[a] != comp[b] and linked(sets[a], sets[b]):
                out.append((rep[a], rep[b]))
                comp[comp == comp[b]] = comp[a]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


SETS = ["n_shingles", "_s1", "_s2"]


def _of_shared_ids(signed: DataFrame) -> DataFrame:
    """(doc_id, set) of the ids whose rows hold different sets, the empty set included."""
    one = F.struct(*SETS)
    shared = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(one).alias("_lo"), F.max(one).alias("_hi")) \
        .where("_lo <> _hi").select("doc_id")
    return signed.join(shared, "doc_id", "left_semi").select("doc_id", *SETS).distinct()


def _linked_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows; the classes of equal sets (SETS, rep); confirmed links (a, b) between classes."""
    d = pick(docs, {"doc_id": "bigint", "text": "string"})
    signed = cut(d.withColumn("_text", F.xxhash64("text")).mapInArrow(
        _signed, "doc_id bigint, _text bigint, n_shingles bigint, _s1 bigint, _s2 bigint, _bands array<bigint>, _sketch binary"))
    some = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = some.groupBy(*SETS).agg(F.min("doc_id").alias("rep"), F.first("_bands").alias("_bands"),
                                         F.first("_sketch").alias("_sketch"))
    classes = cut(classes)
    # buckets with at least two classes
    member = classes.select("rep", F.posexplode("_bands").alias("_band", "_key")) \
        .select("rep", F.xxhash64("_band", "_key").alias("_key"))
    crowded = member.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    member = cut(member.join(crowded, "_key"))
    sketch = classes.select("rep", "_sketch")
    full = member.join(sketch, "rep")
    pivots = full.groupBy("_key").agg(F.min_by(F.struct("rep", "_sketch"), F.struct(F.xxhash64("rep"), "rep")).alias("p")) \
        .select("_key", F.col("p.rep").alias("pivot"), F.col("p._sketch").alias("_pivot_sketch"))
    star = full.join(pivots, "_key").where("rep <> pivot").select("rep", "pivot", "_sketch", "_pivot_sketch") \
        .mapInArrow(_estimated, "rep bigint, pivot bigint, est double").where(F.col("est") >= LOW) \
        .groupBy("rep").agg(F.max_by("pivot", F.struct("est", "pivot")).alias("pivot"))
    # full sets of everything that shares a bucket: the one shuffle of texts, of these documents only
    needed = member.select("rep").distinct()
    texts = d.join(needed, d["doc_id"] == needed["rep"], "left_semi")
    own = texts.withColumnRenamed("doc_id", "rep").mapInArrow(_sets, "rep bigint, _set binary")
    sets = cut(own)
    first = cut(star.join(sets, "rep").join(sets.toDF("pivot", "_pivot_set"), "pivot")
                .select("rep", "pivot", "_set", "_pivot_set").mapInArrow(_confirmed, "a bigint, b bigint"))
    comp = cut(components(first))
    # buckets that are still in several components
    part = member.join(comp.toDF("rep", "_c"), "rep", "left").withColumn("component", F.coalesce("_c", "rep")).drop("_c")
    mixed = part.groupBy("_key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")) \
        .where("_lo <> _hi").select("_key")
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    part = part.join(mixed, "_key").join(sketch, "rep") \
        .withColumn("_b", F.pmod(F.xxhash64("rep"), blocks).cast("int")) \
        .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("_key", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "rep", "component", "_sketch")
    group = ["_key", "_i", "_j"]
    crossing = part.groupBy(*group).applyInArrow(
        _crossing, "_key bigint, _i int, _j int, rep bigint, component bigint, _sketch binary")
    second = crossing.join(sets, "rep").groupBy(*group).applyInArrow(_joining, "a bigint, b bigint")
    return signed, classes.select(*SETS, "rep"), first.union(cut(second))  # cut: no task needs two Python workers at once


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    signed, classes, links = _linked_classes(docs)
    # classes that rows of one id hold are joined as well: an id is one vertex
    shared = cut(_of_shared_ids(signed).join(classes, SETS, "left"))
    least = shared.groupBy("doc_id").agg(F.min("rep").alias("_lo"))
    held = shared.where("rep IS NOT NULL").join(least, "doc_id").where("rep <> _lo") \
        .select(F.col("_lo").alias("a"), F.col("rep").alias("b"))
    comp = cut(components(links.union(held)))
    rows = signed.join(classes, SETS, "left").join(comp.toDF("rep", "_c"), "rep", "left")
    # a row without words takes the component of its id's other rows
    bare = least.where("_lo IS NOT NULL").join(comp.toDF("_lo", "_lc"), "_lo", "left") \
        .select(F.col("doc_id").alias("_sid"), F.coalesce("_lc", "_lo").alias("_sc"))
    return rows.join(bare, (rows["doc_id"] == bare["_sid"]) & (rows["n_shingles"] == 0), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.coalesce("_sc", "doc_id"))
        .otherwise(F.coalesce("_c", "rep")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; see the module for nulls, short texts and repeats."""
    return near_duplicates(docs)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of texts: the row of the smallest doc_id, then text hash.

    Here rows are told apart by id and text, and texts are joined only by their own links: of an id with two texts
    that are nothing like each other neither is lost.  Rows equal in id and text are one row, the first by language and
    source.  Rows without words or without an id are not compared and all stay, but for such repeats of one id.
    """
    signed, classes, links = _linked_classes(docs)
    comp = cut(components(links))
    key = F.struct("doc_id", "_text")
    rows = signed.where("doc_id IS NOT NULL").groupBy("doc_id", "_text", *SETS).agg(F.count(F.lit(1)).alias("_n")) \
        .join(classes, SETS, "left").join(comp.toDF("rep", "_c"), "rep", "left") \
        .select("doc_id", "_text", "_n", F.coalesce("_c", "rep").alias("_c"))
    first = rows.where("_c IS NOT NULL").groupBy("_c").agg(F.min(key).alias("_first"))
    mark = rows.join(first, "_c", "left").withColumn("_gone", F.coalesce(key != F.col("_first"), F.lit(False)))
    mark = cut(mark.where("_gone OR _n > 1").select(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"), "_gone"))
    d = pick(docs).withColumn("_text", F.xxhash64("text"))
    on = lambda m: (d["doc_id"] == m["_id"]) & (d["_text"] == m["_t"])
    once = d.join(mark, on(mark), "left_anti").drop("_text")
    again = mark.where("NOT _gone")
    if again.isEmpty():
        return once
    twice = d.join(again, on(again), "left_semi").groupBy("doc_id", "_text").agg(
        F.min(F.struct("lang", "source", "n_chars", "text")).alias("_r"))
    return once.unionByName(twice.select("doc_id", *[f"_r.{c}" for c in ("text", "lang", "source", "n_chars")]))
