"""Packing: mixture-controlled windows by deficit round-robin over the sources' queues.

Each source is a queue of its documents' tokens in a seeded order.  A window (sequence) of WINDOW tokens is
filled from all queues in target proportions, here each source's share of all tokens, so that every queue
lasts to the end.  Queues are served in grains of GRAIN tokens; a source earns grains in proportion and what a
window can't give it, as a grain is whole, is carried as its deficit to the next.  Serving the g-th grain of
a source with G grains at (g + 1/2) / G of the whole is that round-robin in closed form: how many grains of
each source the first w windows hold follows from w alone.  So a document, once it knows how many tokens
of its source come before it, finds its pieces by itself, and deficits carry across windows and partitions
without a sequential pass.  A document is cut at grain ends, and a window holds one run of each source.

Padding: at most one partial grain per source and one partial window in all.

With target weights, or more than FEW_SOURCES sources, the grains are put in order by a range exchange instead: the
g-th grain of a source of weight w is served at (g + 1/2) / w, so each source earns w a round, and one whose queue ends
leaves its part to the others by their weights.  Windows are cut from that order at every WINDOW tokens (a
grain may be cut, so only the last window is padded), and a window's tokens stand by source.  Rows of documents only
hold their own grains, so any number of sources takes the same memory.

The tokens before a document are a running sum in slices (no window holds a hot source).  One row per source
reaches the driver where there are at most FEW_SOURCES.  Token ids travel once (twice with weights or many sources), as
16-bit numbers where they fit.

Null text counts as empty: its one id is the end mark.  A null source is a source of its own.  Repeated rows
are packed each.  An empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.llm.common import cut, few_rows, passes, pick, running_sum, span_hashes, spans, text_bytes

WINDOW, GRAIN, END_ID = 2048, 64, 1
FEW_SOURCES = 64
MOST_SOURCES = 65536  # rows of sources that are broadcast
TOKENIZER = "word_bpe_49k.json"
_BLANK = np.zeros(256, bool)
_BLANK[[32, 10]] = True  # always white space to the tokenizer, which drops it and never joins across it
_MOST_KEPT, _MOST_WORDS = 1_000_000, 100_000
# the tokenizer's own split of a part, and its printable stand-ins for bytes
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_STAND_IN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class Tokens:
    """Token ids of whole texts.  A text's white-space separated parts are encoded apart, equal ones once: the
    ids of a part are kept by its 64-bit hash, up to _MOST_KEPT parts, then learned again (a bound of memory; the ids are the same)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        # names of tokens of their own, found in the raw text before anything else; none holds white space
        self.added = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.hint = os.path.commonprefix(self.added)  # almost no part holds it
        if any(c.isspace() for name in self.added for c in name):
            raise ValueError("a token's name holds white space, so parts can't be encoded apart")
        self.clear()

    def clear(self) -> None:
        # sorted keys and the place of each: many in the first pair, the latest in the second
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2
        self.words: dict[str, list[int]] = {}
        self.ids, self.start = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64)
        self.n = 0

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for one that is not known."""
        out = np.full(len(keys), -1, np.int64)
        for have, place in self.known:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                out = np.where(have[at] == keys, place[at], out)
        return out

    def _keep(self, keys: np.ndarray) -> None:
        late = [np.concatenate(x) for x in zip(self.known[1], (keys, np.arange(self.n, self.n + len(keys))), strict=True)]
        if len(late[0]) > _MOST_KEPT // 8:
            late = [np.concatenate(x) for x in zip(self.known[0], late, strict=True)]
            self.known[0] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(late[0])
        pair = (late[0][order], late[1][order])
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.known = [pair, empty] if len(pair[0]) > _MOST_KEPT // 8 else [self.known[0], pair]

    def _word(self, word: str) -> list[int]:
        got = self.words.get(word)
        if got is None:
            seen = word if word.isascii() and word.isprintable() else \
                word.encode().decode("latin-1").translate(_STAND_IN)
            if len(self.words) >= _MOST_WORDS:
                self.words.clear()
            got = self.words[word] = [t.id for t in self.tok.model.tokenize(seen)]
        return got

    def part(self, text: str) -> list[int]:
        """Ids of a part.  Below U+0100 the tokenizer's normal form is lower case alone, so its words go to its
        model one by one, which is cheaper than a whole encoding; any other part, and one that holds the name of a
        token of its own, is encoded whole."""
        if (text.isascii() or max(text) < "\u0100") and not (
                self.hint in text and any(name in text for name in self.added)):
            return [i for w in _WORD.findall(text.lower()) for i in self._word(w)]
        return self.tok.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, parts: list[str]) -> None:
        ids = [np.array(self.part(p), np.uint32) for p in parts]
        flat = np.concatenate(ids)
        end = np.cumsum([len(x) for x in ids]) + int(self.start[self.n])
        while self.n + len(parts) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.start[self.n]:end[-1]] = flat
        self.start[self.n + 1:self.n + 1 + len(parts)] = end
        self._keep(keys)
        self.n += len(parts)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after the other, END_ID after each; and where each text's ids start."""
        start, end, doc = spans(data, off, _BLANK)
        keys, first, back = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.n + len(keys) > _MOST_KEPT:
            self.clear()
        place = self._places(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(keys[new], [raw[start[f]:end[f]].decode("utf-8", "replace") for f in first[new].tolist()])
            place = self._places(keys)
        at = place[back]
        lo, m = self.start[at], self.start[at + 1] - self.start[at]
        n_docs = len(off) - 1
        # an END_ID part after each document's parts
        per_doc = np.bincount(doc, minlength=n_docs)
        slot = np.arange(len(at)) + doc
        ends = np.cumsum(per_doc) + np.arange(n_docs)
        length = np.ones(len(at) + n_docs, np.int64)
        length[slot] = m
        source = np.zeros(len(length), np.int64)
        source[slot] = lo
        to = np.cumsum(length) - length
        out = self.ids[np.repeat(source - to, length) + np.arange(int(length.sum()))]
        out[to[ends]] = END_ID
        return out, np.concatenate([[0], to[ends] + 1])


_KEPT: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _KEPT:
        _KEPT[path] = Tokens(path)
    return _KEPT[path]


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, _g (source key), _n (ids with the end mark), _ids (little-endian 32-bit)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens(path)
        for batch in batches:
            data, off = text_bytes(batch.column("text"))
            for i, j in passes(off):
                own = off[i:j + 1]
                ids, at = tok.encode(data[own[0]:own[-1]], own - own[0])
                at = at.tolist()
                blobs = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes()
                         for x in (ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], batch.column("_g")[i:j], pa.array(np.diff(at)),
                     pa.array(blobs, pa.binary())], ["doc_id", "_g", "_n", "_ids"])

    d = pick(docs).select(
        "doc_id", "text", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("_g"))
    return d.mapInArrow(run, "doc_id bigint, _g string, _n bigint, _ids binary")


def served(windows: np.ndarray, grains: np.ndarray, per_window: int) -> np.ndarray:
    """Grains of each source (columns) that the first w windows hold, for each w (rows): those with the smallest
    (g + 1/2) / G, ties by source."""
    total = int(grains.sum())
    want = np.minimum(windows * per_window, total)
    share = want[:, None] / total
    c = np.clip(np.floor(share * grains + 0.5).astype(np.int64), 0, grains)
    while True:
        miss = want - c.sum(axis=1)
        if not miss.any():
            break
        less, more = np.flatnonzero(miss < 0), np.flatnonzero(miss > 0)
        if len(more):
            key = np.where(c[more] < grains, (c[more] + 0.5) / grains, np.inf)
            c[more, np.argmin(key, axis=1)] += 1
        if len(less):
            key = np.where(c[less] > 0, (c[less] - 0.5) / grains, -np.inf)
            c[less, key_last(key)] -= 1
    while True:  # the last served must not come after the first unserved
        nxt = np.where(c < grains, (c + 0.5) / grains, np.inf)
        lst = np.where(c > 0, (c - 0.5) / grains, -np.inf)
        a, b = np.argmin(nxt, axis=1), key_last(lst)
        r = np.arange(len(c))
        na, lb = nxt[r, a], lst[r, b]
        bad = (lb > na) | ((lb == na) & (b > a))
        if not bad.any():
            return c
        c[r[bad], a[bad]] += 1
        c[r[bad], b[bad]] -= 1


def key_last(x: np.ndarray) -> np.ndarray:
    """Column of the largest, the last of equal ones."""
    return x.shape[1] - 1 - np.argmax(x[:, ::-1], axis=1)


def pieces(before: np.ndarray, n: np.ndarray, source: np.ndarray, totals: np.ndarray, window: int = WINDOW,
           grain: int = GRAIN) -> tuple[np.ndarray, ...]:
    """Pieces of documents that have ``before`` tokens of their source before them: row, start in the document,
    length, window, offset in the window."""
    per = window // grain
    grains = -(-totals // grain)
    everything = int(grains.sum())
    slack = len(totals) // per + 2
    g_lo, g_hi = before // grain, (before + n - 1) // grain
    size = grains[source]
    last = max(0, -(-everything // per) - 1)
    lo = np.clip(((g_lo + 0.5) / size * everything / per).astype(np.int64) - slack, 0, last)
    hi = np.clip(((g_hi + 0.5) / size * everything / per).astype(np.int64) + slack, 0, last)
    count = hi - lo + 1
    row = np.repeat(np.arange(len(n)), count)
    w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    all_w = np.unique(np.concatenate([w, w + 1]))
    got = np.minimum(served(all_w, grains, per) * grain, totals)  # tokens of each source in the first w windows
    k = np.searchsorted(all_w, w)
    s = source[row]
    first, end = got[k, s], got[k + 1, s]
    a = np.maximum(first, before[row])
    b = np.minimum(end, (before + n)[row])
    ok = b > a
    row, w, k, s, first, a, b = (x[ok] for x in (row, w, k, s, first, a, b))
    held = got[1:] - got[:-1]
    ahead = np.cumsum(held, axis=1) - held
    return row, a - before[row], b - a, w, ahead[k, s] + a - first


def ordered_pieces(run_: DataFrame, rates: DataFrame, small: bool) -> DataFrame:
    """_g, _before and the pieces (start in the source's queue, length, sequence_id, offset) of each document, from
    (_g, _before, _n) and each source's (_sg, _rate).  ``small``: the rates are few enough to be broadcast."""
    lo, hi = F.col("_before"), F.col("_before") + F.col("_n")
    parts = run_.select("_g", "_before", "_n").join(F.broadcast(rates) if small else rates, F.col("_g") == F.col("_sg")).select(
        "_g", "_before", "_n", "_rate", F.explode(F.sequence(F.expr(f"_before DIV {GRAIN}"), F.expr(f"(_before + _n - 1) DIV {GRAIN}"))).alias("_k"))
    parts = parts.select(
        "_g", "_before", ((F.col("_k") + 0.5) / F.col("_rate")).alias("_at"), F.greatest(lo, F.col("_k") * GRAIN).alias("_lo"),
        F.least(hi, (F.col("_k") + 1) * GRAIN).alias("_hi"))
    order = [F.col("_at"), F.col("_g"), F.col("_lo")]  # unique: a queue's token is in one part
    placed = parts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = cut(placed.withColumn("_part", F.shiftright("_place", 33)))
    sums = placed.groupBy("_part").agg(F.sum(F.col("_hi") - F.col("_lo")).alias("n")).orderBy("_part").collect()  # one a range
    base, total = [], 0
    for r in sums:
        base.append((r["_part"], total))
        total += r["n"]
    base = F.broadcast(run_.sparkSession.createDataFrame(base, "_bp long, _base long"))
    before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    p = F.col("_p")
    cut_ = (
        placed.withColumn("_p", F.coalesce(F.sum(F.col("_hi") - F.col("_lo")).over(before), F.lit(0)))
        .join(base, F.col("_part") == F.col("_bp")).withColumn("_p", p + F.col("_base"))
        .select("_g", "_before", "_lo", "_hi", "_p", F.explode(F.sequence(
            F.expr(f"_p DIV {WINDOW}"), F.expr(f"(_p + _hi - _lo - 1) DIV {WINDOW}"))).alias("sequence_id"))
        .withColumn("_a", F.greatest(p, F.col("sequence_id") * WINDOW))
        .withColumn("_b", F.least(p + F.col("_hi") - F.col("_lo"), (F.col("sequence_id") + 1) * WINDOW))
        .select("_g", "_before", "sequence_id", (F.col("_lo") + F.col("_a") - p).alias("_lo"), (F.col("_b") - F.col("_a")).alias("_len"))
    )
    ahead = Window.partitionBy("sequence_id").orderBy("_g", "_lo").rowsBetween(Window.unboundedPreceding, -1)
    # a document's grains in one window follow each other in its queue
    whole = cut_.repartition("sequence_id").groupBy("_g", "_before", "sequence_id").agg(
        F.min("_lo").alias("_lo"), F.sum("_len").alias("_len")) \
        .withColumn("_offset", F.coalesce(F.sum("_len").over(ahead), F.lit(0)))
    return whole.groupBy(F.col("_g").alias("_pg"), F.col("_before").alias("_pb")).agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_len", "sequence_id", "_offset"))).alias("_pieces"))


def _piece_batch(batch: pa.RecordBatch, row, start, length, w, offset) -> pa.RecordBatch:
    """The pieces of a batch's documents with their ids."""
    n = batch.column("_n").to_numpy(zero_copy_only=False)
    blobs = batch.column("_ids").to_pylist()
    out = []
    for r, a, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
        x = blobs[r]
        wide = np.frombuffer(x, "<u2" if len(x) == 2 * n[r] else "<u4", m, a * (len(x) // int(n[r])))
        out.append(wide.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
         pa.ListArray.from_arrays(
             pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()),
             pa.array(np.frombuffer(b"".join(out), "<i4"))), pa.array([zlib.crc32(x) for x in out], pa.int64()),
         pa.array(n[row]), pa.array(w), pa.array(offset)],
        ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            lists = batch.column("_pieces")
            flat = lists.flatten()
            start, length, w, offset = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            start = start - batch.column("_before").to_numpy(zero_copy_only=False)[row]
            yield _piece_batch(batch, row, start, length, w, offset)


PIECES = ("doc_id bigint, start bigint, length bigint, ids array<int>, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer_path: str | None = None, seed: int = 23,
         weights: dict[str | None, float] | None = None, few: int = FEW_SOURCES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    ``weights`` are the sources' target proportions (a source not named weighs 1, and all must be above 0); without them
    each source's target is its share of all tokens."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be above 0")
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    t = cut(tokenized(docs, tokenizer_path)).withColumn(
        "_h", F.when(F.col("doc_id").isNull(), F.xxhash64("_ids", F.lit(seed)))  # rows without an id are spread as well
        .otherwise(F.xxhash64("doc_id", F.lit(seed))))
    run_ = running_sum(t, "_g", "_h", ["doc_id", "_n", F.xxhash64("_ids")], "_n", "_before")
    spark = docs.sparkSession
    sources = t.groupBy("_g").agg(F.sum("_n").alias("n"))
    rows = few_rows(sources, few)
    if rows is None or weights is not None:
        rate = F.ceil(F.col("n") / GRAIN).cast("double")
        if weights is not None:
            given = spark.createDataFrame([("n" if s is None else f"s{s}", float(x)) for s, x in weights.items()],
                                          "_wg string, _w double")  # a parameter of the caller
            sources = sources.join(F.broadcast(given), F.col("_g") == F.col("_wg"), "left")
            rate = F.coalesce("_w", F.lit(1.0))
        rates = cut(sources.select(F.col("_g").alias("_sg"), rate.alias("_rate")))
        at = ordered_pieces(run_, rates, rates.count() <= MOST_SOURCES)
        return run_.join(at, (F.col("_g") == F.col("_pg")) & (F.col("_before") == F.col("_pb"))) \
            .select("doc_id", "_n", "_ids", "_before", "_pieces").mapInArrow(_laid, PIECES)
    rows = sorted(rows)
    index = F.broadcast(spark.createDataFrame(  # one row per source, at most ``few``
        [(r[0], i) for i, r in enumerate(rows)], "_sg string, _source int"))
    totals = np.array([r[1] for r in rows], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                num = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("_before", "_n", "_source")}
                row, start, length, w, offset = pieces(num["_before"], num["_n"], num["_source"], totals)
                yield _piece_batch(batch, row, start, length, w, offset)

    return run_.join(index, F.col("_g") == F.col("_sg")).select("doc_id", "_n", "_ids", "_before", "_source") \
        .mapInArrow(run, PIECES)


def op9(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece; see the module for nulls,
    empty texts and repeats."""
    return pack(docs).drop("ids")
