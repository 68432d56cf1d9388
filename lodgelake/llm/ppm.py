"""LM scoring: prediction by partial matching over a byte-context trie, pretrained on the training documents.

Every byte of a document (A-Z lower-cased, as for the base) and its end is predicted from the ORDER symbols before it.  A context gives each
symbol it was followed by its count over total + distinct symbols (method C); the rest is the escape to
the context shortened by its oldest symbol, where the symbols already seen in the longer one are excluded
from the counts.  Below the empty context all symbols left are alike.

Counting covers all training documents and no gram is left out, however rare.  Tasks count
the (ORDER + 1)-grams of all documents, Spark adds them up, and shorter grams are sums of these.  Exclusion needs only the next longer context, as a symbol seen in it is seen in every
shorter one: three numbers of a context (total, distinct symbols, and how much of its parent's total its symbols
hold) settle it.  So the probability of every gram that occurs in any document is worked out from the empty
context upwards, one order a step, by joins of a gram with the gram one symbol shorter and windows over a
context's at most SYMBOLS grams; nothing is broadcast and no key is hot.  Chunks of documents ask for their grams
(see rounds).

``learn`` and ``Model`` hold the same model whole in memory, as a trie with the whole distribution of each
context: for small tables only, to compare with.

The unigram base of the contract asks for counts of words over all training documents; rare words are too many
to broadcast, so chunks of documents ask for them (see rounds).

Null or empty text: no word, one end.  A null doc_id counts as empty text in the held-out rule.  Repeated
rows train and are scored each.  Without any training document every symbol is alike.  An empty table gives an
empty result.  Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgelake.llm import rounds
from lodgelake.llm.common import LOWER, cut, distinct, mix, passes, pick, span_hashes, spans, text_bytes

ORDER = 5
SYMBOLS, END = 257, 256
_BITS = 9
_MASK = (1 << _BITS) - 1


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


# ---------------------------------------------------------------- symbols

def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One symbol array for all texts, each as ORDER ends, its bytes, one end; the places that are predicted and
    the document of each."""
    n = len(off) - 1
    size = np.diff(off)
    at = np.concatenate([[0], np.cumsum(size + ORDER + 1)])
    sym = np.full(at[-1], END, np.int64)
    doc = np.repeat(np.arange(n), size + 1)
    place = np.arange(int(size.sum()) + n) + (doc + 1) * ORDER
    body = np.ones(len(place), bool)
    body[np.cumsum(size + 1) - 1] = False
    sym[place[body]] = LOWER[data[off[0]:off[-1]]]
    return sym, place, doc


def codes(sym: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The (ORDER + 1)-gram that ends at each place."""
    n = len(sym)
    code = sym[:n - ORDER]
    for k in range(1, ORDER + 1):
        code = (code << _BITS) | sym[k:n - ORDER + k]
    return code[place - ORDER]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([p[0] for p in parts])
    n = np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        train = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        for i, j in passes(off):
            sym, place, doc = symbols(data, off[i:j + 1])
            code, known = codes(sym, place), train[i:j][doc]
            parts.append(np.unique(code[known], return_counts=True))
            asked = distinct(code[~known])  # of held-out documents: with the count 0
            parts.append((asked, np.zeros(len(asked), np.int64)))
            held += len(parts[-2][0]) + len(asked)
            if held > 3_000_000:
                parts = [_merge(parts)]
                held = len(parts[0][0])
                if held > 2_000_000:  # Spark adds up what a task sends in parts
                    yield from _grams(*parts.pop())
                    held = 0
    if parts:
        yield from _grams(*_merge(parts))


def _grams(code: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(code), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(code[a:a + 100_000]), pa.array(n[a:a + 100_000])], ["code", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """gram and n of every (ORDER + 1)-gram; ``n`` is 0 where only held-out documents hold it."""
    return cut(docs.select("text", "held_out").mapInArrow(_count, "code bigint, n bigint")
               .groupBy(F.col("code").alias("gram")).agg(F.sum("n").alias("n")))


Level = tuple[np.ndarray, np.ndarray]


def learn(texts: DataFrame) -> list[tuple[Level, Level]]:
    """For each order: (gram, count) and (context, total), sorted; all of them, so of a small table only."""
    levels = counted(texts.withColumn("held_out", F.lit(False))).select("n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("order"), F.col("gram").bitwiseAND((1 << _BITS * (k + 1)) - 1).alias("gram"))
        for k in range(ORDER + 1)])).alias("x")).select("x.order", "x.gram", "n")
    sums = levels.groupBy("order", "gram").agg(F.sum("n").alias("n"))
    contexts = levels.groupBy("order", F.shiftright("gram", _BITS).alias("gram")).agg(F.sum("n").alias("n"))
    out = []
    kept, total_of = (_rows(x) for x in (sums, contexts))
    for k in range(ORDER + 1):
        pair = []
        for x in (kept, total_of):
            x = x[x[:, 0] == k]
            x = x[np.argsort(x[:, 1])]
            pair.append((x[:, 1], x[:, 2]))
        out.append(tuple(pair))
    return out


def _rows(nodes: DataFrame) -> np.ndarray:
    got = nodes.toArrow()
    return np.stack([got.column(c).to_numpy() for c in ("order", "gram", "n")], axis=1).astype(np.int64)


class Model:
    """``table[context]``: log10 probability of each symbol; ``child[k][context, older symbol]``: the context one
    longer, or a last row where there is none.  Symbols that no kept node names share one column."""

    BLOCK = 8192

    def __init__(self, levels: list[tuple[Level, Level]]):
        known = {END}
        for k, ((gram, _), (context, _)) in enumerate(levels):
            known.update(np.unique(gram & _MASK).tolist())
            for back in range(k):
                known.update(np.unique((context >> (_BITS * back)) & _MASK).tolist())
        self.column = np.full(SYMBOLS, len(known), np.int64)
        self.column[sorted(known)] = np.arange(len(known))
        width = len(known) + 1
        tables, self.child, self.first = [], [], []
        above = None
        for k, ((gram, n), (context, total)) in enumerate(levels):
            if k == 0 and not len(context):
                context, total = np.zeros(1, np.int64), np.zeros(1, np.int64)
            count = np.zeros((len(context), width))
            count[np.searchsorted(context, gram >> _BITS), self.column[gram & _MASK]] = n
            low, table = np.zeros(count.shape, np.float32), np.zeros(count.shape, np.float32)
            up = np.searchsorted(above[0], context & ((1 << _BITS * (k - 1)) - 1)) if k else None
            for a in range(0, len(context), self.BLOCK):
                b = slice(a, a + self.BLOCK)
                c = count[b]
                seen = c > 0
                q = seen.sum(axis=1)
                if k == 0:
                    low[b] = 1.0 / max(1, SYMBOLS - q[0])
                else:
                    _, count_up, total_up, low_up = (x[up[b]] for x in above)
                    seen_up = count_up > 0
                    left = np.where(seen, 0, count_up)
                    kept = left.sum(axis=1)
                    gone = count_up.sum(axis=1) - kept
                    rest = np.maximum(total_up - gone - kept + seen_up.sum(axis=1) - q, 1)
                    low[b] = np.where(seen_up, left, rest[:, None] * low_up) / (kept + rest)[:, None]
                escape = np.maximum(total[b] - c.sum(axis=1) + q, 1)
                whole = (c.sum(axis=1) + escape)[:, None]
                p = np.where(seen, c, escape[:, None] * low[b]) / whole
                table[b] = np.log10(np.maximum(p, 1e-300))
            self.first.append(sum(len(t) for t in tables))
            tables.append(table)
            if k:
                child = np.full((len(above[0]) + 1, width), len(context), np.int32)
                child[up, self.column[context >> (_BITS * (k - 1))]] = np.arange(len(context))
                self.child.append(child)
            above = (context, count, total.astype(float), low)
        self.first.append(sum(len(t) for t in tables))
        self.table = np.concatenate(tables)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(off) - 1)
        for i, j in passes(off):
            sym, place, doc = symbols(data, off[i:j + 1])
            sym = self.column[sym]
            at = np.zeros(len(place), np.int64)
            deepest = np.zeros(len(place), np.int64)
            for k, table in enumerate(self.child):
                at = table[at, sym[place - k - 1]].astype(np.int64)
                none = self.first[k + 2] - self.first[k + 1]
                deepest = np.where(at < none, self.first[k + 1] + at, deepest)
            out[i:j] = np.bincount(doc, self.table[deepest, sym[place]], minlength=j - i)
        return out


# ---------------------------------------------------------------- grams of all documents

def _grams_of(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pass: its first row, its distinct grams, the place of each gram among them, and its row."""
    data, off = text_bytes(t.column("text"))
    for i, j in passes(off):
        sym, place, doc = symbols(data, off[i:j + 1])
        u, back = np.unique(codes(sym, place), return_inverse=True)
        yield i, u, back.astype(np.int32), (doc + i).astype(np.int32)


def _ask_grams(t: pa.Table) -> rounds.Arrays:
    data, off = text_bytes(t.column("text"))
    code = np.concatenate([distinct(codes(*symbols(data, off[i:j + 1])[:2])) for i, j in passes(off)])
    return [np.sort(mix(distinct(code).astype(np.uint64)))]


def probabilities(grams: DataFrame) -> DataFrame:
    """gram and logp (log10) of every gram counted.

    ``escaped`` is the log10 of the share of a symbol not seen in the context in what escapes from it.
    """
    def low(k: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << _BITS * k) - 1))

    sums = [grams]
    for k in range(ORDER, 0, -1):
        sums.insert(0, cut(sums[0].groupBy(low(k).alias("gram")).agg(F.sum("n").alias("n"))))
    seen = F.col("n") > 0
    w = Window.partitionBy(F.shiftright("gram", _BITS))
    stats = {"total": F.sum("n").over(w), "q": F.sum(seen.cast("long")).over(w)}
    own = F.log10(F.col("n") / (F.col("total") + F.greatest("q", F.lit(1))))
    escape = F.log10(F.greatest("q", F.lit(1)) / (F.col("total") + F.greatest("q", F.lit(1))))
    out = sums[0].withColumns(stats) \
        .withColumn("escaped", -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("q"), F.lit(1)).cast("double"))) \
        .withColumn("logp", F.when(seen, own).otherwise(escape + F.col("escaped")))
    for k in range(1, ORDER + 1):
        up = out.select(*[F.col(c).alias(f"{c}_up") for c in ("gram", "n", "total", "q", "escaped", "logp")])
        rest = F.greatest(F.col("q_up") - F.col("q"), F.lit(1))
        out = sums[k].withColumn("gram_up", low(k)).join(up, "gram_up") \
            .withColumns({**stats, "gone": F.coalesce(F.sum(F.when(seen, F.col("n_up"))).over(w), F.lit(0))}) \
            .withColumn("rest", rest) \
            .withColumn("escaped", F.when(F.col("n_up") > 0, F.log10(F.col("n_up").cast("double")))
                        .otherwise(F.log10(F.col("rest").cast("double")) + F.col("escaped_up"))
                        - F.log10((F.col("total_up") - F.col("gone") + F.col("rest")).cast("double"))) \
            .withColumn("logp", F.when(F.col("total") == 0, F.col("logp_up")).when(seen, own)
                        .otherwise(escape + F.col("escaped"))) \
            .drop("gone", "rest", *[f"{c}_up" for c in ("gram", "n", "total", "q", "escaped", "logp")])
    return out.select("gram", F.col("logp").cast("float"))


def _placed(n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = mix(batch.column("gram").to_numpy().astype(np.uint64))
            order = np.argsort(keys)
            names, at = rounds.cuts(keys[order], n_buckets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, np.diff(at)).astype(np.int32)), pa.array(keys[order].view(np.int64)),
                 batch.column("logp").take(pa.array(order))], ["_bucket", "key", "logp"])

    return run


def _answer_grams(t: pa.Table, known: pa.Table) -> pa.Table:
    keys = known.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, logp = keys[order], known.column("logp").to_numpy()[order]
    answer = [logp[np.searchsorted(keys, rounds.unpack_keys(x.as_py()))].astype("<f4").tobytes()
              for x in t.column("keys")]
    return pa.table({"_chunk": t.column("_chunk"), "_bucket": t.column("_bucket"),
                     "answer": pa.array(answer, pa.binary())})


def _score_grams(t: pa.Table, replies: pa.Table, n_buckets: int) -> np.ndarray:
    """log10 probability of each text of a chunk."""
    parts = list(_grams_of(t))
    code = distinct(np.concatenate([u for _, u, _, _ in parts]))
    keys = mix(code.astype(np.uint64))
    order = np.argsort(keys)
    logp = np.zeros(len(code))
    logp[order] = rounds.answers(replies, keys[order], n_buckets, "<f4")
    out = np.zeros(t.num_rows)
    for i, u, back, row in parts:
        part = np.bincount(row - i, logp[np.searchsorted(code, u)][back])
        out[i:i + len(part)] += part
    return out


# ---------------------------------------------------------------- words

def word_keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word, and of one end per text."""
    data, off = text_bytes(t.column("text"))
    keys, docs = [], []
    for i, j in passes(off):
        own = off[i:j + 1]
        low = LOWER[data[own[0]:own[-1]]]
        start, end, doc = spans(low, own - own[0])
        keys.append(span_hashes(low, start, end))
        docs.append(doc + i)
    keys.append(np.zeros(t.num_rows, np.uint64))  # the end
    docs.append(np.arange(t.num_rows))
    return np.concatenate(keys), np.concatenate(docs)


def _words(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a chunk, the place of each word's key among them, and its row."""
    key, row = word_keys(t)
    keys, back = np.unique(key, return_inverse=True)
    return keys, back, row


def _ask_words(t: pa.Table) -> rounds.Arrays:
    keys, back, row = _words(t)
    train = ~t.column("held_out").to_numpy()
    return [keys, np.bincount(back, train[row], minlength=len(keys))]


def _answer_words(keys: np.ndarray, chunk: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
    u, back = np.unique(keys, return_inverse=True)
    total = np.bincount(back, n, minlength=len(u)).astype(np.int64)
    return total[back], {"n": int(total.sum()), "v": int((total > 0).sum())}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    d = pick(docs, {"doc_id": "bigint", "text": "string"}).withColumn("held_out", fold(F.col("doc_id")) == 1)
    volume = rounds.text_volume(d)
    n_buckets = rounds.buckets(volume)
    chunks = rounds.by_hash(d, volume)
    known = probabilities(counted(d)).mapInArrow(_placed(n_buckets), "_bucket int, key bigint, logp float")
    told = rounds.ask(chunks, n_buckets, _ask_grams).groupBy("_bucket").cogroup(known.groupBy("_bucket")).applyInArrow(
        _answer_grams, "_chunk int, _bucket int, answer binary")
    requests = rounds.ask(chunks, n_buckets, _ask_words, ["<u4"])
    replies = rounds.answer(requests, ["<u4"], _answer_words, "<u8", ("n", "v"))

    def run(t: pa.Table, r: pa.Table) -> pa.Table:
        keys, back, row = _words(t)
        of_gram = r.column("_gram")
        c = rounds.answers(r.filter(pc.invert(of_gram)), keys, n_buckets, "<u8")[back]
        m = t.num_rows
        return pa.table({
            "doc_id": t.column("doc_id"), "held_out": t.column("held_out"),
            "n_tokens": pa.array(np.bincount(row, minlength=m)),
            "n_known": pa.array(np.bincount(row[c > 0], minlength=m)),
            "_logs": pa.array(np.bincount(row, np.log10(c + 0.5), minlength=m)),
            "score": pa.array(_score_grams(t, r.filter(of_gram), n_buckets))})

    own = replies.select("_chunk", "_bucket", "answer", F.lit(False).alias("_gram")) \
        .unionAll(told.withColumn("_gram", F.lit(True))).groupBy("_chunk")
    scored = chunks.groupBy("_chunk").cogroup(own).applyInArrow(
        run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, _logs double, score double")
    sums = replies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("train_tokens"), F.sum("v").alias("_v"))  # one row
    return scored.crossJoin(F.broadcast(sums)).withColumn(
        "base_score", F.col("_logs") - F.col("n_tokens") * F.log10(
            F.col("train_tokens") + 0.5 * (F.coalesce("_v", F.lit(0)) + 1))).drop("_logs", "_v")


def op4(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document; see the module for
    nulls, empty texts and repeats."""
    return score(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
