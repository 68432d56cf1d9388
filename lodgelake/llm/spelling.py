"""Spelling variants: words one edit apart, found by pivotal grams.

Every word of the vocabulary is cut into bigrams, each with its position.  All bigrams are ordered from rare to frequent
by the number of words that hold them.  A word's prefix is its first PREFIX bigrams in this order, and every other
place of the last of them; its pivots are two bigrams of the prefix that don't overlap, chosen by dynamic
programming so that the fewest words hold them.  One edit spoils at most one of two bigrams that don't overlap.  So of two
words one edit apart, the one whose prefix ends earlier in the order (either, if alike) has a pivot that the
other holds, in its prefix, at the same place or shifted by the edit: pivots are joined with prefixes by bigram, position
and length, and each pair is verified by its edit distance.  No pair is lost.  As one edit leaves the first or the
last half of the shorter word as it is, an equal half is part of the join's key: most pairs that share a pivot by chance
are not made, and the list of a frequent bigram is spread.

Two bigrams of any three places don't overlap, so PREFIX = 3 is enough; words have MIN_LENGTH = 5 letters or more.
There are at most 90^2 bigrams, so their order is a table of bounded size.  Positions and lengths split the lists of a
frequent bigram; what is still a large key of the join is split by Spark's skew join.  Pairs meet no group: a word's
neighbours are counted, and the largest is found, by partial aggregates.

A word's form (its most frequent neighbour, if at least twice as frequent) has at least twice its count, so chains
end after less than 64 steps; roots are found by pointer doubling, each round halving what is left of the longest chain.

Words: runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased.  Occurrences that the rule of
``<doc_id>:<run>`` picks lose a letter.  Null text: none; a null doc_id is the empty text in the rule.  Repeated
rows count each.  An empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import LOWER, cut, mix, passes, pick, span_hashes, spans, text_bytes

SPOILED = 97
MIN_LENGTH, MIN_COUNT = 5, 3
PREFIX = 3
TIMES = 2  # as frequent as the word must its form be

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FIRST = 0xC3  # first byte of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every span, continued from the crc32 ``before`` it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")  # the longest first
    at, size, s = start[order], (end - start)[order], state[order]
    k = 0
    while n := int(np.searchsorted(-size, -k, "left")):  # those longer than k
        s[:n] = (s[:n] >> np.uint32(8)) ^ _CRC[(s[:n] ^ data[at[:n] + k]) & np.uint32(255)]
        k += 1
    state[order] = s
    return state ^ np.uint32(0xFFFFFFFF)


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z lower-cased; start, end and document of every run of letters."""
    two = data == _FIRST
    inside = _LETTER[data] | two
    inside[1:] |= two[:-1]
    low = LOWER[data]
    return low, *spans(np.where(inside, 120, 32).astype(np.uint8), off)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each pass with their counts."""
    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        seed = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()],
                        np.uint32)
        for i, j in passes(off):
            own = off[i:j + 1]
            low, start, end, doc = runs(data[own[0]:own[-1]], own - own[0])
            size = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
            length = size[end] - size[start]
            long = length >= MIN_LENGTH  # a shorter run gives no word, whole or spoiled
            start, end, doc, length = start[long], end[long], doc[long], length[long]
            h = crc32_of(low, start, end, seed[i:j][doc])
            bad = h % SPOILED == 0
            _, first, n = np.unique(span_hashes(low, start[~bad], end[~bad]), return_index=True, return_counts=True)
            s, e = start[~bad][first], end[~bad][first]
            words = [low[a:b].tobytes() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            n = n.tolist()
            for a, b, at in zip(start[bad].tolist(), end[bad].tolist(), (h[bad] % length[bad]).tolist(), strict=True):
                w = low[a:b].tobytes().decode()
                if len(w) > MIN_LENGTH:
                    words.append((w[:at] + w[at + 1:]).encode())
                    n.append(1)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                                             ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least MIN_COUNT occurrences."""
    d = pick(docs, {"doc_id": "bigint", "text": "string"})
    return d.mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- pivots

def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words as code points (all below 256), and where each word starts."""
    data, off = text_bytes(col)
    two = data == _FIRST
    value = data.copy()
    value[1:][two[:-1]] += 64  # U+00C0 is C3 80
    keep = ~two
    at = np.concatenate([[0], np.cumsum(keep)])
    return value[off[0]:off[-1]][keep[off[0]:off[-1]]], at[off] - at[off[0]]


def bigrams(value: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every bigram of every word: its code, its word and its position."""
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))
    whole = np.flatnonzero(word[1:] == word[:-1])
    return value[whole].astype(np.int64) * 256 + value[whole + 1], word[whole], whole - off[word[whole]]


#: a bit for each letter; some of the rarer ones share one
_BIT = np.zeros(256, np.int64)
_BIT[97:123] = 1 << np.arange(26, dtype=np.int64)
_BIT[0xC0:] = 1 << (26 + np.arange(64, dtype=np.int64) % 37)


def halves(value: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first and of the last ``n`` letters of each word."""
    return tuple(span_hashes(value, a, a + n) for a in (off[:-1], off[1:] - n))


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        gram, word, _ = bigrams(*letters(batch.column("word")))
        total += np.bincount(np.unique(word * (1 << 16) + gram) % (1 << 16), minlength=1 << 16)
    gram = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(total[gram])], ["gram", "n"])


def gram_order(words: DataFrame) -> np.ndarray:
    """Of each bigram code how many words hold it: at most 90^2 rows, gathered on the driver."""
    rows = words.select("word").mapInArrow(_held, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n")).collect()
    out = np.zeros(1 << 16, np.int64)
    for gram, n in rows:
        out[gram] = n
    return out


def choose(position: np.ndarray, weight: np.ndarray, picks: int = 2, gram: int = 2) -> np.ndarray:
    """For each row of a (words x k) table of bigrams, in order of position: a mask of ``picks`` that don't overlap,
    of the least total weight.

    best[i, p]: the least weight of p of the first i bigrams.  The i-th is either left out, or joins the best p - 1
    among those that end before it starts.
    """
    n, k = position.shape
    never = np.int64(1) << 60
    best = np.full((k + 1, picks + 1, n), never)
    best[:, 0] = 0
    before = (position[:, :, None] >= position[:, None, :] + gram).sum(axis=2)  # how many end before the i-th starts
    row = np.arange(n)
    for i in range(1, k + 1):
        for p in range(1, picks + 1):
            best[i, p] = np.minimum(best[i - 1, p], best[before[:, i - 1], p - 1, row] + weight[:, i - 1])
    out = np.zeros((n, k), bool)
    at, left = np.full(n, k), np.full(n, picks)
    for i in range(k, 0, -1):
        here = (at >= i) & (left > 0)
        taken = here & (best[i, left, row] < best[i - 1, left, row])
        out[taken, i - 1] = True
        at = np.where(taken, before[:, i - 1], at)
        left = left - taken
    return out


SIGNED = "key bigint, seen bigint, word string, n bigint, last bigint"


def _signed(held: np.ndarray, pivots: bool):
    """Rows of one side of the join: the pivots, as a neighbour of another length may hold them, or the prefixes."""
    rank = held * (1 << 16) + np.arange(1 << 16)  # rare first, ties by code: one order of all bigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, off = letters(batch.column("word"))
            gram, word, position = bigrams(value, off)
            if not len(gram):
                continue
            order = np.lexsort((position, rank[gram], word))
            gram, word, position = gram[order], word[order], position[order]
            first = np.searchsorted(word, np.arange(batch.num_rows))
            size = np.bincount(word) + 1  # letters
            head = first[:, None] + np.arange(PREFIX)
            last = rank[gram[head[:, -1]]]
            # pivots, from the first PREFIX in order of position
            by_place = np.argsort(position[head], axis=1)
            head = np.take_along_axis(head, by_place, axis=1)
            chosen = choose(position[head], held[gram[head]])
            w, column = np.nonzero(chosen)
            at = head[w, column]
            seen = np.bitwise_or.reduceat(_BIT[value], off[:-1])
            # halves of the shorter word of a pair, if that is the word itself or one letter less
            same, shorter = halves(value, off, size // 2), halves(value, off, (size - 1) // 2)

            def side(of: np.ndarray, at: np.ndarray, shift: int, longer: int, half: np.ndarray, tag: int) -> pa.RecordBatch:
                fits = position[at] + shift >= 0
                of, at = of[fits], at[fits]
                place = ((position[at] + shift) << 32 | (size[of] + longer)).astype(np.uint64)
                key = mix(mix(half[of] + gram[at].astype(np.uint64)) + mix(place) * np.uint64(2 * tag + 1))
                return pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(seen[of]),
                     batch.column("word").take(pa.array(of)), batch.column("n").take(pa.array(of)), pa.array(last[of])],
                    [c.split()[0] for c in SIGNED.split(", ")])

            for end in (0, 1):
                if pivots:  # where a neighbour of this length may hold them
                    for shift, longer in ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1)):
                        yield side(w, at, shift, longer, (shorter if longer < 0 else same)[end], 2 * end + (longer > 0))
                else:  # with every place of the last bigram
                    pre = np.flatnonzero(rank[gram] <= last[word])
                    yield side(word[pre], pre, 0, 0, same[end], 2 * end)
                    yield side(word[pre], pre, 0, 0, shorter[end], 2 * end + 1)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): both directions of every pair of words exactly one edit apart, once."""
    held = gram_order(words)
    # the key is a hash of bigram, position, length and half: a chance meeting ends with the verification
    pivot = words.mapInArrow(_signed(held, True), SIGNED).select(
        "key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("_la"), F.col("seen").alias("_sa"))
    prefix = words.mapInArrow(_signed(held, False), SIGNED).select(
        "key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("_lb"), F.col("seen").alias("_sb"))
    # one edit changes at most two of the letters seen, which is cheaper to tell than an edit distance
    may = (F.col("_la") <= F.col("_lb")) & (F.bit_count(F.col("_sa").bitwiseXOR(F.col("_sb"))) <= 2) & (F.col("a") != F.col("b"))
    near = pivot.join(prefix, "key").where(F.when(may, F.levenshtein("a", "b", 1) == 1).otherwise(False))
    pair = near.select(F.when(F.col("a") < F.col("b"), F.struct("a", "na", "b", "nb"))
                       .otherwise(F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"),
                                           F.col("na").alias("nb"))).alias("p")).select("p.*").distinct()
    return pair.select(F.inline(F.array(F.struct("a", "na", "b", "nb"), F.struct(
        F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of (word, form): from a word follow forms to the last."""
    at = cut(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("more")))
    while not at.where("more").isEmpty():
        step = at.select(F.col("word").alias("root"), F.col("root").alias("_next"), F.col("more").alias("_more"))
        at = cut(at.join(step, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.coalesce("_more", F.lit(False)).alias("more")))
    return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = cut(vocabulary(docs))
    best = near_words(words).groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min_by(F.struct(F.col("b").alias("form"), F.col("nb").alias("form_n")), F.struct(-F.col("nb"), "b")).alias("_f"))
    best = best.select(F.col("a").alias("word"), "n_near", "_f.*")
    w = cut(words.join(best, "word", "left").withColumn("_has", F.coalesce(F.col("form_n") >= TIMES * F.col("n"), F.lit(False)))
            .select("word", F.when(F.col("_has"), F.col("form")).alias("form"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                    F.when(F.col("_has"), F.col("form_n")).alias("form_n")))
    return w.join(roots(w.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word; see the module for nulls, empty texts and repeats."""
    return variants(docs)
