"""Quality rules: a document's histograms against language references by Jensen-Shannon distance.

Two histograms are taken of each whole text: character classes, and common words of several languages
with one bin for all others.  The references are fixed values, so a document's verdict hangs on its own text and
language alone, whatever else the table holds and however large it is: PROFILE for the classes, and for the words of a
language Zipf's law over its most frequent words in COMMON.  The verdict rejects a document whose distance is above the
limit for its length: limit + slack / sqrt(words), as short texts stray more.

The word distance is that to the own language or, as texts quote each other, to an even blend of it with one other
language of COMMON, whichever is nearest.  ``lang`` is read without case and region (``EN``, ``en-GB``).  Of any other
language, null and wrong tags included, neither the frequent words nor the use of blanks and capitals are known: the
word distance is 0, and the class distance is taken over letters of any script, digits, punctuation, control
characters and symbols alone.  So a heap of symbols is rejected under every tag.  Guard: documents under MIN_WORDS
words fail the base rule, whatever their distances.

Base rules: under MIN_WORDS words, or over half of the words in repeated 3-word windows, fails.

Null or empty text: no words, base_failed.  Null language: a language that is not named.  Repeated rows count each.
An empty table gives an empty result.  Extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodgelake.llm.common import LOWER, SPACE, grams, mix, passes, pick, span_hashes, spans, text_bytes

# fixed values: frequent function words by language
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not at are this have from or an which you had but",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il avec son sont",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como pero sus le ha me si",
}
WORDS = sorted({w for line in COMMON.values() for w in line.split()})
# fixed values: percent of the characters of plain prose
PROFILE = {"letters": 78, "capitals": 3, "digits": 1, "blanks": 16, "punctuation": 3, "control": 0, "symbols": 0.1}
TOP_WORD = 0.065  # share of the most frequent word; the r-th has 1 / r of it

MIN_WORDS = 50
CLASS_LIMIT, CLASS_SLACK = 0.12, 1.0
WORD_LIMIT, WORD_SLACK = 0.14, 2.1

_CLASSES = 8
_CLASS = np.full(256, 6, np.int64)  # other ASCII: symbols
_CLASS[:32] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[127] = 5
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0xC0:] = 7
_CLASS[0x80:0xC0] = _CLASSES  # continuation bytes count nowhere
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_LETTER_GAP = np.ones(256, bool)
_LETTER_GAP[97:123] = False
_LETTER_GAP[0x80:] = False


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    raw = [w.encode() for w in WORDS]
    end = np.cumsum([len(w) for w in raw])
    h = span_hashes(np.frombuffer(b"".join(raw), np.uint8), end - [len(w) for w in raw], end)
    order = np.argsort(h)
    return h[order], order


_TABLE, _TABLE_ID = _common_table()
BINS = _CLASSES + len(WORDS) + 1


def _repeats(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, key): its group and the groups' sizes."""
    _, group, n = np.unique(mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)),
                            return_inverse=True, return_counts=True)
    return group, n


def measure(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the
    two histograms side by side."""
    n = len(off) - 1
    of = np.repeat(np.arange(n), np.diff(off))
    base = np.zeros((n, 5), np.int64)
    start, end, doc = spans(data, off)
    base[:, 0] = np.bincount(doc, minlength=n)
    base[:, 1] = np.bincount(of[~SPACE[data] & ((data & 0xC0) != 0x80)], minlength=n)
    base[:, 2] = np.bincount(of[_SYMBOL[data]], minlength=n)

    ls, le, ld = spans(data, off, _LINE)
    inked = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = inked[le] > inked[ls]
    ls, le, ld = ls[full], le[full], ld[full]
    if len(ls):
        group, size = _repeats(span_hashes(data, ls, le), ld)
        first = np.zeros(len(ls), bool)
        first[np.unique(group, return_index=True)[1]] = True
        base[:, 3] = np.bincount(ld[~first], minlength=n)

    window, at = grams(span_hashes(data, start, end), doc, 3)
    if len(at):
        group, size = _repeats(window, doc[at])
        cover = np.zeros(len(start) + 1, np.int64)
        hit = at[size[group] > 1]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + 3, -1)
        base[:, 4] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n)

    hist = np.zeros((n, BINS), np.int64)
    hist[:, :_CLASSES] = np.bincount(of * (_CLASSES + 1) + _CLASS[data],
                                     minlength=n * (_CLASSES + 1)).reshape(n, -1)[:, :_CLASSES]
    low = LOWER[data]
    start, end, doc = spans(low, off, _LETTER_GAP)
    h = span_hashes(low, start, end)
    k = np.minimum(np.searchsorted(_TABLE, h), len(_TABLE) - 1)
    bin_ = np.where(_TABLE[k] == h, _TABLE_ID[k], len(WORDS)) if len(h) else np.zeros(0, np.int64)
    hist[:, _CLASSES:] = np.bincount(doc * (len(WORDS) + 1) + bin_, minlength=n * (len(WORDS) + 1)).reshape(n, -1)
    return base, hist


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of every row of counts ``p`` to the counts ``q``."""
    p = p / np.maximum(p.sum(axis=1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def _measured(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = text_bytes(batch.column("text"))
    for i, j in passes(off):
        part = off[i:j + 1]
        yield i, j, *measure(data[part[0]:part[-1]], part - part[0])


def word_reference(lang: str) -> np.ndarray:
    """Shares of WORDS and of all other words in the language."""
    share = {w: TOP_WORD / r for r, w in enumerate(COMMON[lang].split(), 1)}
    of = np.array([share.get(w, 0.0) for w in WORDS])
    return np.append(of, 1 - of.sum())


def classes(hist: np.ndarray) -> np.ndarray:
    """Counts in the order of PROFILE: small letters of any script as letters."""
    out = hist[:, :_CLASSES - 1].copy()
    out[:, 0] += hist[:, _CLASSES - 1]
    return out


def _scriptless(counts: np.ndarray) -> np.ndarray:
    """Without blanks, and capitals as letters: what scripts have in common."""
    return np.concatenate([counts[:, :1] + counts[:, 1:2], counts[:, [2, 4, 5, 6]]], axis=1)


_PROFILE = np.array(list(PROFILE.values()))
_SCRIPTLESS = _scriptless(_PROFILE[None, :])[0]
_OWN = {g: word_reference(g) for g in COMMON}
_BLENDS = {g: [own, *[(own + other) / 2 for h, other in _OWN.items() if h != g]] for g, own in _OWN.items()}


def distances(hist: np.ndarray, langs: list) -> np.ndarray:
    """Class and word distance of each document (row of histograms) of the given language."""
    tags = [re.split("[-_]", (x or "").strip().lower())[0] for x in langs]
    count = classes(hist)
    far = np.zeros((len(hist), 2))
    for tag in set(tags):
        rows = np.array([x == tag for x in tags])
        if tag in _BLENDS:
            far[rows, 0] = js_distance(count[rows], _PROFILE)
            far[rows, 1] = np.min([js_distance(hist[rows, _CLASSES:], r) for r in _BLENDS[tag]], axis=0)
        else:
            far[rows, 0] = js_distance(_scriptless(count[rows]), _SCRIPTLESS)
    return far


def quality(docs: DataFrame) -> DataFrame:
    """Documents' columns with the base counts, base_failed, class_distance, word_distance and kept."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            base, far = np.zeros((n, 5), np.int64), np.zeros((n, 2))
            langs = batch.column("lang").to_pylist()
            for i, j, b, hist in _measured(batch):
                base[i:j] = b
                far[i:j] = distances(hist, langs[i:j])
            words = base[:, 0]
            failed = (words < MIN_WORDS) | (100 * base[:, 4] > 50 * words)
            root = np.sqrt(np.maximum(words, 1))
            kept = ~failed & (far[:, 0] <= CLASS_LIMIT + CLASS_SLACK / root) \
                & (far[:, 1] <= WORD_LIMIT + WORD_SLACK / root)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(base[:, k]) for k in range(5)], pa.array(failed),
                 pa.array(far[:, 0]), pa.array(far[:, 1]), pa.array(kept)],
                [*batch.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "class_distance", "word_distance", "kept"])

    d = pick(docs)
    schema = ", ".join(f"{c} {t}" for c, t in d.dtypes)
    return d.mapInArrow(judge, schema + ", n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                        "n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, "
                        "kept boolean")


def op6(docs: DataFrame) -> DataFrame:
    """The base counts, base_failed and kept of every document; see the module for nulls, languages and repeats."""
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                "base_failed", "kept", "class_distance", "word_distance")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass."""
    return quality(docs).where("kept").select(*pick(docs).columns)
