"""Filter audit, spelling variants and toxicity against plain restatements of their contracts."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from lodgelake.llm import audit, spelling, toxicity
from llm.llm_texts import LOWER, odd_documents, prose, words

ROWS = odd_documents(9)
LABELS = [(i, i % 3 != 0, i % 5 == 0) for i in (0, 1, 2, 3, 4, 5, 6, 100, 101, 200, 201, 202, 300, 301, 601, 7)]
LABELS = [(i, int(q), int(t)) for i, q, t in LABELS] + [(3, 0, None), (None, 1, 1), (5, None, 1), (5, None, 0)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' AS mask", "2 AS n")


# ---------------------------------------------------------------- op12

def _audit(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, t, lang, _ in rows:
        t = t or ""
        w = words(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if t in first and (i is None or i > first[t]):
            fails.add("E")
        parts[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for step, x in enumerate(order, 1):
                now = [d for d in left if x in d[0]]
                kept = [d for d in left if x not in d[0]]
                out[part, order, step] = [len(kept), len(now), sum(x in d[0] for d in gone), sum(d[0] == {x} for d in docs),
                                          sum(d[1] for d in now), sum(d[2] for d in now), x]
                shapley[x] += len(now)
                left, gone = kept, gone + now
        for k, v in out.items():
            if k[0] == part:
                v[6] = shapley[v[6]]
    return out


def test_op12_equals_one_by_one(make, labels):
    rows = [(r[0], r[1], *(r[2:] or ("en", "a"))) for r in ROWS] + [(700, None, "", ""), (8, "", None, ""), (8, "", None, "")]
    got = {tuple(r[:3]): list(r[3:]) for r in audit.op12(make(rows), labels).collect()}
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == _audit(rows, LABELS)


def test_op12_hot_text_and_id(spark, make, labels):
    text = "Copy # of one text " * 3
    rows = [(i % 40, text, "en", "a") for i in range(120)] + [(5, f"word {i}", "fr", "a") for i in range(60)]
    got = {tuple(r[:3]): list(r[3:]) for r in audit.op12(make(rows), labels).collect()}
    assert got == _audit(rows, LABELS)


def test_op12_empty(make, labels):
    assert audit.op12(make([]), labels).collect() == []
    none = audit.op12(make([(1, "a b", "en", "s")]), labels.where("false")).collect()
    assert len(none) == 600 and all(r["good_lost"] == r["toxic_lost"] == 0 for r in none)


# ---------------------------------------------------------------- op13

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _variants(rows):
    count = collections.Counter()
    for i, t, *_ in rows:
        for w in RUN.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    v = {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}
    near = {w: [x for x in v if _near(w, x)] for w in v}
    form = {w: min(x, key=lambda f: (-v[f], f)) for w, x in near.items() if x}
    form = {w: f for w, f in form.items() if v[f] >= 2 * v[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), v[w], len(near[w]), v.get(form.get(w))) for w in v}


def test_op13_equals_brute_force(make):
    rng = random.Random(5)
    letters = "abÀé"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 8))) for _ in range(250)]
    rows = [(r[0], r[1], *(r[2:] or ("en", "a"))) for r in ROWS]
    for i in range(60):
        rows.append((2000 + i, " ".join(rng.choice(texts[:rng.choice((5, 40, 250))]) for _ in range(60)), "en", "a"))
    chain = ["kettles", "kettle", "kettlee", "kettlex", "kettlexy", "settlexy"]
    for k, w in enumerate(chain):
        rows.append((3000 + k, f"{w}-" * (4 << k), None, None))
    rows += [(4000, "aaaaaaaa " * 9 + "aaaaaaaaa " * 5 + "aaaaaaa " * 5, "en", "a"), (4001, "Zebras×Zebra÷ ZEBRAS1" * 3, "en", "a")]
    got = {r[0]: tuple(r[1:]) for r in spelling.op13(make(rows)).collect()}
    want = _variants(rows)
    assert len(want) > 200 and sum(x[0] is not None for x in want.values()) > 30
    assert any(x[1] != (x[0] or w) for w, x in want.items())  # a chain of forms
    assert got == want


def test_op13_pivots_take_the_least_weight():
    rng = np.random.default_rng(1)
    position = np.sort(np.array([rng.choice(9, 5, replace=False) for _ in range(200)]), axis=1)
    weight = rng.integers(1, 50, position.shape)
    chosen = spelling.choose(position, weight)
    for p, w, c in zip(position.tolist(), weight.tolist(), chosen.tolist(), strict=True):
        pairs = [w[a] + w[b] for a in range(5) for b in range(a) if p[a] - p[b] >= 2]
        a, b = [k for k in range(5) if c[k]]
        assert p[b] - p[a] >= 2 and w[a] + w[b] == min(pairs)


def test_op13_crc32_and_empty(make):
    data = "0123456789 é long-span".encode()
    start, end = np.array([0, 3, 11, 5]), np.array([4, 3, 22, 6])
    before = np.array([zlib.crc32(b"7:"), 0, zlib.crc32(b":"), 12], np.uint32)
    got = spelling.crc32_of(np.frombuffer(data, np.uint8), start, end, before)
    assert got.tolist() == [zlib.crc32(data[a:b], int(c)) for a, b, c in zip(start, end, before, strict=True)]
    assert spelling.op13(make([])).collect() == []
    assert spelling.op13(make([(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", "en", "a")])).collect() == []


# ---------------------------------------------------------------- op11

INSULTS = ["blockhead", "numbskull", "nitwitted", "dimwitted"]


def _toxic_rows(seed=2, n=900):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = prose(rng, rng.randint(40, 300)).split(" ")
        if toxic:
            for _ in range(max(2, len(w) // 30)):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, " ".join(w), rng.choice(["en", "fr"]), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_op11_held_out_and_misspelled(spark, make):
    rows, labels = _toxic_rows()
    toxic = {i for i, _, t in labels if t}
    lab = spark.createDataFrame(labels + [(5, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    rng = random.Random(3)

    def misspell(text):
        for x in INSULTS:
            k = rng.randrange(1, len(x) - 1)
            text = text.replace(x, x[:k] + x[k + 1:])
        return text

    new = [(10_000 + i, misspell(t), g, s) for i, t, g, s in rows if i in toxic]
    odd = [(20_000, None, None, None), (20_001, "", "en", ""), (20_002, "### !!", "en", ""), (None, "a b", "en", "s"),
           (3, rows[3][1], "xx", "other"), (20_003, "one " * 9000, "en", "s")]
    got = collections.defaultdict(list)
    for r in toxicity.op11(make(rows + new + odd), lab).collect():
        got[r[0]].append((r[1], r[2], r[3]))
    assert len(got[3]) == 2 and got[3][0] == got[3][1]  # neither language nor source counts
    for i, x in got.items():
        for held, score, predicted in x:
            assert held == (zlib.crc32(str("" if i is None else i).encode()) % 5 == 0)
            assert 0 <= score <= 1 and predicted == int(score >= 0.5)
    assert got[20_000][0][1:] == got[20_001][0][1:] == got[20_002][0][1:]
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    caught = [got[i][0][2] for i in out if i in toxic]
    clean = [got[i][0][2] for i in out if i not in toxic]
    assert np.mean(caught) > 0.95 and np.mean(clean) < 0.03
    assert np.mean([got[r[0]][0][2] for r in new]) > 0.5  # words never seen in training


def test_op11_labels_of_held_out_rows_are_unused(spark, make):
    rows, labels = _toxic_rows(n=200)
    schema = "doc_id bigint, quality int, toxic int"
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    a = {r[0]: r[2] for r in toxicity.op11(make(rows), spark.createDataFrame(labels, schema)).collect()}
    b = {r[0]: r[2] for r in toxicity.op11(make(rows), spark.createDataFrame(flipped, schema)).collect()}
    assert a == b


def test_op11_empty(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.op11(make([]), none).collect() == []
    got = toxicity.op11(make([(1, "some words", "en", "s"), (2, None, "en", "s")]), none).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]


def test_op11_sample_is_one_text_an_id(spark, make):
    rows, labels = _toxic_rows(n=60)
    rows += [(1, f"other text {k}", "en", "s") for k in range(50)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    number, bias = toxicity.fit(make(rows), lab, sample=20)
    assert np.isfinite(number).all() and np.isfinite(bias)
