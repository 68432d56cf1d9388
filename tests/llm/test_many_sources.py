"""Mixing and packing with more sources than the driver holds, and packing to target weights."""

import collections
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodgelake.llm import mixing, packing
from llm.llm_texts import odd_documents, prose

ROWS = odd_documents()


def test_plans_are_the_same(spark):
    rng = random.Random(3)
    for n, weights, share in ((1, (5, 2, 1), Fraction(3, 2)), (40, (5, 2, 1), Fraction(3, 2)), (300, (1, 1000), Fraction(19, 10)),
                              (30, (3,), Fraction(5, 2)), (6, (5, 2, 1), Fraction(3, 2))):
        sizes = [(f"s{rng.randrange(10**9)}é{i}", rng.choice([0, 1, 7, rng.randrange(10**4), 10**9])) for i in range(n)] + [("n", 40)]
        if n == 6:
            sizes = [(g, 0) for g, _ in sizes]
        df = spark.createDataFrame(sizes, "_g string, n long").repartition(3)
        want = sorted(mixing.driver_plan(sizes, weights, share, 2))
        got = sorted(tuple(r) for r in mixing.spark_plan(df, weights, share, 2).collect())
        assert [r[:2] + r[3:4] for r in got] == [r[:2] + r[3:4] for r in want]
        assert [x for r in got for x in r[2::2]] == pytest.approx([x for r in want for x in r[2::2]])


def test_mix_beyond_the_driver(make):
    docs = make(ROWS).cache()
    assert sorted(map(str, mixing.mix_sources(docs, most=2).collect())) == sorted(map(str, mixing.mix_sources(docs).collect()))


def _whole(rows, docs):
    """Sequences as lists of (offset, length, doc); every id of every document in one piece, windows gapless."""
    seq, tokens = collections.defaultdict(list), collections.Counter()
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seq[r["sequence_id"]].append((r["offset"], r["length"], r["doc_id"]))
        for k, x in enumerate(r["ids"]):
            tokens[r["doc_id"], r["doc_tokens"], r["start"] + k, x] += 1
    for parts in seq.values():
        at = 0
        for offset, length, _ in sorted(parts, key=lambda p: p[0]):
            assert offset == at
            at += length
        assert at <= 2048
    want = collections.Counter()
    for r in packing.pack(docs).collect():
        for k, x in enumerate(r["ids"]):
            want[r["doc_id"], r["doc_tokens"], r["start"] + k, x] += 1
    assert tokens == want
    assert sorted(seq) == list(range(len(seq)))
    assert all(sum(p[1] for p in seq[k]) == 2048 for k in list(seq)[:-1] if k != len(seq) - 1)
    return seq


def test_ordered_packing_is_whole(make):
    docs = make(ROWS).cache()
    rows = packing.pack(docs, few=0).collect()
    _whole(rows, docs)
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack(docs.repartition(7), few=0).collect()))
    assert packing.pack(make([]), few=0, weights={"a": 2.0}).collect() == []


def test_weights_are_met_until_a_queue_ends(make):
    rng = random.Random(8)
    rows = [(i, prose(rng, 300), "en", "abc"[i % 3]) for i in range(90)]
    docs = make(rows).cache()
    source = {i: s for i, _, _, s in rows}
    packed = packing.pack(docs, weights={"a": 6.0, "b": 3.0}).collect()  # "c" is not named: 1
    seq = _whole(packed, docs)
    left = collections.Counter()
    for r in packed:
        left[source[r["doc_id"]]] += r["length"]
    weight = {"a": 6, "b": 3, "c": 1}
    checked = 0
    for k in sorted(seq):
        got = collections.Counter()
        for _, n, i in seq[k]:
            got[source[i]] += n
        alive = [s for s in weight if left[s] > 2048]
        if len(alive) == len([s for s in weight if left[s]]):
            for s in alive:
                assert abs(got[s] - 2048 * weight[s] / sum(weight[x] for x in alive)) <= 130
            checked += 1
        left -= got
    assert checked > 10
    with pytest.raises(ValueError, match="above 0"):
        packing.pack(docs, weights={"a": 0.0})


def test_five_thousand_sources(make):
    rng = random.Random(9)
    rows = [(i, prose(rng, 20), "en", f"s{i % 5000}") for i in range(6000)] + [(9999, prose(rng, 3000), "en", "s1"), (None, None, None, None)]
    packed = packing.pack(make(rows)).drop("ids").collect()
    total = sum({(r["doc_id"]): r["doc_tokens"] for r in packed}.values())
    assert sum(r["length"] for r in packed) == total
    assert 1 + max(r["sequence_id"] for r in packed) == -(-total // 2048)  # only the last is padded
