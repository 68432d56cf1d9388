"""Rows that share an id: one vertex in the near-duplicate operators, and no text lost in the pipeline."""

import collections

import numpy as np
import pytest

import corpus_pipeline as P
from lodgelake.llm import embeddings, minhash

A, B = (" ".join(f"{x}{k}" for k in range(80)) for x in "ab")


def test_op3_one_component_an_id(make):
    got = [tuple(r) for r in minhash.op3(make([(3, A), (7, A), (7, B), (9, B), (9, ""), (12, None), (12, " ")])).collect()]
    assert sorted(got) == sorted([(3, 76, 3, True), (7, 76, 3, False), (7, 76, 3, False), (9, 76, 3, False), (9, 0, 3, False),
                                  (12, 0, 12, True), (12, 0, 12, True)])


def test_op3_chain_through_shared_ids(make):
    texts = [" ".join(f"t{j}w{k}" for k in range(40)) for j in range(12)]
    rows = [(100 + j, texts[j + x]) for j in range(11) for x in (0, 1)] + [(5, texts[11]), (300, "other words than those above")]
    got = collections.defaultdict(set)
    for r in minhash.op3(make(rows)).collect():
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got == {**{100 + j: {(5, False)} for j in range(11)}, 5: {(5, True)}, 300: {(300, True)}}


def test_dedup_stage_loses_no_text(spark, make):
    rows = [(3, A), (7, A), (7, B), (9, B), (5, "k k k"), (5, "k k k"), (8, ""), (8, ""), (8, "k K k"), (None, A), (None, A)]
    got = sorted(((r["doc_id"], r["text"]) for r in P.minhash_dedup(spark, make(rows), "").collect()), key=str)
    assert got == sorted([(3, A), (7, B), (5, "k k k"), (8, ""), (None, A), (None, A)], key=str)


def test_dedup_stage_repeats_differ_in_source(spark, make):
    rows = [(5, A, "en", "s2"), (5, A, "en", "s1"), (5, A, "en", "s1"), (6, B, None, None), (6, B, None, None)]
    got = sorted(tuple(r) for r in P.minhash_dedup(spark, make(rows), "").collect())
    assert got == [(5, A, "en", "s1", len(A)), (6, B, None, None, len(B))]


def test_op1_one_component_an_id(spark):
    u, v = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(3, u), (7, u), (7, v), (9, v), (9, None), (11, [0.0, 0.0, 1.0])]
    got = sorted(tuple(r) for r in embeddings.op1(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(3, 1, 3, True), (7, 1, 3, False), (7, 1, 3, False), (9, 0, 3, False), (9, 1, 3, False), (11, 0, 11, True)]


@pytest.mark.parametrize("block", [50, 400])
def test_op1_groups_are_bounded(spark, monkeypatch, block):
    """A dense cell with many visitors: no group of more than 2 blocks, links as by brute force."""
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.eye(8)[0] + rng.normal(size=(900, 8)) * 0.08, rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embeddings, "CELL_ROWS", 8)
    sizes = [r[0] for r in embeddings.group_sizes(df).collect()]
    assert max(sizes) <= 2 * block and len(sizes) > 1200 // block
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r[0]: r[1] for r in embeddings.op1(df.repartition(4)).collect()}
    assert sum(got.values()) >= 0.998 * near.sum()
    assert all(got[i] <= n for i, n in enumerate(near.sum(axis=1).tolist()))
