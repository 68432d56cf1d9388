"""The pipeline's stages, each on what the one before kept, against brute force."""

import collections

import corpus_pipeline as P
from lodgelake.llm import mixing, quality
from llm.llm_texts import by_id, components, grams, odd_documents
from llm.test_operators import _remove

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order(spark, make, tmp_path):
    assert [name for name, _ in P.STAGES] == ["quality rules", "minhash near-dedup", "suffix-array dedup", "mixing", "packing"]
    rows = [r for r in odd_documents(4) if r[0] != 7 or r[3] != "s1"][:-2]
    docs = make(rows)
    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        df = stage(spark, docs, "unused")
        df.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        out.append(docs)
        assert k == 4 or docs.columns == DOCUMENT
    quality_, near, suffix, mixed, packed = out

    verdict = by_id(quality.op6(make(rows)), "doc_id", "kept")
    kept = by_id(quality_, "doc_id", "text")
    assert {i for i, v in verdict.items() if v[0][0]} == set(kept)
    assert 601 not in kept and 101 not in kept

    sets = {i: grams(t[0][0], 5) for i, t in kept.items() if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp = components(sets, links)
    assert {i for i in by_id(near, "doc_id", "text") if i is not None} == set(comp.values())

    before = [(r["doc_id"], r["text"]) for r in near.collect()]
    after = {i: t[0][0] for i, t in by_id(suffix, "doc_id", "text").items()}
    assert set(after) == {i for i, _ in before}
    import hashlib
    for i, _, removed, _, digest in _remove([r for r in before if r[0] is not None]):
        if not removed:
            assert hashlib.sha256(after[i].encode()).hexdigest() == digest
        else:
            assert len(after[i]) < len(dict(before)[i])

    copies = collections.Counter({r["doc_id"]: r["copies"] for r in mixing.mix_sources(suffix).collect()})
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +copies

    tokens = collections.Counter()
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == r["length"] and r["offset"] + r["length"] <= 2048
    assert set(tokens) == set(+copies)
    size = {r["doc_id"]: r["doc_tokens"] for r in packed.collect()}
    assert tokens == {i: n * size[i] for i, n in (+copies).items()}


def test_run_is_the_stages(spark, tmp_path):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 0


def test_empty_documents(spark, make):
    docs = make([])
    for k, (_, stage) in enumerate(P.STAGES):
        assert stage(spark, docs, "unused").collect() == []
