import corpus_pipeline
import pytest
from pathloom.llm import packing


def brute_keep(rows):
    """Rows that exact and near dedup leave, by definition."""
    import re

    from .test_similar_texts import brute_kept

    seen, first = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        if t not in seen:
            seen.add(t)
            first.append(r)
    return {r["doc_id"] for r in first}, brute_kept([(r["doc_id"], r["text"]) for r in first])


def test_stages_against_definitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert 4 <= len(names) <= 5
    exact, near = brute_keep(kept[names[0]])
    assert {r["doc_id"] for r in kept[names[1]]} == exact
    assert {r["doc_id"] for r in kept[names[2]]} == near
    times = {}
    for r in kept[names[3]]:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert set(times) <= near and max(times.values()) <= 3
    pieces = kept[names[4]]
    assert {r["doc_id"] for r in pieces} == set(times)
    assert sum(r["piece"] == 0 for r in pieces) == sum(times.values())


def test_run_returns_packed_sequences(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    fill = {}
    for r in rows:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 1024
    import numpy as np

    assert packing.lower_bound(np.array([r["length"] for r in rows]), 1024) <= len(fill)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_on_odd_documents(spark, odd_docs, no_docs, stage):
    found = stage[1](spark, odd_docs, "")
    if stage != corpus_pipeline.STAGES[-1]:
        assert found.columns == odd_docs.columns
    assert found.count() > 0
    assert stage[1](spark, no_docs, "").count() == 0
