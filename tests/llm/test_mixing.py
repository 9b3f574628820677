import re

import pytest

from pathloom.llm import mixing


def fill(sizes, weights, cap):
    """Water-filling by the book: clamp what is above, share the rest, again."""
    total, clamped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in clamped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in clamped)
        targets = [cap * sizes[i] if i in clamped else weights[i] * rest / w for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in clamped and targets[i] >= cap * sizes[i]}
        if not over:
            return targets
        clamped |= over


def check(rows, docs):
    sizes = {}
    for d in docs:
        sizes.setdefault(d["source"], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    totals = [sum(sizes[n]) for n in names]
    want = dict(zip(names, fill(totals, [(5, 2, 1)[i % 3] for i in range(len(names))], 3), strict=True))
    source_of = {}
    for d in docs:
        source_of.setdefault(d["doc_id"], []).append(d["source"])
    taken = dict.fromkeys(names, 0)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        source = next(s for s in source_of[r["doc_id"]] if sum(sizes[s]) == r["source_size"])
        assert r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    for name in names:
        assert abs(taken[name] - want[name]) <= 1


def test_query_shape(spark, sf_dir):
    from pathloom.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.op10_mixing(spark, sf_dir).collect()
    check(rows, docs)
    again = queries.op10_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd_documents(odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, odd_docs.collect())
    assert mixing.mix(no_docs).count() == 0


def test_no_words_at_all(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.repeated(df).count() == 2


def test_repetitions_keep_columns(odd_docs, no_docs):
    out = mixing.repeated(odd_docs)
    assert out.columns == odd_docs.columns
    texts = {(r["doc_id"], r["text"]) for r in odd_docs.collect()}
    counts = {}
    for r in out.collect():
        assert (r["doc_id"], r["text"]) in texts
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts[i] for i in counts if i not in (8, None)) <= 3
    assert mixing.repeated(no_docs).count() == 0
