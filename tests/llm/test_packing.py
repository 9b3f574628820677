import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import packing, queries

FILES = queries.tokenizer_files()


def check_sequences(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_against_tokenizer(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_best_fit_packing(spark, sf_dir).collect()
    slow = Tokenizer.from_file(FILES["json_path"])
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for i, r in enumerate(sorted(pieces[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (i, at)
            assert i == 0 or r["length"] == 1024
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[doc_id]) == 1)
    used = check_sequences(rows)
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 1024)
    assert bound <= used <= 1.01 * bound + 1


@pytest.mark.parametrize("text", ["plain text's don't", "Ünïcödé ſ — …", "日本語 テスト ١٢٣ ²", "a<|endoftext|>b", "", "  \n\n x\t\t", "\x85  x", "😀 é"])
def test_both_libraries_agree(text):
    slow = Tokenizer.from_file(FILES["json_path"])
    got = np.frombuffer(packing.encode_bytes(text, **FILES), "<u4").tolist()
    assert got == slow.encode(text, add_special_tokens=False).ids


def test_exchange_between_partitions(spark):
    rng = random.Random(4)
    lengths = [rng.choice([342, 341, 500, 524, 700, 324, 60]) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces, partition_pieces=400).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    used = check_sequences(rows)
    alone = packing.best_fit_decreasing(np.array(lengths), 1024)[0].max() + 1
    assert used <= 1.01 * alone
    cert = packing.certificate(packing.pack(pieces)).first()
    assert cert["bound"] <= cert["sequences"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_never_exceeds_the_best_packing(lengths):
    capacity, best = 20, len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    assert packing.lower_bound(np.array(lengths), capacity) <= best


def test_odd_documents(spark, odd_docs, no_docs):
    rows = packing.pack(packing.tokenize(odd_docs, **FILES, with_ids=True))
    got = rows.collect()
    check_sequences(got)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in odd_docs.collect()}
    assert [r["length"] for r in got if r["doc_id"] in (4, 5)] == [1, 1]
    assert sum(r["doc_id"] == 8 for r in got) == 2
    sequences = packing.assemble(rows).collect()
    assert sum(len(s["ids"]) for s in sequences) == sum(r["length"] for r in got)
    assert packing.pack(packing.tokenize(no_docs, **FILES)).count() == 0
