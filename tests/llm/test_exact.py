import dataclasses
import hashlib
import re

import pytest
from pathloom.llm import exact
from pyspark.sql import functions as F


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows]
    out, seen = [], set()
    for r, t in zip(rows, norm, strict=True):
        ids = [x["doc_id"] for x, u in zip(rows, norm, strict=True) if u == t]
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        stays = r["doc_id"] == keep and (keep, t) not in seen
        seen.add((r["doc_id"], t))
        out.append((r["doc_id"], keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(odd_docs, no_docs):
    got = [tuple(r) for r in exact.exact_dedup(odd_docs).collect()]
    assert sorted(got, key=str) == brute(odd_docs.collect())
    assert exact.exact_dedup(no_docs).count() == 0


def test_kept_rows_are_unchanged(odd_docs, no_docs):
    kept = exact.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    want = [x[0] for x in brute(odd_docs.collect()) if x[3]]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted(want, key=str)
    assert exact.keep_first(no_docs).count() == 0


@pytest.mark.parametrize("capacity", [1, 2, 5])
def test_index_splits_and_lookup_survives(odd_docs, capacity):
    keys = exact.keyed(odd_docs)
    index = exact.build_index(odd_docs, keys, capacity=capacity)
    entries = index.entries.collect()
    assert len({r["sha"] for r in entries}) == len(entries)
    buckets = {r["bucket"] for r in entries}
    assert len(buckets) > 1 and max(sum(r["bucket"] == b for r in entries) for b in buckets) <= capacity
    assert len({r["local_depth"] for r in index.directory.collect()}) > 1 or capacity > 1  # only overfull buckets split
    got = [tuple(r) for r in exact.exact_dedup(odd_docs, capacity=capacity).collect()]
    assert sorted(got, key=str) == brute(odd_docs.collect())


def poor(norm):
    """Three hash values for everything."""
    return F.length(norm) % 3


@pytest.mark.parametrize("capacity", [1, 100])
def test_collisions_are_chained_and_told_apart(odd_docs, capacity):
    index = exact.build_index(odd_docs, exact.keyed(odd_docs, hash_of=poor), capacity=capacity, hash_of=poor)
    chains = {}
    for r in index.entries.collect():
        chains.setdefault(r["hash"], []).append(r["chain"])
    assert len(chains) == 3 and all(sorted(c) == list(range(len(c))) for c in chains.values()) and index.chained
    got = [tuple(r) for r in exact.exact_dedup(odd_docs, capacity=capacity, hash_of=poor).collect()]
    assert sorted(got, key=str) == brute(odd_docs.collect())
    kept = exact.keep_first(odd_docs, capacity=capacity, hash_of=poor).collect()
    want = [x[0] for x in brute(odd_docs.collect()) if x[3]]
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted(want, key=str)


def test_lookup_goes_through_the_directory(spark, odd_docs):
    keys = exact.keyed(odd_docs)
    index = exact.build_index(odd_docs, keys, capacity=1)
    assert exact.lookup(odd_docs, keys, index).count() == odd_docs.count()
    moved = index.directory.withColumn("bucket", F.col("bucket") + 1)
    astray = dataclasses.replace(index, directory=moved)
    assert exact.lookup(odd_docs, keys, astray).count() == 0


def test_often_met_entries_are_broadcast(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact.exact_dedup(docs).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.max("group_size").alias("most")).first()
    assert (got["n"], got["kept"], got["most"]) == (3000, 1501, 1500)
    assert exact.keep_first(docs).count() == 1501


def test_any_ids_and_names(spark):
    rows = [("b", "x", 1, "s"), ("a", "x", 2, "s"), ("a", "x", 3, "s"), (None, "x", 4, "s"), (None, None, 5, "s"), (None, "", 6, "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, hash int, SHA string").withColumns({"row": F.lit(1), "g_id": F.lit(2), "first": F.lit(3), "_hash": F.lit(4)})
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["hash"] for r in kept.collect()) in ([2, 5], [2, 6], [3, 5], [3, 6])
    assert sorted((r["doc_id"], r["kept"]) for r in exact.exact_dedup(docs).filter("doc_id IS NOT NULL").collect()) == [("a", False), ("a", True), ("b", False)]


def test_directory_doubling():
    def counted(hashes):
        def count(bits, depth, prefixes):
            found = {}
            for h in hashes:
                if h >> (64 - depth) in prefixes:
                    found[h >> (64 - bits)] = found.get(h >> (64 - bits), 0) + 1
            return found
        return count

    three = {0b000: 1, 0b100: 5, 0b101: 5, 0b111: 1}
    hashes = [(p << 61) + i for p, n in three.items() for i in range(n)]
    slots, depth = exact.grow_directory(counted(hashes), len(hashes), 6)
    assert [s for s, _, _ in slots] == list(range(8)) and depth == 3  # 10x held 10 entries and was split at the third bit
    assert sorted({b: d for _, b, d in slots}.values()) == [1, 2, 3, 3]
    assert exact.grow_directory(counted([]), 0, 10) == ([(0, 0, 0)], 0)
    deep = [5 << 44, (5 << 44) + (1 << 43), 1]  # apart at the 21st bit only
    slots, depth = exact.grow_directory(counted(deep), 3, 1)
    assert depth == 21 and len({b for _, b, _ in slots}) == 22
