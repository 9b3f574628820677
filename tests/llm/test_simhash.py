import re

import numpy as np
import pytest
import xxhash

from pathloom.llm import components, simhash
from pyspark.sql import functions as F


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs, threshold=3):
    """(id, fingerprint) -> smallest id reachable."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, a) in enumerate(pairs):
        for j, (_, b) in enumerate(pairs[:i]):
            if (a ^ b).bit_count() <= threshold:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(pairs))]


def test_code_covers():
    of_byte, ways = simhash.code_tables()

    def syndrome(word):
        return int(of_byte[0][word & 255] ^ of_byte[1][word >> 8 & 255] ^ of_byte[2][word >> 16 & 255] ^ of_byte[3][word >> 24])

    rng = np.random.default_rng(0)
    for word in rng.integers(0, 1 << simhash.CODE_BITS, 200).tolist():
        s = syndrome(word)
        assert syndrome(word ^ int(ways[s, 0])) == 0 and bin(int(ways[s, 0])).count("1") <= 1
        if s:
            others = [int(w) for w in ways[s, 1:]]
            assert len(set(others)) == 15 and all(syndrome(word ^ w) == 0 and bin(w).count("1") == 2 for w in others)


@pytest.mark.parametrize("searches", [simhash.HALVES, simhash.TRIPLES], ids=["halves", "triples"])
def test_every_close_pair_meets(searches):
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    near = fps.copy()
    for i in range(len(near)):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            near[i] ^= np.uint64(1 << int(b))
    both = np.concatenate([fps, near]).view(np.int64)
    index, keys, own = simhash.anchors(both, searches)
    home, visits = {}, {}
    for i, k, o in zip(index.tolist(), keys.tolist(), own.tolist(), strict=True):
        visits.setdefault(i, set()).add(k)
        if o:
            home.setdefault(i, set()).add(k)
    assert all(len(h) == len(searches) for h in home.values())
    for i in range(300):
        assert visits[i] & home[i + 300] and visits[i + 300] & home[i]


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_copies_meet_few_residents_at_any_size(n):
    fps = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, n)
    index, keys, own = simhash.anchors(fps)
    assert len(index) <= 34 * n
    residents = np.sort(keys[own])
    met = np.searchsorted(residents, keys, "right") - np.searchsorted(residents, keys, "left")
    assert met.sum() - 2 * n < 0.1 * n  # besides itself


def test_query_against_brute_force(spark, sf_dir):
    from pathloom.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sorted(queries.op3_simhash_near_dedup(spark, sf_dir).collect(), key=lambda r: r["doc_id"])
    want = [(r["doc_id"], brute_fingerprint(texts[r["doc_id"]])) for r in rows]
    assert [f"{f:016x}" for _, f in want] == [r["fingerprint"] for r in rows]
    assert brute_groups(want) == [r["component_id"] for r in rows]


def test_odd_documents(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", g) for (i, f), g in zip(fps, brute_groups(fps), strict=True)), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(odd_docs).collect()), key=str) == want
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, g in want if i == g}
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_links(no_docs.selectExpr("doc_id AS fp"), 4)
    named = odd_docs.selectExpr("concat('x', doc_id) AS doc_id", "text")
    assert sorted(r["doc_id"] for r in simhash.near_duplicates(named).filter("doc_id IS NOT NULL").collect()) == sorted(f"x{i}" for i, _ in rows if i is not None)


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {i: 200 for i in (200, 201, 202)}
    assert got == want
    assert components.components(df.limit(0)).count() == 0
    hub = spark.range(1, 30_001).selectExpr("0 AS a", "id AS b")  # its centre has more neighbours than are dealt by key
    found = components.components(hub).selectExpr("count(*) AS n", "max(root) AS root").first()
    assert (found["n"], found["root"]) == (30_001, 0)


def test_copies_of_fingerprints_are_never_broadcast(spark, tmp_path):
    spark.range(20_000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node")).write.parquet(str(tmp_path / "fps"))
    distinct = spark.read.parquet(str(tmp_path / "fps"))
    for found in (simhash.fingerprint_links(distinct), simhash._meetings(distinct, simhash.HALVES, 3, ("node",))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
