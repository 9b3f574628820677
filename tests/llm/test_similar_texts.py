"""Near-dedup of the pipeline against its definition: five-word shingle sets with a Jaccard similarity of 0.8 or more."""

import random

from pathloom.llm import common, simhash
from pyspark.sql import functions as F


def brute_kept(rows, similarity=0.8):
    """Smallest ids of the groups, by comparing everything with everything."""
    sets = [(i, set(simhash.shingles(t, 5))) for i, t in sorted(rows)]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if len(a & b) >= similarity * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {sets[x][0] for x in range(len(sets)) if find(x) == x}


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return {r["doc_id"] for r in simhash.keep_one(df).collect()}


def edited(docs):
    rng, rows = random.Random(8), list(docs)
    for i in range(150):
        words = rng.choice(docs[:100])[1].split()
        for _ in range(rng.randint(1, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"edited{rng.randrange(40)}"
        rows.append((10_000 + i, " ".join(words)))
    return rows


def test_no_similar_pair_is_left(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = edited(docs)
    stay = kept(spark, rows)
    assert stay == brute_kept(rows)
    fps = [simhash.fingerprint(t, 5) for _, t in rows]
    near = {i for i, _ in rows if i not in stay}
    alone = [i for (i, _), f in zip(rows, fps, strict=True) if i in near and min((f ^ g).bit_count() for (j, _), g in zip(rows, fps, strict=True) if j != i) > 3]
    assert alone  # what no anchor within 3 bits finds


def test_common_tokens_are_dealt_by_salts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(simhash, "SALTED", 20)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = docs[3][1].split()[:150]
    rows = [(i, " ".join([*base[: 10 + i % 5], f"only{i}", *base[12 + i % 5 :]])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = simhash.token_order(df.withColumnRenamed("doc_id", "node"), 5, 0.8)
    assert order.salts.max() > 1
    assert kept(spark, rows) == brute_kept(rows)


def test_packed_rows_come_back():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [rng.integers(0, 1 << 40, 99).astype(np.uint64), rng.integers(-(1 << 62), 1 << 62, 99), rng.integers(0, 1 << 20, 99).astype(np.int32), rng.integers(0, 99, 99).astype(np.int32)]
    assert all((a == b).all() for a, b in zip(rows, simhash.unpack_rows(simhash.pack_rows(*rows)), strict=True))


def prose(rng, n):
    return " ".join(f"w{rng.randrange(100_000)}" for _ in range(n))


def test_close_fingerprints_alone_drop_nothing(spark):
    for seed in range(500):
        rng = random.Random(seed)
        rows = [(i, "a b c " * 12 + prose(rng, 40)) for i in (1, 2)]
        a, b = (simhash.fingerprint(t, 5) for _, t in rows)
        if 1 <= (a ^ b).bit_count() <= 3:
            break
    assert 1 <= (a ^ b).bit_count() <= 3 and brute_kept(rows) == {1, 2}
    assert kept(spark, rows) == {1, 2}


def test_members_of_one_fingerprint_are_compared_by_their_own_texts(spark):
    rng = random.Random(3)
    x, y = prose(rng, 40), prose(rng, 40)
    rows = [(1, "a b c " * 150 + x), (2, "a b c " * 150 + y), (3, "a b c a b c a " + y)]
    one, two, three = (simhash.fingerprint(t, 5) for _, t in rows)
    assert one == two and (one ^ three).bit_count() > 7 and brute_kept(rows) == {1, 2}
    assert kept(spark, rows) == {1, 2}


def test_bitmaps_never_rule_out_a_similar_pair():
    import numpy as np

    rng = np.random.default_rng(6)
    for size, other in ((0, 0), (1, 1), (40, 50), (300, 330), (3000, 2600), (700, 5)):
        for shared in (0, min(size, other) // 2, min(size, other)):
            common = rng.integers(0, 1 << 63, shared).astype(np.uint64)
            a, b = (np.concatenate([common, rng.integers(0, 1 << 63, n - shared).astype(np.uint64)]) for n in (size, other))
            differ = len(set(a.tolist()) ^ set(b.tolist()))
            least = simhash.least_difference(simhash.parity_bits(a), simhash.parity_bits(b))
            assert least <= differ and (differ == 0 or least > 0.2 * differ or size / 100 > other)


def test_ids_of_any_type(spark):
    rng = random.Random(9)
    base = prose(rng, 100)
    df = spark.createDataFrame([("a", base), ("b", base + " more"), ("c", prose(rng, 50)), (None, base + " end")], "doc_id string, text string")
    left = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert "c" in left and len(left & {"a", "b"}) == 1 and None not in left


def test_equal_sets_and_bitmaps_are_never_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    text = " ".join(f"word{i}" for i in range(400))
    spark.range(500).select(F.col("id").alias("node"), F.lit(text).alias("text"), F.lit(396).alias("size"), F.lit(bytes(128)).alias("bits")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    rows.filter("node > 0").select((F.col("node") * 0).alias("a"), F.col("node").alias("b")).write.parquet(str(tmp_path / "pairs"))
    pairs = spark.read.parquet(str(tmp_path / "pairs"))
    for found in (simhash.plausible(pairs, rows.select("node", "size", "bits"), 0.8), simhash.similar_pairs(rows, pairs, 5, 0.8)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 499
