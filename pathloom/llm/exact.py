"""Exact dedup through an extendible-hash index kept in shared files.

Built from DataFrame functions alone. Texts are normalised (white-space runs become one space) and hashed to 64
bits; a first pass writes (row, id, hash, digest) of every row and no text.

Directory. It starts with one slot and doubles while a bucket holds more than ``capacity`` hashes; only overfull buckets
split, so a bucket has a local depth of its own and several slots may name it. Counts by hash prefix are fetched for the
overfull buckets alone, a few bits deeper each time, and there is no limit of depth but the hash's 64 bits. Without a
given capacity it follows the table, so that the directory has some 2 ** 15 buckets at most and each owner several.

Owners. Hashes that occur once are entries as they are. The texts of the others, and only these, are read again, combined
within each reading task, and written in fragments under their bucket. Each owner task takes a range of buckets from
these files, compares the bytes of the texts that share a hash, adds equal ones up, and chains different ones.

Lookup. A row goes from its hash's slot to the bucket and there to the hash's chain. A chain of one entry is the answer; in
a longer chain the texts' bytes are compared. Entries that very many rows look up are few and broadcast, so that no
task gets all copies of a text.

Edge cases: a null text is an empty one; of rows that repeat id and text one stays; a null id never wins over another
id; an empty table gives an empty result; columns other than the id and the text are ignored, and
keep_first() returns them as they were whatever their names; ids may have any type that can be ordered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, free_names, joined_with, looked_up, shuffle_width, written

Hash = Callable[[Column], Column]
#: Buckets that a directory has at most, about, where the capacity follows the table.
BUCKETS = 1 << 15
#: Parts that the copies of a text are combined in before their owner compares them.
FRAGMENTS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ")


@dataclass(frozen=True)
class Index:
    """directory: slot, bucket, local_depth. entries: bucket, local_depth, hash, chain (place in the hash's chain), length
    (of that chain), sha, text (where the chain is longer than 1), keep_id, group_size. rows: what was indexed."""

    directory: DataFrame
    depth: int
    entries: DataFrame
    rows: int
    chained: int
    hash_of: Hash


def grow_directory(count: Callable[[int, int, list[int]], dict[int, int]], total: int, capacity: int) -> tuple[list[tuple[int, int, int]], int]:
    """((slot, bucket, local depth) of every slot, global depth). count(bits, depth, prefixes) gives the hashes by
    their first bits bits, of those whose first depth bits are among the prefixes."""
    buckets = {(0, 0)}  # (local depth, prefix)
    full, depth, known = [0] if total > capacity else [], 0, 0
    by_depth: dict[int, dict[int, int]] = {}
    while full and depth < 64:
        if depth == known:
            known = min(64, depth + (4 if depth else 12))
            by_depth = {known: {p % (1 << known): n for p, n in count(known, depth, full).items()}}
            for d in range(known - 1, depth, -1):
                shorter: Counter[int] = Counter()
                for prefix, n in by_depth[d + 1].items():
                    shorter[prefix >> 1] += n
                by_depth[d] = shorter
        depth += 1  # the directory doubles
        children = [child for prefix in full for child in (2 * prefix, 2 * prefix + 1)]
        buckets -= {(depth - 1, prefix) for prefix in full}
        buckets |= {(depth, child) for child in children}
        full = [child for child in children if by_depth[depth].get(child, 0) > capacity]
    slots = []
    for bucket, (local, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (depth - b[0]))):
        first = prefix << (depth - local)
        slots += [(slot, bucket, local) for slot in range(first, first + (1 << (depth - local)))]
    return slots, depth


def _first_bits(bits: int) -> Column:
    """Of the hash mixed once more, so that poor hashes spread too."""
    return F.shiftrightunsigned(F.xxhash64("hash"), 64 - bits) if bits else F.lit(0).cast("long")


def _placed(rows: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """rows (with a hash) with bucket and local_depth, through the directory, which is of bounded size."""
    return rows.withColumn("slot", _first_bits(depth)).join(F.broadcast(directory), "slot").drop("slot")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Hash = F.xxhash64) -> DataFrame:
    """row, id, hash, sha: written once, so that row numbers stay."""
    norm = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    return written(norm.select(F.monotonically_increasing_id().alias("row"), "id", hash_of(F.col("norm")).cast("long").alias("hash"), sha), "exact-keys")


def _texts_of(docs: DataFrame, hashes: DataFrame, n: int, id_col: str, text_col: str, hash_of: Hash) -> DataFrame:
    """id, norm, hash of the rows whose hash is among n hashes."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", hash_of(F.col("norm")).cast("long"))
    return joined_with(rows, hashes.select("hash"), n, "hash", "left_semi")


def build_index(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Hash = F.xxhash64) -> Index:
    """The index of docs, whose keyed() rows are given."""
    spark = docs.sparkSession
    hashes = written(keys.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("keep_id"), F.min("sha").alias("sha")), "exact-hashes")
    total, rows, repeated = hashes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    if capacity is None:
        capacity = max(1, total // BUCKETS, min(16_384, total // (8 * shuffle_width(spark))))

    def count(bits: int, depth: int, prefixes: list[int]) -> dict[int, int]:
        there = hashes.select("hash")
        if depth:
            wanted = spark.createDataFrame([(p,) for p in prefixes], "prefix long")
            there = there.join(F.broadcast(wanted), _first_bits(depth) == F.col("prefix"), "left_semi")
        return {r[0]: r[1] for r in there.groupBy(_first_bits(bits)).count().collect()}

    slots, depth = grow_directory(count, total, capacity)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("slot", "bucket", "local_depth")])
    directory = written(spark.createDataFrame(slots, schema), "exact-directory")

    texts = _placed(_texts_of(docs, hashes.filter("n > 1"), repeated, id_col, text_col, hash_of), directory, depth)
    texts = texts.withColumn("fragment", F.spark_partition_id() % FRAGMENTS)
    together = ["bucket", "local_depth", "hash", "norm"]
    fragments = written(texts.groupBy(*together, "fragment").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).drop("fragment"), "exact-fragments")
    # an owner has a range of buckets, and with it all fragments of a hash: neither grouping nor chaining shuffles again
    owned = fragments.repartitionByRange("bucket").groupBy(*together).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "hash")
    owned = owned.withColumn("chain", F.row_number().over(chain.orderBy("norm")) - 1).withColumn("length", F.count("*").over(chain))
    columns = ["bucket", "local_depth", "hash", "chain", "length", "sha", "text", "keep_id", "group_size"]
    several = owned.withColumn("sha", F.unhex(F.sha2("norm", 256))).withColumn("text", F.when(F.col("length") > 1, F.col("norm"))).select(*columns)
    once = _placed(hashes.filter("n = 1"), directory, depth).select(
        "bucket", "local_depth", "hash", F.lit(0).alias("chain"), F.lit(1).cast("long").alias("length"), "sha", F.lit(None).cast("string").alias("text"), "keep_id", F.col("n").alias("group_size")
    )
    entries = once.unionByName(several).repartitionByRange("bucket", "hash").sortWithinPartitions("bucket", "hash", "chain")
    entries = written(entries, "exact-index")
    return Index(directory, depth, entries, rows, entries.filter("length > 1").count(), hash_of)


def lookup(docs: DataFrame, keys: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, hash, sha, keep_id, group_size of each keyed() row of docs that the index holds. Rows of a longer chain
    have no row number."""
    often = max(1000, index.rows // 1000)
    answer = ["bucket", "hash", "sha", "keep_id", "group_size"]
    probes = _placed(keys.select("row", "id", "hash"), index.directory, index.depth).drop("local_depth")
    found = looked_up(probes, index.entries.filter("length = 1").select(*answer), ["bucket", "hash"], "group_size", often)
    columns = ["row", "id", "hash", "sha", "keep_id", "group_size"]
    if not index.chained:
        return found.select(*columns)
    chained = index.entries.filter("length > 1")
    texts = _texts_of(docs, chained.select("hash").distinct(), index.chained, id_col, text_col, index.hash_of)
    texts = _placed(texts, index.directory, index.depth).drop("local_depth").withColumn("row", F.lit(None).cast("long"))
    by_bytes = looked_up(texts, chained.select(*answer, F.col("text").alias("norm")), ["bucket", "hash", "norm"], "group_size", often)
    return found.select(*columns).unionByName(by_bytes.select(*columns))


def _again(keys: DataFrame) -> tuple[DataFrame, int]:
    """(hash, sha, id and the first row number of rows that repeat all three, how many such there are)."""
    found = written(keys.groupBy("hash", "sha", "id").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1").select("hash", "sha", F.col("id").alias("t_id"), "first"), "exact-again")
    return found, found.count()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Hash = F.xxhash64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    keys = keyed(docs, id_col, text_col, hash_of)
    index = build_index(docs, keys, id_col, text_col, capacity, hash_of)
    found = lookup(docs, keys, index, id_col, text_col)
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    again, n = _again(keys)
    if n:
        # rows are alike but for their number, and those of a longer chain have none: they are numbered by the key table
        numbers = keys.select("row", "id", "hash", "sha")
        if index.chained:
            entry = found.select("hash", "sha", "keep_id", "group_size").distinct()
            found = numbers.join(entry, ["hash", "sha"])
        on = [F.col("id").eqNullSafe(F.col("t_id")), F.col("hash") == F.col("t_hash"), F.col("sha") == F.col("t_sha")]
        again = again.withColumnsRenamed({"hash": "t_hash", "sha": "t_sha"})
        found = joined_with(found, again, n, on, "left")
        kept = kept & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, hash_of: Hash = F.xxhash64) -> DataFrame:
    """docs without the later copies of a text, all columns as they were. Rows that share an id but not a text are
    judged one by one; of rows that share both, the one with the smallest unnormalised text stays. What goes is looked
    for by hash, digest and id; where it is little, texts stay where they are."""
    keys = keyed(docs, id_col, text_col, hash_of)
    found = lookup(docs, keys, build_index(docs, keys, id_col, text_col, capacity, hash_of), id_col, text_col)
    gone = written(found.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("hash").alias("g_hash"), F.col("sha").alias("g_sha"), F.col("id").alias("g_id")).distinct(), "exact-gone")
    h, s, row, gh, gs, gi, first = free_names(docs, "hash", "sha", "row", "g_hash", "g_sha", "g_id", "first")
    norm = normalised(F.col(text_col))
    probes = docs.withColumns({h: hash_of(norm).cast("long"), s: F.unhex(F.sha2(norm, 256))})

    def same(table: DataFrame) -> tuple[DataFrame, list[Column]]:
        return table.toDF(gh, gs, gi), [F.col(h) == F.col(gh), F.col(s) == F.col(gs), F.col(id_col).eqNullSafe(F.col(gi))]

    table, on = same(gone)
    stay = joined_with(probes, table, gone.count(), on, "left_anti")
    again, n = _again(keys)
    if not n:
        return stay.select(*docs.columns)
    table, on = same(again.select("hash", "sha", "t_id"))
    alone = joined_with(stay, table, n, on, "left_anti").select(*docs.columns)
    several = joined_with(stay, table, n, on, "left_semi")
    one = several.groupBy(h, s).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(row))
    return alone.unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
