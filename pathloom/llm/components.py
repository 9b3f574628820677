"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, looked_up


def _star(pairs: DataFrame, n: int, with_centre: bool) -> DataFrame:
    """n pairs (u, v): every v, and with_centre u itself, is linked to the least of u and its neighbours. The minimum is
    combined before the shuffle; the few nodes with very many neighbours are broadcast, so that no task gets all of these."""
    least = checkpointed(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("times")))
    out = looked_up(pairs, least, ["u"], "times", max(10_000, n // 1000))
    out = out.filter("v > u" if not with_centre else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if with_centre:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of links (a, b), both bigint.

    Links to itself and repeated links change nothing; an empty table gives an empty result. The number
    of rounds grows with the logarithm of the longest chain, and every round is checkpointed."""
    edges = checkpointed(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = checkpointed(_star(both, 2 * state[0], with_centre=False))
        edges = checkpointed(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), state[0], with_centre=True))
