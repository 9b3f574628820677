"""Sliding n-grams over ordered items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_arrays(items: Column, n: int) -> Column:
    """Array of (start, ngram), stride 1; none if there are fewer than n items."""
    if n < 1:
        raise ValueError("n must be at least 1")
    starts = F.sequence(F.lit(0), F.size(items) - n)
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), F.slice(items, i + 1, n).alias("ngram")))
    # sequence() counts down when the end is below the start, so short paths are kept away from it
    return F.when(F.size(items) >= n, windows).otherwise(F.array().cast("array<struct<start: int, ngram: array<string>>>"))


def shingle(paths: DataFrame, n: int, items: str = "mnemonics", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per window of each path, with the path's other columns; each column in carry (arrays
    parallel to items) is cut to the window too."""
    rows = paths.withColumn("_w", F.explode(window_arrays(F.col(items), n)))
    cut = [F.slice(c, F.col("_w.start") + 1, n).alias(c) for c in carry]
    rest = [c for c in paths.columns if c != items and c not in carry]
    return rows.select(*rest, F.col("_w.start").alias("start"), *cut, F.col("_w.ngram").alias("ngram"))


def linear(instructions: DataFrame, n: int, by: list[str], order: str = "idx", item: str = "mnemonic") -> DataFrame:
    """n-grams of each group in its order; windows never reach into the next group."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(*by).orderBy(order)
    ahead = [F.col(item), *[F.lead(item, k).over(w) for k in range(1, n)]]
    rows = instructions.select(*by, F.col(order).alias("start"), F.array(*ahead).alias("ngram"), F.lead(order, n - 1).over(w).alias("_last"))
    return rows.filter("_last IS NOT NULL").drop("_last")
