"""Vocabularies, counts, frequencies and sparse matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def lexicographic_vocabulary(ngrams: DataFrame) -> DataFrame:
    """Distinct n-grams with ids in item order (which is not the order of the joined text)."""
    return numbered(ngrams.select("ngram").distinct(), [F.col("ngram")], "feature_id")


def first_seen_vocabulary(ngrams: DataFrame, order: list[str]) -> DataFrame:
    """Distinct n-grams with ids in the order in which they first occur. A min before any sort keeps
    one row per n-gram, combined on the map side."""
    first = ngrams.groupBy("ngram").agg(F.min(F.struct(*order)).alias("first_seen"))
    return numbered(first, [F.col("first_seen"), F.col("ngram")], "feature_id")


def ngram_counts(ngrams: DataFrame, sample: str = "program") -> DataFrame:
    """Occurrences of each n-gram in each sample."""
    return ngrams.groupBy(sample, "ngram").agg(F.count("*").alias("n"))


def feature_counts(ngrams: DataFrame, vocabulary: DataFrame, sample: str = "program") -> DataFrame:
    """Occurrences of each known n-gram in each sample. Counts are taken before the vocabulary is joined, so
    the join moves a row per sample and n-gram; Spark broadcasts the vocabulary if it is small."""
    return known_counts(ngram_counts(ngrams, sample), vocabulary, sample)


def known_counts(counts: DataFrame, vocabulary: DataFrame, sample: str = "program") -> DataFrame:
    """ngram_counts() of the known n-grams."""
    return counts.join(vocabulary.select("ngram", "feature_id"), "ngram").select(sample, "feature_id", "n")


def frequencies(counts: DataFrame, sample: str = "program") -> DataFrame:
    """count / all known n-grams of the sample: unknown ones are not in the denominator."""
    total = F.sum("n").over(Window.partitionBy(sample))
    return counts.withColumn("value", F.col("n") / total)


def sample_vectors(samples: DataFrame, freq: DataFrame, sample: str = "program") -> DataFrame:
    """samples with features (map of id to value); empty for samples without known n-grams."""
    vectors = freq.groupBy(sample).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature_id", "value")))).alias("features"))
    return samples.join(vectors, sample, "left").withColumn("features", F.coalesce("features", F.expr("cast(map() as map<bigint, double>)")))


def batch_rows(samples: DataFrame, order: list[str], batch: int = 100, split: str = "split") -> DataFrame:
    """samples with row_index_in_split, batch_number and row_index_in_batch."""
    if batch < 1:
        raise ValueError("a batch needs at least 1 row")
    placed = numbered(samples, [F.col(c) for c in order], "_row", (split,))
    row = F.col("_row")
    return placed.select(
        *samples.columns, row.cast("int").alias("row_index_in_split"), F.floor(row / batch).cast("int").alias("batch_number"), (row % batch).cast("int").alias("row_index_in_batch")
    )


def coordinates(rows: DataFrame, freq: DataFrame, sample: str = "program") -> DataFrame:
    """Matrix entries with 32-bit values."""
    return rows.join(freq, sample).select("split", "batch_number", "row_index_in_batch", "feature_id", F.col("value").cast("float").alias("value"))


def density(nonzero: Column, rows: Column, columns: Column) -> Column:
    cells = rows * columns
    return F.when(cells > 0, nonzero / cells)


def stratified_split(samples: DataFrame, label: str, key: str, test_tenths: int = 2) -> DataFrame:
    """samples with split: of each label the ceiling of the given tenths, first by MD5 of the key, is test."""
    ranked = numbered(samples, [F.md5(F.col(key).cast("string")), F.col(key)], "_rank", (label,))
    test = F.col("_rank") < F.ceil(F.col("_size") * test_tenths / 10)
    return _with_sizes(ranked, label).select(*samples.columns, F.when(test, "test").otherwise("train").alias("split"))


def folds(samples: DataFrame, label: str, order: str, k: int = 3) -> DataFrame:
    """samples with fold 0..k-1: contiguous, of near equal size within each label, larger ones first."""
    ranked = numbered(samples, [F.col(order)], "_rank", (label,))
    size, more = F.floor(F.col("_size") / k), F.col("_size") % k
    in_large = F.col("_rank") < more * (size + 1)
    fold = F.when(in_large, F.floor(F.col("_rank") / (size + 1))).otherwise(more + F.floor((F.col("_rank") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return _with_sizes(ranked, label).select(*samples.columns, fold.cast("int").alias("fold"))


def _with_sizes(rows: DataFrame, label: str) -> DataFrame:
    """rows with _size, the number of rows of their label; counts are combined before the join."""
    sizes = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_size"))
    return rows.join(sizes, rows[label].eqNullSafe(sizes["_label"])).drop("_label")


def occurrence_report(shingles: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """program, feature_id, ngram and its occurrences (function, graph_type, addresses), sorted."""
    known = shingles.join(vocabulary.select("ngram", "feature_id"), "ngram")
    place = F.struct("function", "graph_type", "addresses")
    return known.groupBy("program", "feature_id", "ngram").agg(F.array_sort(F.collect_list(place)).alias("occurrences"))


def ngram_functions(ngrams: DataFrame) -> DataFrame:
    """Distinct functions of each n-gram, sorted."""
    return ngrams.groupBy("ngram").agg(F.array_sort(F.collect_set("function")).alias("functions"))


def top_contributions(contributions: DataFrame, sample: str, k: int = 20, value: str = "value") -> DataFrame:
    """The k entries of each sample with the largest absolute value, ranked from 1; ties by feature id."""
    order = [F.abs(F.col(value)).desc(), F.col("feature_id")]
    ranked = contributions.withColumn("rank", F.row_number().over(Window.partitionBy(sample).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def evidence(top: DataFrame, functions_by_ngram: DataFrame) -> DataFrame:
    """Ranked features with the functions they occur in; none is an empty list."""
    found = top.join(functions_by_ngram, "ngram", "left")
    return found.withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))
