"""Exact metrics of binary classifiers, from (y_true, y_pred) or (y_true, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import running_totals


def thresholded(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return scored.withColumn("y_pred", F.when(F.col(score) >= threshold, 1).otherwise(0))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(predictions: DataFrame) -> DataFrame:
    """One row: tn, fp, fn, tp."""
    cell = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    return predictions.agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def false_positive_rate(predictions: DataFrame) -> DataFrame:
    """fp / (tn + fp); without negatives it is undefined, and raises."""
    negatives = F.col("tn") + F.col("fp")
    rate = F.when(negatives > 0, F.col("fp") / negatives).otherwise(F.raise_error(F.lit("no negative samples")).cast("double"))
    return confusion(predictions).select(rate.alias("false_positive_rate"))


def classification_report(predictions: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support: a row per class, then accuracy, macro and weighted averages."""
    c = confusion(predictions)
    one = lambda label, hit, wrong, missed: F.struct(
        F.lit(label).alias("label"), _ratio(F.col(hit), F.col(hit) + F.col(wrong)).alias("precision"), _ratio(F.col(hit), F.col(hit) + F.col(missed)).alias("recall"), (F.col(hit) + F.col(missed)).alias("support")
    )
    rows = c.select(((F.col("tn") + F.col("tp")) / (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp"))).alias("accuracy"), F.explode(F.array(one("0", "tn", "fn", "fp"), one("1", "tp", "fp", "fn"))).alias("r"))
    rows = rows.select("accuracy", "r.*").withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    parts = ["precision", "recall", "f1"]
    per_class = rows.select("label", *parts, "support")
    mean = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(x).alias(x) for x in parts], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in parts], F.sum("support").alias("support"))
    overall = rows.agg(F.lit("accuracy").alias("label"), *[F.first("accuracy").alias(x) for x in parts], F.sum("support").alias("support"))
    return per_class.unionByName(overall).unionByName(mean).unionByName(weighted)


def _by_score(scored: DataFrame) -> DataFrame:
    """A row per distinct score with its positives and negatives, and totals from the highest score down."""
    tied = scored.groupBy("score").agg(F.sum("y_true").cast("long").alias("p"), F.sum(1 - F.col("y_true")).cast("long").alias("n"))
    return running_totals(tied, [F.col("score").desc()], {"tp": "p", "fp": "n"})


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall, f1 at every distinct score."""
    rows = _by_score(scored)
    positives = scored.agg(F.sum("y_true").cast("long").alias("positives"))
    rows = rows.crossJoin(F.broadcast(positives))  # one row
    rows = rows.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("positives")))
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rows.select(F.col("score").alias("threshold"), "tp", "fp", "precision", "recall", f1.alias("f1"), "p")


def roc_curve(scored: DataFrame) -> DataFrame:
    """threshold, fpr, tpr at every distinct score."""
    totals = scored.agg(F.sum("y_true").cast("long").alias("positives"), F.sum(1 - F.col("y_true")).cast("long").alias("negatives"))
    rows = _by_score(scored).crossJoin(F.broadcast(totals))  # one row
    return rows.select(F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("negatives")).alias("fpr"), _ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def best_f1(scored: DataFrame) -> DataFrame:
    """The threshold with the highest F1; of equals the lowest."""
    return pr_curve(scored).orderBy(F.col("f1").desc(), F.col("threshold")).limit(1).select("threshold", "precision", "recall", "f1")


def roc_auc(scored: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half. Null without both."""
    rows = _by_score(scored)
    # a score's negatives lose to the positives above it and tie with its own
    won = F.sum((2 * F.col("tp") - F.col("p")) * F.col("n"))
    pairs = F.sum("p") * F.sum("n")
    return rows.agg(F.when(pairs > 0, won / (2 * pairs)).alias("roc_auc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """Sum of precision times the step in recall (no interpolation)."""
    rows = pr_curve(scored)
    return rows.agg((F.sum(F.col("precision") * F.col("p")) / F.sum("p")).alias("average_precision"))


def nearest_threshold(curve: DataFrame, threshold: float) -> DataFrame:
    """The curve point to mark."""
    return curve.orderBy(F.abs(F.col("threshold") - threshold), "threshold").limit(1)


def percent_report(report: DataFrame, digits: int = 4) -> DataFrame:
    parts = ["precision", "recall", "f1"]
    return report.select("label", *[F.round(F.col(x) * 100, digits).alias(x) for x in parts], "support")


def learning_curve_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of each split's F1 by training size."""
    kinds = ("train_f1", "validation_f1")
    return scores.groupBy("size").agg(*[f(k).alias(f"{k}_{n}") for k in kinds for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
