import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from pathloom.functions.numbering import numbered, running_totals
from pathloom.operators import metrics as mt
from pyspark.sql import functions as F


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, score double")


def test_ranking_metrics_against_definitions(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    df = scored(spark, rows)
    assert math.isclose(mt.roc_auc(df).first()[0], auc)
    ap, before = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        hits = sum(s >= t for s in pos)
        recall, precision = hits / len(pos), hits / sum(s >= t for _, s in rows)
        ap, before = ap + (recall - before) * precision, recall
    assert math.isclose(mt.average_precision(df).first()[0], ap)


def test_published_confusion_counts(spark):
    # a fixed published test result: 616 true negatives, 3 false positives, 5 false negatives, 257 true positives
    rows = [(0, 0)] * 616 + [(0, 1)] * 3 + [(1, 0)] * 5 + [(1, 1)] * 257
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    assert tuple(mt.confusion(df).first()) == (616, 3, 5, 257)
    report = {r["label"]: r for r in mt.classification_report(df).collect()}
    assert round(report["accuracy"]["f1"], 6) == 0.990919
    assert round(report["1"]["precision"], 4) == 0.9885
    assert round(report["1"]["recall"], 4) == 0.9809


def test_undefined_cases(spark):
    ones = spark.createDataFrame([(1, 1)], "y_true int, y_pred int")
    with pytest.raises(PySparkException):
        mt.false_positive_rate(ones).collect()
    assert mt.roc_auc(scored(spark, [(1, 0.5)])).first()[0] is None
    assert mt.classification_report(ones).filter("label = '0'").first()["f1"] == 0.0


def test_lowest_threshold_wins_ties(spark):
    df = scored(spark, [(1, 0.9), (0, 0.5), (1, 0.3), (0, 0.1)])
    best = mt.best_f1(df).first()
    f1 = {r["threshold"]: r["f1"] for r in mt.pr_curve(df).collect()}
    assert best["threshold"] == min(t for t, f in f1.items() if f == max(f1.values()))


def test_numbering_over_ranges(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r["v"]: r["id"] for r in numbered(df, [F.col("v")], "id").collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    totals = {r["v"]: r["t"] for r in running_totals(df, [F.col("v").desc()], {"t": "v"}).collect()}
    down = sorted(values, reverse=True)
    assert totals == dict(zip(down, np.cumsum(down).tolist(), strict=True))
    assert numbered(df.filter("v < 0"), [F.col("v")], "id").count() == 0


def test_numbers_whatever_the_columns_are_called(spark):
    names = ["range", "size", "AT", "offset", "rank", "in_g", "v", "g"]
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, i, i % 2) for i in range(20)], names)
    got = numbered(df, [F.col("v")], "rank", ("g",))
    assert got.columns == ["range", "size", "AT", "offset", "in_g", "v", "g", "rank"]
    assert all(r["rank"] == r["v"] // 2 for r in got.collect())
    totals = running_totals(df.withColumn("of_t", F.lit(1)), [F.col("v")], {"t": "v"})
    assert all(r["t"] == r["v"] * (r["v"] + 1) // 2 for r in totals.collect())
