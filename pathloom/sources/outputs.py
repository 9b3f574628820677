"""Results in the files that other programs read: predictions, metrics, row metadata, occurrences, guarded CSV."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import csv_guarded

#: Spreadsheets tell UTF-8 by it.
BYTE_ORDER_MARK = "﻿"


def write_csv(df: DataFrame, path: str, mark: bool = True, one_file: bool = False) -> None:
    """CSV with header, formula guard and byte order mark. one_file: for small tables that a person opens."""
    rows = csv_guarded(df)
    if mark:
        rows = rows.withColumnRenamed(rows.columns[0], BYTE_ORDER_MARK + rows.columns[0])
    rows = rows.coalesce(1) if one_file else rows
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def write_predictions(scored: DataFrame, path: str, order: str) -> None:
    """y_true and y_pred in the order of a column: ranges are written one after another."""
    scored.repartitionByRange(order).sortWithinPartitions(order).select("y_true", "y_pred").write.mode("overwrite").option("header", True).csv(path)


def _plain(value: object) -> object:
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a metric is not finite")
    return value


def metrics_document(report: DataFrame, cells: DataFrame, extra: dict) -> dict:
    """One set's metrics: the classification report by label, as shares and as percentages, the confusion cells, and what else is
    given. The tables have a few rows each."""
    rows = {r["label"]: r.asDict() for r in report.collect()}
    parts = ("precision", "recall", "f1")
    shares = {label: {x: _plain(r[x]) for x in parts} | {"support": r["support"]} for label, r in rows.items()}
    percent = {label: {x: None if r[x] is None else round(r[x] * 100, 4) for x in parts} | {"support": r["support"]} for label, r in rows.items()}
    one = cells.first().asDict()
    named = {"true_negatives": one["tn"], "false_positives": one["fp"], "false_negatives": one["fn"], "true_positives": one["tp"]}
    return {k: _plain(v) for k, v in extra.items()} | named | {"classification_report": shares, "classification_report_percent": percent}


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A small document as one line of JSON; NaN and infinity are refused."""
    text = json.dumps(document, ensure_ascii=False, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_row_metadata(rows: DataFrame, path: str) -> None:
    """Row metadata by split and batch, a JSON object a row in the order of the rows; stale batches go."""
    dealt = rows.repartition("split", "batch_number").sortWithinPartitions("split", "batch_number", "row_index_in_batch")
    dealt.write.mode("overwrite").partitionBy("split", "batch_number").json(path)


def occurrence_documents(report: DataFrame, n: int) -> DataFrame:
    """program and document (JSON): the n-grams of each program by feature id with their occurrences. A program's document
    is one value by its format; what is collected is one program's n-grams, never more."""
    feature = F.struct("feature_id", F.array_join("ngram", " ").alias("ngram"), F.size("occurrences").alias("count"), "occurrences")
    listed = report.groupBy("program").agg(F.array_sort(F.collect_list(feature)).alias("features"))
    document = F.to_json(F.struct(F.col("program").alias("binary"), F.lit(n).alias("n"), F.size("features").alias("feature_count"), "features"))
    return listed.select("program", document.alias("document"))


def write_occurrences(report: DataFrame, n: int, path: str) -> None:
    """A document a line, programs in folders of their own."""
    occurrence_documents(report, n).write.mode("overwrite").partitionBy("program").text(path)
