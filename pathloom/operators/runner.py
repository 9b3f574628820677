"""A batch of judge inputs from a folder to tables: screened, resumed, asked, saved, summarised."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.storage import exists, written
from ..sources.graphs import read_strict_json
from . import calls, judging, reports
from .reports import JudgeOptions

_FORM = "unsupported_claims array<struct<quote: string, candidate_path: string>>, shap_faithfulness struct<faithful: boolean, discrepancies: array<struct<quote: string>>>, scores map<string, double>"


def prepared(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A row per input file, in the order of their names and the first ``limit`` of them at most: path, sample_id, status, reason, the columns
    of screened(), and item (JSON, of those that are ready). Of files with the same binary and n the first counts."""
    if limit is not None and limit < 1:
        raise ValueError("a limit must be positive")
    files = read_strict_json(spark, path).withColumn("path", F.col("path"))
    files = files.orderBy("path").limit(limit) if limit else files
    rows = judging.sample_ids(judging.screened(judging.judge_inputs(files)))
    rows = rows.withColumn("status", F.when(F.col("valid"), F.col("status")).otherwise("input_error")).withColumn("analysis", F.coalesce(F.get_json_object("text", "$.llm.analysis"), F.get_json_object("text", "$.analysis")))
    ready = judging.first_of_identity(rows.filter("status = 'input_ready'"), "sample_id", ["path"])
    rows = ready.unionByName(rows.filter("status <> 'input_ready'").withColumn("sample_id", F.lit(None).cast("string")))
    items = calls.judge_items(ready).withColumnRenamed("sample_id", "_id")
    joined = rows.join(items, (F.col("sample_id") == F.col("_id")) & (F.col("status") == "input_ready"), "left").drop("_id", "text", "valid")
    return written(joined, "judge-inputs")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Everything that was saved, with the time of its last attempt."""
    if not exists(spark, path):
        return spark.createDataFrame([], calls.EVALUATED).withColumn("at", F.lit(None).cast("string"))
    return spark.read.schema(calls.EVALUATED).parquet(path).withColumn("at", F.element_at("attempts.at", -1))


def judged(inputs: DataFrame, saved: DataFrame, protocol: str) -> DataFrame:
    """inputs with the latest result of the same input and protocol, successes first, and the flags that follow from it: has_unsupported_claims and
    faithful_to_shap, with the numbers of the assessments checked anew."""
    mine = saved.filter(F.col("protocol_hash") == protocol).select(F.col("sample_id").alias("_id"), F.col("input_hash").alias("_hash"), F.col("status").alias("verdict"), "evaluation", "error", "attempts", "at")
    last = Window.partitionBy("_id", "_hash").orderBy((F.col("verdict") == "success").desc(), F.col("at").desc_nulls_last())
    mine = mine.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "at")
    rows = inputs.withColumn("input_hash", F.sha2("item", 256)).join(mine, (F.col("sample_id") == F.col("_id")) & (F.col("input_hash") == F.col("_hash")), "left").drop("_id", "_hash")
    status = F.when((F.col("status") == "input_ready") & F.col("verdict").isNotNull(), F.col("verdict")).otherwise(F.col("status"))
    known = F.map_from_entries(F.transform("features", lambda f: F.struct(f["ngram"], f["shap_value"])))
    off = lambda a: known[a["ngram"]].isNull() | (F.abs(a["shap_contribution"] - known[a["ngram"]]) > judging.TOLERANCE + judging.SLACK)
    numbers_match = ~F.coalesce(F.exists("evidence_analysis", off), F.lit(False))
    form = F.from_json("evaluation", _FORM)
    rows = rows.withColumn("status", status).withColumn("numbers_match", F.when(F.col("status") == "success", numbers_match)).withColumn("form", form)
    claims = (F.size("form.unsupported_claims") > 0) | (F.size("form.shap_faithfulness.discrepancies") > 0) | ~F.col("numbers_match")
    rows = rows.withColumn("has_unsupported_claims", F.when(F.col("status") == "success", claims))
    rows = rows.withColumn("faithful_to_shap", F.when(F.col("status") == "success", F.col("form.shap_faithfulness.faithful") & F.col("numbers_match")))
    return rows.select(*[c for c in rows.columns if c not in ("form", "verdict")], *[F.col("form.scores")[d].alias(d) for d in judging.DIMENSIONS])


def run_batch(spark: SparkSession, inputs: str, output: str, options: JudgeOptions, rubric: calls.Rubric, send: Callable[[dict], dict], limit: int | None = None, dry_run: bool = False, delay: float = 1.0, chunk: int = 1000) -> dict[str, int]:
    """Judges the files under inputs that have no saved success, appends to output/results, and returns how many have which status. A folder of
    results made under another protocol is refused, so that protocols are never mixed. dry_run: nothing is asked.

    Samples are judged and saved in chunks, one after another. After a chunk that stopped (a fatal refusal, or errors in a row) the rest is
    not_attempted_batch_stopped, after an interruption not_attempted_interrupted; what was saved stays, and another run goes on from there."""
    if output.rstrip("/") == inputs.rstrip("/") or output.startswith(inputs.rstrip("/") + "/"):
        raise ValueError("the output must lie outside the input folder")
    protocol, path = calls.protocol_hash(options, rubric), f"{output.rstrip('/')}/results"
    saved = results(spark, path)
    if saved.filter(F.col("protocol_hash") != protocol).limit(1).count():
        raise ValueError("options or rubric have changed: use another output folder")
    rows = prepared(spark, inputs, limit)
    pending = "input_ready"
    if not dry_run:
        ready = rows.filter("item IS NOT NULL").withColumn("input_hash", F.sha2("item", 256)).withColumn("protocol_hash", F.lit(protocol))
        todo = written(numbered(judging.resume(ready, saved).filter("action = 'run'").select("sample_id", "item"), [F.col("sample_id")], "pos"), "judge-todo")
        for first in range(0, todo.count(), chunk):
            part = todo.filter((F.col("pos") >= first) & (F.col("pos") < first + chunk))
            try:
                found = written(calls.evaluate_all(part, options, rubric, send, delay), "judge-chunk")
                found.write.mode("append").parquet(path)
            except KeyboardInterrupt:
                pending = "not_attempted_interrupted"
                break
            if found.filter("fatal OR status = 'not_attempted_batch_stopped'").limit(1).count():
                pending = "not_attempted_batch_stopped"
                break
    done = judged(rows, results(spark, path), protocol).withColumn("status", F.when(F.col("status") == "input_ready", pending).otherwise(F.col("status")))
    return {r["status"]: r["n"] for r in judging.status_counts(done).collect()}


def summary_tables(done: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report, from judged() rows."""
    attempts = done.filter("attempts IS NOT NULL").select(F.explode("attempts").alias("a")).select("a.*")
    return {
        "hallucination": judging.share_table(done, "has_unsupported_claims", "Explanations with unsupported claims", "Explanations without unsupported claims"),
        "faithfulness": judging.share_table(done, "faithful_to_shap", "Faithful to SHAP", "Faithfulness discrepancy"),
        "quality": judging.quality_table(done), "status": judging.status_counts(done), "usage": judging.token_usage(attempts),
    }


def export(spark: SparkSession, inputs: str, output: str, options: JudgeOptions, rubric: calls.Rubric, folder: str, limit: int | None = None) -> None:
    """Report of what is saved, into a folder of the driver's."""
    done = written(judged(prepared(spark, inputs, limit), results(spark, f"{output.rstrip('/')}/results"), calls.protocol_hash(options, rubric)), "judged")
    reports.export_summary(summary_tables(done), folder, "Judged explanations")
