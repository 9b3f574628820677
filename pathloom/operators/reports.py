"""Detection reports, prompts, judge forms and run states; exports of small summaries."""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import judging

#: A detection report as one row (nested, as its JSON file is).
REPORT = """
sample struct<binary_name: string, source_name: string, source_path: string, split: string, batch_number: int, row_index_in_batch: int, actual_label: int, actual_class: string>,
random_forest struct<ngram_size: int, malware_probability: double, predicted_class: int, predicted_class_name: string>,
shap struct<top_feature_limit: int, top_features: array<struct<feature_id: int, ngram: string, value: double, shap_value: double>>, status: string, error: string>,
llm struct<status: string, reason: string, analysis: struct<tier: string, explanation: string, confidence_score: double>, error: string,
  token_usage: struct<input_tokens: bigint, output_tokens: bigint, source: string>>
"""


@dataclass(frozen=True)
class JudgeOptions:
    """What a judging run depends on; public() is what its protocol hash covers."""

    model: str
    api_key: str = field(default="", repr=False)
    effort: str = "high"
    thinking: bool = True
    max_tokens: int = 8000
    timeout: float = 600.0
    max_attempts: int = 3
    shap_target_class: int = 1
    shap_tolerance: float = judging.TOLERANCE
    consistency_runs: int = 3

    def __post_init__(self) -> None:
        if self.effort not in ("low", "medium", "high", "xhigh", "max"):
            raise ValueError("unknown effort")
        for name, least in (("max_tokens", 1), ("max_attempts", 1), ("consistency_runs", 2)):
            value = getattr(self, name)
            if type(value) is not int or value < least:
                raise ValueError(f"{name} must be a whole number of at least {least}")
        if not self.thinking and self.effort in ("xhigh", "max"):
            raise ValueError("without thinking the effort is low, medium or high")
        if self.shap_target_class not in (0, 1) or self.timeout <= 0 or self.shap_tolerance < 0:
            raise ValueError("invalid class, timeout or tolerance")

    @classmethod
    def from_env(cls, environ: dict[str, str], prefix: str = "JUDGE_") -> JudgeOptions:
        """Options named JUDGE_MODEL, JUDGE_MAX_TOKENS and so on; the rest keep their defaults."""
        given = {}
        for f in fields(cls):
            raw = environ.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default) if f.default is not MISSING else str
                given[f.name] = raw.lower() in ("1", "true", "yes") if kind is bool else kind(raw)
        return cls(**given)

    def public(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "api_key"}


def flat_reports(reports: DataFrame) -> DataFrame:
    """The 19 columns of the batch CSV."""
    features = F.to_json("shap.top_features")
    return reports.select(
        "sample.binary_name", "sample.source_name", "sample.source_path", "sample.batch_number", "sample.row_index_in_batch", "sample.actual_class",
        "random_forest.predicted_class", "random_forest.predicted_class_name", "random_forest.malware_probability",
        F.col("shap.status").alias("shap_status"), features.alias("top_shap_features_json"), F.col("llm.status").alias("llm_status"),
        F.col("llm.analysis.tier").alias("llm_tier"), F.col("llm.analysis.confidence_score").alias("llm_confidence_score"), F.col("llm.analysis.explanation").alias("llm_explanation"),
        F.col("llm.token_usage.input_tokens").alias("llm_input_tokens"), F.col("llm.token_usage.output_tokens").alias("llm_output_tokens"), F.col("llm.token_usage.source").alias("llm_token_usage_source"),
        F.coalesce("llm.error", "shap.error").alias("error"),
    )


def detection_summary(reports: DataFrame) -> DataFrame:
    """One row of counts and metrics over detection reports; accuracy is null without any."""
    y, p, status = F.col("sample.actual_label"), F.col("random_forest.predicted_class"), F.col("llm.status")
    n = F.count("*")
    counts = {
        "actual_benign": y == 0, "actual_cryptojacking": y == 1, "predicted_benign": p == 0, "predicted_cryptojacking": p == 1,
        "llm_completed": status == "completed", "llm_failed": status == "failed", "llm_skipped": status == "skipped",
        "true_positives": (y == 1) & (p == 1), "false_positives": (y == 0) & (p == 1), "false_negatives": (y == 1) & (p == 0),
    }
    return reports.agg(n.alias("test_samples"), *[F.count_if(c).alias(k) for k, c in counts.items()], F.when(n > 0, F.count_if(y == p) / n).alias("accuracy"))


def reusable(rows: DataFrame, saved: DataFrame, ngram_size: int) -> DataFrame:
    """rows of a manifest with reuse: is there a saved report of the same source, place and label, for
    this n, whose SHAP is complete and whose explanation is complete or skipped?"""
    s = saved.filter((F.col("random_forest.ngram_size") == ngram_size) & (F.col("shap.status") == "completed") & F.col("llm.status").isin("completed", "skipped"))
    keys = ["source_name", "source_path", "batch_number", "row_index_in_batch"]
    s = s.select(*[F.col(f"sample.{k}").alias(f"_{k}") for k in keys], F.col("sample.actual_label").alias("_label")).distinct().withColumn("_hit", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & rows[k].eqNullSafe(s[f"_{k}"])
    joined = rows.join(s, same & rows["label"].eqNullSafe(s["_label"]), "left")
    return joined.select(*rows.columns, F.coalesce("_hit", F.lit(False)).alias("reuse"))


def paired_batches(features: DataFrame, labels: DataFrame) -> DataFrame:
    """batch ids with what is wrong: only on one side, or different row counts. None is right.

    features, labels: (batch_id, n_rows)."""
    both = features.withColumnRenamed("n_rows", "feature_rows").join(labels.withColumnRenamed("n_rows", "label_rows"), "batch_id", "full")
    problem = F.when(F.col("label_rows").isNull(), "no labels").when(F.col("feature_rows").isNull(), "no features").when(F.col("feature_rows") != F.col("label_rows"), "row mismatch")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL")


def dimension_check(model_features: int, vocabulary: DataFrame, matrix: DataFrame) -> None:
    """Raises unless the model, the vocabulary and the matrix agree on the number of features."""
    size = vocabulary.count()
    highest = matrix.agg(F.max("feature_id")).first()[0]
    if size != model_features:
        raise ValueError(f"the model has {model_features} features, the vocabulary {size}")
    if highest is not None and highest >= size:
        raise ValueError(f"feature {highest} is beyond the vocabulary's {size}")


def token_count(value: Column) -> Column:
    """A reported token count (as text): a whole number that is not negative; truth values are none."""
    number = F.when(value.rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(value)).cast("bigint")
    return F.when(number >= 0, number)


def truncated(finish_reason: Column, done: Column, output_tokens: Column, max_tokens: int) -> Column:
    """Was an answer cut off: by its stated reason, an unfinished flag, or the token limit?"""
    stated = F.lower(finish_reason).isin("length", "max_tokens", "length_limit")
    return F.coalesce(stated, F.lit(False)) | F.coalesce(~done, F.lit(False)) | F.coalesce(output_tokens >= max_tokens, F.lit(False))


# The text of a prompt, on whose wording answers depend. Before and after the evidence; the system's part.
PROMPT_INTRODUCTION = """ most influential features (assembly mnemonic n-gram sequences) that drove the Random Forest prediction, ranked by absolute SHAP contribution. For each n-gram, the relative frequency in the binary, the SHAP contribution score, and every function where the n-gram was observed are listed.

============================================================
SHAP EVIDENCE
============================================================"""
PROMPT_INSTRUCTIONS = """

============================================================
ANALYSIS INSTRUCTIONS

Based on the SHAP evidence above, classify this binary into one of three tiers:
  • high-confidence  — strong evidence of cryptojacking
  • low-confidence   — some indicators present but inconclusive
  • benign           — evidence does not support cryptojacking

IMPORTANT: Your analysis must be grounded ONLY in the evidence provided above. Do not reference functions, API calls, or behaviors not present in the evidence. Every claim must be traceable to specific n-grams and SHAP contributions listed above.

Respond with a single JSON object matching this schema:
{
  "tier": "<one of: high-confidence, low-confidence, benign>",
  "explanation": "<detailed paragraph explaining your reasoning, referencing specific n-grams and SHAP contributions from the evidence>",
  "evidence_analysis": [
    {
      "ngram": "<n-gram sequence>",
      "shap_contribution": <float>,
      "assessment": "<your interpretation of what this pattern indicates in the context of cryptojacking>"
    }
  ],
  "confidence_score": <float between 0.0 and 1.0>,
  "key_indicators": ["<indicator 1>", "<indicator 2>"],
  "recommended_action": "<action recommendation for a malware analyst>"
}"""
PROMPT_SYSTEM = "You are an expert malware analyst specializing in cryptojacking detection. You analyze assembly-level evidence from binary executables and produce structured JSON assessments. Output ONLY valid JSON — no markdown fences, no commentary outside the JSON object."


def prompts(samples: DataFrame, evidence: DataFrame) -> DataFrame:
    """sample_id and prompt: the forest's verdict and the ranked evidence in fixed lines, then what to answer.

    samples: sample_id, binary_name, prediction, probability; evidence: sample_id, rank, ngram, value, shap_value."""
    line = F.concat(
        F.lit("\n\nRank "), F.col("rank").cast("string"), F.lit(": "), "ngram", F.lit("\n  Frequency : "), F.format_string("%.6f", "value"),
        F.lit("\n  SHAP      : "), F.format_string("%+.6f", "shap_value"), F.lit(" ("), tx.direction(F.col("shap_value")), F.lit(")"),
    )
    listed = evidence.select("sample_id", "rank", line.alias("line")).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("e"))
    joined = samples.join(listed, "sample_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<rank: int, line: string>>")))
    head = F.concat(
        F.lit("Binary Name: "), "binary_name", F.lit("\nRandom Forest Prediction: MALWARE (class "), F.col("prediction").cast("string"),
        F.lit(") with probability "), F.format_string("%.4f", "probability"), F.lit(".\n\nThe following are the Top-"), F.size("e").cast("string"), F.lit(PROMPT_INTRODUCTION),
    )
    return joined.select("sample_id", F.concat(head, F.array_join(F.transform("e", lambda x: x["line"]), ""), F.lit(PROMPT_INSTRUCTIONS)).alias("prompt"))


def run_states(attempts: DataFrame, most_errors: int = 3) -> DataFrame:
    """attempts in order (pos, outcome, fatal) with status: once most_errors judge errors come in a row, or a
    fatal one, everything that would still be asked is not_attempted_batch_stopped. Rejected inputs are never
    asked, and neither break nor lengthen a row of errors. Ordered by a run's file order, so one run is one group."""
    asked = F.col("outcome").isin("success", "judge_error", "resumed")
    order = Window.partitionBy("run").orderBy("pos")
    tries = attempts.filter(asked)
    streak = F.col("outcome") == "judge_error"
    for k in range(1, most_errors):
        streak = streak & F.coalesce(F.lag("outcome", k).over(order) == "judge_error", F.lit(False))
    stops = tries.withColumn("_stop", streak | F.coalesce(F.col("fatal"), F.lit(False))).filter("_stop").groupBy("run").agg(F.min("pos").alias("_stop_pos"))
    late = asked & F.coalesce(F.col("pos") > F.col("_stop_pos"), F.lit(False))
    return attempts.join(stops, "run", "left").withColumn("status", F.when(late, "not_attempted_batch_stopped").otherwise(F.col("outcome"))).drop("_stop_pos")


def _pointers(documents, paths):
    """json_pointer() over Arrow arrays."""
    import pyarrow as pa

    pairs = zip(documents.to_pylist(), paths.to_pylist(), strict=True)
    return pa.array([tx.json_pointer(d, p) for d, p in pairs], pa.string())


def verified_findings(findings: DataFrame, candidates: DataFrame, item: str = "sample_id") -> DataFrame:
    """findings with verified: does the text that candidate_path points to hold the quote word for word? Paths must
    lead into the candidate analysis. candidates: (sample_id, analysis), the analysis as JSON."""
    # paths are data, which no built-in JSON path takes
    find = F.arrow_udf(_pointers, "string")
    inner = F.regexp_replace("candidate_path", "^/candidate_analysis", "")
    joined = findings.join(candidates.select(item, "analysis"), item, "left").withColumn("_target", find("analysis", inner))
    inside = F.col("candidate_path").startswith("/candidate_analysis/")
    return joined.withColumn("verified", F.coalesce(inside & F.contains("_target", "quote"), F.lit(False))).drop("_target", "analysis")


def consistent_faithfulness(forms: DataFrame) -> DataFrame:
    """forms (faithful, discrepancies) with valid: a form is faithful exactly if it lists no discrepancy."""
    return forms.withColumn("valid", F.coalesce(F.col("faithful") == (F.size("discrepancies") == 0), F.lit(False)))


def write_reports(reports: DataFrame, path: str) -> None:
    """A JSON object a line; NaN and infinity, which JSON has not, are refused in any number."""
    odd = lambda c: c.isNotNull() & ~tx.finite(c)
    numbers = [odd(F.col("random_forest.malware_probability"))]
    numbers += [F.coalesce(F.exists("shap.top_features", lambda x: odd(x["value"]) | odd(x["shap_value"])), F.lit(False))]
    numbers += [odd(F.col("llm.analysis.confidence_score"))]
    bad = numbers[0]
    for x in numbers[1:]:
        bad = bad | x
    if reports.filter(bad).limit(1).count():
        raise ValueError("a number is not finite")
    reports.write.mode("overwrite").json(path)


def export_summary(tables: dict[str, DataFrame], folder: str | Path, title: str) -> None:
    """report.md, report.html and a CSV of each summary table: of a few rows each, so they are rendered on the driver, into a
    folder of the driver's (for people, not for further jobs)."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    md, pages, bodies = [f"# {title}"], [f"<h1>{html.escape(title)}</h1>"], []
    for name, df in tables.items():
        rows = [r.asDict() for r in df.collect()]
        md += ["", f"## {name}", "", tx.markdown_table(df.columns, rows)]
        pages += [f"<h2>{name}</h2>", tx.html_table(df.columns, rows)]
        bodies.append((f"{tx.file_name(name)}.csv", tx.csv_table(df.columns, rows)))
    bodies += [("report.md", "\n".join(md) + "\n"), ("report.html", '<!doctype html><meta charset="utf-8">' + "".join(pages))]
    for file, body in bodies:
        part = folder / (file + ".tmp")
        part.write_text(body, encoding="utf-8")
        part.replace(folder / file)


def append_history(superseded: DataFrame, path: str) -> None:
    """Results that a new run replaces are added to the history, never overwritten."""
    superseded.withColumn("archived_at", F.current_timestamp()).write.mode("append").parquet(path)


def retried(call: Callable[[str], str], attempts: int = 3, delay: float = 1.0, sleep: Callable[[float], None] | None = None) -> Callable[[str], str]:
    """call, tried again with twice the wait each time; the last error is raised."""
    import time

    def run(prompt: str) -> str:
        wait = delay
        for i in range(attempts):
            try:
                return call(prompt)
            except Exception:  # the callable is the user's
                if i + 1 == attempts:
                    raise
                (sleep or time.sleep)(wait)
                wait *= 2
        raise AssertionError

    return run


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).option("multiLine", True).json(path)
