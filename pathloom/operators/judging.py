"""Auditing and summarising machine-written explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_names, finite

# Tolerances of shown SHAP values, rating dimensions and finding categories.
TOLERANCE, SLACK = 5e-7, 1e-12
DIMENSIONS = ("technical_accuracy", "coherence", "cybersecurity_relevance", "actionable_utility")
TIERS = ("high-confidence", "low-confidence", "benign", "insufficient-evidence")


# The two layouts of an explanation file: a detection report, and an analyser's own result.
_FEATURE = "array<struct<ngram: string, value: double, shap_value: double>>"
_ANALYSIS = "struct<tier: string, explanation: string, parse_error: boolean, evidence_analysis: array<struct<ngram: string, shap_contribution: double, assessment: string>>>"
REPORT_LAYOUT = f"""sample struct<binary_name: string>, random_forest struct<ngram_size: int, malware_probability: double, predicted_class: int>,
shap struct<status: string, top_features: {_FEATURE}>, llm struct<status: string, model: string, analysis: {_ANALYSIS}>"""
RESULT_LAYOUT = f"""binary_name string, ngram_size int, rf_prediction int, rf_probability double, analysis_status string, analysis {_ANALYSIS},
evidence array<struct<ngram: string, frequency: double, value: double, shap_value: double, occurrences: array<string>, functions: array<string>>>,
context_limits struct<occurrences_per_feature: int>"""


def judge_inputs(files: DataFrame, text: str = "text") -> DataFrame:
    """files (JSON text) in the columns of screened(), whichever layout they have; layout is null for any other. An
    n-gram may be given as a list of items; its size is derived from the n-grams if they agree; of a feature's
    occurrences the first three count, or as many as the file's own limit says."""
    rows = files.withColumn("_a", F.from_json(text, REPORT_LAYOUT)).withColumn("_b", F.from_json(text, RESULT_LAYOUT))
    every = lambda s, names: F.forall(F.array(*[F.col(f"{s}.{n}").isNotNull() for n in names]), lambda x: x)
    is_a, is_b = every("_a", ("sample", "random_forest", "shap", "llm")), every("_b", ("rf_prediction", "evidence", "analysis"))
    pick = lambda a, b: F.when(is_a, a).when(is_b, b)
    joined = lambda n: F.when(n.startswith("["), F.array_join(F.from_json(n, "array<string>"), " ")).otherwise(n)
    feature = lambda n, v, s: F.struct(joined(n).alias("ngram"), v.alias("value"), s.alias("shap_value"))
    features = pick(
        F.transform("_a.shap.top_features", lambda x: feature(x["ngram"], x["value"], x["shap_value"])),
        F.transform("_b.evidence", lambda x: feature(x["ngram"], F.coalesce(x["frequency"], x["value"], F.lit(0.0)), x["shap_value"])),
    )
    analysis = pick(F.col("_a.llm.analysis"), F.col("_b.analysis"))
    cap = F.coalesce("_b.context_limits.occurrences_per_feature", F.lit(3))
    out = rows.select(
        *files.columns, F.when(is_a, "report").when(is_b, "result").alias("layout"), pick(F.col("_a.sample.binary_name"), F.col("_b.binary_name")).alias("binary_name"),
        pick(F.col("_a.shap.status"), F.lit("completed")).alias("shap_status"),
        pick(F.col("_a.llm.status"), F.when(F.coalesce("_b.analysis_status", F.lit("success")) == "success", "completed").otherwise("failed")).alias("llm_status"),
        analysis["explanation"].alias("explanation"), analysis["parse_error"].alias("parse_error"), analysis["tier"].alias("tier"), analysis["evidence_analysis"].alias("evidence_analysis"),
        pick(F.col("_a.random_forest.predicted_class"), F.col("_b.rf_prediction")).alias("prediction"), pick(F.col("_a.random_forest.malware_probability"), F.col("_b.rf_probability")).alias("probability"),
        features.alias("features"), pick(F.col("_a.random_forest.ngram_size"), F.col("_b.ngram_size")).alias("ngram_size"),
        F.when(is_b & ~is_a, F.transform("_b.evidence", lambda x: F.struct(joined(x["ngram"]).alias("ngram"), F.slice(x["occurrences"], F.lit(1), cap).alias("records"), x["functions"].alias("functions")))).alias("occurrences"),
    )
    sizes = F.array_distinct(F.transform("features", lambda x: F.size(F.split(F.trim(x["ngram"]), r"\s+"))))
    return out.withColumn("ngram_size", F.coalesce("ngram_size", F.when(F.size(sizes) == 1, sizes[0])))


def _first_failure(checks: list[tuple[Column, str, str]]) -> tuple[Column, Column]:
    """(status, reason) of the first check that fails; null if none does."""
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for bad, kind, why in reversed(checks):
        status, reason = F.when(bad, kind).otherwise(status), F.when(bad, why).otherwise(reason)
    return status, reason


def screened(reports: DataFrame) -> DataFrame:
    """Detection reports with status and reason: the first thing that keeps a report from being judged.

    Columns: binary_name, shap_status, llm_status, explanation, parse_error, tier, prediction, probability,
    features (array of ngram, value, shap_value)."""
    f = F.col("features")
    names = F.transform(f, lambda x: x["ngram"])
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    layout = [(F.col("layout").isNull(), "input_error", "unsupported layout")] if "layout" in reports.columns else []
    checks = [
        *layout,
        (~(F.col("llm_status").eqNullSafe("completed") & F.col("shap_status").eqNullSafe("completed")), "generation_error", "explanation or SHAP not completed"),
        (blank(F.col("binary_name")), "input_error", "no binary name"),
        (blank(F.col("explanation")), "generation_error", "no explanation"),
        (F.coalesce(F.col("parse_error"), F.lit(False)) | F.lower("explanation").contains("could not be parsed"), "generation_error", "parse-failure fallback"),
        (~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)), "input_error", "unknown tier"),
        (~F.coalesce(F.col("prediction").isin(0, 1) & finite(F.col("probability")) & F.col("probability").between(0, 1), F.lit(False)), "input_error", "invalid class or probability"),
        (f.isNull() | (F.size(f) == 0), "input_error", "no features"),
        (F.exists(names, blank) | (F.size(F.array_distinct(names)) < F.size(names)), "input_error", "invalid or repeated n-gram"),
        (F.exists(f, lambda x: ~(finite(x["value"]) & finite(x["shap_value"]))), "input_error", "invalid feature value"),
    ]
    status, reason = _first_failure(checks)
    return reports.withColumn("status", F.coalesce(status, F.lit("input_ready"))).withColumn("reason", reason)


def sample_ids(reports: DataFrame) -> DataFrame:
    """reports with an id that does not tell the binary."""
    identity = F.concat_ws("\x1f", "binary_name", F.coalesce(F.col("ngram_size").cast("string"), F.lit("")))
    return reports.withColumn("sample_id", F.concat(F.lit("sample_"), F.substring(F.sha2(identity, 256), 1, 16)))


def blinded(reports: DataFrame) -> DataFrame:
    """What a judge may see: no label, path, name or generator."""
    shown = ("sample_id", "prediction", "probability", "features", "tier", "explanation", "evidence_analysis", "ngram_size")
    return reports.select(*[c for c in shown if c in reports.columns])


def first_of_identity(items: DataFrame, identity: str, order: list[str]) -> DataFrame:
    """items with status duplicate_input for all but the first of each identity."""
    rank = F.row_number().over(Window.partitionBy(identity).orderBy(*order))
    return items.withColumn("status", F.when(rank > 1, "duplicate_input").otherwise("input_ready"))


def unambiguous(items: DataFrame, identity: str) -> DataFrame:
    """items whose identity occurs once: of repeated ones none is trusted."""
    return items.withColumn("_n", F.count("*").over(Window.partitionBy(identity))).filter("_n = 1").drop("_n")


def numeric_audit(evidence: DataFrame, assessments: DataFrame, by: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """assessments (ngram, reported) with expected and whether they differ: unknown n-gram, or a value
    farther off than the tolerance."""
    known = evidence.select(*by, "ngram", F.col("shap_value").alias("expected"))
    joined = assessments.join(known, [*by, "ngram"], "left")
    off = F.abs(F.col("reported") - F.col("expected")) > tolerance + SLACK
    return joined.withColumn("discrepancy", F.col("expected").isNull() | off)


def distinct_findings(findings: DataFrame, by: list[str]) -> DataFrame:
    """The first finding of each (candidate_path, quote), sources in the order of source_rank, then pos."""
    w = Window.partitionBy(*by, "candidate_path", "quote").orderBy("source_rank", "pos")
    return findings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def share_table(records: DataFrame, flag: str, yes: str, no: str) -> DataFrame:
    """explanation, n, percentage over the successful records: with the flag, without it, all. No success: null."""
    ok = records.filter("status = 'success'")
    c = ok.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("hits"))
    percent = lambda n: F.when(F.col("total") > 0, 100.0 * n / F.col("total"))
    row = lambda name, n: F.struct(F.lit(name).alias("explanation"), n.alias("n"), percent(n).alias("percentage"))
    hits, total = F.col("hits"), F.col("total")
    return c.select(F.explode(F.array(row(no, total - hits), row(yes, hits), row("Total evaluated", total))).alias("r")).select("r.*")


def quality_table(records: DataFrame) -> DataFrame:
    """dimension, mean score, sample deviation (null for fewer than two) and n over the successful records."""
    ok = records.filter("status = 'success'")
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("score")) for d in DIMENSIONS])
    rows = ok.select(F.explode(pairs).alias("r")).select("r.*")
    return rows.groupBy("dimension").agg(F.avg("score").alias("mean_score"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n"))


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count("*").alias("n"))


def token_usage(attempts: DataFrame) -> DataFrame:
    """Sums of reported tokens; requests that report both counts, and those that do not (nothing is guessed)."""
    reported = F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()
    return attempts.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.count_if(reported).alias("requests_with_reported_usage"),
        F.count_if(~reported).alias("requests_without_reported_usage"),
    )


def repeat_groups(runs: DataFrame, required: int) -> DataFrame:
    """Per sample with repeats: (sample_id, available_runs, eligible, tier_agreement, function_agreement).

    runs: sample_id, run (1 is the original), evidence_hash, tier, cited (sorted array, null or empty if
    none). A group is eligible with all required runs on the same evidence; functions agree only if each run
    cites some."""
    groups = runs.groupBy("sample_id").agg(
        F.count_distinct("run").alias("available_runs"),
        F.max((F.col("run") == 1).cast("int")).alias("_original"),
        F.size(F.collect_set("evidence_hash")).alias("_evidence"),
        F.size(F.collect_set("tier")).alias("_tiers"),
        F.count_if(F.col("cited").isNull() | (F.size("cited") == 0)).alias("_uncited"),
        F.size(F.collect_set("cited")).alias("_cited"),
    )
    groups = groups.filter("_original = 1 AND available_runs > 1")
    eligible = (F.col("available_runs") == required) & (F.col("_evidence") == 1)
    return groups.select(
        "sample_id", "available_runs", eligible.alias("eligible"),
        F.when(eligible, F.col("_tiers") == 1).alias("tier_agreement"),
        F.when(eligible & (F.col("_uncited") == 0), F.col("_cited") == 1).alias("function_agreement"),
    )


def consistency_table(groups: DataFrame) -> DataFrame:
    """One row: eligible samples, and the percentages of agreement among those that can be compared."""
    share = lambda c: 100.0 * F.count_if(F.col(c)) / F.count(c)
    return groups.filter("eligible").agg(
        F.count("*").alias("samples_rerun"),
        F.when(F.count("tier_agreement") > 0, share("tier_agreement")).alias("tier_agreement"),
        F.when(F.count("function_agreement") > 0, share("function_agreement")).alias("function_agreement"),
    )


def resume(inputs: DataFrame, saved: DataFrame) -> DataFrame:
    """inputs with action: resumed if a success is saved for the same sample, input and protocol, else run."""
    keys = ["sample_id", "input_hash", "protocol_hash"]
    done = saved.filter("status = 'success'").select(*keys).distinct().withColumn("_done", F.lit(True))
    return inputs.join(done, keys, "left").withColumn("action", F.when(F.col("_done"), "resumed").otherwise("run")).drop("_done")


def superseded(inputs: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved results that a new run replaces, to be appended to the history."""
    keys = ["sample_id", "input_hash", "protocol_hash"]
    return saved.join(inputs.select("sample_id").distinct(), "sample_id", "left_semi").join(inputs.select(*keys), keys, "left_anti")


def manifest_violations(rows: DataFrame) -> DataFrame:
    """check, n: rows of a batch manifest that break each rule; a sound manifest has only zeros.

    rows: split, batch_number, row_index_in_batch, label, class_name, source_name, matrix_label."""
    expected = F.when(F.col("label") == 1, "cryptojacking").otherwise("benign")
    position = Window.partitionBy("split", "batch_number").orderBy("row_index_in_batch")
    report = Window.partitionBy("source_name")
    r = rows.withColumn("_at", F.row_number().over(position) - 1).withColumn("_names", F.count("*").over(report))
    checks = {
        "label_in_range": ~F.col("label").isin(0, 1),
        "class_name_matches": ~F.col("class_name").eqNullSafe(expected),
        "matrix_label_matches": ~F.col("label").eqNullSafe(F.col("matrix_label")),
        "row_index_contiguous": F.col("_at") != F.col("row_index_in_batch"),
        "report_name_unique": F.col("_names") > 1,
    }
    counted = r.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(k) for k, bad in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks])
    return counted.select(F.explode(pairs).alias("r")).select("r.*")


def batch_mismatches(matrix_rows: DataFrame, labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Batches in which a row is missing in matrix, labels or metadata, comes twice, or has different labels; none is right. Rows
    are told by (split, batch_number, row_index_in_batch); labels and metadata have a label.

    split, batch_number, rows (different places), missing (in one of the three), repeated, different (labels)."""
    key = ["split", "batch_number", "row_index_in_batch"]
    null = F.lit(None).cast("int")
    parts = [matrix_rows.select(*key, F.lit("m").alias("of"), null.alias("label")), labels.select(*key, F.lit("y").alias("of"), "label"), metadata.select(*key, F.lit("d").alias("of"), "label")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    count = lambda of: F.count_if(F.col("of") == of)
    row = every.groupBy(*key).agg(
        F.least(count("m"), count("y"), count("d")).alias("fewest"), F.greatest(count("m"), count("y"), count("d")).alias("most"),
        F.max(F.when(F.col("of") == "y", F.col("label"))).alias("y"), F.max(F.when(F.col("of") == "d", F.col("label"))).alias("d"),
    )
    batches = row.groupBy("split", "batch_number").agg(
        F.count("*").alias("rows"), F.count_if(F.col("fewest") == 0).alias("missing"), F.count_if(F.col("most") > 1).alias("repeated"),
        F.count_if((F.col("fewest") > 0) & ~F.col("y").eqNullSafe(F.col("d"))).alias("different"),
    )
    return batches.filter("missing > 0 OR repeated > 0 OR different > 0")


def valid_judgements(forms: DataFrame, valid_ids: Column) -> DataFrame:
    """forms with valid: exactly the four dimensions, whole scores 1 to 5, and references that exist.

    forms: scores map<string, double>, references array<string>."""
    s = F.col("scores")
    names = F.array_sort(F.map_keys(s)) == F.array_sort(F.array(*[F.lit(d) for d in DIMENSIONS]))
    whole = F.forall(F.map_values(s), lambda v: (v == F.floor(v)) & v.between(1, 5))
    refs = F.size(F.array_except("references", valid_ids)) == 0
    return forms.withColumn("valid", F.coalesce(names & whole & refs, F.lit(False)))


# Criteria and claim labels of the first judge form.
CRITERIA_V1 = ("evidence_faithfulness", "shap_alignment", "code_region_grounding")
SUPPORT_LABELS = ("supported", "partially_supported", "unsupported", "contradicted", "not_verifiable")


def valid_criteria(forms: DataFrame, valid_ids: Column, criteria: tuple[str, ...] = CRITERIA_V1) -> DataFrame:
    """forms of the first kind with valid: each criterion once with a whole score from 1 to 5 and a rationale, claims with a known label and a
    rationale, an overall rationale, and evidence ids that exist.

    criteria array<struct<name, score: double, rationale, evidence_ids>>, claims array<struct<claim, support, rationale, evidence_ids>>,
    overall_rationale string."""
    known = lambda ids: ids.isNotNull() & (F.size(F.array_except(ids, valid_ids)) == 0)
    names = F.array_sort(F.transform("criteria", lambda c: c["name"])) == F.array_sort(F.array(*[F.lit(c) for c in criteria]))
    scores = F.forall("criteria", lambda c: (c["score"] == F.floor(c["score"])) & c["score"].between(1, 5) & c["rationale"].isNotNull() & known(c["evidence_ids"]))
    claims = F.forall("claims", lambda c: c["claim"].isNotNull() & c["support"].isin(*SUPPORT_LABELS) & c["rationale"].isNotNull() & known(c["evidence_ids"]))
    return forms.withColumn("valid", F.coalesce(names & scores & claims & F.col("overall_rationale").isNotNull(), F.lit(False)))


def claim_summaries(claims: DataFrame, by: str = "sample_id") -> DataFrame:
    """Per report: claim_count, unsupported_or_contradicted_count and their ratio (all listed claims count, not verifiable ones too)."""
    bad = F.count_if(F.col("label").isin("unsupported", "contradicted"))
    return claims.groupBy(by).agg(F.count("*").alias("claim_count"), bad.alias("unsupported_or_contradicted_count"), (bad / F.count("*")).alias("unsupported_claim_rate"))


def criterion_means(forms: DataFrame) -> DataFrame:
    """Mean of each criterion over all forms."""
    return forms.select(F.explode("scores").alias("criterion", "score")).groupBy("criterion").agg(F.avg("score").alias("mean"))


def unsupported_rate(claims: DataFrame) -> DataFrame:
    """Unsupported or contradicted claims over all claims: a ratio of sums."""
    bad = F.count_if(F.col("label").isin("unsupported", "contradicted"))
    return claims.agg(F.when(F.count("*") > 0, bad / F.count("*")).alias("unsupported_claim_rate"))


def with_citations(candidates: DataFrame, text: str, known: str, explicit: str | None = None) -> DataFrame:
    return candidates.withColumn("cited", cited_names(F.col(text), F.col(known), F.col(explicit) if explicit else None))


def evidence_catalog(evidence: DataFrame, disassembly: DataFrame) -> DataFrame:
    """sample_id, evidence_id, text: SHAP:rank for ranked features, DISASM:function:line for code lines."""
    shap = evidence.select("sample_id", F.concat(F.lit("SHAP:"), F.col("rank").cast("string")).alias("evidence_id"), F.col("ngram").alias("text"))
    lines = disassembly.select("sample_id", "function", F.posexplode("lines").alias("line", "text"))
    code = lines.select("sample_id", F.concat_ws(":", F.lit("DISASM"), "function", F.col("line").cast("string")).alias("evidence_id"), "text")
    return shap.unionByName(code)
