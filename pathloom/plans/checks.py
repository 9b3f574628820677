"""More registered queries with their SQL: validation, judging calls, pairing and text functions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import calls as ca
from ..operators import features as ft
from ..operators import judging as jd
from ..operators import metrics as mt
from ..operators import reports as rp
from ..sources import fixtures as fx
from ..sources import graphs as src
from ..sources import outputs as out
from ..streaming import arrivals as ar
from . import catalogue
from .catalogue import query



def _d() -> Column:
    return F.col("doc_id")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "labels")


def _id(prefix: str = "s") -> Column:
    return F.concat(F.lit(prefix), _d().cast("string"))


@query(f"WITH {fx.SCORED} SELECT doc_id, CASE WHEN score >= 0.433 THEN 1 ELSE 0 END AS y_pred FROM sc")
def threshold_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _labels(spark, sf_dir).select("doc_id", ((_d() * 37 % 101) / 100.0).alias("score"))
    return mt.thresholded(scored, 0.433).select("doc_id", "y_pred")


@query("SELECT 'c' || (doc_id % 3)::VARCHAR AS criterion, round(avg(doc_id % 5 + 1), 9) AS mean FROM labels GROUP BY 1")
def criterion_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = _labels(spark, sf_dir).select(F.create_map(F.concat(F.lit("c"), (_d() % 3).cast("string")), (_d() % 5 + 1).cast("double")).alias("scores"))
    return jd.criterion_means(forms).select("criterion", F.round("mean", 9).alias("mean"))


@query("""SELECT 'r' || (doc_id % 40)::VARCHAR AS sample_id, count(*) AS claim_count, count(*) FILTER (doc_id % 5 IN (1, 2)) AS unsupported_or_contradicted_count,
round(count(*) FILTER (doc_id % 5 IN (1, 2))::DOUBLE / count(*), 9) AS unsupported_claim_rate FROM labels GROUP BY 1""")
def claim_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(_d() % 5 == 1, "unsupported").when(_d() % 5 == 2, "contradicted").when(_d() % 5 == 3, "not_verifiable").otherwise("supported")
    claims = _labels(spark, sf_dir).select(F.concat(F.lit("r"), (_d() % 40).cast("string")).alias("sample_id"), label.alias("label"))
    return jd.claim_summaries(claims).withColumn("unsupported_claim_rate", F.round("unsupported_claim_rate", 9))


@query("SELECT doc_id, doc_id % 7 BETWEEN 1 AND 5 AND doc_id % 6 <> 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS valid FROM labels")
def criteria_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, score, ids: F.struct(F.lit(name).alias("name"), score.cast("double").alias("score"), F.lit("because").alias("rationale"), ids.alias("evidence_ids"))
    known = F.array(F.lit("SHAP:1"))
    second = F.when(_d() % 6 == 0, jd.CRITERIA_V1[0]).otherwise(jd.CRITERIA_V1[1])  # a name twice
    criteria = F.array(one(jd.CRITERIA_V1[0], _d() % 7, known), F.struct(second.alias("name"), F.lit(3.0).alias("score"), F.lit("because").alias("rationale"), known.alias("evidence_ids")), one(jd.CRITERIA_V1[2], F.lit(1), F.array(F.when(_d() % 5 == 0, "SHAP:9").otherwise("SHAP:1"))))
    claims = F.array(F.struct(F.lit("c").alias("claim"), F.when(_d() % 11 == 0, "maybe").otherwise("supported").alias("support"), F.lit("r").alias("rationale"), known.alias("evidence_ids")))
    forms = _labels(spark, sf_dir).select("doc_id", criteria.alias("criteria"), claims.alias("claims"), F.when(_d() % 13 != 0, "o").alias("overall_rationale"))
    return jd.valid_criteria(forms, F.array(F.lit("SHAP:1"), F.lit("SHAP:2"))).select("doc_id", "valid")


@query("""WITH p AS (SELECT doc_id // 20 AS b, doc_id % 20 AS r, toxic FROM labels)
SELECT 'train' AS split, b::INT AS batch_number, count(*) AS rows, count(*) FILTER (b % 5 = 1 AND r = 3) AS missing, 0::BIGINT AS repeated, count(*) FILTER (b % 3 = 0 AND r < 2 AND NOT (b % 5 = 1 AND r = 3)) AS different
FROM p GROUP BY b HAVING count(*) FILTER (b % 5 = 1 AND r = 3) > 0 OR count(*) FILTER (b % 3 = 0 AND r < 2) > 0""")
def batch_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every third batch two labels are off, in every fifth a row is missing."""
    place = [F.lit("train").alias("split"), F.floor(_d() / 20).cast("int").alias("batch_number"), (_d() % 20).cast("int").alias("row_index_in_batch")]
    rows = _labels(spark, sf_dir).select(*place, F.col("toxic").alias("label"))
    off = rows.withColumn("label", F.when((F.col("batch_number") % 3 == 0) & (F.col("row_index_in_batch") < 2), 1 - F.col("label")).otherwise(F.col("label")))
    return jd.batch_mismatches(rows.filter("batch_number % 5 <> 1 OR row_index_in_batch <> 3"), rows, off)


@query("SELECT doc_id, (doc_id % 2 = 0) = (doc_id % 3 = 0) AS valid FROM labels")
def consistent_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.when(_d() % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("d")))
    return rp.consistent_faithfulness(_labels(spark, sf_dir).select("doc_id", (_d() % 2 == 0).alias("faithful"), found.alias("discrepancies"))).select("doc_id", "valid")


@query("""SELECT doc_id, 'key [REDACTED] and [REDACTED].' AS redacted, 'part ' || doc_id::VARCHAR || '.v1' AS stem, CASE WHEN doc_id % 2 = 0 THEN '.json' ELSE '.txt' END AS suffix,
'mov n' || doc_id::VARCHAR AS ngram FROM labels""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/data/x.y/part "), _d().cast("string"), F.lit(".v1"), F.when(_d() % 2 == 0, ".json").otherwise(".txt"))
    return _labels(spark, sf_dir).select(
        "doc_id", tx.redacted(F.lit("key s3cret and s3cret."), "s3cret").alias("redacted"), tx.stem(path).alias("stem"), tx.suffix(path).alias("suffix"), tx.ngram_text(F.array(F.lit("mov"), _id("n"))).alias("ngram")
    )


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['a', 'z'] WHEN doc_id % 3 = 1 THEN ['f' || doc_id::VARCHAR] ELSE ['FUN_00401000'] END AS cited FROM labels")
def explicit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(_d() % 3 == 1, F.concat(F.lit("calls "), _id("f"), F.lit(", not "), _id("xf"))).otherwise("calls FUN_00401000")
    rows = _labels(spark, sf_dir).select("doc_id", text.alias("t"), F.array(_id("f"), F.lit("g")).alias("known"), F.when(_d() % 3 == 0, F.array(F.lit("z"), F.lit("a"), F.lit(""), F.lit("z"))).alias("explicit"))
    return jd.with_citations(rows, "t", "known", "explicit").select("doc_id", "cited")


@query("""WITH c AS (SELECT doc_id % 50 AS program, doc_id % 7 AS feature_id, count(*) AS n FROM labels WHERE doc_id % 50 < 40 GROUP BY ALL), f AS (
  SELECT program, feature_id, n::DOUBLE / sum(n) OVER (PARTITION BY program) AS value FROM c
) SELECT s.program, count(f.feature_id) AS n_features, round(coalesce(max(value), 0), 9) AS largest, round(coalesce(sum(value), 0), 9) AS total
FROM (SELECT DISTINCT doc_id % 50 AS program FROM labels) s LEFT JOIN f USING (program) GROUP BY s.program""")
def sample_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select((_d() % 50).alias("program"), (_d() % 7).alias("feature_id"))
    counts = rows.filter("program < 40").groupBy("program", "feature_id").agg(F.count("*").alias("n"))
    vectors = ft.sample_vectors(rows.select("program").distinct(), ft.frequencies(counts))
    values = F.map_values("features")
    return vectors.select("program", F.size(F.map_keys("features")).cast("long").alias("n_features"), F.round(F.coalesce(F.array_max(values), F.lit(0.0)), 9).alias("largest"), F.round(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '/files/' || doc_id::VARCHAR WHEN doc_id % 3 = 1 THEN '/set/benign/n' || doc_id::VARCHAR END AS source FROM labels""")
def source_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    rows = labels.select("doc_id", _id("/files/").alias("source_path"), F.lit("benign").alias("class_name"), _id("n").alias("source_name"))
    files = labels.filter(_d() % 3 == 0).select(_id("/files/").alias("path")).unionByName(labels.filter(_d() % 3 < 2).select(_id("/set/benign/n").alias("path")))
    return src.resolved_sources(rows, files, "/set/").select("doc_id", "source")


@query("""SELECT 'sample_' || substr(sha256('bin ' || doc_id::VARCHAR || chr(31) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE (doc_id % 4)::VARCHAR END), 1, 16) AS sample_id, toxic AS prediction, 'benign' AS tier FROM labels""")
def blinded_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir).select(_id("bin ").alias("binary_name"), F.when(_d() % 4 != 0, _d() % 4).alias("ngram_size"), F.col("toxic").alias("prediction"), F.lit("benign").alias("tier"), F.lit("secret").alias("generator"), F.col("quality").alias("actual_label"))
    return jd.blinded(jd.sample_ids(rows)).drop("ngram_size")


@query("""SELECT 's' || doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 5 <> 0 THEN upper('ask ' || doc_id::VARCHAR) END AS answer, CASE WHEN doc_id % 5 = 0 THEN 'ValueError: busy' END AS error
FROM labels WHERE toxic = 1 AND doc_id % 3 <> 0""")
def gated_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted positives with SHAP values are asked about; a call that keeps failing stops no other."""

    def answer(prompt: str) -> str:
        if int(prompt.split()[1]) % 5 == 0:
            raise ValueError("busy")
        return prompt.upper()

    rows = _labels(spark, sf_dir).select(_id().alias("sample_id"), F.col("toxic").alias("prediction"), F.when(_d() % 3 == 0, "failed").otherwise("completed").alias("shap_status"), _id("ask ").alias("prompt"))
    return ar.analysed(rows, answer)


def _judge(body: dict) -> dict:
    """A provider that answers by the sample's number: most well, some cut off, some with an invalid form first."""
    lines = body["messages"][0]["content"].split("\n")
    item, corrected = json.loads(lines[4]), len(lines) > 5
    n = int(item["sample_id"][1:])
    scores = dict.fromkeys(jd.DIMENSIONS, n % 5 + 1 if n % 3 or corrected else 9)
    faith = {"faithful": True, "reason": "r", "discrepancies": []}
    form = {"sample_id": item["sample_id"], "scores": scores, "justifications": dict.fromkeys(jd.DIMENSIONS, "r"), "unsupported_claims": [], "shap_faithfulness": faith, "evidence_limitations": [], "summary": "s"}
    return {"content": [{"type": "text", "text": json.dumps(form)}], "stop_reason": "max_tokens" if n % 7 == 0 else "end_turn", "usage": {"input_tokens": n, "output_tokens": 1}}


@query("""SELECT 's' || doc_id::VARCHAR AS sample_id, CASE WHEN doc_id % 7 = 0 THEN 'judge_error' ELSE 'success' END AS status, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 <> 0 THEN 1 ELSE 2 END::BIGINT AS attempts,
CASE WHEN doc_id % 7 = 0 THEN 422 WHEN doc_id % 3 = 0 THEN NULL END::INT AS first_status, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 5 + 1 END::BIGINT AS coherence,
(CASE WHEN doc_id % 7 = 0 OR doc_id % 3 <> 0 THEN 1 ELSE 2 END * doc_id)::BIGINT AS input_tokens, sha256('{"sample_id": "s' || doc_id::VARCHAR || '"}') AS input_hash FROM labels""")
def judged_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms are asked for again if they are invalid, not if an answer is cut off; the ledger keeps every attempt."""
    items = _labels(spark, sf_dir).select(F.format_string('{"sample_id": "s%d"}', _d()).alias("item"))
    done = ca.evaluate_all(items, rp.JudgeOptions("m"), ca.Rubric(), _judge, delay=0.0, most_errors=1 << 30)
    return done.select(
        "sample_id", "status", F.size("attempts").cast("long").alias("attempts"), F.col("attempts")[0]["status"].alias("first_status"), F.get_json_object("evaluation", "$.scores.coherence").cast("long").alias("coherence"),
        F.aggregate("attempts", F.lit(0).cast("long"), lambda n, a: n + a["input_tokens"]).alias("input_tokens"), "input_hash",
    )


@query("""WITH o AS (SELECT doc_id % 30 AS program, doc_id % 4 AS feature_id, count(*) AS n FROM labels GROUP BY ALL)
SELECT program, count(*) AS feature_count, min(feature_id) AS first_feature, sum(n)::BIGINT AS occurrences FROM o GROUP BY program""")
def occurrence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON document of each program, read again."""
    rows = _labels(spark, sf_dir).select((_d() % 30).alias("program"), _id("f").alias("function"), F.lit("cfg").alias("graph_type"), F.array(_d().cast("string")).alias("addresses"), F.array(F.lit("n"), (_d() % 4).cast("string")).alias("ngram"))
    vocabulary = rows.select("ngram", F.col("ngram")[1].cast("long").alias("feature_id")).distinct()
    made = out.occurrence_documents(ft.occurrence_report(rows, vocabulary), 2)
    read = F.from_json("document", "feature_count bigint, features array<struct<feature_id: bigint, count: bigint>>")
    return made.withColumn("r", read).select("program", "r.feature_count", F.col("r.features")[0]["feature_id"].alias("first_feature"), F.aggregate("r.features", F.lit(0).cast("long"), lambda n, f: n + f["count"]).alias("occurrences"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'high-confidence' ELSE 'benign' END AS tier, CASE WHEN doc_id % 2 = 0 THEN 'why ' || doc_id::VARCHAR ELSE '' END AS explanation,
CASE WHEN doc_id % 5 = 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence_score, 'Manual review required' AS recommended_action FROM labels""")
def completed_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing keys get their defaults, an unknown tier is benign."""
    tier = F.when(_d() % 3 == 0, '"tier": "high-confidence"').when(_d() % 3 == 1, '"tier": "strange"').otherwise('"other": 1')
    parts = F.concat(F.lit("{"), tier, F.when(_d() % 2 == 0, F.concat(F.lit(', "explanation": "why '), _d().cast("string"), F.lit('"'))).otherwise(""), F.when(_d() % 5 == 0, ', "confidence_score": 0.5').otherwise(""), F.lit("}"))
    done = tx.completed_analysis(tx.salvaged_json(F.concat(F.lit("<think>no</think>"), parts)))
    return _labels(spark, sf_dir).select("doc_id", done.alias("a")).select("doc_id", "a.tier", "a.explanation", "a.confidence_score", "a.recommended_action")


@query(f"WITH {fx.PREDICTED} SELECT 'accuracy' AS label, round((tn + tp) / (tn + fp + fn + tp), 9) AS value FROM cm UNION ALL SELECT 'true_positives', tp::DOUBLE FROM cm UNION ALL SELECT 'support', (fn + tp)::DOUBLE FROM cm")
def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics file of a test set, written and read again."""
    from ..functions.storage import shared_dir

    predicted = fx.predicted(spark, sf_dir)
    document = out.metrics_document(mt.classification_report(predicted), mt.confusion(predicted), {"threshold_used": 0.5})
    path = f"{shared_dir(spark)}/metrics-document"
    out.write_document(spark, document, path)
    back = out.read_document(spark, path)
    rows = [("accuracy", round(back["classification_report"]["accuracy"]["f1"], 9)), ("true_positives", float(back["true_positives"])), ("support", float(back["classification_report"]["1"]["support"]))]
    return spark.createDataFrame(rows, "label string, value double")


@query(f"""WITH RECURSIVE {fx.CFG}, wk(function, block, path, ways) AS (
  SELECT function, entry_block, [entry_block], []::INT[] FROM eb
  UNION ALL
  SELECT w.function, ce.dst, list_append(w.path, ce.dst), list_append(w.ways, ce.pos) FROM wk w JOIN ce ON ce.function = w.function AND ce.src = w.block
  WHERE NOT list_contains(w.path, ce.dst)
) SELECT function, (row_number() OVER (PARTITION BY function ORDER BY ways) - 1)::INT AS path_id, path FROM wk w
WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.function = w.function AND ce.src = w.block)""")
def cfg_path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths are numbered in depth-first order."""
    return catalogue._paths(spark, sf_dir).select("function", "path_id", "path")
