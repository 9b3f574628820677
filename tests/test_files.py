"""Round trips of what is read and written."""

import json

import pytest
from pathloom.functions import text as tx
from pathloom.operators import features as ft
from pathloom.operators import judging as jd
from pathloom.operators import metrics as mt
from pathloom.operators import reports as rp
from pathloom.sources import graphs as src
from pathloom.sources import outputs as out
from pyspark.sql import functions as F


def text_of(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def test_matrix_is_replaced_whole(spark, tmp_path):
    cells = "split string, batch_number int, row_index_in_batch int, feature_id long, value float"
    src.write_matrix(spark.createDataFrame([("train", 0, 0, 1, 0.5), ("train", 1, 0, 2, 0.25), ("test", 0, 0, 1, 1.0)], cells), str(tmp_path / "m"))
    src.write_matrix(spark.createDataFrame([("train", 0, 0, 3, 0.5), ("test", 0, 0, 1, 1.0)], cells), str(tmp_path / "m"))
    back = src.read_matrix(spark, str(tmp_path / "m"), "train")
    assert [r["feature_id"] for r in back.collect()] == [3]
    vocabulary = spark.createDataFrame([(i,) for i in range(4)], "feature_id long")
    rp.dimension_check(4, vocabulary, back)
    with pytest.raises(ValueError):
        rp.dimension_check(5, vocabulary, back)
    with pytest.raises(ValueError):
        rp.dimension_check(3, vocabulary.filter("feature_id < 3"), back)


def test_swapped_labels_are_found(spark):
    place = "split string, batch_number int, row_index_in_batch int"
    m = spark.createDataFrame([("train", 0, 0), ("train", 0, 1), ("train", 1, 0), ("train", 2, 0)], place)
    y = spark.createDataFrame([("train", 0, 0, 1), ("train", 0, 1, 0), ("train", 1, 0, 1), ("train", 2, 0, 1)], place + ", label int")
    swapped = spark.createDataFrame([("train", 0, 0, 0), ("train", 0, 1, 1), ("train", 1, 0, 1), ("train", 1, 0, 1)], place + ", label int")
    assert jd.batch_mismatches(m, y, y).count() == 0
    got = {r["batch_number"]: (r["missing"], r["repeated"], r["different"]) for r in jd.batch_mismatches(m, y, swapped).collect()}
    assert got == {0: (0, 0, 2), 1: (0, 1, 0), 2: (1, 0, 0)}


def test_labelled_files_in_order(spark, tmp_path):
    for name in ("benign/b.json", "benign/a.JSON", "benign/sub/x.json", "benign/c.txt", "cryptojacking/z.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    rows = src.labelled_files(spark, str(tmp_path)).collect()
    assert sorted((r["class_name"], r["label"], r["pos"], r["path"].rsplit("/", 1)[1]) for r in rows) == [("benign", 0, 0, "a.JSON"), ("benign", 0, 1, "b.json"), ("cryptojacking", 1, 0, "z.json")]
    (tmp_path / "cryptojacking/z.json").unlink()
    with pytest.raises(FileNotFoundError):
        src.labelled_files(spark, str(tmp_path))


def test_strict_json_and_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text("﻿" + '{"a": 1}')
    (tmp_path / "b.json").write_text('{"a": 1, "a": 2}')
    got = {r["path"].rsplit("/", 1)[1]: r["valid"] for r in src.read_strict_json(spark, str(tmp_path)).collect()}
    assert got == {"a.json": True, "b.json": False}
    files = spark.createDataFrame([("/d/benign/x",), ("/e/y",)], "path string")
    rows = spark.createDataFrame([("/e/y", "benign", "y"), ("/gone", "benign", "x"), (None, "benign", "z")], "source_path string, class_name string, source_name string")
    found = src.resolved_sources(rows, files, "/d/")
    assert {r["source_name"]: r["source"] for r in found.collect()} == {"y": "/e/y", "x": "/d/benign/x", "z": None}
    src.require_sources(found.filter("source_name <> 'z'"))
    with pytest.raises(FileNotFoundError):
        src.require_sources(found)


def test_predictions_and_metrics(spark, tmp_path):
    scored = mt.thresholded(spark.range(200).select(F.col("id").alias("pos"), (F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") / 200).alias("score")), 0.5)
    out.write_predictions(scored, str(tmp_path / "p"), "pos")
    back = src.read_predictions(spark, str(tmp_path / "p"))
    assert back.columns == ["y_true", "y_pred"] and back.filter("y_pred = 1").count() == 100 and back.count() == 200
    document = out.metrics_document(mt.classification_report(scored), mt.confusion(scored), {"threshold_used": 0.5, "n_samples": 200})
    assert (document["true_positives"], document["classification_report"]["1"]["support"]) == (50, 100)
    assert document["classification_report_percent"]["accuracy"]["f1"] == 50.0
    out.write_document(spark, document, str(tmp_path / "d"))
    assert out.read_document(spark, str(tmp_path / "d")) == document
    with pytest.raises(ValueError):
        out.metrics_document(mt.classification_report(scored), mt.confusion(scored), {"x": float("nan")})


def test_row_metadata_and_occurrences(spark, tmp_path):
    rows = spark.createDataFrame([("train", 0, 1, "b"), ("train", 0, 0, "a"), ("test", 0, 0, "c")], "split string, batch_number int, row_index_in_batch int, source_name string")
    out.write_row_metadata(rows, str(tmp_path / "r"))
    assert [json.loads(x)["source_name"] for x in text_of(spark, tmp_path / "r/split=train/batch_number=0")] == ["a", "b"]
    shingles = spark.createDataFrame([("p", "f", "cfg", ["1", "2"], ["a", "b"]), ("p", "g", "dfg", ["3", "4"], ["a", "b"]), ("q", "f", "cfg", ["1", "2"], ["x", "y"])], "program string, function string, graph_type string, addresses array<string>, ngram array<string>")
    vocabulary = spark.createDataFrame([(["a", "b"], 1), (["x", "y"], 0)], "ngram array<string>, feature_id long")
    report = ft.occurrence_report(shingles, vocabulary)
    out.write_occurrences(report, 2, str(tmp_path / "o"))
    one = json.loads(text_of(spark, tmp_path / "o/program=p")[0])
    assert (one["binary"], one["n"], one["feature_count"]) == ("p", 2, 1) and one["features"][0]["count"] == 2


def test_csv_with_mark_and_guard(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'say "x"', None)], "a string, b string, c string")
    out.write_csv(df, str(tmp_path / "c"), one_file=True)
    body = next((tmp_path / "c").glob("part-*")).read_bytes()
    assert body.startswith(b"\xef\xbb\xbfa,b,c\n") and b"'=1+1" in body
    rp.export_summary({"a table": df}, tmp_path / "r", "T<")
    assert (tmp_path / "r/a_table.csv").read_text(encoding="utf-8").startswith("﻿a,b,c\n'=1+1")
    assert "T&lt;" in (tmp_path / "r/report.html").read_text()


def reports(spark, probability=0.5, shap=0.1):
    row = (("b", "s", "/p", "test", 0, 0, 1, "x"), (2, probability, 1, "x"), (20, [(1, "a b", 0.5, shap)], "completed", None), ("completed", None, ("benign", "e", 0.5), None, (1, 2, "api")))
    return spark.createDataFrame([row], rp.REPORT)


def test_reports_round_trip_and_refuse_nan(spark, tmp_path):
    rp.write_reports(reports(spark), str(tmp_path / "r"))
    assert rp.read_reports(spark, str(tmp_path / "r")).collect() == reports(spark).collect()
    for bad in ({"probability": float("nan")}, {"shap": float("inf")}):
        with pytest.raises(ValueError):
            rp.write_reports(reports(spark, **bad), str(tmp_path / "x"))
    rp.append_history(reports(spark).select("sample.binary_name"), str(tmp_path / "h"))
    rp.append_history(reports(spark).select("sample.binary_name"), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2


def test_small_functions(spark):
    df = spark.createDataFrame([("/a/b.c/x.tar.gz", ["m", "n"], "key=s3cret", r"odd\Ename here", ["odd\\Ename", "nam"], [])], "p string, g array<string>, t string, u string, known array<string>, none array<string>")
    got = df.select(
        tx.stem(F.col("p")).alias("stem"), tx.suffix(F.col("p")).alias("suffix"), tx.ngram_text(F.col("g")).alias("g"), tx.redacted(F.col("t"), "s3cret").alias("t"), tx.redacted(F.col("t"), "").alias("same"),
        tx.cited_names(F.col("u"), F.col("known")).alias("cited"), tx.cited_names(F.col("u"), F.col("known"), F.array(F.lit("z"), F.lit("a"), F.lit("a"))).alias("explicit"),
    ).first()
    assert tuple(got) == ("x.tar", ".gz", "m n", "key=[REDACTED]", "key=s3cret", ["odd\\Ename"], ["a", "z"])
    forms = spark.createDataFrame([(True, []), (True, ["d"]), (False, []), (None, [])], "faithful boolean, discrepancies array<string>")
    assert [r["valid"] for r in rp.consistent_faithfulness(forms).collect()] == [True, False, False, False]
    scored = spark.createDataFrame([({"a": 1.0, "b": 3.0},), ({"a": 2.0},)], "scores map<string, double>")
    assert {r["criterion"]: r["mean"] for r in jd.criterion_means(scored).collect()} == {"a": 1.5, "b": 3.0}
    samples, freq = spark.createDataFrame([("p",), ("q",)], "program string"), spark.createDataFrame([("p", 2, 0.5), ("p", 1, 0.5)], "program string, feature_id long, value double")
    assert {r["program"]: r["features"] for r in ft.sample_vectors(samples, freq).collect()} == {"p": {1: 0.5, 2: 0.5}, "q": {}}


def test_first_judge_forms(spark):
    criterion = "array<struct<name: string, score: double, rationale: string, evidence_ids: array<string>>>"
    claim = "array<struct<claim: string, support: string, rationale: string, evidence_ids: array<string>>>"
    good = [(c, 3.0, "r", ["SHAP:1"]) for c in jd.CRITERIA_V1]
    claims = [("c", "supported", "r", [])]
    rows = [
        (good, claims, "o"), (good[:2], claims, "o"), ([*good, good[0]], claims, "o"), ([(n, 3.5, r, i) for n, _, r, i in good], claims, "o"), ([(n, s, r, ["SHAP:9"]) for n, s, r, i in good], claims, "o"),
        (good, [("c", "maybe", "r", [])], "o"), (good, [], "o"), (good, claims, None), (good, [("c", "supported", "r", None)], "o"),
    ]
    df = spark.createDataFrame(rows, f"criteria {criterion}, claims {claim}, overall_rationale string")
    assert [r["valid"] for r in jd.valid_criteria(df, F.array(F.lit("SHAP:1"))).collect()] == [True, False, False, False, False, False, True, False, False]
    labels = spark.createDataFrame([("a", "supported"), ("a", "contradicted"), ("b", "not_verifiable")], "sample_id string, label string")
    assert {r["sample_id"]: r["unsupported_claim_rate"] for r in jd.claim_summaries(labels).collect()} == {"a": 0.5, "b": 0.0}


def test_shared_folder_is_asked_for_on_a_cluster():
    from pathloom.functions import storage

    class Fake:
        def __getattr__(self, name):
            return self

        def __call__(self, *args):
            return self

        def isEmpty(self):
            return True

        def master(self):
            return "spark://host:7077"

        def get(self, *args):
            return None

    with pytest.raises(RuntimeError):
        storage.shared_dir(Fake())


def test_written_tables_are_released(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from pathloom.functions import storage

    table = storage.written(spark.range(3).toDF("x"), "released")
    folder = Path(urlparse(table.inputFiles()[0]).path).parent
    assert folder.exists() and table.count() == 3 and storage.exists(spark, str(folder))
    # other tests' tables stay
    made, storage._MADE[spark.sparkContext.applicationId] = storage._MADE[spark.sparkContext.applicationId], [str(folder)]
    assert storage.release(spark) == 1 and not folder.exists() and not storage.exists(spark, str(folder))
    storage._MADE[spark.sparkContext.applicationId] = made


def test_splits_load_only_if_they_fit(spark, tmp_path):
    cells = spark.createDataFrame([("train", 0, 0, 1, 0.5), ("train", 1, 0, 2, 0.25), ("test", 0, 0, 1, 1.0)], "split string, batch_number int, row_index_in_batch int, feature_id long, value float")
    labels = spark.createDataFrame([("train", 0, 0, 1), ("train", 0, 1, 0), ("train", 1, 0, 1), ("test", 0, 0, 0)], "split string, batch_number int, row_index_in_batch int, label int")
    src.write_split(cells, labels, 3, str(tmp_path / "a"))
    matrix, y, n = src.load_split(spark, str(tmp_path / "a"), "train")
    assert (matrix.count(), y.count(), n) == (2, 3, 3)
    for bad_cells, bad_labels, width in ((cells, labels, 2), (cells, labels.filter("batch_number = 0"), 3), (cells, labels.unionByName(labels), 3)):
        src.write_split(bad_cells, bad_labels, width, str(tmp_path / "b"))
        with pytest.raises(ValueError):
            src.load_split(spark, str(tmp_path / "b"), "train")
    with pytest.raises(ValueError):
        src.load_split(spark, str(tmp_path / "a"), "none")
