from pathloom.functions import text as tx
from pathloom.operators import judging as jd
from pyspark.sql import functions as F


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()["x"]


def test_salvage(spark):
    get = lambda raw: one(spark, tx.salvaged_json(F.col("c0")), raw)
    assert get('{"a": 1}') == '{"a": 1}'
    assert get('<think>{"b": 2}</think> {"a": 1}') == '{"a": 1}'
    assert get('<think>{"b": 2}</think>') == '{"b": 2}'
    assert get('x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert get("none") is None
    assert get('{"a": 1, "a": 2}') is None  # repeated keys


def test_schema_defaults(spark):
    a = one(spark, tx.completed_analysis(F.col("c0")), '{"tier": "weird", "confidence_score": 0.5}')
    assert (a["tier"], a["explanation"], a["confidence_score"], a["recommended_action"]) == ("benign", "", 0.5, "Manual review required")
    assert a["key_indicators"] == [] and a["evidence_analysis"] == []


def test_names_guards_pointers(spark):
    assert one(spark, tx.safe_name(F.col("c0")), "bad näme?.JSON") == "bad_näme_"
    assert one(spark, tx.formula_guard(F.col("c0")), "=1+1") == "'=1+1"
    assert one(spark, tx.ngram_items(F.col("c0")), "  a \t b ") == ["a", "b"]
    assert tx.json_pointer('{"a": [{"b/c": "x"}]}', "/a/0/b~1c") == "x"
    assert tx.json_pointer('{"a": 1}', "/b") is None
    assert [tx.duration(s) for s in (3723, 3600, 123, 59.9, 0, -5)] == ["1h 02m", "1h 00m", "2m 03s", "59s", "0s", "0s"]
    assert tx.display(None) == "N/A" and tx.display(0.5) == "0.5000"
    assert "&lt;" in tx.html_table(["a"], [{"a": "<"}])
    assert tx.markdown_table(["a"], [{"a": 1}]).endswith("| 1 |")


def test_citations(spark):
    df = spark.createDataFrame([("main calls FUN_00401000 and xmain", ["main", "other", "a.b"])], "t string, known array<string>")
    assert jd.with_citations(df, "t", "known").first()["cited"] == ["FUN_00401000", "main"]


def test_numeric_audit_tolerance(spark):
    e = spark.createDataFrame([("s", "a", 0.1), ("s", "b", 0.2)], "s string, ngram string, shap_value double")
    a = spark.createDataFrame([("s", "a", 0.1000004), ("s", "b", 0.2000007), ("s", "c", 0.0)], "s string, ngram string, reported double")
    assert {r["ngram"]: r["discrepancy"] for r in jd.numeric_audit(e, a, ["s"]).collect()} == {"a": False, "b": True, "c": True}


def test_quality_needs_two(spark):
    r = spark.createDataFrame([("success", 1, 2, 3, 4)], "status string, " + ", ".join(f"{d} int" for d in jd.DIMENSIONS))
    assert all(x["sd"] is None for x in jd.quality_table(r).collect())
    assert jd.share_table(r.withColumn("flag", F.lit(True)).filter("false"), "flag", "y", "n").first()["percentage"] is None


def test_judge_options():
    import pytest

    from pathloom.operators.reports import JudgeOptions

    o = JudgeOptions.from_env({"JUDGE_MODEL": "m", "JUDGE_API_KEY": "secret", "JUDGE_MAX_TOKENS": "10", "JUDGE_THINKING": "false"})
    assert (o.max_tokens, o.thinking) == (10, False)
    assert "secret" not in repr(o) and "api_key" not in o.public()
    with pytest.raises(ValueError):
        JudgeOptions("m", consistency_runs=1)


def test_exports(spark, tmp_path):
    from pathloom.operators import reports as rp
    from pathloom.sources import graphs as src

    df = spark.createDataFrame([("=x", 0.5)], "name string, value double")
    rp.export_summary({"t": df}, tmp_path / "r", "Report")
    assert "0.5000" in (tmp_path / "r/report.md").read_text() and "<td>=x</td>" in (tmp_path / "r/report.html").read_text()
    src.guarded_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["name"] == "'=x"
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    waits = []
    assert rp.retried(flaky, sleep=waits.append)("p") == "ok" and waits == [1.0, 2.0]
