"""A folder of analyses through screening, judging, a restart and a report."""

import json

import pytest
from pathloom import __main__ as cli
from pathloom.operators import calls as ca
from pathloom.operators import runner as ru
from pathloom.operators.reports import JudgeOptions

from .test_calls import blocks, form

OPTIONS = JudgeOptions("m")


def analysis(name, shown=0.25, explanation="It mines coins"):
    return {
        "sample": {"binary_name": name}, "random_forest": {"ngram_size": 2, "malware_probability": 0.9, "predicted_class": 1},
        "shap": {"status": "completed", "top_features": [{"ngram": "a b", "value": 0.5, "shap_value": 0.25}]},
        "llm": {"status": "completed", "model": "m", "analysis": {"tier": "benign", "explanation": explanation, "evidence_analysis": [{"ngram": "a b", "shap_contribution": shown, "assessment": "x"}]}},
    }


@pytest.fixture()
def folder(tmp_path):
    given = tmp_path / "in"
    given.mkdir()
    files = {"a": analysis("one"), "b": analysis("two", shown=0.3), "c": analysis("one"), "d": analysis("four", explanation=""), "e": analysis("five")}
    for name, body in files.items():
        (given / f"{name}.json").write_text(json.dumps(body))
    (given / "f.json").write_text('{"sample": 1, "sample": 2}')
    return tmp_path


def judge(fail=()):
    """A provider that fills in a clean form, but is down for some binaries; it runs in the workers, which do not see names, so they are told by their ids."""

    def send(body):
        item = json.loads(body["messages"][0]["content"].split("\n")[4])
        if item["sample_id"] in fail:
            raise ca.ProviderError("down", 422)
        return blocks(form(sample_id=item["sample_id"], unsupported_claims=[]))

    return send


def test_batch_is_resumed_and_summarised(spark, folder):
    given, out = str(folder / "in"), str(folder / "out")
    go = lambda send, **more: ru.run_batch(spark, given, out, OPTIONS, ca.Rubric(), send, **more)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in ru.prepared(spark, given).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"a.json": "input_ready", "b.json": "input_ready", "c.json": "duplicate_input", "d.json": "generation_error", "e.json": "input_ready", "f.json": "input_error"}
    assert "one" not in rows["a.json"]["item"].replace("completed", "")
    assert go(judge(), dry_run=True) == {"input_ready": 3, "duplicate_input": 1, "generation_error": 1, "input_error": 1}
    first = go(judge(fail={rows["e.json"]["sample_id"]}))
    assert first == {"success": 2, "judge_error": 1, "duplicate_input": 1, "generation_error": 1, "input_error": 1} and ca.exit_code(first) == 1
    refuse = judge(fail={rows["a.json"]["sample_id"], rows["b.json"]["sample_id"]})  # what is done is not asked again
    assert go(refuse)["success"] == 3
    assert go(judge(), limit=2) == {"success": 2}
    done = ru.judged(ru.prepared(spark, given), ru.results(spark, out + "/results"), ca.protocol_hash(OPTIONS, ca.Rubric()))
    flags = {r["path"].rsplit("/", 1)[1]: (r["has_unsupported_claims"], r["faithful_to_shap"], r["coherence"]) for r in done.collect()}
    assert flags["a.json"] == (False, True, 4.0) and flags["b.json"] == (True, False, 4.0) and flags["d.json"] == (None, None, None)
    ru.export(spark, given, out, OPTIONS, ca.Rubric(), str(folder / "report"))
    text = (folder / "report/report.md").read_text()
    assert "| Total evaluated | 3 | 100.0000 |" in text and (folder / "report/quality.csv").exists()
    with pytest.raises(ValueError):
        ru.run_batch(spark, given, out, JudgeOptions("other"), ca.Rubric(), judge())
    with pytest.raises(ValueError):
        ru.run_batch(spark, given, given + "/out", OPTIONS, ca.Rubric(), judge())


def test_command_line(spark, folder, capsys):
    given, out = str(folder / "in"), str(folder / "out")
    assert cli.main([given, out, "--dry-run", "--limit", "2"], {"JUDGE_MODEL": "m"}) == 0
    assert "input_ready: 2" in capsys.readouterr().out
    assert cli.main([given, out, "--dry-run"], {"JUDGE_MODEL": "m"}) == 1  # rejected inputs
    assert cli.main([given, out], {"JUDGE_MODEL": "m"}) == 1 and "JUDGE_API_KEY" in capsys.readouterr().err
    assert cli.main([given, out, "--dry-run", "--limit", "0"], {"JUDGE_MODEL": "m"}) == 1


def test_chunks_are_saved_one_by_one(spark, folder, monkeypatch):
    given, out = str(folder / "in"), str(folder / "out")
    go = lambda send: {k: v for k, v in ru.run_batch(spark, given, out, OPTIONS, ca.Rubric(), send, chunk=1).items() if "error" not in k or k == "judge_error"}
    ids = sorted(r["sample_id"] for r in ru.prepared(spark, given).filter("item IS NOT NULL").collect())
    asked, real = [], ca.evaluate_all

    def interrupted(*args, **more):
        asked.append(1)
        if len(asked) == 2:
            raise KeyboardInterrupt
        return real(*args, **more)

    monkeypatch.setattr(ca, "evaluate_all", interrupted)
    assert go(judge()) == {"success": 1, "not_attempted_interrupted": 2, "duplicate_input": 1}
    monkeypatch.setattr(ca, "evaluate_all", real)

    def refuse(body):
        raise ca.ProviderError("no", 401)

    assert go(refuse) == {"success": 1, "judge_error": 1, "not_attempted_batch_stopped": 1, "duplicate_input": 1}
    assert go(judge(fail={ids[2]})) == {"success": 2, "judge_error": 1, "duplicate_input": 1}
    assert go(judge()) == {"success": 3, "duplicate_input": 1}
