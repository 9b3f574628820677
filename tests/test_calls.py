"""Judge requests against scripted providers."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pathloom.operators import calls as ca
from pathloom.operators import judging as jd
from pathloom.operators.reports import JudgeOptions

ITEM = {"sample_id": "s1", "evidence": {"top_features": [{"ngram": "a b", "shap_value": 0.1}]}, "candidate_analysis": {"explanation": "It mines coins", "parts": ["x", {"y": 0.5}]}}
OPTIONS = JudgeOptions("m", api_key="secret-key-1")


def form(**changes):
    good = {
        "sample_id": "s1", "scores": dict.fromkeys(jd.DIMENSIONS, 4), "justifications": dict.fromkeys(jd.DIMENSIONS, "because"),
        "unsupported_claims": [{"quote": "mines", "candidate_path": "/candidate_analysis/explanation", "evidence_reference": "/evidence", "reason": "r", "category": "unsupported_crypto"}],
        "shap_faithfulness": {"faithful": True, "reason": "r", "discrepancies": []}, "evidence_limitations": ["few"], "summary": "ok",
    }
    return good | changes


def blocks(value, stop="end_turn"):
    text = value if isinstance(value, str) else json.dumps(value)
    return {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": text}], "stop_reason": stop, "usage": {"input_tokens": 5, "output_tokens": 7}}


def script(*answers):
    """A provider that gives one answer after another, and what it was asked."""
    asked, left = [], list(answers)

    def send(body):
        asked.append(body)
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return send, asked


def run(*answers, options=OPTIONS):
    send, asked = script(*answers)
    waits = []
    return ca.evaluated(ITEM, options, ca.Rubric(), send, sleep=waits.append), asked, waits


def test_first_answer_is_taken():
    out, asked, waits = run(blocks(form()))
    assert (out["status"], out["error"], len(out["attempts"]), waits) == ("success", None, 1, [])
    assert out["attempts"][0]["input_tokens"] == 5 and out["attempts"][0]["request_hash"] == ca.content_hash(asked[0])
    assert out["protocol_hash"] != ca.protocol_hash(JudgeOptions("other"), ca.Rubric()) and "secret" not in json.dumps(asked)


def test_invalid_forms_are_sent_back_with_the_reason():
    out, asked, waits = run(blocks("no json"), blocks(form(summary=" ")), blocks(form()))
    assert out["status"] == "success" and waits == [1.0, 2.0]
    assert "no summary" in asked[2]["messages"][0]["content"] and "rejected" not in asked[0]["messages"][0]["content"]


@pytest.mark.parametrize("status, tries, fatal", [(None, 3, False), (408, 3, False), (409, 3, False), (429, 3, False), (500, 3, False), (529, 3, False), (400, 1, True), (401, 1, True), (403, 1, True), (404, 1, True), (422, 1, False), (413, 1, False)])
def test_which_errors_are_tried_again(status, tries, fatal):
    out, asked, _ = run(*[ca.ProviderError("secret-key-1 no", status)] * 3)
    assert (len(asked), out["fatal"], out["status"]) == (tries, fatal, "judge_error")
    assert "secret" not in json.dumps(out) and "[REDACTED]" in out["error"]


def test_waits_follow_the_provider_up_to_a_minute():
    _, _, waits = run(ca.ProviderError("x", 429, 7.5), ca.ProviderError("x", 429, 9000.0), blocks(form()))
    assert waits == [7.5, 60.0]
    assert ca.retry_rule(ca.ProviderError("x", 503, float("nan")), 3, 1.0) == (True, 4.0, False)


def test_cut_off_answers_are_not_scored():
    out, asked, _ = run(blocks(form(), stop="max_tokens"))
    assert out["status"] == "judge_error" and len(asked) == 1 and out["attempts"][0]["stop_reason"] == "max_tokens"


BAD = [
    {"extra": 1}, {"sample_id": "s2"}, {"scores": dict.fromkeys(jd.DIMENSIONS, 6)}, {"scores": dict.fromkeys(jd.DIMENSIONS, True)}, {"scores": dict.fromkeys(jd.DIMENSIONS, 4.0)},
    {"scores": {"coherence": 3}}, {"justifications": dict.fromkeys(jd.DIMENSIONS, "")}, {"summary": 3}, {"evidence_limitations": [""]}, {"unsupported_claims": {}},
    {"unsupported_claims": [form()["unsupported_claims"][0] | {"quote": "absent"}]}, {"unsupported_claims": [form()["unsupported_claims"][0] | {"category": "none"}]},
    {"unsupported_claims": [form()["unsupported_claims"][0] | {"candidate_path": "/evidence/top_features"}]}, {"unsupported_claims": [form()["unsupported_claims"][0] | {"candidate_path": "/candidate_analysis/none"}]},
    {"shap_faithfulness": {"faithful": False, "reason": "r", "discrepancies": []}}, {"shap_faithfulness": {"faithful": True, "reason": "", "discrepancies": []}},
    {"shap_faithfulness": {"faithful": False, "reason": "r", "discrepancies": [{"quote": "0.5", "candidate_path": "/candidate_analysis/parts/1/y"}]}},
]


@pytest.mark.parametrize("change", BAD, ids=lambda c: next(iter(c)))
def test_untruthful_forms_are_refused(change):
    with pytest.raises((ValueError, TypeError)):
        ca.validated(form(**change), ITEM)


def test_truthful_forms_pass():
    assert ca.validated(form(), ITEM)
    faith = {"faithful": False, "reason": "r", "discrepancies": [{"quote": "0.5", "candidate_path": "/candidate_analysis/parts/1/y", "reason": "r"}]}
    assert ca.validated(form(shap_faithfulness=faith), ITEM)


def test_final_text():
    assert ca.parse_final('{"a": 1}') == ca.parse_final(' ```json\n{"a": 1}\n``` ') == {"a": 1}
    for text in ("", "[1]", '{"a": 1, "a": 2}', '{"a": NaN}', 'text ```json\n{"a": 1}\n```'):
        with pytest.raises(ValueError):
            ca.parse_final(text)


def test_answers_of_other_providers():
    assert ca.answer_of({"choices": [{"message": {"content": "x"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": True}}) == ("x", "stop", 1, None)
    assert ca.answer_of({"message": {"content": "y"}, "done": False, "eval_count": 3}) == ("y", "length", None, 3)
    assert ca.answer_of({"response": "z", "done": True, "prompt_eval_count": -1}) == ("z", "stop", None, None)
    with pytest.raises(ValueError):
        ca.answer_of([])


def test_schema_asks_for_every_field():
    schema = ca.response_schema()
    assert set(schema["required"]) == set(form()) and schema["additionalProperties"] is False
    assert schema["properties"]["unsupported_claims"]["items"]["properties"]["category"]["enum"] == sorted(ca.CATEGORIES)
    with pytest.raises(ValueError):
        ca.Rubric(definitions={"one": "x"})


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        status = body.get("status", 200)
        self.send_response(status)
        if status == 429:
            self.send_header("Retry-After", "3")
        self.end_headers()
        self.wfile.write(json.dumps({"key": self.headers["x-api-key"]}).encode())

    def log_message(self, *args):
        pass


def test_over_http():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = ca.over_http(f"http://127.0.0.1:{server.server_port}/", {"x-api-key": "secret-key-1"}, 5)
    assert send({}) == {"key": "secret-key-1"}
    with pytest.raises(ca.ProviderError) as e:
        send({"status": 429})
    assert (e.value.status, e.value.retry_after) == (429, 3.0) and "secret" not in str(e.value)
    server.shutdown()
    server.server_close()
    with pytest.raises(ca.ProviderError) as e:
        send({})
    assert e.value.status is None


def test_batch_stops_after_a_fatal_answer_or_errors_in_a_row(spark):
    items = spark.createDataFrame([(json.dumps({**ITEM, "sample_id": f"s{i}"}),) for i in range(8)], "item string").coalesce(1)

    def refuse(body):
        raise ca.ProviderError("no", 401)

    def broken(body):
        raise ca.ProviderError("no", 422)

    def good(body):
        name = json.loads(body["messages"][0]["content"].split("\n")[4])["sample_id"]
        return blocks(form(sample_id=name))

    states = lambda send: [r["status"] for r in ca.evaluate_all(items, OPTIONS, ca.Rubric(), send).collect()]
    assert states(good) == ["success"] * 8
    assert states(refuse) == ["judge_error"] + ["not_attempted_batch_stopped"] * 7
    assert states(broken) == ["judge_error"] * 3 + ["not_attempted_batch_stopped"] * 5
    row = ca.evaluate_all(items, OPTIONS, ca.Rubric(), good).first()
    assert row["attempts"][0]["output_tokens"] == 7 and json.loads(row["evaluation"])["summary"] == "ok"


def test_items_show_no_label_or_name(spark):
    rows = [("bin1", 2, 1, 0.9, [("a b", 0.5, 0.1)], "input_ready", '{"explanation": "e"}'), ("bin2", 2, 1, 0.9, [], "input_error", None)]
    df = spark.createDataFrame(rows, "binary_name string, ngram_size int, prediction int, probability double, features array<struct<ngram: string, value: double, shap_value: double>>, status string, analysis string")
    items = ca.judge_items(jd.sample_ids(df)).collect()
    assert len(items) == 1 and "bin1" not in items[0]["item"]
    item = json.loads(items[0]["item"])
    assert item["candidate_analysis"] == {"explanation": "e"} and item["evidence"]["top_features"][0]["ngram"] == "a b" and item["sample_id"] == items[0]["sample_id"]
    assert set(jd.blinded(jd.sample_ids(df)).columns) == {"sample_id", "prediction", "probability", "features", "ngram_size"}


def test_exit_codes():
    assert ca.exit_code({"success": 3, "duplicate_input": 1}) == 0
    assert [ca.exit_code({x: 1}) for x in ("judge_error", "input_error", "generation_error", "not_attempted_batch_stopped")] == [1] * 4
    assert ca.exit_code({"success": 1}, interrupted=True) == 130
