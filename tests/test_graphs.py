import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pathloom.operators import graphs as gr
from pathloom.operators import ngrams as ng
from pathloom.sources import graphs as src
from pathloom.streaming import arrivals


def edges(spark, *pairs, function="f"):
    return spark.createDataFrame([(function, i, a, b) for i, (a, b) in enumerate(pairs)], "function string, pos int, src int, dst int")


def paths(spark, nodes, pairs, entry=0, **options):
    n = spark.createDataFrame([("f", x) for x in nodes], "function string, block int")
    e = spark.createDataFrame([("f", entry)], "function string, entry_block int")
    found = gr.acyclic_paths(n, edges(spark, *pairs), e, **options)
    return [list(r["path"]) for r in found.orderBy("path_id").collect()]


@pytest.mark.parametrize(
    ("nodes", "pairs", "expected"),
    [
        ([0, 1, 2], [(0, 1), (1, 2)], [[0, 1, 2]]),
        ([0, 1, 2, 3], [(0, 1), (0, 2), (1, 3), (2, 3)], [[0, 1, 3], [0, 2, 3]]),
        ([0, 1], [(0, 0), (0, 1)], [[0, 1]]),
        ([0, 1], [(0, 1), (1, 0)], []),  # the last block has a successor, so nothing ends
        ([0, 1], [(0, 1), (0, 1)], [[0, 1], [0, 1]]),
        ([0], [], [[0]]),
    ],
)
def test_acyclic_paths(spark, nodes, pairs, expected):
    assert paths(spark, nodes, pairs) == expected


def test_path_guard_and_broken_edge(spark):
    assert paths(spark, [0, 1, 2], [(0, 1), (0, 2)], most_paths=1) == [[0, 1]]
    with pytest.raises(PySparkException):
        paths(spark, [0], [(0, 9)])


def dfg(spark, *rows):
    return spark.createDataFrame([("f", "v", i, a, b, k, loop) for i, (a, b, k, loop) in enumerate(rows)], "function string, var string, pos int, src int, dst int, kind string, loop_carried boolean")


@pytest.mark.parametrize(
    ("rows", "expected"),
    [
        ([(0, 1), (1, 2)], [[0, 1, 2]]),
        ([(0, 1), (1, 2), (1, 3)], [[0, 1], [1, 2], [1, 3]]),
        ([(0, 2), (1, 2), (2, 3)], [[0, 2], [1, 2], [2, 3]]),
        ([(0, 1), (1, 0)], []),
    ],
)
def test_segments(spark, rows, expected):
    found = gr.segments(dfg(spark, *[(a, b, "k", False) for a, b in rows]), ["function", "var"])
    assert sorted(list(r["segment"]) for r in found.collect()) == expected


def test_loop_carried_and_kinds(spark):
    e = dfg(spark, (0, 1, "first", True), (1, 2, "second", False))
    assert [list(r["segment"]) for r in gr.segments(e, ["function", "var"]).collect()] == [[1, 2]]
    assert [list(r["chain"]) for r in gr.chains(e, ["function", "var"], keep_loop_carried=True).collect()] == [[0, 1, 2]]
    assert gr.first_kinds(e, ["function", "var"]).first()["kind"] == "first"
    assert gr.segments(e.withColumn("loop_carried", F.lit(True)), ["function", "var"]).count() == 0


def test_short_paths_and_missing_instructions(spark):
    p = spark.createDataFrame([("f", ["a"]), ("g", ["a", "b", "c"])], "function string, mnemonics array<string>")
    assert [tuple(r["ngram"]) for r in ng.shingle(p, 2).orderBy("start").collect()] == [("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        ng.shingle(p, 0)
    i = spark.createDataFrame([("f", 0, "mov")], "function string, idx int, mnemonic string")
    q = spark.createDataFrame([("f", [0, 5])], "function string, path array<int>")
    with pytest.raises(PySparkException):
        gr.path_items(q, i).collect()


def graph_file(name, **more):
    body = {
        "function": "main", "entry": "0X10",
        "instructions": [{"idx": 0, "addr": "0x10", "mnemonic": "mov", "operands": "a"}, {"idx": 1, "addr": "0x11", "mnemonic": "add"}, {"idx": 2, "addr": "0x12", "mnemonic": "ret"}],
        "cfg_nodes": [{"instr_indices": [0, 1]}, {"instr_indices": [2]}],
        "cfg_edges": [{"from": 0, "to": 1}, {"src": 0}], "dfg_edges": [{"from": 0, "to": 1, "var": "r", "kind": "k"}],
    }
    return {"binary": name, "label": 1, "label_name": "cryptojacking", "graphs": [body | more]}


def test_loader(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(graph_file("a")))
    (tmp_path / "b.JSON").write_text("{not json")
    (tmp_path / "c.txt").write_text("other")
    files = src.read_files(spark, str(tmp_path)).cache()
    assert files.count() == 2
    assert [r["path"].rsplit("/", 1)[1] for r in src.skipped(files).collect()] == ["b.JSON"]
    f = src.functions(files).first()
    assert [tuple(e) for e in f["cfg_edges"]] == [(0, 1)]
    assert f["dfg_edges"][0]["loop_carried"] is False
    assert [i["operands"] for i in f["instructions"]] == ["a", "", ""]
    rows = src.functions(files)
    blocks = rows.select("function", F.posexplode("blocks").alias("block", "b")).select("function", "block", F.explode("b.instr_indices").alias("idx"))
    found = gr.entry_blocks(blocks, src.instructions(rows), rows.select("function", "entry"))
    assert found.first()["entry_block"] == 0  # addresses differ in case only


def test_streamed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(graph_file("a")))
    out = str(tmp_path / "out")
    for name in ("b", "c"):
        q = arrivals.count_ngrams(arrivals.arriving_graphs(spark, str(tmp_path / "in")), 2, out, str(tmp_path / "cp"))
        q.awaitTermination(120)
        (tmp_path / f"in/{name}.json").write_text(json.dumps(graph_file(name)))
    rows = spark.read.parquet(out)
    assert sorted((r["binary"], " ".join(r["ngram"]), r["n"]) for r in rows.collect()) == [("a", "add ret", 1), ("a", "mov add", 1), ("b", "add ret", 1), ("b", "mov add", 1)]
    arrivals.count_ngrams(arrivals.arriving_graphs(spark, str(tmp_path / "in")), 2, out, str(tmp_path / "cp2")).awaitTermination(120)  # a new checkpoint
    counts = {r["binary"]: r["count"] for r in spark.read.parquet(out).groupBy("binary").count().collect()}
    assert counts == {"a": 2, "b": 2, "c": 2}


def test_vocabulary_round_trip(spark, tmp_path):
    v = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "c"])], "feature_id long, ngram array<string>")
    src.write_vocabulary(v, 2, str(tmp_path / "v"))
    back = src.read_vocabulary(spark, str(tmp_path / "v"))
    assert sorted((r["feature_id"], tuple(r["ngram"]), r["n"]) for r in back.collect()) == [(0, ("a", "b"), 2), (1, ("a", "c"), 2)]


def test_model_stage_is_isolated(spark):
    s = spark.createDataFrame([("a", 1, "completed", "x"), ("b", 1, "completed", "boom"), ("c", 0, "completed", "x"), ("d", 1, "failed", "x")], "sample_id string, prediction int, shap_status string, prompt string")

    def mock(prompt):
        if prompt == "boom":
            raise RuntimeError("no answer")
        return prompt.upper()

    found = {r["sample_id"]: (r["answer"], r["error"]) for r in arrivals.analysed(s, mock).collect()}
    assert found == {"a": ("X", None), "b": (None, "RuntimeError: no answer")}
