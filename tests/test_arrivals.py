"""Streaming judging over restarts."""

from pathloom.streaming import arrivals as ar
from pyspark.sql import functions as F

INPUT = "sample_id string, input_hash string, protocol_hash string"


def test_restarts_keep_results_and_judge_nothing_twice(spark, tmp_path):
    inbox, saved, judged = tmp_path / "in", str(tmp_path / "saved"), []

    def arrive(*rows):
        spark.createDataFrame(list(rows), INPUT).coalesce(1).write.mode("append").json(str(inbox))

    def judge(todo):
        judged.append(sorted(r["sample_id"] for r in todo.collect()))
        return todo.withColumn("status", F.when(F.col("sample_id") == "bad", "judge_error").otherwise("success")).withColumn("note", F.lit("x"))

    def run(checkpoint):
        stream = spark.readStream.schema(INPUT).json(str(inbox))
        ar.judge_arrivals(stream, saved, judge, str(tmp_path / checkpoint)).awaitTermination()

    arrive(("a", "1", "p"), ("bad", "1", "p"))
    run("c1")
    run("c1")  # nothing new
    run("c2")  # a new checkpoint sees all inputs again
    arrive(("b", "1", "p"), ("a", "2", "p"))
    run("c2")
    run("c3")
    assert [x for x in judged if x] == [["a", "bad"], ["bad"], ["a", "b"], ["bad"]]
    done = spark.read.parquet(saved).filter("status = 'success'")
    assert sorted((r["sample_id"], r["input_hash"]) for r in done.collect()) == [("a", "1"), ("a", "2"), ("b", "1")]
