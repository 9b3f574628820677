"""Joins by size, and what operators give when nothing may be broadcast."""

from pathloom.llm import common, exact, simhash
from pyspark.sql import functions as F

from .test_exact import brute
from .test_similar_texts import brute_kept, edited, kept


def test_joins_beyond_the_bound_are_shuffled(spark, monkeypatch):
    rows, few = spark.range(100).toDF("k"), spark.range(10).toDF("k")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(common.joined_with(rows, few, 10, "k", "left_semi"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    assert "broadcast" not in plan(common.joined_with(rows, few, 10, "k", "left_semi"))


def test_often_met_rows_meet_once(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("k"), "id")
    table = spark.range(12).select(F.col("id").alias("k"), (F.col("id") * 100).alias("times"))
    for often in (-1, 500, 10_000):
        found = common.looked_up(rows, table, ["k"], "times", often)
        assert found.count() == 1000 and found.select("id").distinct().count() == 1000


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "hash int, HASH_ int, x int")
    assert common.free_names(df, "hash", "x", "y", "y") == ["hash__", "x_", "y", "y_"]


def test_exact_dedup_without_broadcasts(odd_docs, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    want = brute(odd_docs.collect())
    assert sorted((tuple(r) for r in exact.exact_dedup(odd_docs).collect()), key=str) == want
    assert sorted((r["doc_id"] for r in exact.keep_first(odd_docs).collect()), key=str) == sorted((x[0] for x in want if x[3]), key=str)


def test_near_dedup_without_broadcasts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = edited(docs)
    assert kept(spark, rows) == brute_kept(rows)
