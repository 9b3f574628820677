"""Graph files and judge inputs as they arrive. The same operators run on every micro-batch, and what is
done is told from saved results, so a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import exists
from ..operators import judging, ngrams
from ..sources import graphs


def arriving_graphs(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Graph files under path as a stream of rows."""
    reader = spark.readStream.schema(graphs.GRAPH_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path).withColumn("path", F.col("_metadata.file_path"))


def count_ngrams(stream: DataFrame, n: int, out: str, checkpoint: str) -> StreamingQuery:
    """n-gram counts of each arriving binary, appended to out. Files that are counted there already are passed over, so a batch
    that is repeated after a failure, or a new checkpoint over the same folders, counts nothing twice and loses nothing."""
    columns = "path string, binary string, ngram array<string>, n bigint"

    def batch(files: DataFrame, number: int) -> None:
        if exists(files.sparkSession, out):
            done = files.sparkSession.read.schema(columns).parquet(out).select("path").distinct()
            files = files.join(done, "path", "left_anti")
        rows = graphs.instructions(graphs.functions(files))
        grams = ngrams.linear(rows, n, ["path", "binary", "pos"], order="pos_in_function")
        counted = grams.groupBy("path", "binary", "ngram").agg(F.count("*").alias("n"))
        counted.write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def analysed(samples: DataFrame, analyse: Callable[[str], str], attempts: int = 3) -> DataFrame:
    """samples (sample_id, prediction, shap_status, prompt) of predicted positives, with answer or error. A
    sample whose call keeps failing does not stop the others."""
    import pandas as pd

    gate = samples.filter((F.col("prediction") == 1) & (F.col("shap_status") == "completed")).select("sample_id", "prompt")

    def run(batches):
        for batch in batches:
            rows = []
            for sample_id, prompt in zip(batch["sample_id"], batch["prompt"], strict=True):
                answer, error = None, None
                for _ in range(attempts):
                    try:
                        answer, error = analyse(prompt), None
                        break
                    except Exception as e:  # the callable is the user's
                        error = f"{type(e).__name__}: {e}"
                rows.append((sample_id, answer, error))
            yield pd.DataFrame(rows, columns=["sample_id", "answer", "error"])

    return gate.mapInPandas(run, "sample_id string, answer string, error string")


def judge_arrivals(inputs: DataFrame, saved_path: str, judge: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Judges what has no saved success for the same input and protocol; the rest is resumed. Results are appended, never overwritten, and
    every batch reads all of them: a batch that is repeated, a restart, and a new checkpoint over the same folder find what is done."""

    def batch(rows: DataFrame, number: int) -> None:
        before = saved_results(rows.sparkSession, saved_path)
        todo = judging.resume(rows, before).filter("action = 'run'").drop("action")
        judge(todo).write.mode("append").parquet(saved_path)

    return inputs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, input_hash, protocol_hash and status of everything saved under path; none if nothing is."""
    schema = "sample_id string, input_hash string, protocol_hash string, status string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
