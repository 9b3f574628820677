"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import free_names
from ..functions.storage import checkpointed, shared_dir, shuffle_width, written

__all__ = ["bounded_batches", "checkpointed", "discard", "documents", "free_names", "joined_with", "looked_up", "shared_dir", "shuffle_width", "written"]

#: White space as every contract counts it; a word is a run of anything else.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Rows of a table of keys that may be broadcast; beyond, both sides of a join are shuffled.
BROADCAST_ROWS = 200_000


def joined_with(rows: DataFrame, few: DataFrame, n: int, on: str | list[str] | list[Column], how: str = "inner") -> DataFrame:
    """rows joined with a table of n narrow rows: broadcast if they are few, so that rows stay where they are."""
    return rows.join(F.broadcast(few) if n <= BROADCAST_ROWS else few, on, how)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], times: str, often: int, shuffled: bool = False) -> DataFrame:
    """rows joined with a table whose column ``times`` tells how many of them meet each of its rows. Those that more than
    ``often`` meet are few and broadcast, so that no task gets all the rows of one key. shuffled: the rest is never broadcast, however
    small its compressed files are."""
    hot, rest = table.filter(F.col(times) > often), table.filter(F.col(times) <= often)
    others = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(others.join(rest.hint("merge") if shuffled else rest, on))


def bounded_batches(spark: SparkSession, most: str = "8m") -> None:
    """Arrow batches hold so many bytes at most, so that a Python worker's memory does not follow the length of the
    texts. A session that has a bound of its own keeps it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864"):  # Spark's default
        spark.conf.set(key, most)


def discard(table: DataFrame) -> None:
    """Removes a written() table that nothing will read again."""
    files = table.inputFiles()
    if files:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
