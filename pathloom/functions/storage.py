"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of each application, for release().
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, as spark.checkpoint.dir names it.

    Only where nothing is set and the master is local (one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext._jsc.sc()
    if sc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master()):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="pathloom-"))
    return sc.getCheckpointDir().get()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at path, in whatever store."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder, without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes the tables that written() made in this application; results that were not saved elsewhere cannot be read after
    that. Returns their number."""
    sc, made = spark.sparkContext, _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
