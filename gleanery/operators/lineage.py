"""Dealing rows out, and cutting lineage in loops, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df's rows over four tasks a core, by key. A narrow table of millions of rows lies in a few row groups, so without this the
    texts that are made of it are all made and searched in as many tasks."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where none is set, one of our own if Spark runs in this one
    process (tests); on a cluster that would be a folder that others don't see, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-stash-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def settle(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
