"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode one is made where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def unique() -> str:
    """A name for a folder that no other run uses."""
    return uuid.uuid4().hex


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written there once and read again: what follows starts from its files, also
    after an executor is lost. The files go with the session."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{unique()}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)
