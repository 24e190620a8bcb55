"""Parquet tables by directory; every reader goes through Spark so that any Hadoop path works."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir; one of our own where that is unset and all runs on one machine, as in tests."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again: a table that several branches of a plan read is computed once, and lost executors cost no more than it."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
