"""Folders for what operators write on their way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share. Where it is unset, a temporary one in local mode, as in tests; on a cluster, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder there, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)  # only of what is there
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, which ends its lineage."""
    path = folder(df.sparkSession, name)
    df.write.parquet(f"{path}/t")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/t")
