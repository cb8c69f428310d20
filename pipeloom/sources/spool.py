"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The application's folder in the one that spark.checkpoint.dir names. Only in local mode, where every task sees the
    driver's disk, may that be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="pipeloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written between steps; results that still read it must have been stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(df: DataFrame, name: str = "spool") -> DataFrame:
    """df as a table in the cluster's shared folder: lineage ends here,
    rows stay as they are however often they are read, and lost executors lose none."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
