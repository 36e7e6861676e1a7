"""Folders that the driver and all executors reach."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir; in a temporary one only where that is unset and the session is local."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(told or 'file://' + tempfile.mkdtemp(prefix='spark-shared-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that no plan refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
