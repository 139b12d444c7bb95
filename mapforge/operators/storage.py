"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="mapforge-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a written table: its lineage ends there, and losing an executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
