"""Tables that a job writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, and only where the session names no checkpoint folder.
LOCAL = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: lineage ends there, and a lost executor costs no more than its tasks."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tidewatch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
