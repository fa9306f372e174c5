"""The folder that all executors share, and tables written there to end a long plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset and Spark runs in this process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: the plan starts anew there, and lost executors cost nothing.

    The folder belongs to the application and may be removed when it has ended."""
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
