"""New folders below that of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below that of spark.checkpoint.dir, which a cluster shares; on one machine without it a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """df written once as a table in the shared folder and read back: it is not made twice, and a lost executor's part not at all."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
