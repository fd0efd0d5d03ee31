"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, one of our own on a single machine; on a cluster that is an error."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have is None:
        have = spark.conf.get("spark.checkpoint.dir", None)
        if have is None and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        have = have or tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(have)
    return have


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder; cuts lineage."""
    path = fresh(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
