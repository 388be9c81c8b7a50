"""Results that several steps read, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where a local session has none, a folder set here."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexmill-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read back: nothing computes it again, lost executors don't lose it.
    All tables of an application are in one folder, to be removed after it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
