"""The folder that driver and executors share, and results that are kept there instead of being made again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a session on one machine may leave it unset and gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, made once and read from the shared folder from then on: for results that must not be made twice, and to cut a long
    lineage.  Rows keep their partitions."""
    context, base = df.sparkSession.sparkContext, scratch_dir(df.sparkSession)
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return df.checkpoint()


def kept_columns(df: DataFrame) -> DataFrame:
    """The same as a table of columns, for wide rows (texts, answers of a scorer) that are read for a few columns."""
    path = f"{scratch_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
