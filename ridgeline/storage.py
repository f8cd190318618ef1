"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names. Where that is unset a session on this machine alone uses a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ridgeline-tables")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def own_columns(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, so that they can meet rows that come from the same table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))
