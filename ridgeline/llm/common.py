"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a session on this machine alone uses a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "ridgeline-shared")
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch while a table is made: batches are held several times over, in the JVM and in its Python worker.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    before = spark.conf.get(_BATCHES)
    spark.conf.set(_BATCHES, str(BATCH_BYTES))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCHES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.work_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text(name: str = "text") -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))



def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores more as it takes not to meet a column of the table."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
