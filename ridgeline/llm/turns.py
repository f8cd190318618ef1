"""Rows of conversations in order, however many of them one conversation holds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def numbered(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Adds blk, pos (from 1) and n_rows: the block of a row, its place among the rows of its key and how many those are. ``key`` isn't null.

    Rows are dealt by range of key and order, so that a key with a third of all rows is spread over many partitions; a block is what one partition
    holds of a key. Places are counted within blocks and begin where the blocks before end; only sums of blocks meet by key. Rows that agree in all of the order
    follow one another in any order.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = materialise(tied.repartitionByRange(F.col(key), *order, F.col("_tie")).withColumn("blk", F.spark_partition_id().cast("long")), "turns")
    blocks = dealt.groupBy(key, "blk").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key)
    starts = blocks.select(key, "blk", F.coalesce(F.sum("_n").over(w.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(w).alias("n_rows"))
    inside = F.row_number().over(Window.partitionBy(key, "blk").orderBy(*order, "_tie"))
    return dealt.withColumn("_inside", inside).join(starts, [key, "blk"]).withColumn("pos", F.col("_start") + F.col("_inside")).drop("_tie", "_start", "_inside")


def runs(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows with equal first ``n_key`` columns, as (key, rows of the other columns)."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_key] != key:
                if held:
                    yield key, held
                key, held = row[:n_key], []
            held.append(row[n_key:])
    if held:
        yield key, held
