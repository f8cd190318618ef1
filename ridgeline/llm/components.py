"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _settle(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).drop("_n")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (u, v), longs; a component is named by its least vertex.

    Each round is written to the shared folder; the driver sees a count and a checksum. Vertices with many edges are
    skewed keys of joins, which AQE splits, and never a list.
    """
    now = materialise(_settle(edges.select("u", "v")), "edges")
    seen = None
    for _ in range(ROUNDS):
        n, total = now.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 20))).first()
        if not n or (n, total) == seen:
            break
        seen = (n, total)
        before, now = now, materialise(_settle(_small_star(_settle(_large_star(now)))), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    # settled: every edge goes from a vertex to the least of its component
    named = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out = materialise(named, "components")
    discard(now)
    return out
