"""Pointer jumping: sums and ranks along chains of any length in a logarithm of rounds, each a few joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise

ROUNDS = 64


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """(id, total): of nodes (id, next, weight) of a forest, the weights of all nodes from which a node is reached, its own included.

    After k rounds a node knows what lies less than 2^k steps above it, and points 2^k steps down; what comes next stands exactly there.
    """
    now = materialise(nodes.select("id", "next", F.col("weight").cast("double").alias("total")), "sums")
    for _ in range(ROUNDS):
        if not now.where("next IS NOT NULL").limit(1).count():
            return now.select("id", "total")
        gained = now.where("next IS NOT NULL").groupBy(F.col("next").alias("id")).agg(F.sum("total").alias("_more"))
        further = now.select(F.col("id").alias("next"), F.col("next").alias("_far"))
        after = now.join(gained, "id", "left").join(further, "next", "left").select("id", F.col("_far").alias("next"), (F.col("total") + F.coalesce("_more", F.lit(0.0))).alias("total"))
        before, now = now, materialise(after, "sums")
        discard(before)
    raise ValueError("the nodes' pointers run in a circle")


def chain_ranks(links: DataFrame) -> DataFrame:
    """(id, head, rank): of links (id, up), each id once, the end of the chain of ups from an id, and the steps to it. Ids on circles have none and are left out."""
    now = materialise(links.select("id", F.col("up").alias("head"), F.lit(1).cast("long").alias("rank"), F.lit(False).alias("done")), "ranks")
    open_before = None
    for _ in range(ROUNDS):
        n_open = now.where("NOT done").count()
        if n_open in (0, open_before):
            return now.where("done").select("id", "head", "rank")
        open_before = n_open
        above = now.select(F.col("id").alias("head"), F.col("head").alias("_head"), F.col("rank").alias("_rank"), F.col("done").alias("_done"))
        # what stands above no link is a head
        todo = now.where("NOT done").join(above, "head", "left")
        after = todo.select("id", F.coalesce("_head", "head").alias("head"), (F.col("rank") + F.coalesce("_rank", F.lit(0))).alias("rank"), F.coalesce("_done", F.lit(True)).alias("done"))
        before, now = now, materialise(now.where("done").unionByName(after), "ranks")
        discard(before)
    raise ValueError(f"chains did not end in {ROUNDS} rounds")


def ring_minima(links: DataFrame) -> DataFrame:
    """(id, least): of links (id, up) that make rings, the least id on each id's ring. After k rounds an id knows the least of 2^k; a round that changes none has met all."""
    now = materialise(links.select("id", "up", F.col("id").alias("least"), F.lit(True).alias("moved")), "rings")
    for _ in range(ROUNDS):
        if not now.where("moved").limit(1).count():
            return now.select("id", "least")
        above = now.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        lower = F.col("_least") < F.col("least")
        after = now.join(above, "up").select("id", F.col("_up").alias("up"), F.when(lower, F.col("_least")).otherwise(F.col("least")).alias("least"), lower.alias("moved"))
        before, now = now, materialise(after, "rings")
        discard(before)
    raise ValueError(f"rings did not close in {ROUNDS} rounds")
