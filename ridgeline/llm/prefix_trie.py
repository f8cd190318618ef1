"""The trie of conversation prefixes by smallest-member ownership.

Each distinct sequence of first d turns is a node of depth d; a node is owned by the smallest conversation that starts with it. What a conversation owns is a
suffix of its path, since a smallest member stays smallest where fewer follow. So (owner, depth) names a node, a conversation enters its own
part at one depth, and sums over a subtree are sums over the members of its top:

* tokens saved below a node: of each member, the tokens of turns from the node on to where its own part begins;
* leaves below a node: the members that own their last node where nobody goes on.

Plan. Prefixes are known by two 64-bit hashes, running exclusive ors of hashes of (depth, role, text): these can be
taken block by block, so a conversation with a third of all turns is many tasks, and only the sums of its blocks meet. Nodes are grouped by
prefix with partial sums, so the root and a hot first turn are a few rows a task. Where windows would gather a hot node's members or a long conversation, a
group-by marks the owned part instead. The ids of ends are joined in chunks of bounded size, which are then streamed into one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .turns import numbered

#: Ids that stand in one chunk of ends at most.
CHUNK = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ("depth", "x1", "x2")


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, blk, pos, n_rows, role, text: turns by number, null first, ties by role and text; rows without an id are no conversation's."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", empty("role"), empty("text"))
    return numbered(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("role").asc(), F.col("text").asc()]).drop("turn")


def with_shared_heads(turns: DataFrame, family: int, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``head`` turns (of a Column of conv_id) are exchanged for those of the first of their ``family``.

    Returns ids (conv_id) and turns (conv_id, blk, depth, role, text). ``head`` is small: a family's first turns go to each of its members.
    """
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_own")).withColumns({"_head": head, "_base": F.col("conv_id") - F.col("conv_id") % family})
    bases = ids.where("conv_id = _base").select("_base", F.col("_own").alias("_there"))
    ids = ids.join(bases, "_base", "left").select("conv_id", "_base", "_head", F.least("_head", F.coalesce("_there", F.lit(0))).alias("_got"))
    first = turns.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("_base"), "pos", "role", "text")
    most = ids.agg(F.max("_head")).first()[0] or 0
    heads = ids.join(first.where(F.col("pos") <= most), "_base").where("pos <= _head").select("conv_id", F.lit(-1).cast("long").alias("blk"), F.col("pos").alias("depth"), "role", "text")
    own = turns.join(ids, "conv_id").where("pos > _head").select("conv_id", "blk", (F.col("pos") - F.col("_head") + F.col("_got")).alias("depth"), "role", "text")
    return ids.select("conv_id"), heads.unionByName(own)


def occurrences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, x1, x2 (the prefix), y1, y2 (the prefix without its last turn), before (tokens of earlier turns), n_turns and tokens of the conversation.

    A row for each turn, and one of depth 0 for each conversation.
    """
    size = F.char_length("text").cast("long")
    hashed = [F.xxhash64(F.lit(seed), "depth", "role", "text").alias(f"k{seed}") for seed in (1, 2)]
    root = ids.select("conv_id", F.lit(-2).cast("long").alias("blk"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "size")))
    keyed = turns.select("conv_id", "blk", F.col("depth").cast("long").alias("depth"), *hashed, size.alias("size")).unionByName(root)
    sums = [F.bit_xor("k1"), F.bit_xor("k2"), F.sum("size")]
    blocks = keyed.groupBy("conv_id", "blk").agg(sums[0].alias("k1"), sums[1].alias("k2"), sums[2].alias("size"), F.count(F.when(F.col("depth") > 0, 1)).alias("_n"))
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    offsets = blocks.select("conv_id", "blk", *(none(s.over(earlier)).alias(c) for s, c in zip(sums, ("_x1", "_x2", "_before"))), F.sum("_n").over(whole).alias("n_turns"), F.sum("size").over(whole).alias("tokens"))
    inside = Window.partitionBy("conv_id", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    each = keyed.withColumns({f"_in{i}": s.over(inside) for i, s in enumerate(sums)}).join(offsets, ["conv_id", "blk"])
    x1, x2 = F.col("_x1").bitwiseXOR(F.col("_in0")), F.col("_x2").bitwiseXOR(F.col("_in1"))
    return each.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("k1")).alias("y1"), x2.bitwiseXOR(F.col("k2")).alias("y2"), (F.col("_before") + F.col("_in2") - F.col("size")).alias("before"), "n_turns", "tokens")


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined parts of each node, whose chunks follow one another."""
    node, state = None, None
    for batch in batches:
        done = []
        for *at, part in zip(*(c.to_pylist() for c in batch.columns)):
            if at == node:
                state.update(b"," + part.encode())
                continue
            if node:
                done.append((*node, state.hexdigest()))
            node, state = at, hashlib.sha256(part.encode())
        yield _rows(done)
    if node:
        yield _rows([(*node, state.hexdigest())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of ends (depth, x1, x2, conv_id), the ids ascending. A digest is sequential: a node's chunks pass one task, a batch at a time."""
    chunks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / CHUNK).alias("_chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "_chunk").select(*NODE, "_ids")
    return ordered.mapInArrow(_joined_digests, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` (conv_id) are all conversations, those without turns too; ``turns`` has conv_id, blk, depth (1, 2, ... for each conversation, blocks in that order), role, text.
    A token is a code point of the text. Null roles and texts have to be filled in.
    """
    at = materialise(occurrences(ids, turns), "occurrences")
    nodes = materialise(at.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("y1", "y2", "before"))), "nodes")
    # where each owner's own part begins, and whose node it hangs from
    entries = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "y1", "y2", "before")).alias("_e")).select("conv_id", F.col("_e.depth").alias("_own"), F.col("_e.y1").alias("x1"), F.col("_e.y2").alias("x2"), (F.col("_e.depth") - 1).alias("depth"), F.col("_e.before").alias("_shared"))
    parents = nodes.select(*NODE, F.col("conv_id").alias("_parent"))
    entries = materialise(entries.join(parents, [*NODE], "left").select("conv_id", "_own", "_shared", "_parent"), "entries")
    branches = entries.where("_parent IS NOT NULL").groupBy(F.col("_parent").alias("conv_id"), (F.col("_own") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("_branches"))
    members = at.where("depth = 0").select("conv_id", F.col("n_turns").alias("depth"), "tokens").join(entries, "conv_id", "left").join(branches, ["conv_id", "depth"], "left")
    members = members.select("conv_id", "_own", "_parent", F.coalesce("_shared", "tokens").alias("_shared"), (F.col("_own").isNotNull() & F.col("_branches").isNull()).cast("long").alias("_leaf"))
    joined = at.join(members, "conv_id")
    owner = F.min(F.struct("conv_id", "_own", "_parent", "n_turns")).alias("_o")
    grouped = joined.groupBy(*NODE).agg(owner, F.count(F.lit(1)).alias("n_convs"), F.sum(F.greatest(F.col("_shared") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.sum("_leaf").alias("n_leaves"))
    digests = end_digests(at.where("depth = n_turns").select(*NODE, "conv_id"))
    named = grouped.join(digests, [*NODE], "left").select(F.col("_o.conv_id").alias("conv_id"), "depth", "_o", "n_convs", "saved_tokens", "n_leaves", "ends_sha256").join(branches, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > F.col("_o._own"), F.col("conv_id")).otherwise(F.col("_o._parent"))
    children = F.coalesce("_branches", F.lit(0)) + (F.col("depth") < F.col("_o.n_turns")).cast("long")
    out = named.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    discard(nodes)
    return out
