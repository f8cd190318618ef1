"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in the order of a hash of their ids, are cut into blocks of ``block_rows``. With target weights that
sum to one, block j = 1, 2, ... of a source of weight w is released at floor((j - 1) / w) and due at ceil(j / w); in each slot the released
block that is due first runs (earliest deadline first; ties by the exact deadline, then by the source's name). So after t slots each source has run
more than w t - 1 and fewer than w t + 1 blocks: the mixture is off by less than one block at any time. When a source has
run out, the remaining ones share its weight in proportion, and scheduling starts anew from there, with the same bound for each such
phase. Every document is placed; nothing is repeated or dropped.

What grows with the data stays distributed. The driver sees the number of rows of each source and nothing else. Ranks within a source come from
counts of (source, bucket) cells, buckets being ranges of the hash that hold about ``cell_rows`` rows, so a source with a
third of all rows is spread over its buckets. The schedule is computed in one task that streams one row per block, in memory
that grows with the number of sources only.

Defined results: a null source is a source of its own; sources without a target weight get the default weight, the square root of their
number of rows; weights of zero or less are an error; rows of equal ids are ranked by a hash of all columns; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
CELL_ROWS = 4096
#: Hash space of the order within a source.
SPACE_BITS = 62
NULL_SOURCE = "\x00null"


def as_fractions(weights: dict[str, float]) -> dict[str, Fraction]:
    """Weights that sum to exactly one, so that releases and deadlines are exact."""
    whole = {s: Fraction(w).limit_denominator(1_000_000) for s, w in weights.items()}
    if any(w <= 0 for w in whole.values()):
        raise ValueError("target weights have to be positive")
    total = sum(whole.values())
    return {s: w / total for s, w in whole.items()}


def phase(blocks: dict[str, int], done: dict[str, int], weights: dict[str, Fraction]) -> Iterator[str]:
    """Earliest deadline first among released blocks, until one of the sources has run out."""
    wait: list[tuple[int, Fraction, str, int]] = [(0, 1 / w, s, 1) for s, w in weights.items()]
    heapq.heapify(wait)  # by release
    ready: list[tuple[int, Fraction, str, int]] = []  # by deadline
    slot = 0
    while True:
        while wait and wait[0][0] <= slot:
            _, due, s, j = heapq.heappop(wait)
            heapq.heappush(ready, (math.ceil(due), due, s, j))
        _, _, s, j = heapq.heappop(ready)  # full utilisation: some block is always released
        yield s
        slot += 1
        if done[s] + j == blocks[s]:
            return
        w = weights[s]
        heapq.heappush(wait, (math.floor(j / w), (j + 1) / w, s, j + 1))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, block from 0, phase from 0) in the order of the slots, until every block has run."""
    blocks = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(blocks, 0)
    live, number = set(blocks), 0
    while live:
        share = as_fractions({s: weights[s] for s in sorted(live)})
        ran = dict.fromkeys(live, 0)
        for s in phase(blocks, done, share):
            yield s, done[s] + ran[s], number
            ran[s] += 1
        for s, n in ran.items():
            done[s] += n
        live = {s for s in live if done[s] < blocks[s]}
        number += 1


def default_weights(sizes: dict[str, int]) -> dict[str, float]:
    return {s: math.sqrt(n) for s, n in sizes.items()}


def positions(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", carry: bool = False) -> DataFrame:
    """id, source, source_rank, block, slot, phase and mix_position (from 0) of every row; with ``carry`` also the row as struct _row."""
    spark = docs.sparkSession
    row = F.struct("*")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_name"), F.coalesce(F.col(source_col), F.lit(NULL_SOURCE)).alias("_source"),
        F.shiftrightunsigned(F.xxhash64(F.lit("mix"), id_col), 64 - SPACE_BITS).alias("_hash"), F.xxhash64(F.lit("tie"), row).alias("_tie"), *([row.alias("_row")] if carry else []),
    )
    sizes = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    aim = {s: (weights or {}).get(None if s == NULL_SOURCE else s, d) for s, d in default_weights(sizes).items()}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}

    # one cell is a range of the hash that holds about CELL_ROWS rows of all sources
    bits = max(0, math.ceil(math.log2(max(1, total / CELL_ROWS))))
    rows = rows.withColumn("_cell", F.shiftright("_hash", SPACE_BITS - bits) if bits else F.lit(0).cast("long"))
    # running sums over cells in two steps, so that no task meets all cells of a source
    cells = rows.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_super", F.shiftright("_cell", bits // 2))
    supers = cells.groupBy("_source", "_super").agg(F.sum("_n").alias("_m"))
    before = supers.select("_source", "_super", (F.sum("_m").over(Window.partitionBy("_source").orderBy("_super")) - F.col("_m")).alias("_base"))
    inside = cells.withColumn("_in", F.sum("_n").over(Window.partitionBy("_source", "_super").orderBy("_cell")) - F.col("_n"))
    offset = (F.col("_base") + F.col("_in")).cast("long")
    block_of = lambda rank: F.floor(rank / block_rows).cast("long")
    parts = inside.join(before, ["_source", "_super"]).select("_source", "_cell", offset.alias("_offset"), F.explode(F.sequence(block_of(offset), block_of(offset + F.col("_n") - 1))).alias("_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, part = 0, []
            for at, (s, b, p) in enumerate(schedule(blocks, aim)):
                part.append((s, b, at, p, first))
                first += min(block_rows, sizes[s] - b * block_rows)
                if len(part) == 8192:
                    yield _packed(part)
                    part = []
            if part:
                yield _packed(part)

    slots = spark.range(0, 1, 1, 1).mapInArrow(run, "_source string, _block long, _slot long, _phase int, _first long")
    # a cell meets few blocks, about CELL_ROWS / block_rows: they ride along with the cell
    info = parts.join(slots, ["_source", "_block"]).groupBy("_source", "_cell").agg(
        F.min("_offset").alias("_offset"), F.min("_block").alias("_least"), F.sort_array(F.collect_list(F.struct("_block", "_slot", "_phase", "_first"))).alias("_slots"),
    )
    local = F.row_number().over(Window.partitionBy("_source", "_cell").orderBy("_hash", "_tie", "_id")) - 1
    ranked = rows.withColumn("_local", local).join(info, ["_source", "_cell"]).withColumn("_rank", (F.col("_offset") + F.col("_local")).cast("long"))
    ranked = ranked.withColumn("_block", block_of(F.col("_rank"))).withColumn("_at", F.element_at("_slots", (F.col("_block") - F.col("_least") + 1).cast("int")))
    place = (F.col("_at._first") + F.col("_rank") - F.col("_block") * block_rows).cast("long")
    return ranked.select(
        F.col("_id").alias(id_col), F.col("_name").alias(source_col), F.col("_rank").alias("source_rank"), F.col("_block").alias("block"),
        F.col("_at._slot").alias("slot"), F.col("_at._phase").alias("phase"), place.alias("mix_position"), *(["_row"] if carry else []),
    )


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source", position_col: str | None = None) -> DataFrame:
    """The rows themselves, with the columns they came with, range-partitioned and sorted by their place in the mixture.

    Files that are read again come in no order: what has to outlive them is ``position_col``, which holds the place where it is named; a column
    of that name that the rows came with gives way to it.
    """
    placed = positions(docs, weights, block_rows, id_col, source_col, carry=True).select("mix_position", "_row")
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if position_col is None or c.lower() != position_col.lower()]
    return in_order(placed, "mix_position").select(*own, *([F.col("mix_position").alias(position_col)] if position_col else []))


def in_order(rows: DataFrame, position_col: str) -> DataFrame:
    """Rows range-partitioned and sorted by a position."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(width, position_col).sortWithinPartitions(position_col)


def _packed(part: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*part))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_source", "_block", "slot", "phase", "_first"])
