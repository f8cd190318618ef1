"""Repair of conversation structure: Dijkstra over the lattice of turns and grammar states.

Roles have to read ``(s?(ua)+)?`` by their initials. A node is (turns taken, state); edits keep, rerole or delete the next turn or insert an empty one. The
queue is ordered by (cost, audit), the audit being the initials of the edits so far; the first accepting node at the end that is popped is the answer.

Long conversations. The lattice is a chain, so the cheapest ways through a block of turns, from each state to each, are all that the rest needs to
know. A conversation of up to ``BLOCK`` turns is one search. A longer one is cut into blocks; each is searched from all four states, costs
and orders of audits (a few numbers a block) are folded along the conversation, and the blocks are then repaired from the states that the fold chose. Inserts at the end
of a block count to the next one. So different audits for the same turns never begin one another, and the order of two is that of their first blocks that differ.
Texts pass the digest a block at a time.

Defined results: a null conv_id is a conversation of its own; null roles and texts, and nulls in the key of the damage, are one space; repeated rows are turns of
their own, ties of turn go by role and text; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .turns import numbered, runs

BLOCK = 2048
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
FINE, BLANK, DUPLICATE, CUT = range(4)
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may always follow, and the state after it.
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
ACCEPTING = (0, 3)
LEGAL = frozenset(("su", "ua", "au"))
SPACES = " \t\n\x0b\x0c\r"
BLANK_DIGEST = hashlib.sha256(b"").hexdigest()


def cheapest(turns: list[tuple[str, int]], start: int, last: bool) -> dict[int, tuple[int, str]]:
    """The cheapest (cost, audit) from a state through turns (initial, fault).

    Of the last turns, the one accepting end reached first; otherwise all ends, none of them by an insert at the end.
    """
    n, found, done = len(turns), {}, set()
    heap = [(0, "", 0, start)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if last and state in ACCEPTING:
                return {state: (cost, audit)}
            if not last:
                found[state] = (cost, audit)
                continue
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state][1]))
        if i == n:
            continue
        initial, fault = turns[i]
        heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
        if fault in (FINE, CUT):
            more = TRUNCATED if fault == CUT else 0
            heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, NEXT[state][1]))
            if initial in KEEPS[state]:
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, KEEPS[state][initial]))
    return found


def applied(audit: str, state: int, turns: list[tuple[str, str]]) -> list[str]:
    """Lines role:text of turns (role, text) after the edits."""
    out, rest = [], iter(turns)
    for edit in audit:
        role, after = NEXT[state]
        if edit == "I":
            out.append(f"{role}:")
            state = after
            continue
        given, text = next(rest)
        if edit == "D":
            continue
        if edit == "K":
            role, after = given, KEEPS[state][given[:1]]
        out.append(f"{role}:{text}")
        state = after
    return out


def illegal_steps(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _batch(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names.split())


_REPAIRED = "_key string, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of one block: rows (_key, role, text, fault) in order."""

    def batch(rows):
        return _batch(rows, "_key illegal cost audit repaired_sha256", [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    done = []
    for (key,), rows in runs(batches, 1):
        turns = [(role[:1], fault) for role, _, fault in rows]
        ((cost, audit),) = cheapest(turns, 0, True).values()
        text = "\n".join(applied(audit, 0, [r[:2] for r in rows]))
        done.append((key, illegal_steps([t[0] for t in turns]), cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        if len(done) >= 1000:
            yield batch(done)
            done = []
    yield batch(done)


_SEARCHED = "_key string, _block long, ends string, illegal long, costs array<long>, ranks array<int>"
_FAR = 1 << 60


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of long conversations: costs from each state to each, and the order of the audits from one state. Rows (_key, _block, _last, initial, fault)."""
    for (key, block, last), rows in runs(batches, 3):
        costs, ranks = [], []
        for start in range(4):
            found = cheapest(rows, start, last)
            order = sorted(found, key=lambda t: found[t][1])
            costs += [found[t][0] if t in found else _FAR for t in range(4)]
            ranks += [order.index(t) if t in found else 4 for t in range(4)]
        initials = [r[0] for r in rows]
        ends = (initials[0] or " ") + (initials[-1] or " ")
        yield _batch([(key, block, ends, illegal_steps(initials), costs, ranks)], "_key _block ends illegal costs ranks", [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32())])


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """Start and end states of a conversation's blocks on its cheapest way, its cost and illegal steps; a few numbers a block."""
    pdf = pdf.sort_values("_block")
    here, back = {0: (0, 0)}, []  # state: (cost, rank of its audit among the states)
    illegal, before = 0, ""
    for ends, inner, costs, ranks in zip(pdf["ends"], pdf["illegal"], pdf["costs"], pdf["ranks"]):
        illegal += int(inner) + bool(before and before + ends[0] not in LEGAL)
        before = ends[1]
        ways = {t: min((c + costs[4 * s + t], r, s) for s, (c, r) in here.items()) for t in range(4)}
        ways = {t: w for t, w in ways.items() if w[0] < _FAR}
        order = sorted(ways, key=lambda t: (ways[t][1], ranks[4 * ways[t][2] + t]))
        back.append({t: w[2] for t, w in ways.items()})
        here = {t: (ways[t][0], k) for k, t in enumerate(order)}
    end = min((t for t in here if t in ACCEPTING), key=lambda t: here[t])
    cost, states = here[end][0], [end]
    for step in reversed(back):
        states.append(step[states[-1]])
    states.reverse()
    return pd.DataFrame({"_key": pdf["_key"].to_numpy(), "_block": pdf["_block"].to_numpy(), "_from": states[:-1], "_to": states[1:], "cost": int(cost), "illegal": illegal})


_FOLDED = "_key string, _block long, _from int, _to int, cost long, illegal long"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and lines of blocks whose states are known. Rows (_key, _block, _last, _from, _to, cost, illegal, role, text, fault)."""
    for (key, block, last, start, end, cost, illegal), rows in runs(batches, 7):
        audit = cheapest([(r[0][:1], r[2]) for r in rows], start, last)[end][1]
        lines = applied(audit, start, [r[:2] for r in rows])
        yield _batch([(key, block, illegal, cost, audit, "\n".join(lines) if lines else None)], "_key _block illegal cost audit lines", [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its repaired blocks in order; texts are held a batch at a time."""

    def row():
        return _batch([(key[0], key[1], key[2], "".join(audits), state.hexdigest())], "_key illegal cost audit repaired_sha256", [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])

    key, state, audits, begun = None, hashlib.sha256(), [], False
    for batch in batches:
        for *now, audit, lines in zip(*(c.to_pylist() for c in batch.columns)):
            if now != key:
                if key:
                    yield row()
                key, state, audits, begun = now, hashlib.sha256(), [], False
            audits.append(audit)
            if lines is not None:
                state.update((("\n" if begun else "") + lines).encode())
                begun = True
    if key:
        yield row()


def faults(turns: DataFrame) -> DataFrame:
    """Adds fault to rows (_key, pos, role, text): blank, duplicate of an earlier one, or truncated, whichever comes first."""
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    digests = [F.xxhash64(F.lit(seed), "role", "text").alias(f"_h{seed}") for seed in (1, 2)]
    turns = turns.withColumn("_end", end).select("*", *digests)
    again = turns.groupBy("_key", "_h1", "_h2").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = turns.join(again, ["_key", "_h1", "_h2"], "left")
    fault = F.when(F.col("_end") == "", BLANK).when(F.col("pos") > F.col("_first"), DUPLICATE).when(~F.col("_end").isin(".", "!", "?"), CUT).otherwise(FINE)
    return met.withColumn("fault", fault).drop("_end", "_h1", "_h2", "_first")


def repaired(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """_key, illegal, cost, audit, repaired_sha256 of rows (_key, pos, n_rows, role, text, fault), pos from 1 to n_rows."""
    short = turns.where(F.col("n_rows") <= block).repartition("_key").sortWithinPartitions("_key", "pos").select("_key", "role", "text", "fault")
    place = F.floor((F.col("pos") - 1) / block)
    long = turns.where(F.col("n_rows") > block).withColumns({"_block": place, "_last": place == F.floor((F.col("n_rows") - 1) / block)})
    at = ("_key", "_block")
    searched = long.select(*at, "_last", F.substring("role", 1, 1).alias("_initial"), "fault", "pos").repartition(*at).sortWithinPartitions(*at, "pos").drop("pos").mapInArrow(_searched, _SEARCHED)
    chosen = searched.groupBy("_key").applyInPandas(_folded, _FOLDED)
    met = long.join(chosen, list(at)).select(*at, "_last", "_from", "_to", "cost", "illegal", "role", "text", "fault", "pos")
    lines = met.repartition(*at).sortWithinPartitions(*at, "pos").drop("pos").mapInArrow(_repaired, "_key string, _block long, illegal long, cost long, audit string, lines string")
    joined = lines.repartition("_key").sortWithinPartitions(*at).select("_key", "illegal", "cost", "audit", "lines").mapInArrow(_digested, _REPAIRED)
    return short.mapInArrow(_whole, _REPAIRED).unionByName(joined)


def structure_repair(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of turns (conv_id, turn, role, text), no role or text null."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("_key")
    order = [F.asc_nulls_first("turn"), F.col("role").asc(), F.col("text").asc()]
    placed = materialise(faults(numbered(turns.select(key, "turn", "role", "text"), "_key", order)), "faults")
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count_distinct("turn")
    gaps = F.when(wide.isNotNull(), F.least(wide, F.lit((1 << 63) - 1))).cast("long").alias("gaps")
    count = lambda fault, name: F.count(F.when(F.col("fault") == fault, 1)).alias(name)
    sums = placed.groupBy("_key").agg(gaps, count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(CUT, "truncated"))
    out = ids.select("conv_id").distinct().withColumn("_key", key)
    for part in (sums, repaired(placed, block)):
        out = out.join(part, "_key", "left")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(BLANK_DIGEST)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged by crc32 of conv_id:turn modulo 20: 0 the row goes, 1 no text, 2 no marks of an end, 3 twice, 4 role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")
