"""Contours: marching squares as joins of neighbours, assembly and simplification of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .jumping import chain_ranks, ring_minima
from .tiles import TILE, tile_of

#: Fixed value: keeps levels off the heights themselves.
NUDGE = 0.0137
#: Sides that a segment joins, by the corners above the level (1 north-west, 2 north-east, 4 south-east, 8 south-west).
CASES = {1: ("LT",), 14: ("LT",), 2: ("TR",), 13: ("TR",), 3: ("LR",), 12: ("LR",), 4: ("RB",), 11: ("RB",), 6: ("TB",), 9: ("TB",), 7: ("LB",), 8: ("LB",)}


def quads(grid: DataFrame, value: str) -> DataFrame:
    """Each square of four cells with values, by its north-west cell: a, b, c, d clockwise."""
    along = Window.partitionBy("y").orderBy("x")
    down = Window.partitionBy("x").orderBy("y")
    wide = grid.select("y", "x", F.col(value).alias("a"), F.lead(value).over(along).alias("b"))
    return wide.withColumns({"d": F.lead("a").over(down), "c": F.lead("b").over(down)}).where("a + b + c + d IS NOT NULL")


def segments(grid: DataFrame, value: str, interval: float) -> DataFrame:
    """(level, y, x, side_a, side_b, ax, ay, bx, by): line segments in squares; sides T, R, B, L; positions in cells, the
    first cell's centre at 0.5. A level is raised by ``NUDGE`` for the cut alone, so that no value lies on it."""
    quad = quads(grid, value)
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    first, last = F.ceil((low - NUDGE) / interval), F.floor((high - NUDGE) / interval)
    at = quad.where(first <= last).withColumn("_k", F.explode(F.sequence(first, last))).withColumns({"level": F.col("_k") * interval, "_cut": F.col("_k") * interval + NUDGE})
    above = lambda c: F.col(c) > F.col("_cut")
    at = at.withColumn("_case", above("a").cast("int") + 2 * above("b").cast("int") + 4 * above("c").cast("int") + 8 * above("d").cast("int"))
    middle = (F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4 > F.col("_cut")
    pairs = lambda *names: F.array(*map(F.lit, names))
    # opposite corners above: the centre tells whether they are joined
    choice = F.when(F.col("_case") == 5, F.when(middle, pairs("TR", "LB")).otherwise(pairs("LT", "RB"))).when(F.col("_case") == 10, F.when(middle, pairs("LT", "RB")).otherwise(pairs("TR", "LB")))
    for case, sides in CASES.items():
        choice = choice.when(F.col("_case") == case, pairs(*sides))
    each = at.withColumn("_s", F.explode(choice)).withColumns({"side_a": F.substring("_s", 1, 1), "side_b": F.substring("_s", 2, 1)})
    cut = lambda p, q: (F.col("_cut") - F.col(p)) / (F.col(q) - F.col(p)) + 0.5

    def spot(side: str) -> tuple[Column, Column]:
        s = F.col(side)
        x = F.when(s == "T", F.col("x") + cut("a", "b")).when(s == "B", F.col("x") + cut("d", "c")).when(s == "L", F.col("x") + 0.5).otherwise(F.col("x") + 1.5)
        y = F.when(s == "L", F.col("y") + cut("a", "d")).when(s == "R", F.col("y") + cut("b", "c")).when(s == "T", F.col("y") + 0.5).otherwise(F.col("y") + 1.5)
        return x, y

    (ax, ay), (bx, by) = spot("side_a"), spot("side_b")
    return each.select("level", "y", "x", "side_a", "side_b", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def side_number(y: Column, x: Column, side: Column) -> Column:
    """One number for each side of a square: its upper or left side, or that of the square below or to the right."""
    below, right = (side == "B").cast("long"), (side == "R").cast("long")
    return (y + below) * (1 << 32) + (x + right) * 2 + side.isin("L", "R").cast("long")


def _partners(sides: np.ndarray) -> np.ndarray:
    """For each of the ends 0..2n-1 of n segments (a-ends, then b-ends) the other end at its side, -1 if there is none."""
    order = np.argsort(sides, kind="stable")
    same = sides[order][1:] == sides[order][:-1]
    out = np.full(len(sides), -1)
    out[order[1:][same]] = order[:-1][same]
    out[order[:-1][same]] = order[1:][same]
    return out


def _ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head and rank of each element of chains, given the element before (-1 at heads), by doubling."""
    head = np.where(before < 0, np.arange(len(before)), before)
    rank = (before >= 0).astype(int)
    for _ in range(len(before).bit_length()):
        rank, head = rank + rank[head], head[head]
    return head, rank


def _least_on_ring(after: np.ndarray) -> np.ndarray:
    """The least element of each ring, given the next element, by doubling; where there is no next one (-1) the least up to the end."""
    low, jump = np.arange(len(after)), np.where(after < 0, np.arange(len(after)), after)
    for _ in range(len(after).bit_length()):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    return low


def _pieces(sides: np.ndarray, places: np.ndarray) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(closed, sides, points) of the lines that n segments make; row i of both inputs is end i, a-ends first.

    An arc, a segment walked from one of its ends, bears that end's number. Each line is walked both ways: of an open one the way from the lesser side is taken, of a ring the one
    that holds its least arc, from there.
    """
    n = len(sides) // 2
    partner, other = _partners(sides), (np.arange(2 * n) + n) % (2 * n)
    after, before = partner[other], np.where(partner < 0, -1, other[partner])
    head, rank = _ranked(before)
    ring = before[head] >= 0
    cut = ring & (_least_on_ring(after) == np.arange(2 * n))
    if cut.any():
        head, rank = _ranked(np.where(cut, -1, before))
    order = np.lexsort((rank, head))
    starts = np.flatnonzero(np.r_[True, np.diff(head[order]) != 0])
    out = []
    for lo, hi in zip(starts, np.r_[starts[1:], 2 * n]):
        arcs = order[lo:hi]
        tip = other[arcs[-1]]
        closed = bool(ring[arcs[0]])
        if (arcs[0] < other[arcs].min()) if closed else sides[arcs[0]] < sides[tip]:
            walk = np.r_[arcs, tip]
            out.append((closed, sides[walk], places[walk]))
    return out


def _kept(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Which of a line's points Douglas-Peucker keeps, without recursion."""
    if len(p) < 3:
        return np.ones(len(p), bool)
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        along = p[b] - p[a]
        rel = p[a + 1 : b] - p[a]
        size = np.hypot(*along)
        off = np.abs(along[0] * rel[:, 1] - along[1] * rel[:, 0]) / size if size > 0 else np.hypot(rel[:, 0], rel[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """The points that Douglas-Peucker keeps."""
    p = np.array(points, float).reshape(-1, 2)
    return [tuple(map(float, q)) for q in p[_kept(p, tolerance)]]


def _thinned(lines: pa.Array, tolerance: float) -> pa.Array:
    """An array of lists of (x, y) with the points of each list that are kept; points stay in flat arrays, for a line may have millions."""
    ends = lines.offsets.to_numpy()
    x, y = (c.to_numpy() for c in lines.values.flatten())
    p = np.column_stack([x[ends[0] : ends[-1]], y[ends[0] : ends[-1]]])
    ends = ends - ends[0]
    keep = np.zeros(len(p), bool)
    for a, b in zip(ends, ends[1:]):
        keep[a:b] = _kept(p[a:b], tolerance)
    n = np.r_[0, np.cumsum(keep)][ends]
    kept = p[keep]
    return pa.ListArray.from_arrays(pa.array(n, pa.int32()), pa.StructArray.from_arrays([pa.array(kept[:, 0].copy()), pa.array(kept[:, 1].copy())], ["x", "y"]))


_POINTS = "array<struct<x:double,y:double>>"
_PIECES = f"level double, ty int, tx int, piece int, closed boolean, low long, first long, last long, pts {_POINTS}"


def contours(grid: DataFrame, value: str, interval: float, tolerance: float = 0.0, tile: int = TILE) -> DataFrame:
    """(level, line_id, closed, pts): lines of joined segments, named by the least number of the sides that they cross; a ring's first point is repeated at its end.

    Segments are joined tile by tile and level by level. What is open there is a piece, which may go on at its first or last side; pieces are ranked along
    their lines by pointer jumping, rings being cut at their least piece. Only a line itself comes together in one task, as one row.
    """
    found = segments(grid, value, interval)
    number = lambda side: side_number(F.col("y").cast("long"), F.col("x").cast("long"), F.col(side))
    found = found.select("level", tile_of("y", tile).alias("ty"), tile_of("x", tile).alias("tx"), number("side_a").alias("sa"), number("side_b").alias("sb"), "ax", "ay", "bx", "by")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sa", "sb"])
        places = np.concatenate([pdf[["ax", "ay"]].to_numpy(), pdf[["bx", "by"]].to_numpy()])
        lines = _pieces(np.concatenate([pdf["sa"].to_numpy(), pdf["sb"].to_numpy()]), places)
        rows = [(*key, i, closed, sides.min(), sides[0], sides[-1], [{"x": x, "y": y} for x, y in points]) for i, (closed, sides, points) in enumerate(lines)]
        return pd.DataFrame(rows, columns=["level", "ty", "tx", "piece", "closed", "low", "first", "last", "pts"])

    pieces = materialise(found.groupBy("level", "ty", "tx").applyInPandas(run, _PIECES), "pieces")
    rings = pieces.where("closed").select("level", F.col("low").alias("line_id"), "closed", "pts")
    part = F.struct("ty", "tx", "piece").alias("part")
    open_ = pieces.where("NOT closed").select("level", part, "low", "first", "last", "pts")
    # each piece is walked both ways: an arc starts at one of its ends
    way = F.explode(F.array(*(F.struct(F.lit(d).alias("way"), F.col(a).alias("from"), F.col(b).alias("to")) for d, a, b in ((0, "first", "last"), (1, "last", "first"))))).alias("_w")
    arcs = materialise(open_.select("level", "low", F.struct("level", F.col("part"), F.lit(0).alias("way")).alias("id"), "part", way).select("level", "low", F.struct("level", "part", "_w.way").alias("id"), "_w.from", "_w.to"), "arcs")
    # the arc before: it comes to where this one starts, and isn't this one walked back
    came = arcs.select("level", F.col("to").alias("from"), F.col("id").alias("up"))
    links = arcs.join(came, ["level", "from"]).where("up.part <> id.part").select("id", "up")
    links = materialise(links, "links")
    ranks = chain_ranks(links)
    heads = arcs.join(links, "id", "left_anti").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("rank"))
    ranks = heads.unionByName(ranks)
    # what is on no chain is on a ring: it is cut before its least arc, and ranked from there, one way
    round_ = links.join(ranks, "id", "left_anti")
    least = ring_minima(round_)
    forward = least.where("least.way = 0").select("id", "least")
    cut = round_.join(forward, "id").where("id <> least").select("id", "up")
    turned = chain_ranks(cut).unionByName(forward.where("id = least").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("rank")))
    ends = ranks.join(arcs, "id").groupBy("head").agg(F.max(F.struct("rank", "to")).alias("_e"), F.min(F.struct("rank", "from")).alias("_s")).where("_s.from < _e.to").select("head")
    taken = ranks.join(ends, "head", "left_semi").withColumn("closed", F.lit(False)).unionByName(turned.withColumn("closed", F.lit(True)))
    pts = F.when(F.col("id.way") == 1, F.reverse("pts")).otherwise(F.col("pts"))
    placed = taken.join(arcs.select("id", "low"), "id").join(open_.select("level", "part", "pts"), (F.col("id.level") == F.col("level")) & (F.col("id.part") == F.col("part")))
    parts = placed.select("level", "head", "closed", "low", F.struct("rank", pts.alias("pts")).alias("_p"))
    lines = parts.groupBy("level", "head", "closed").agg(F.min("low").alias("line_id"), F.array_sort(F.collect_list("_p")).alias("_p"))
    # a piece begins where the one before ends
    joined = F.concat(F.element_at("_p", 1)["pts"], F.flatten(F.transform(F.slice("_p", 2, F.size("_p")), lambda p: F.slice(p["pts"], 2, F.size(p["pts"])))))
    out = rings.unionByName(lines.select("level", "line_id", "closed", joined.alias("pts")))
    if not tolerance:
        return out

    def thin(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("level", "line_id", "closed")), _thinned(part.column("pts"), tolerance)], ["level", "line_id", "closed", "pts"])

    return out.select("level", "line_id", "closed", "pts").mapInArrow(thin, f"level double, line_id long, closed boolean, pts {_POINTS}")


def polyline_length(points: Column) -> Column:
    """Length of an array of structs with x and y."""
    nexts = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    legs = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), nexts, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))
    return F.aggregate(legs, F.lit(0.0), lambda s, d: s + d)


def smooth_line(points: DataFrame, half: int, key: str = "line_id") -> DataFrame:
    """Moving average along a line (seq, px, py); its ends stay."""
    w = Window.partitionBy(key).orderBy("seq")
    inside = F.lag("seq").over(w).isNotNull() & F.lead("seq").over(w).isNotNull()
    mean = lambda c: F.when(inside, F.avg(c).over(w.rowsBetween(-half, half))).otherwise(F.col(c))
    return points.withColumns({"px": mean("px"), "py": mean("py")})
