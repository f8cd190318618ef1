"""Summits with their prominence and key saddles, by a merge tree that is built tile by tile and joined four by four; saddles worth crossing."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from .tiles import TILE, tile_of

STEPS_8 = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
#: What surfacing cells bring with them: nothing, the border of the grid, or that their island has been at the border before.
PLAIN, BORDER, BEEN = range(3)


class _Island:
    """Cells that hang together above some height: the number and height of the top, a kept cell if other parts of the grid may add to it, and whether it has been at the border."""

    __slots__ = ("been", "height", "open", "top")

    def __init__(self, top: int, height: float):
        self.top, self.height, self.open, self.been = top, height, None, False


def _surface(heights: dict[int, float], near: Callable[[int], list[int]], marks: dict[int, int], rim: set[int], least: float) -> tuple[list[tuple], dict[int, int], list[tuple]]:
    """Cells surface from the highest, of equals the first; where islands meet, all but the one with the highest top end.

    ``near`` has the neighbours of a cell. Cells of ``rim`` have neighbours elsewhere: an island that holds one is open, and what becomes of it where it meets others isn't
    known here. Returns (top, height, prominence, saddle or -1) of the peaks that are known to end or to reach the border, and a smaller graph, kept cells with their
    marks and edges, in which open islands meet others at the same cells as here: it holds the rim, the places where open islands meet, and their tops.
    """
    parent: dict[int, int] = {}
    islands: dict[int, _Island] = {}
    kept: dict[int, int] = {}
    peaks, edges = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def keep(i: int, mark: int = PLAIN) -> None:
        kept[i] = max(kept.get(i, PLAIN), mark)

    def kept_cell(a: _Island) -> int:
        if a.open is None:
            keep(a.top, BEEN if a.been else PLAIN)
            a.open = a.top
        return a.open

    def learn(a: _Island, i: int, mark: int) -> None:
        """An open island comes to the border, or to one that has been there: cell i is kept to say so."""
        keep(i, mark)
        if a.open != i:
            edges.append((a.open, i))
            a.open = i

    def tell(a: _Island, at: int, saddle: int) -> None:
        if a.height - heights[at] >= least:
            peaks.append((a.top, a.height, a.height - heights[at], saddle))

    for i in sorted(heights, key=lambda i: (-heights[i], i)):
        met = sorted((islands[r] for r in {root(j) for j in near(i) if j in parent}), key=lambda a: (-a.height, a.top))
        if not met:
            here = islands[i] = _Island(i, heights[i])
            parent[i] = i
            if i in rim:
                keep(i)
                here.open = i
        else:
            here = met[0]
            parent[i] = here.top
            # islands whose lot isn't known: open ones, and the highest one here if it meets any of those or the rim
            loose = [a for a in met if a.open is not None]
            if (loose or i in rim) and here.open is None:
                loose.append(here)
            if len(loose) > 1 or i in rim:
                keep(i)
                edges += [(kept_cell(a), i) for a in loose]
                here.open = i
            been = any(a.been for a in loose)
            ended = [a for a in met if a not in loose]
            for a in met[1:]:
                if a in ended and not a.been:
                    tell(a, i, i)
                parent[a.top] = here.top
            if not been and any(a.been for a in ended) and here.open is not None:
                learn(here, i, BEEN)
            here.been = any(a.been for a in met)
        mark = marks.get(i, PLAIN)
        if mark != PLAIN and not here.been:
            here.been = True
            if here.open is not None:
                learn(here, i, mark)
            elif mark == BORDER:
                tell(here, i, -1)
    return peaks, kept, edges


_ROWS = "ty int, tx int, kind int, a long, b long, height double, rise double, mark int"
_PEAK, _CELL, _EDGE = range(3)


def _rows(at: tuple, heights: dict[int, float], found: tuple) -> pd.DataFrame:
    peaks, kept, edges = found
    rows = [(_PEAK, top, saddle, height, rise, 0) for top, height, rise, saddle in peaks]
    rows += [(_CELL, i, -1, heights[i], 0.0, mark) for i, mark in kept.items()]
    rows += [(_EDGE, i, j, 0.0, 0.0, 0) for i, j in edges]
    out = pd.DataFrame(rows, columns=["kind", "a", "b", "height", "rise", "mark"])
    out.insert(0, "tx", at[1])
    out.insert(0, "ty", at[0])
    return out


def summit_table(grid: DataFrame, least: float, top: int | None = 14, value: str = "z", tile: int = TILE) -> DataFrame:
    """(y, x, height, prominence, saddle_y, saddle_x, edge): the ``top`` peaks by prominence, or all of them, that rise ``least`` or more above their key saddle.

    Where islands meet, the one with the highest top goes on. An island that touches the border before it ends is an edge peak with the least prominence that
    the grid allows; its saddle is unknown (-1). Ties go to the first cell by row. Cells without a value are no ground.

    Each tile is surfaced on its own and leaves a graph about as large as its rim; four neighbours' graphs are surfaced together, and so on. A task holds
    the rims of four squares, and there are as many rounds as the tiles across can be halved.
    """
    schema = "y int, x int, height double, prominence double, saddle_y int, saddle_x int, edge boolean"
    grid = grid.where(F.col(value).isNotNull()).select("y", "x", F.col(value).cast("double").alias("z"))
    top_y, left, bottom, right = grid.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
    if top_y is None:
        return grid.sparkSession.createDataFrame([], schema)
    width = right + 1
    steps = [(dy, dx, dy * width + dx) for dy, dx in STEPS_8]

    def on_rim(y: int, x: int, at: tuple, side: int) -> bool:
        y0, x0 = at[0] * side, at[1] * side
        return (y == y0 and y > top_y) or (x == x0 and x > left) or (y == y0 + side - 1 and y < bottom) or (x == x0 + side - 1 and x < right)

    def first(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = list(zip(pdf["y"].tolist(), pdf["x"].tolist(), pdf["z"].tolist()))
        heights = {y * width + x: z for y, x, z in cells}
        marks = {y * width + x: BORDER for y, x, _ in cells if y in (top_y, bottom) or x in (left, right)}
        rim = {y * width + x for y, x, _ in cells if on_rim(y, x, at, tile)}

        def near(i: int) -> list[int]:
            x = i % width
            return [i + step for _, dx, step in steps if 0 <= x + dx < width]

        return _rows(at, heights, _surface(heights, near, marks, rim, least))

    def joined(side: int) -> Callable:
        def run(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            cells, pairs = pdf[pdf["kind"] == _CELL], pdf[pdf["kind"] == _EDGE]
            heights, marks = dict(zip(cells["a"].tolist(), cells["height"].tolist())), dict(zip(cells["a"].tolist(), cells["mark"].tolist()))
            beside: dict[int, list[int]] = {i: [] for i in heights}
            for i, j in zip(pairs["a"].tolist(), pairs["b"].tolist()):
                beside[i].append(j)
                beside[j].append(i)
            for i in heights:
                y, x = divmod(i, width)
                for dy, dx, step in steps:
                    if 0 <= x + dx < width and i + step in heights and ((y + dy) // side, (x + dx) // side) != (y // side, x // side):
                        beside[i].append(i + step)
            rim = {i for i in heights if on_rim(*divmod(i, width), at, 2 * side)}
            return _rows(at, heights, _surface(heights, beside.__getitem__, marks, rim, least))

        return run

    step = materialise(grid.withColumns({"ty": tile_of("y", tile), "tx": tile_of("x", tile)}).groupBy("ty", "tx").applyInPandas(first, _ROWS), "peaks")
    levels, side = [step], tile
    while top_y // side != bottom // side or left // side != right // side:
        half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
        up = step.where(F.col("kind") != _PEAK).select(half("ty"), half("tx"), "kind", "a", "b", "height", "mark")
        step = materialise(up.groupBy("ty", "tx").applyInPandas(joined(side), _ROWS), "peaks")
        levels.append(step)
        side *= 2
    found = levels[0].where(F.col("kind") == _PEAK)
    for level in levels[1:]:
        found = found.unionByName(level.where(F.col("kind") == _PEAK))
    place = lambda c, name: F.when(F.col(c) < 0, -1).otherwise(F.col(c) % width if name[-1] == "x" else F.floor(F.col(c) / width)).cast("int").alias(name)
    out = materialise(found.select(place("a", "y"), place("a", "x"), "height", F.col("rise").alias("prominence"), place("b", "saddle_y"), place("b", "saddle_x"), (F.col("b") < 0).alias("edge")), "summits")
    discard(*levels)
    return out.orderBy(F.desc("prominence"), "y", "x").limit(top) if top else out


def saddle_axis(points: DataFrame, grid: DataFrame, width: int, height: int, radius: float, value: str = "z", key: str = "id") -> DataFrame:
    """key, angle, drop_a, drop_b: of 36 directions that whose higher opposite end is lowest, the first of equals; ``radius`` in cells."""
    from .raster import sample_bilinear

    ends = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(s * radius * math.sin(math.radians(5 * k))).alias("dx"), F.lit(-s * radius * math.cos(math.radians(5 * k))).alias("dy")) for k in range(36) for s in (1, -1)))
    each = points.select(key, F.col("x").alias("_x0"), F.col("y").alias("_y0"), F.explode(ends).alias("_e"))
    ring = each.select(key, F.concat_ws("/", F.col(key).cast("string"), F.col("_e.k").cast("string"), F.col("_e.s").cast("string")).alias("_id"), F.col("_e.k").alias("_k"), F.col("_e.s").alias("_s"), (F.col("_x0") + F.col("_e.dx")).alias("px"), (F.col("_y0") + F.col("_e.dy")).alias("py"))
    ring = sample_bilinear(ring, grid, value, width, height, "_id", out="_h")
    both = ring.groupBy(key, "_k").agg(F.max(F.when(F.col("_s") == 1, F.col("_h"))).alias("_a"), F.max(F.when(F.col("_s") == -1, F.col("_h"))).alias("_b"))
    best = both.groupBy(key).agg(F.min(F.struct(F.round(F.greatest("_a", "_b"), 9).alias("score"), F.col("_k").alias("k"), F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_best"))
    here = grid.select("y", "x", F.col(value).cast("double").alias("_z"))
    return points.select(key, "y", "x").join(best, key).join(here, ["y", "x"]).select(key, (F.col("_best.k") * 5).alias("angle"), (F.col("_z") - F.col("_best.a")).alias("drop_a"), (F.col("_z") - F.col("_best.b")).alias("drop_b"))


def chosen_saddles(peaks: DataFrame, grid: DataFrame, cell: float, here: tuple[float, float], box: tuple[int, int, int, int] | None = None, apart_m: float = 400.0, top: int = 14, open_col: str = "open") -> DataFrame:
    """number, saddle_y, saddle_x, depth, away_m, open: key saddles of peaks that don't touch the edge, in order of prominence, each ``apart_m`` or more from all
    chosen before, ``top`` of them, numbered outwards from ``here`` (y, x).

    ``box`` is (top, left, bottom, right), the last two not included. ``open`` says what the grid has there. One is chosen at a time, by an aggregate over those that are far enough from all
    chosen, so the driver holds no more than the ``top``.
    """
    left = peaks.where("NOT edge").select("saddle_y", "saddle_x", F.col("prominence").alias("depth"), "y", "x")
    if box is not None:
        left = left.where(F.col("saddle_y").between(box[0], box[2] - 1) & F.col("saddle_x").between(box[1], box[3] - 1))
    left = materialise(left, "saddles")
    kept = []
    while len(kept) < top:
        nearer = F.lit(False)
        for k in kept:
            dy, dx = ((F.col(c) - k[c]).cast("double") for c in ("saddle_y", "saddle_x"))  # squares of whole numbers overflow
            nearer = nearer | (F.sqrt(dy * dy + dx * dx) * cell < apart_m)
        best = left.where(~nearer).orderBy(F.desc("depth"), "y", "x").limit(1).collect()
        if not best:
            break
        kept += best
    away = lambda r: math.hypot(r["saddle_y"] - here[0], r["saddle_x"] - here[1]) * cell
    rows = [(n, r["saddle_y"], r["saddle_x"], r["depth"], away(r)) for n, r in enumerate(sorted(kept, key=lambda r: (away(r), r["saddle_y"], r["saddle_x"])), 1)]
    chosen = peaks.sparkSession.createDataFrame(rows, "number int, saddle_y int, saddle_x int, depth double, away_m double")
    cells = grid.select(F.col("y").alias("saddle_y"), F.col("x").alias("saddle_x"), open_col)
    return cells.join(F.broadcast(chosen), ["saddle_y", "saddle_x"]).select("number", "saddle_y", "saddle_x", "depth", "away_m", open_col)
