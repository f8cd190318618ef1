"""Water over a height grid: levels, ways, areas upstream and streams, by tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise
from .jumping import chain_ranks, subtree_sums
from .tiles import about, long_tile, pack, plane, settle, sides, tile_of, with_cells

STEPS_8 = tuple((dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)


#: Cells of a tile, and how far beyond it the ground is flooded with it: ways that wind to and fro across a border within that are found in one round.
CELLS = 1 << 18
OVERLAP = 64


def flooded(z: np.ndarray, known: np.ndarray, lift: float) -> np.ndarray:
    """Water levels of a padded tile: from cells whose level is known (finite), each cell is filled to just above the lowest that reaches it; NaN cells are no ground.

    Cells whose level fell and lies within a span of the lowest are gone on from at once, until no level falls; the least are the same as one by one.
    """
    side = z.shape[1]
    ground, level = z.ravel(), known.ravel().copy()
    ring = np.ones(z.shape, bool)
    ring[1:-1, 1:-1] = False
    free = ~(np.isfinite(level) | np.isnan(ground) | ring.ravel())
    steps = np.array([dy * side + dx for dy, dx in STEPS_8])
    held = ground[~np.isnan(ground)]
    span = float(held.max() - held.min()) / 32 if len(held) else 0.0
    todo, waits = np.flatnonzero(np.isfinite(level)), np.zeros(level.size, bool)
    waits[todo] = True
    while len(todo):
        due = level[todo] <= level[todo].min() + span
        now, todo = todo[due], todo[~due]
        waits[now] = False
        cells = (now[:, None] + steps).ravel()
        water = np.repeat(level[now] + lift, len(steps))
        on = (cells >= 0) & (cells < level.size)  # cells of the ring aren't free, so no step runs over a side
        cells, water = cells[on], water[on]
        on = free[cells]
        cells, water = cells[on], water[on]
        water = np.maximum(ground[cells], water)
        on = water < level[cells]
        cells = cells[on]
        np.minimum.at(level, cells, water[on])
        fell = np.unique(cells[~waits[cells]])
        waits[fell] = True
        todo = np.concatenate([todo, fell])
    return level.reshape(z.shape)


@dataclass(frozen=True)
class _Frame:
    """Where a grid ends, and how its cells are numbered."""

    top: int
    left: int
    bottom: int
    right: int
    rows: int
    columns: int

    @property
    def width(self) -> int:
        return self.right + 1

    @property
    def ends(self) -> tuple[int, int, int, int]:
        return self.top, self.left, self.bottom, self.right

    @property
    def halo(self) -> int:
        return min(OVERLAP, self.rows, self.columns)

    def near(self, padded: np.ndarray) -> np.ndarray:
        """The tile and the cells next to it, of an array that reaches as far as the overlap."""
        cut = self.halo - 1
        return padded[cut : padded.shape[0] - cut, cut : padded.shape[1] - cut]

    def levels(self, ty: int, tx: int, z: np.ndarray, ring: pd.DataFrame) -> np.ndarray:
        """What is known of a padded tile: the levels of its outermost cells, and the heights of cells at the grid's border."""
        out = np.full(z.shape, np.inf)
        y0, x0 = ty * self.rows - self.halo, tx * self.columns - self.halo
        y, x, v = ring["y"].to_numpy(int) - y0, ring["x"].to_numpy(int) - x0, ring["v"].to_numpy(float)
        on = (y == 0) | (x == 0) | (y == z.shape[0] - 1) | (x == z.shape[1] - 1)
        out[y[on], x[on]] = v[on]
        for y in (self.top, self.bottom):
            if 0 <= y - y0 < z.shape[0]:
                out[y - y0] = z[y - y0]
        for x in (self.left, self.right):
            if 0 <= x - x0 < z.shape[1]:
                out[:, x - x0] = z[:, x - x0]
        return np.where(np.isnan(out), np.inf, out)

    def beyond(self, ty: int, tx: int, depth: int) -> np.ndarray:
        """The cells of a tile that lie ``depth`` cells from another one, on the sides that have one."""
        out = np.zeros((self.rows, self.columns), bool)
        y0, x0 = ty * self.rows, tx * self.columns
        for there, part in ((y0 > self.top, np.s_[depth - 1]), (y0 + self.rows <= self.bottom, np.s_[-depth]), (x0 > self.left, np.s_[:, depth - 1]), (x0 + self.columns <= self.right, np.s_[:, -depth])):
            out[part] |= there
        return out


def _frame(grid: DataFrame, tile: int | tuple[int, int] | None) -> _Frame | None:
    ends = grid.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()
    if ends[0] is None:
        return None
    return _Frame(*ends, *(long_tile(ends[2] - min(ends[0], 0) + 1, ends[3] - min(ends[1], 0) + 1, CELLS) if tile is None else sides(tile)))


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The neighbours, a step away, of the inner cells of a padded array."""
    return a[1 + dy : a.shape[0] - 1 + dy, 1 + dx : a.shape[1] - 1 + dx]


def _downstream(z: np.ndarray, filled: np.ndarray, size: np.ndarray, y0: int, x0: int, frame: _Frame) -> np.ndarray:
    """The cell's number that each inner cell of a padded tile drains to, -1 for none."""
    yy, xx = np.indices((z.shape[0] - 2, z.shape[1] - 2))
    number = (yy + y0).astype(np.int64) * frame.width + xx + x0
    ground = np.where(np.isnan(z), np.inf, z)
    here = np.where(np.isinf(ground), -np.inf, ground)[1:-1, 1:-1]
    drops = np.stack([(here - _shifted(ground, dy, dx)) / (size[1:-1, 1:-1] * math.hypot(dy, dx)) for dy, dx in STEPS_8])
    drops = np.where(np.isnan(drops), -np.inf, drops)
    to = np.array([dy * frame.width + dx for dy, dx in STEPS_8])
    best, most = drops.argmax(0), drops.max(0)
    # the neighbour that the flood came from: the lowest, of equals the first
    levels = np.stack([_shifted(filled, dy, dx) for dy, dx in STEPS_8])
    back = levels.argmin(0)
    border = (yy + y0 == frame.top) | (yy + y0 == frame.bottom) | (xx + x0 == frame.left) | (xx + x0 == frame.right)
    flood = np.where(border | ~np.isfinite(levels.min(0)), -1, number + to[back])
    inner = filled[1:-1, 1:-1]
    free = (np.abs(inner - here) < 0.01) & (most > 0)
    return np.where(np.isfinite(inner), np.where(free, number + to[best], flood), -1)


class _Flow:
    """The drained cells of one tile, and where their water goes.

    Water is handed on only to cells that come later in the order from the highest level; ``late`` cells drain to an earlier one, which gets their area without handing it on.
    """

    def __init__(self, job: pd.Series, ty: int, tx: int, frame: _Frame):
        rows, columns = tile = frame.rows, frame.columns
        padded = plane(job["filled"], tile, 1)
        self.filled = padded[1:-1, 1:-1]
        self.down = np.frombuffer(job["down"], np.int64).reshape(tile)
        self.area = np.frombuffer(job["area"]).reshape(tile)
        yy, xx = np.indices(tile)
        self.y, self.x = yy + ty * rows, xx + tx * columns
        self.number = self.y.astype(np.int64) * frame.width + self.x
        ty_, tx_ = self.down // frame.width - ty * rows, self.down % frame.width - tx * columns
        known = self.down >= 0
        level = padded[np.where(known, ty_ + 1, 0), np.where(known, tx_ + 1, 0)]
        onward = known & ((self.filled > level) | ((self.filled == level) & (self.number < self.down)))
        self.late = known & ~onward
        inside = (ty_ >= 0) & (ty_ < rows) & (tx_ >= 0) & (tx_ < columns)
        self.leaves = (onward & ~inside).ravel()
        self.next = np.where(onward & inside, ty_ * columns + tx_, -1).ravel()

    def drained(self, inflow: np.ndarray) -> np.ndarray:
        """Upstream area of each cell within the tile and of what flows in: cells hand theirs on once all above them have."""
        out, goes = (self.area + inflow).ravel(), self.next >= 0
        above = np.bincount(self.next[goes], minlength=out.size)
        now = np.flatnonzero(goes & (above == 0))
        while len(now):
            to = self.next[now]
            np.add.at(out, to, out[now])
            np.subtract.at(above, to, 1)
            to = np.unique(to)
            now = to[goes[to] & (above[to] == 0)]
        return out.reshape(self.area.shape)

    def exits(self) -> np.ndarray:
        """The cell by which water leaves the tile from each cell, -1 if it stays."""
        out = np.where(self.next >= 0, self.next, np.arange(self.next.size))
        while True:
            further = out[out]
            if (further == out).all():
                return np.where(self.leaves[out], out, -1)
            out = further


def drainage_table(grid: DataFrame, cell: float | str, value: str = "z", lift: float = 1e-3, tile: int | tuple[int, int] | None = None) -> DataFrame:
    """(y, x, filled, down_y, down_x, area_km2); down is null at outlets. ``cell`` is the cell size in metres or a column that has it.

    Levels are those of a flood from the grid's border: a cell is filled to ``lift`` above the lowest cell that reaches it, or stands above. Where nothing was filled water takes the
    steepest way down, elsewhere it follows the flood back to the lowest neighbour, of equals the first. Cells without a value are no ground: water neither crosses
    nor leaves there, and what they shut in from the border has no level, no way and its own area.

    By tiles, long ones where the grid is narrow: levels settle in rounds, each tile being flooded with the ground about it, so rounds are few; then each tile says which of its cells hand water to another tile, how much of its own, and by which of them water
    that enters it leaves again. Sums along those links, by pointer jumping, are what flows in, and each tile is drained once more with that.
    """
    size = F.col(cell) if isinstance(cell, str) else F.lit(float(cell))
    grid = grid.select("y", "x", F.col(value).cast("double").alias("z"), size.cast("double").alias("size"))
    frame = _frame(grid, tile)
    schema = "y int, x int, filled double, down_y int, down_x int, area_km2 double"
    if frame is None:
        return grid.sparkSession.createDataFrame([], schema)
    tile, halo = (frame.rows, frame.columns), frame.halo
    tiles = materialise(pack(grid, ["z", "size"], halo, tile, frame.ends), "tiles")

    def solve(at: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        z = plane(job["z"], tile, halo)
        inner = flooded(z, frame.levels(*at, z, ring), lift)[halo:-halo, halo:-halo]
        y, x = np.nonzero(np.isfinite(inner) & frame.beyond(*at, halo))
        return pd.DataFrame({"y": (y + at[0] * frame.rows).astype("int32"), "x": (x + at[1] * frame.columns).astype("int32"), "v": inner[y, x]})

    levels = settle(tiles, tiles.select("ty", "tx"), solve, [], "", halo, tile)

    def drain(at: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        z = plane(job["z"], tile, halo)
        filled = frame.near(flooded(z, frame.levels(*at, z, ring), lift))
        size = frame.near(plane(job["size"], tile, halo))
        down = _downstream(frame.near(z), filled, size, at[0] * frame.rows, at[1] * frame.columns, frame)
        there = np.where(np.isnan(size[1:-1, 1:-1]), 0.0, size[1:-1, 1:-1] ** 2 / 1e6)
        return pd.DataFrame({"ty": [at[0]], "tx": [at[1]], "filled": [filled.tobytes()], "down": [down.astype(np.int64).tobytes()], "area": [there.tobytes()]})

    place = ["ty", "tx"]
    flows = materialise(with_cells(tiles, about(levels, halo, tile), place, drain, "ty int, tx int, filled binary, down binary, area binary"), "flows")
    discard(tiles)

    def links(at: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flow = _Flow(pdf.iloc[0], *at, frame)
        own, exits, number = flow.drained(np.zeros(flow.area.shape)).ravel(), flow.exits(), flow.number.ravel()
        out = np.flatnonzero(flow.leaves)
        enter = np.flatnonzero(frame.beyond(*at, 1).ravel() & (exits >= 0))
        weight = pd.Series([*own[out].tolist(), *[None] * len(enter)], dtype=object)
        return pd.DataFrame({"cell": np.r_[number[out], number[enter]], "other": np.r_[flow.down.ravel()[out], number[exits[enter]]], "own": weight})

    found = materialise(flows.groupBy(*place).applyInPandas(links, "cell long, other long, own double"), "links")
    leaving = found.where("own IS NOT NULL").select(F.col("cell").alias("id"), F.col("other").alias("to"), F.col("own").alias("weight"))
    through = found.where("own IS NULL").select(F.col("cell").alias("to"), F.col("other").alias("next"))
    totals = subtree_sums(leaving.join(through, "to", "left").select("id", "next", "weight"))
    row, col = F.floor(F.col("to") / frame.width), F.col("to") % frame.width
    inflow = totals.join(leaving, "id").groupBy("to").agg(F.sum("total").alias("v")).select(row.cast("int").alias("y"), col.cast("int").alias("x"), "v")
    inflow = inflow.withColumns({"ty": tile_of("y", frame.rows), "tx": tile_of("x", frame.columns)})

    def accumulate(at: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        flow = _Flow(job, *at, frame)
        gained = np.zeros(flow.area.shape)
        gained[ring["y"].to_numpy(int) - at[0] * frame.rows, ring["x"].to_numpy(int) - at[1] * frame.columns] = ring["v"].to_numpy(float)
        there = flow.area > 0
        y, x, down = flow.y[there], flow.x[there], flow.down[there]
        none = down < 0
        pick = lambda a: pd.Series(np.where(none, 0, a)).mask(none).astype("Int32")
        return pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32"), "filled": flow.filled[there], "down_y": pick(down // frame.width), "down_x": pick(down % frame.width), "area_km2": flow.drained(gained)[there], "late": flow.late[there]})

    cells = materialise(with_cells(flows, inflow, place, accumulate, schema + ", late boolean"), "drained")
    discard(flows, found)
    late = cells.where("late").groupBy(F.col("down_y").alias("y"), F.col("down_x").alias("x")).agg(F.sum("area_km2").alias("_late"))
    full = cells.join(late, ["y", "x"], "left")
    level = F.when(F.col("filled") < float("inf"), F.col("filled")).alias("filled")
    return full.select("y", "x", level, "down_y", "down_x", (F.col("area_km2") + F.coalesce("_late", F.lit(0.0))).alias("area_km2"))


def stream_table(drained: DataFrame, threshold: float) -> DataFrame:
    """(reach, seq, y, x, km2) of a drainage table: the cells from a head or confluence down to the next confluence, the first cell that is no channel or an outlet,
    and the area at the lower end. A reach bears the place of its first cell, as ``y:x``. Reaches of one cell are left out.

    The cells between a reach's ends have one channel above them each; their place in the reach is their rank along the chain of those, by pointer jumping.
    """
    at = drained.select(F.struct("y", "x").alias("id"), F.when(F.col("down_y").isNotNull(), F.struct(F.col("down_y").alias("y"), F.col("down_x").alias("x"))).alias("down"), "area_km2")
    at = materialise(at.where(F.col("area_km2") >= threshold), "channels")
    inflow = at.where("down IS NOT NULL").groupBy(F.col("down").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_up"))
    at = materialise(at.join(inflow, "id", "left").withColumn("inner", F.coalesce(F.col("_n") == 1, F.lit(False))), "channels")
    ranks = chain_ranks(at.where("inner").select("id", F.col("_up").alias("up")))
    members = at.where("NOT inner").select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("rank")).unionByName(ranks)
    members = members.join(at.select("id", "down", "area_km2", "inner"), "id")
    # a reach ends below its last channel cell: at a confluence, or where no channel goes on
    below = at.select(F.col("id").alias("down"), F.col("inner").alias("_inner"))
    met = materialise(members.join(below, "down", "left").withColumn("_ends", ~F.coalesce("_inner", F.lit(False))), "reaches")
    tips = met.where("_ends AND down IS NOT NULL").select("head", (F.col("rank") + 1).alias("rank"), F.col("down").alias("id"))
    area = drained.select(F.struct("y", "x").alias("id"), "area_km2")
    tips = tips.join(area, "id").select("head", "rank", "id", "area_km2")
    cells = met.select("head", "rank", "id", "area_km2").unionByName(tips)
    ends = cells.groupBy("head").agg(F.max(F.struct("rank", "area_km2")).alias("_e")).where("_e.rank > 0").select("head", F.col("_e.area_km2").alias("km2"))
    return cells.join(ends, "head").select(F.concat_ws(":", "head.y", "head.x").alias("reach"), F.col("rank").cast("int").alias("seq"), "id.y", "id.x", "km2")
