"""Least-cost walking over a grid: times from a start or to it, and the ways, tile by tile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise, own_columns
from .tiles import about, long_tile, pack, plane, settle, sides, tile_of, with_cells

#: Lengths of a step to a side, to a corner and of a knight's move.
LENGTHS = {1: 1.0, 2: 1.41421, 5: 2.23607}
MOVES = tuple((dy, dx) for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx in LENGTHS)
#: Cells that a move reaches.
REACH = 2
#: Cells of a tile: as many moves as a task may hold. Ways along a narrow grid pass few tiles where these are long.
CELLS = 1 << 20


def tobler_speed(slope):
    """Walking km/h on a slope (rise over run); for Columns, arrays and floats."""
    if isinstance(slope, Column):
        return 6 * F.exp(-3.5 * F.abs(slope + 0.05))
    if isinstance(slope, np.ndarray):
        return 6 * np.exp(-3.5 * np.abs(slope + 0.05))
    return 6 * math.exp(-3.5 * abs(slope + 0.05))


def _move_hours(z: np.ndarray, factor: np.ndarray, size: np.ndarray, reverse: bool) -> np.ndarray:
    """Hours of each move from each cell of a padded tile, the moves last; infinite where it is barred or leaves the array.

    The run of a move is its length times the cell size of the row it leaves; moves whose mean factor isn't positive are barred.
    """
    h, w = z.shape
    out = np.full((h, w, len(MOVES)), np.inf)
    for k, (dy, dx) in enumerate(MOVES):
        here = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
        there = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
        run = LENGTHS[dy * dy + dx * dx] * size[here]
        rise = (z[there] - z[here]) * (-1 if reverse else 1)
        mean = (factor[here] + factor[there]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            hours = run / 1000 / (tobler_speed(rise / run) * mean)
        out[here][..., k] = np.where((mean > 0) & ~np.isnan(hours), hours, np.inf)
    return out


def _walked(hours: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Least hours of the inner cells of a padded tile, from cells whose hours are known (finite).

    All cells whose hours fell and lie within a span of the least are walked on from at once, until no hours fall: sums are made along ways from their
    start, as by one cell after the other, so the least are the same.
    """
    side = hours.shape[1]
    inner = np.zeros(hours.shape, bool)
    inner[REACH:-REACH, REACH:-REACH] = True
    inner, best, costs = inner.ravel(), hours.ravel().copy(), moves.reshape(-1, len(MOVES))
    steps = np.array([dy * side + dx for dy, dx in MOVES])
    finite = costs[np.isfinite(costs)]
    span = float(finite.mean()) if len(finite) else 0.0
    todo, waits = np.flatnonzero(np.isfinite(best)), np.zeros(best.size, bool)
    waits[todo] = True
    while len(todo):
        due = best[todo] <= best[todo].min() + span
        now, todo = todo[due], todo[~due]
        waits[now] = False
        after = best[now, None] + costs[now]
        i, k = np.nonzero(after < np.inf)  # no such move leaves the array
        cells, after = now[i] + steps[k], after[i, k]
        less = inner[cells] & (after < best[cells])
        cells = cells[less]
        np.minimum.at(best, cells, after[less])
        fell = np.unique(cells[~waits[cells]])
        waits[fell] = True
        todo = np.concatenate([todo, fell])
    return best.reshape(hours.shape)


def _came_from(hours: np.ndarray, moves: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The number of the cell before each cell of a padded tile: of those that give the least hours the one reached first, then the first; -1 for none."""
    h, w = hours.shape
    best, early, before = np.full((h, w), np.inf), np.full((h, w), np.inf), np.full((h, w), -1, np.int64)
    for k, (dy, dx) in enumerate(MOVES):
        here = (slice(max(0, -dy), h - max(0, dy)), slice(max(0, -dx), w - max(0, dx)))
        there = (slice(max(0, dy), h - max(0, -dy)), slice(max(0, dx), w - max(0, -dx)))
        after = hours[here] + moves[here][..., k]
        first = (hours[here] < early[there]) | ((hours[here] == early[there]) & (number[here] < before[there]))
        better = (after < np.inf) & ((after < best[there]) | ((after == best[there]) & first))
        for kept, new in ((best, after), (early, hours[here]), (before, number[here])):
            kept[there] = np.where(better, new, kept[there])
    return before


def _long_tile(height: int, width: int) -> tuple[int, int]:
    """Rows and columns of the tiles of a grid: near squares of ``CELLS`` cells, longer where the grid is narrower than that."""
    return long_tile(height, width, CELLS)


def travel_table(grid: DataFrame, starts: DataFrame, cell: float | str, value: str = "z", factor: str = "factor", tile: int | tuple[int, int] | None = None) -> DataFrame:
    """(start, reverse, y, x, hours, before_y, before_x) for each start (start, sy, sx, reverse), over 16 moves; before is -1 at the start.

    ``cell`` is the cell size in metres or a column that has it; a null factor bars a cell. Unreachable cells are absent, and so is a start without a cell. Times settle in rounds in
    which only tiles that have been told shorter ways take part, for all starts at once; nothing is crossed and no task holds more than a tile. Tiles are as long as ``CELLS`` allows where the
    grid is narrow, so rounds are as many as the grid has millions of cells, or fewer.
    """
    size = F.col(cell) if isinstance(cell, str) else F.lit(float(cell))
    grid = grid.where(F.col(value).isNotNull()).select("y", "x", F.col(value).cast("double").alias("z"), F.coalesce(F.col(factor).cast("double"), F.lit(0.0)).alias("factor"), size.cast("double").alias("size"))
    ends = [c or 0 for c in grid.agg(F.min("y"), F.min("x"), F.max("y"), F.max("x")).first()]
    rows, columns = tile = _long_tile(ends[2] - min(ends[0], 0) + 1, ends[3] - min(ends[1], 0) + 1) if tile is None else sides(tile)
    tiles = materialise(pack(grid, ["z", "factor", "size"], REACH, tile), "tiles")
    width = ends[3] + 1
    first = starts.select("start", tile_of("sy", rows).alias("ty"), tile_of("sx", columns).alias("tx"), F.col("sy").cast("int"), F.col("sx").cast("int"), "reverse")

    def solved(at: tuple, job: pd.Series, ring: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        z, speed, size = (plane(job[c], tile, REACH) for c in ("z", "factor", "size"))
        moves = _move_hours(z, np.nan_to_num(speed), size, bool(job["reverse"]))
        hours = np.full(z.shape, np.inf)
        y0, x0 = at[1] * rows - REACH, at[2] * columns - REACH
        hours[ring["y"].to_numpy(int) - y0, ring["x"].to_numpy(int) - x0] = ring["v"].to_numpy(float)
        if int(job["sy"]) // rows == at[1] and int(job["sx"]) // columns == at[2] and z[job["sy"] - y0, job["sx"] - x0] == z[job["sy"] - y0, job["sx"] - x0]:
            hours[job["sy"] - y0, job["sx"] - x0] = 0.0
        return _walked(hours, moves), moves

    def solve(at: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        inner = solved(at, job, ring)[0][REACH:-REACH, REACH:-REACH]
        # what other tiles are told: the outer cells on the sides that have one beyond
        told = np.zeros(inner.shape, bool)
        y0, x0 = at[1] * rows, at[2] * columns
        for there, part in ((y0 > ends[0], np.s_[:REACH]), (y0 + rows <= ends[2], np.s_[-REACH:]), (x0 > ends[1], np.s_[:, :REACH]), (x0 + columns <= ends[3], np.s_[:, -REACH:])):
            told[part] |= there
        y, x = np.nonzero(told & np.isfinite(inner))
        return pd.DataFrame({"y": (y + y0).astype("int32"), "x": (x + x0).astype("int32"), "v": inner[y, x]})

    kind = dict(starts.dtypes)["start"]
    known = settle(tiles, first, solve, ["start"], f"start {kind}, ", REACH, tile)

    def finish(at: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        hours, moves = solved(at, job, ring)
        across, down = np.arange(columns + 2 * REACH), np.arange(rows + 2 * REACH)
        number = (at[1] * rows - REACH + down)[:, None] * width + at[2] * columns - REACH + across[None, :]
        before = _came_from(hours, moves, number)[REACH:-REACH, REACH:-REACH]
        inner = hours[REACH:-REACH, REACH:-REACH]
        y, x = np.nonzero(np.isfinite(inner))
        b = np.where(inner[y, x] > 0, before[y, x], -1)
        return pd.DataFrame({"start": at[0], "reverse": bool(job["reverse"]), "y": y + at[1] * rows, "x": x + at[2] * columns, "hours": inner[y, x], "before_y": np.where(b < 0, -1, b // width), "before_x": np.where(b < 0, -1, b % width)})

    at = ["start", "ty", "tx"]
    ring = about(known, REACH, tile)
    reached = ring.select(*at).unionByName(first.select(*at)).distinct()
    jobs = reached.join(first.drop("ty", "tx"), "start").join(tiles, ["ty", "tx"])
    out = materialise(with_cells(jobs, ring, at, finish, f"start {kind}, reverse boolean, y int, x int, hours double, before_y int, before_x int"), "hours")
    discard(tiles)
    return out


#: Cells of a row of a way's piece, ways that share a row, and rows that a task writes.
CHUNK, WAYS, ROWS_A_TASK = 512, 256, 4_000_000
_PIECES = "ty int, tx int, y int, x int, runs array<struct<piece: int, first: int, last: int>>, steps long, next_y int, next_x int, piece int, chunk int, at int, cells array<struct<y: int, x: int, hours: double>>"


def _pieced(before: np.ndarray, tips: np.ndarray) -> tuple[list[np.ndarray], list[list[tuple[int, int, int]]], np.ndarray, np.ndarray]:
    """The ways from tips back to where they leave a tile, as pieces that ways share: the pieces' cells, the runs (piece, first, last) of each tip's way, how many cells before it each cell has, and the cell by which it leaves.

    ``before`` is the cell before each, -1 where that isn't of the tile. A piece holds one cell for each number of cells before it; the longest way is the first piece, and each further one is what no longer way has passed.
    """
    left, depth = np.where(before < 0, np.arange(len(before)), before), (before >= 0).astype(np.int64)
    while (left != left[left]).any():
        depth, left = depth + depth[left], left[left]
    back, deep, owner, pieces, lows, onto = before.tolist(), depth.tolist(), [-1] * len(before), [], [], []
    for tip in tips[np.argsort(-depth[tips], kind="stable")].tolist():
        way = []
        while tip >= 0 and owner[tip] < 0:
            owner[tip] = len(pieces)
            way.append(tip)
            tip = back[tip]
        if way:
            lows.append(deep[way[-1]])
            onto.append(owner[tip] if tip >= 0 else -1)
            pieces.append(np.array(way[::-1]))
    runs = []
    for tip in tips.tolist():
        own, last, piece = [], deep[tip], owner[tip]
        while piece >= 0:
            own.append((piece, lows[piece], last))
            last, piece = lows[piece] - 1, onto[piece]
        runs.append(own)
    return pieces, runs, depth, left


def _way_pieces(cells: DataFrame, tips: DataFrame, start: str, tile: tuple[int, int]) -> DataFrame:
    """For each tile the pieces of the ways back from its tips (a row for ``CHUNK`` cells of a piece) and the runs of each tip's way, with the cell of another tile before it."""
    rows, columns = tile
    order = ["start", "ty", "tx", "y", "x", "runs", "steps", "next_y", "next_x", "piece", "chunk", "at", "cells"]
    whole = {c: pa.int32() for c in ("ty", "tx", "y", "x", "next_y", "next_x", "piece", "chunk", "at")} | {"steps": pa.int64()}
    ground = pa.struct([("y", pa.int32()), ("x", pa.int32()), ("hours", pa.float64())])
    whole |= {"runs": pa.list_(pa.struct([(c, pa.int32()) for c in ("piece", "first", "last")])), "cells": pa.list_(ground)}

    def run(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        y, x, by, bx, ty, tx = (t[c].to_numpy().astype(np.int64) for t, c in ((own, "y"), (own, "x"), (own, "before_y"), (own, "before_x"), (asked, "y"), (asked, "x")))
        y0, x0 = key[1].as_py() * rows, key[2].as_py() * columns
        stands = np.full(rows * columns + 1, -1)
        stands[(y - y0) * columns + x - x0] = np.arange(len(y))
        held = (by >= 0) & (by >= y0) & (by < y0 + rows) & (bx >= x0) & (bx < x0 + columns)
        before = stands[np.where(held, (by - y0) * columns + bx - x0, -1)]
        tips = stands[(ty - y0) * columns + tx - x0]
        tips = tips[tips >= 0]
        pieces, runs, depth, left = _pieced(before, tips)
        out = left[tips]
        told = {"y": y[tips], "x": x[tips], "runs": [[dict(zip(("piece", "first", "last"), r)) for r in way] for way in runs], "steps": depth[tips] + 1, "next_y": by[out], "next_x": bx[out]}
        # a row of a piece holds the cells whose numbers of cells before them have the same quotient
        places = np.concatenate([np.zeros(0, np.int64), *pieces])
        number = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        begin = np.flatnonzero(np.diff(number, prepend=-1) | np.diff(depth[places] // CHUNK, prepend=-1))
        spots = pa.StructArray.from_arrays([pa.array(v[places], f.type) for v, f in zip((y, x, own["hours"].to_numpy()), ground)], fields=list(ground))
        cells = pa.ListArray.from_arrays(pa.array(np.append(begin, len(places)), pa.int32()), spots)
        kept = {"piece": number[begin], "chunk": depth[places[begin]] // CHUNK, "at": depth[places[begin]], "cells": cells}
        both = []
        for part, n in ((told, len(tips)), (kept, len(begin))):
            part |= {"ty": np.full(n, key[1].as_py()), "tx": np.full(n, key[2].as_py())}
            told_or_none = {c: part[c] if isinstance(part.get(c), pa.Array) else pa.array(part[c], kind) if c in part else pa.nulls(n, kind) for c, kind in whole.items()}
            both.append(pa.table({"start": pa.array([key[0].as_py()] * n, key[0].type), **told_or_none}).select(order))
        return pa.concat_tables(both)

    at = ["start", "ty", "tx"]
    return cells.groupBy(*at).cogroup(tips.groupBy(*at)).applyInArrow(run, f"start {start}, {_PIECES}")


def _gates_back(gates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many cells each way back from a gate (start, y, x, steps, next_y, next_x) has, and the gates (ay, ax) that it passes, itself among them: by doubling, in a logarithm of rounds."""
    at = ["start", "y", "x"]
    onward = [F.when(F.col(c) >= 0, F.col(c)).alias(j) for c, j in (("next_y", "jy"), ("next_x", "jx"))]
    links = materialise(gates.select(*at, F.col("steps").alias("total"), *onward), "links")
    reach = materialise(gates.select(*at, F.col("y").alias("ay"), F.col("x").alias("ax")), "reach")
    while links.where("jy IS NOT NULL").limit(1).count():
        jump = links.where("jy IS NOT NULL").select("start", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("jy").alias("y"), F.col("jx").alias("x"))
        more = jump.join(own_columns(reach), at).select("start", F.col("_y").alias("y"), F.col("_x").alias("x"), "ay", "ax")
        beyond = links.select("start", F.col("y").alias("jy"), F.col("x").alias("jx"), F.col("total").alias("_t"), F.col("jy").alias("_jy"), F.col("jx").alias("_jx"))
        older = links, reach
        reach = materialise(reach.unionByName(more), "reach")
        doubled = own_columns(links).join(beyond, ["start", "jy", "jx"], "left")
        links = materialise(doubled.select(*at, (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"), F.col("_jy").alias("jy"), F.col("_jx").alias("jx")), "links")
        discard(*older)
    return links, reach


def path_table(table: DataFrame, ends: DataFrame, tile: int | tuple[int, int] | None = None) -> DataFrame:
    """(path, seq, y, x, hours) from the start to each end (path, start, y, x) of a travel table, read back from the cells before; an end that isn't reached has no rows.

    Each tile says once which pieces of ways lead back from its ends, and from the gates by which ways come back into it from other tiles; gates are followed from tile to tile by doubling. A piece is stored once for all ways
    along it, and ways that come to the same gate are written together, ``WAYS`` at a time: the rows of the result are made from both where they are read, and are dealt by pieces of ``CHUNK`` cells.
    """
    if tile is None:
        bottom, right = (c or 0 for c in table.agg(F.max("y"), F.max("x")).first())
        tile = _long_tile(bottom + 1, right + 1)
    rows, columns = tile = sides(tile)
    kind = dict(table.dtypes)["start"]
    sided = lambda df, y="y", x="x": df.withColumns({"ty": tile_of(y, rows), "tx": tile_of(x, columns)})
    cells = sided(table.select("start", F.col("y").cast("int"), F.col("x").cast("int"), "hours", "before_y", "before_x"))
    asked = materialise(ends.where("path IS NOT NULL").select("path", F.col("start").cast(kind), F.col("y").cast("int"), F.col("x").cast("int")), "ends")
    across = cells.where((F.col("before_y") >= 0) & ((F.col("ty") != tile_of("before_y", rows)) | (F.col("tx") != tile_of("before_x", columns))))
    gates = across.select("start", F.col("before_y").cast("int").alias("y"), F.col("before_x").cast("int").alias("x")).distinct()
    tips = sided(gates.unionByName(asked.select("start", "y", "x")).distinct())
    found = materialise(_way_pieces(cells, own_columns(tips), kind, tile), "pieces")
    at, place = ["start", "y", "x"], ["start", "ty", "tx"]
    told = found.where("piece IS NULL").select(*place, "y", "x", "runs", "steps", "next_y", "next_x")
    total, reach = _gates_back(told.join(gates, at, "left_semi"))
    # a tile's cells follow those of the way back from the gate that stands before them
    base = own_columns(told).join(total.select("start", F.col("y").alias("next_y"), F.col("x").alias("next_x"), F.col("total").alias("_b")), ["start", "next_y", "next_x"], "left").withColumn("base", F.coalesce("_b", F.lit(0)))
    base = materialise(base.select(*place, "y", "x", "runs", "base", "next_y", "next_x"), "runs")
    own = asked.join(base, at)
    through = own.where("next_y >= 0").select("path", "start", F.col("next_y").alias("y"), F.col("next_x").alias("x"))
    many = through.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / WAYS).cast("long").alias("_n"))
    shared = own_columns(through).join(many, at).groupBy(*at, F.pmod(F.xxhash64("path"), F.col("_n")).alias("_part")).agg(F.collect_list("path").alias("paths")).drop("_part")
    passed = shared.join(reach, at).select("paths", "start", F.col("ay").alias("y"), F.col("ax").alias("x")).join(own_columns(base), at)
    runs = own.select(F.array("path").alias("paths"), *place, "base", F.explode("runs").alias("r")).unionByName(passed.select("paths", *place, "base", F.explode("runs").alias("r")))
    wanted = materialise(runs.select("paths", *place, "base", "r.piece", "r.first", "r.last"), "wanted")
    discard(asked, base, total, reach)
    length = wanted.agg(F.sum(F.size("paths") * (F.col("last") - F.col("first") + 1).cast("long"))).first()[0] or 0
    tasks = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), length // ROWS_A_TASK)
    key = [*place, "piece", "chunk"]
    rowed = wanted.withColumn("chunk", F.explode(F.sequence(tile_of("first", CHUNK), tile_of("last", CHUNK)))).repartition(tasks, *key)
    met = rowed.join(found.where("piece IS NOT NULL").select(*key, "at", "cells").repartition(tasks, *key), key)
    met = met.select("paths", (F.col("base") + F.col("at")).alias("_s"), F.slice("cells", F.lit(1), F.col("last") - F.col("at") + 1).alias("cells"))
    each = met.select(F.explode("paths").alias("path"), "_s", "cells").select("path", "_s", F.posexplode("cells").alias("_i", "c"))
    return each.select("path", (F.col("_s") + F.col("_i")).cast("int").alias("seq"), "c.y", "c.x", "c.hours")
