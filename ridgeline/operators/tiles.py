"""Grids in square tiles: no task holds more than one tile and the cells about it.

A tile is a row: its place (ty, tx) and, for each value, the bytes of an array of doubles that reaches ``halo`` cells beyond the tile; cells that the grid lacks are
NaN. What spreads over a grid from cell to cell (water levels, walking times) is worked out tile by tile: a tile is solved for what is known of the
cells about it, what its outer cells have gained is told to its neighbours, and those are solved again until nothing is gained. Rounds are as many as the tiles
that a way passes, and only tiles that have been told something take part in one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialise, own_columns

TILE = 512
ROUNDS = 10_000


def sides(tile: int | tuple[int, int]) -> tuple[int, int]:
    """Rows and columns of a tile: one number is a square."""
    return (tile, tile) if isinstance(tile, int) else tile


def long_tile(height: int, width: int, cells: int) -> tuple[int, int]:
    """Rows and columns of the tiles of a grid: near squares of that many cells, longer where the grid is narrower than that."""
    square = math.isqrt(cells)
    if height < width:
        return long_tile(width, height, cells)[::-1]
    across = min(width, square)
    return min(height, cells // across), across


def tile_of(c: str | Column, tile: int) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / tile).cast("int")


def touched(cells: DataFrame, halo: int, tile: int | tuple[int, int]) -> DataFrame:
    """Each cell (y, x, ...) once for every tile (ty, tx) that it lies in or within ``halo`` cells of."""
    for axis, side in zip("yx", sides(tile)):
        cells = cells.withColumn(f"t{axis}", F.explode(F.sequence(tile_of(F.col(axis) - halo, side), tile_of(F.col(axis) + halo, side))))
    return cells


def pack(grid: DataFrame, values: list[str], halo: int, tile: int | tuple[int, int], ends: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(ty, tx, one binary column for each value) of the tiles that have a cell. Where the least and most y and x of the grid are told, none of it is dealt to tiles that lie beyond."""
    height, width = sides(tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy() - key[0] * height + halo, pdf["x"].to_numpy() - key[1] * width + halo
        if not ((y >= halo) & (y < height + halo) & (x >= halo) & (x < width + halo)).any():
            return pd.DataFrame({"ty": [], "tx": [], **{v: [] for v in values}})
        out = {"ty": [key[0]], "tx": [key[1]]}
        for v in values:
            plane = np.full((height + 2 * halo, width + 2 * halo), np.nan)
            plane[y, x] = pdf[v].to_numpy(float)
            out[v] = [plane.tobytes()]
        return pd.DataFrame(out)

    cells = touched(grid.select("y", "x", *(F.col(v).cast("double").alias(v) for v in values)), halo, tile)
    if ends is not None:
        top, left, bottom, right = ends
        cells = cells.where(F.col("ty").between(top // height, bottom // height) & F.col("tx").between(left // width, right // width))
    return cells.groupBy("ty", "tx").applyInPandas(run, "ty int, tx int, " + ", ".join(f"{v} binary" for v in values))


def plane(data: bytes, tile: int | tuple[int, int], halo: int) -> np.ndarray:
    height, width = sides(tile)
    return np.frombuffer(data).reshape(height + 2 * halo, width + 2 * halo).copy()


def _empty(schema: str) -> pd.DataFrame:
    return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])


def with_cells(jobs: DataFrame, cells: DataFrame, at: list[str], run: Callable, schema: str) -> DataFrame:
    """run(key, the job's row, its cells) for each job; ``at`` are the columns that both share, of which (ty, tx) are the last two."""

    def each(key: tuple, job: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        return run(key, job.iloc[0], own) if len(job) else _empty(schema)

    return own_columns(jobs).groupBy(*at).cogroup(cells.groupBy(*at)).applyInPandas(each, schema)


def about(known: DataFrame, halo: int, tile: int | tuple[int, int]) -> DataFrame:
    """Each cell once for every other tile that it lies within ``halo`` cells of."""
    height, width = sides(tile)
    return touched(known, halo, tile).where((F.col("ty") != tile_of("y", height)) | (F.col("tx") != tile_of("x", width)))


def settle(tiles: DataFrame, first: DataFrame, solve: Callable, key: list[str], kinds: str, halo: int, tile: int | tuple[int, int]) -> DataFrame:
    """The least values (key, y, x, v) of the cells of the tiles' outer bands, ``halo`` cells wide, at the fixpoint.

    ``first`` are the jobs (key, ty, tx, ...) of the first round, whose further columns go by key; ``solve(at, job, ring)`` gives (y, x, v) of the band of the
    tile at (key, ty, tx), job being a row with the tile's columns and ring the known (y, x, v) about it. Values only fall from round to round.
    A round reads only the tiles between the outermost ones that are told something.
    """
    schema = f"{kinds}y int, x int, v double"
    at = [*key, "ty", "tx"]

    def run(place: tuple, job: pd.Series, ring: pd.DataFrame) -> pd.DataFrame:
        found = solve(place, job, ring)
        for i, name in enumerate(key):
            found.insert(i, name, place[i])
        return found

    extra = first.drop("ty", "tx").distinct()
    nothing = first.select(*at, *(F.lit(None).cast(kind).alias(c) for c, kind in (("y", "int"), ("x", "int"), ("v", "double")))).limit(0)
    known = materialise(with_cells(first.join(tiles, ["ty", "tx"]), nothing, at, run, schema).withColumn("fresh", F.lit(True)), "band")
    for _ in range(ROUNDS):
        ends = known.where("fresh").agg(*(f(c) for c in ("y", "x") for f in (F.min, F.max))).first()
        if ends[0] is None:
            return known.select(*key, "y", "x", "v")
        within = [F.col(f"t{axis}").between((ends[2 * i] - halo) // side, (ends[2 * i + 1] + halo) // side) for i, (axis, side) in enumerate(zip("yx", sides(tile)))]
        told = about(known.where("fresh").select(*key, "y", "x"), halo, tile).select(*at).distinct()
        jobs = (told.join(extra, key) if key else told).join(tiles.where(within[0] & within[1]), ["ty", "tx"])
        ring = about(known.select(*key, "y", "x", "v"), halo, tile).join(told, at, "left_semi")
        gained = with_cells(jobs, ring, at, run, schema).withColumn("fresh", F.lit(True))
        best = known.withColumn("fresh", F.lit(False)).unionByName(gained).groupBy(*key, "y", "x").agg(F.min(F.struct("v", "fresh")).alias("_b"))
        before, known = known, materialise(best.select(*key, "y", "x", "_b.v", "_b.fresh"), "band")
        discard(before)
    raise RuntimeError(f"no fixpoint in {ROUNDS} rounds")
