"""Rays over a height grid: line of sight, viewshed, vantage, sun and wind.

Two forms. ``line_of_sight`` explodes each pair into one row per step and joins the cells. Where whole areas are looked at, tiles meet the tiles between them and the eye or
the sun, and a task holds two of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CURVATURE_RADIUS_M, REFRACTION
from ..storage import materialise
from .tiles import TILE, pack, plane, sides, tile_of, touched, with_cells


def curvature_drop(metres):
    """Metres by which the ground falls away, refraction allowed for; for Columns and arrays."""
    return metres * metres / (2 * CURVATURE_RADIUS_M) * (1 - REFRACTION)


def bilinear(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights at places of an array that all lie before its last row and column."""
    i, j = np.floor(x).astype(int), np.floor(y).astype(int)
    fx, fy = x - i, y - j
    return (z[j, i] * (1 - fx) + z[j, i + 1] * fx) * (1 - fy) + (z[j + 1, i] * (1 - fx) + z[j + 1, i + 1] * fx) * fy


@dataclass(frozen=True)
class _Extent:
    """Cells of a grid across and down, from 0, and its highest and lowest ground."""

    height: int
    width: int
    top: float
    low: float

    def clipped(self, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.clip(px, 0, self.width - 1.001), np.clip(py, 0, self.height - 1.001)


def _extent(grid: DataFrame, value: str) -> _Extent:
    bottom, right, top, low = grid.agg(F.max("y"), F.max("x"), F.max(value), F.min(value)).first()
    return _Extent((bottom or 0) + 1, (right or 0) + 1, top if top is not None else 0.0, low if low is not None else 0.0)


def _in_tile(px: np.ndarray, py: np.ndarray, ty: int, tx: int, tile: int | tuple[int, int]) -> np.ndarray:
    rows, columns = sides(tile)
    return (np.floor(px) >= tx * columns) & (np.floor(px) < (tx + 1) * columns) & (np.floor(py) >= ty * rows) & (np.floor(py) < (ty + 1) * rows)


def _sampled(z: np.ndarray, px: np.ndarray, py: np.ndarray, ty: int, tx: int, tile: int | tuple[int, int]) -> np.ndarray:
    """Heights at places of a tile, of which the array reaches one cell beyond it."""
    rows, columns = sides(tile)
    return bilinear(z, px - tx * columns + 1, py - ty * rows + 1)


def _near_line(y0: Column, x0: Column, y1: Column, x1: Column, y: Column, x: Column) -> Column:
    """Distance of (y, x) from the straight way from (y0, x0) to (y1, x1)."""
    dy, dx = y1 - y0, x1 - x0
    t = F.coalesce(F.try_divide((y - y0) * dy + (x - x0) * dx, dy * dy + dx * dx), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(y0 + t * dy - y, F.lit(2)) + F.pow(x0 + t * dx - x, F.lit(2)))


_RAYS = "{eye}, ty int, tx int, hidden binary"


def viewsheds(grid: DataFrame, eyes: DataFrame, radius_m: float, cell: float, eye: float = 1.7, target: float = 1.0, value: str = "z", tile: int = TILE) -> DataFrame:
    """(eye, y, x, seen) of the cells within a radius of each eye (eye, y, x): 1 or 0; cells out of reach are absent, and so are eyes without a cell.

    One sample of the ground per cell of distance. The tile that holds the cells looked at meets each tile that lies between it and the eye: a task has two tiles,
    says which of the cells are hidden by the second, and what any tile hides is hidden. So neither the grid nor a radius has to fit a task.
    """
    size = _extent(grid, value)
    reach = radius_m / cell
    tiles = materialise(pack(grid.select("y", "x", F.col(value).alias("z")), ["z"], 1, tile), "tiles")
    kind = f"eye {dict(eyes.dtypes)['eye']}"
    from_ = eyes.select("eye", F.col("y").alias("oy"), F.col("x").alias("ox")).join(grid.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col(value).cast("double").alias("_z0")), ["oy", "ox"]).where("_z0 IS NOT NULL")
    around = lambda c, name: F.explode(F.sequence(tile_of(F.col(c) - reach, tile), tile_of(F.col(c) + reach, tile))).alias(name)
    looked = from_.select("eye", "oy", "ox", "_z0", around("oy", "ty")).select("*", around("ox", "tx")).join(tiles.select("ty", "tx"), ["ty", "tx"])
    between = looked
    for axis in ("y", "x"):
        first, last = tile_of(f"o{axis}", tile), F.col(f"t{axis}")
        between = between.withColumn(f"r{axis}", F.explode(F.sequence(F.least(first, last), F.greatest(first, last))))
    middle = lambda c: (F.col(c) + 0.5) * tile
    # a ray to a cell of one tile runs through the other only if their middles lie this near the same line
    between = between.where(_near_line(F.col("oy"), F.col("ox"), middle("ty"), middle("tx"), middle("ry"), middle("rx")) <= 1.4143 * tile + 2)
    pairs = between.join(tiles, ["ty", "tx"]).join(tiles.select(F.col("ty").alias("ry"), F.col("tx").alias("rx"), F.col("z").alias("ground")), ["ry", "rx"])

    def cells(at: tuple[int, int], z: np.ndarray, oy: int, ox: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns within the tile of cells that are looked at, and their heights."""
        inner = z[1:-1, 1:-1]
        yy, xx = np.indices(inner.shape)
        dy, dx = yy + at[0] * tile - oy, xx + at[1] * tile - ox
        y, x = np.nonzero((dy * dy + dx * dx <= reach * reach) & ~np.isnan(inner))
        return y, x, inner[y, x]

    def hide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        here, there, oy, ox = (int(row["ty"]), int(row["tx"])), (int(row["ry"]), int(row["rx"])), int(row["oy"]), int(row["ox"])
        z, ground = plane(row["z"], tile, 1), plane(row["ground"], tile, 1)
        y, x, height = cells(here, z, oy, ox)
        dy, dx = y + here[0] * tile - oy, x + here[1] * tile - ox
        far = np.hypot(dy, dx)
        n = np.ceil(far).astype(int)
        start = row["_z0"] + eye
        aim = height + target - curvature_drop(far * cell) - start
        hidden = np.zeros(len(y), bool)
        corner = [(math.hypot(there[0] * tile + a - oy, there[1] * tile + b - ox)) for a in (0, tile) for b in (0, tile)]
        nearest = math.hypot(max(there[0] * tile - oy, 0, oy - (there[0] + 1) * tile), max(there[1] * tile - ox, 0, ox - (there[1] + 1) * tile))
        for s in range(max(1, int(nearest) - 1), min(int(n.max(initial=0)), int(max(corner)) + 3)):
            live = np.flatnonzero(~hidden & (s < n) & (far >= 1.5))
            f = s / n[live]
            px, py = size.clipped(ox + dx[live] * f, oy + dy[live] * f)
            on = _in_tile(px, py, *there, tile)
            live, f = live[on], f[on]
            hidden[live[_sampled(ground, px[on], py[on], *there, tile) - curvature_drop(far[live] * f * cell) > start + aim[live] * f]] = True
        whole = np.zeros((tile, tile), bool)
        whole[y, x] = hidden
        return pd.DataFrame({"eye": [row["eye"]], "ty": [here[0]], "tx": [here[1]], "hidden": [np.packbits(whole).tobytes()]})

    shade = pairs.groupBy("eye", "ty", "tx", "ry", "rx").applyInPandas(hide, _RAYS.format(eye=kind))

    def tell(key: tuple, job: pd.Series, hidden: pd.DataFrame) -> pd.DataFrame:
        y, x, _ = cells(key[1:], plane(job["z"], tile, 1), int(job["oy"]), int(job["ox"]))
        seen = ~_any(hidden["hidden"], tile)[y, x]
        return pd.DataFrame({"eye": [key[0]] * len(y), "y": y + key[1] * tile, "x": x + key[2] * tile, "seen": seen.astype("int32")})

    return with_cells(looked.join(tiles, ["ty", "tx"]), shade, ["eye", "ty", "tx"], tell, f"{kind}, y int, x int, seen int")


def _any(bits: Iterable[bytes], tile: int | tuple[int, int]) -> np.ndarray:
    """Cells of a tile that any of the packed masks holds."""
    rows, columns = sides(tile)
    out = np.zeros(-(-rows * columns // 8), np.uint8)
    for b in bits:
        out |= np.frombuffer(b, np.uint8)
    return np.unpackbits(out, count=rows * columns).reshape(rows, columns).astype(bool)


def viewshed(grid: DataFrame, oy: int, ox: int, radius_m: float, cell: float, eye: float = 1.7, target: float = 1.0, value: str = "z", tile: int = TILE) -> DataFrame:
    """(y, x, seen) of the cells within a radius of one eye."""
    eyes = grid.where((F.col("y") == oy) & (F.col("x") == ox)).select(F.lit(0).alias("eye"), "y", "x")
    return viewsheds(grid, eyes, radius_m, cell, eye, target, value, tile).drop("eye")


def line_of_sight(pairs: DataFrame, grid: DataFrame, width: int, height: int, cell: float, eye: float = 1.7, target: float = 1.0, value: str = "z", key: str = "id") -> DataFrame:
    """key, seen and first_block (the first step that blocks, else null) of pairs (ox, oy, tx, ty), by joins only."""
    cells = grid.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(value).cast("double").alias("_z"))
    at = lambda df, x, y, name: df.join(cells.select(F.col("_x").alias(x), F.col("_y").alias(y), F.col("_z").alias(name)), [x, y], "left")
    far = F.sqrt(F.pow(F.col("tx") - F.col("ox"), F.lit(2)) + F.pow(F.col("ty") - F.col("oy"), F.lit(2)))
    ends = at(at(pairs, "ox", "oy", "_z0"), "tx", "ty", "_z1").withColumn("_far", far)
    ends = ends.withColumns({"_n": F.ceil("_far").cast("int"), "_start": F.col("_z0") + eye, "_aim": F.col("_z1") + target - curvature_drop(F.col("_far") * cell)})
    steps = ends.where("_n > 1 AND _far >= 1.5").withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_n") - 1)))
    f = F.col("_s") / F.col("_n")
    px = F.least(F.col("ox") + (F.col("tx") - F.col("ox")) * f, F.lit(width - 1.001))
    py = F.least(F.col("oy") + (F.col("ty") - F.col("oy")) * f, F.lit(height - 1.001))
    steps = steps.withColumns({"_px": px, "_py": py})
    fx, fy = F.col("_px") - F.floor("_px"), F.col("_py") - F.floor("_py")
    corners = [F.struct((F.floor("_px") + i).cast("int").alias("x"), (F.floor("_py") + j).cast("int").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    taps = steps.select(key, "_s", "_n", "_far", "_start", "_aim", F.explode(F.array(*corners)).alias("_c")).select(key, "_s", "_n", "_far", "_start", "_aim", F.col("_c.x").alias("_x"), F.col("_c.y").alias("_y"), F.col("_c.w").alias("_w"))
    ground = taps.join(cells, ["_x", "_y"]).groupBy(key, "_s", "_n", "_far", "_start", "_aim").agg(F.sum(F.col("_z") * F.col("_w")).alias("_g"))
    f = F.col("_s") / F.col("_n")
    blocked = F.round(F.col("_g") - curvature_drop(F.col("_far") * f * cell) - F.col("_start") - (F.col("_aim") - F.col("_start")) * f, 9) > 0
    first = ground.groupBy(key).agg(F.min(F.when(blocked, F.col("_s"))).alias("first_block"))
    return pairs.select(key).join(first, key, "left").select(key, F.col("first_block").isNull().cast("int").alias("seen"), "first_block")


def seen_count(viewsheds: list[DataFrame]) -> DataFrame:
    """How many of the viewsheds see each cell; cells that none reaches are absent."""
    out = viewsheds[0]
    for v in viewsheds[1:]:
        out = out.unionByName(v)
    return out.groupBy("y", "x").agg(F.sum("seen").alias("n_seen"))


def vantage_scores(grid: DataFrame, candidates: DataFrame, cell: float, stride: int, near_m: float, far_m: float, eye: float = 1.7, target: float = 1.0, value: str = "z", open_col: str | None = None, tile: int = TILE) -> DataFrame:
    """y, x, area_km2 and share seen of candidates (y, x), over targets at multiples of the stride from them within near to far; only cells that are ``open`` where a column is named.

    A task holds the heights of one tile and as far about it as candidates see, and the candidates of the tile.
    """
    reach = int(far_m / cell) // stride * stride
    steps = np.arange(-reach, reach + 1, stride)
    dx, dy = (a.ravel() for a in np.meshgrid(steps, steps))
    away = np.hypot(dx, dy) * cell
    ring = (away >= near_m) & (away <= far_m)
    dx, dy = dx[ring], dy[ring]
    far, n = np.hypot(dx, dy), np.ceil(np.hypot(dx, dy)).astype(int)
    side, halo = max(tile, reach), reach + 1
    size = _extent(grid, value)
    wanted = F.lit(1.0) if open_col is None else F.coalesce(F.col(open_col).cast("double"), F.lit(0.0))
    tiles = pack(grid.select("y", "x", F.col(value).alias("z"), wanted.alias("open")), ["z", "open"], halo, side)

    def score(key: tuple, job: pd.Series, own: pd.DataFrame) -> pd.DataFrame:
        z, free = plane(job["z"], side, halo), np.nan_to_num(plane(job["open"], side, halo)) > 0
        y0, x0 = key[0] * side - halo, key[1] * side - halo
        rows = []
        for y, x in zip(own["y"].tolist(), own["x"].tolist()):
            ty, tx = y + dy, x + dx
            at = np.flatnonzero((tx >= 0) & (ty >= 0) & (tx < size.width) & (ty < size.height))
            at = at[free[ty[at] - y0, tx[at] - x0]]
            start = z[y - y0, x - x0] + eye
            aim = z[ty[at] - y0, tx[at] - x0] + target - curvature_drop(far[at] * cell) - start
            hidden = np.zeros(len(at), bool)
            for s in range(1, int(n[at].max(initial=0))):
                live = np.flatnonzero(~hidden & (s < n[at]) & (far[at] >= 1.5))
                f = s / n[at[live]]
                px, py = size.clipped(x + dx[at[live]] * f, y + dy[at[live]] * f)
                hidden[live[bilinear(z, px - x0, py - y0) - curvature_drop(far[at[live]] * f * cell) > start + aim[live] * f]] = True
            seen = int((~hidden).sum())
            rows.append((y, x, seen * (stride * cell) ** 2 / 1e6, seen / max(1, len(at))))
        return pd.DataFrame(rows, columns=["y", "x", "area_km2", "share"])

    own = candidates.select("y", "x", tile_of("y", side).alias("ty"), tile_of("x", side).alias("tx"))
    return with_cells(tiles, own, ["ty", "tx"], score, "y int, x int, area_km2 double, share double")


def greedy_spaced(rows: list, place, apart: float, most: int) -> list:
    """Best first: keep a row if it is ``apart`` from all kept ones, up to ``most``. For rows that a top-k has bounded."""
    kept: list = []
    for r in rows:
        if len(kept) >= most:
            break
        y, x = place(r)
        if all(math.hypot(y - place(k)[0], x - place(k)[1]) > apart for k in kept):
            kept.append(r)
    return kept


def best_vantages(grid: DataFrame, candidates: DataFrame, cell: float, coarse: int = 3, top: int = 160, apart_m: float = 700.0, picks: int = 8, near_m: float = 300.0, far_m: float = 3000.0, open_col: str | None = None, tile: int = TILE) -> DataFrame:
    """rank, y, x, area_km2, share: coarse scores of all candidates over all ground, the ``top`` again at full density over open ground, then a spaced choice.

    With ``open_col`` only candidates on open ground are taken on. The driver sees the ``top``.
    """
    first = vantage_scores(grid, candidates, cell, coarse, near_m, far_m, tile=tile)
    if open_col is not None:
        first = first.join(grid.where(F.col(open_col)).select("y", "x"), ["y", "x"], "left_semi")
    first = materialise(first.orderBy(F.desc("area_km2"), "y", "x").limit(top), "vantages")
    rows = vantage_scores(grid, first, cell, 1, near_m, far_m, open_col=open_col, tile=tile).orderBy(F.desc("area_km2"), "y", "x").limit(top).collect()
    kept = greedy_spaced(rows, lambda r: (r["y"], r["x"]), apart_m / cell, picks)
    return grid.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(kept, 1)], "rank int, y int, x int, area_km2 double, share double")


def kernel_smooth(points: DataFrame, cells: DataFrame, value: str, reach: int = 10, variance: float = 9.0) -> DataFrame:
    """Gaussian weighted mean of scattered scores (y, x, value) at cells, cut at ``reach`` cells; points are dealt to the tiles they touch."""
    size = 2 * reach + 1
    tile = lambda c: F.floor(F.col(c) / size)
    spread = points.select(F.col("y").alias("_py"), F.col("x").alias("_px"), F.col(value).alias("_v"))
    for axis in ("y", "x"):
        spread = spread.withColumn(f"_t{axis}", F.explode(F.sequence(F.floor((F.col(f"_p{axis}") - reach) / size), F.floor((F.col(f"_p{axis}") + reach) / size))))
    met = cells.select("y", "x", tile("y").alias("_ty"), tile("x").alias("_tx")).join(spread, ["_ty", "_tx"])
    d2 = F.pow(F.col("_py") - F.col("y"), F.lit(2)) + F.pow(F.col("_px") - F.col("x"), F.lit(2))
    w = F.exp(-d2 / (2 * variance))
    near = met.where(d2 <= reach * reach)
    return near.groupBy("y", "x").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias(value))


def ray_steps(longest: float) -> np.ndarray:
    """Distances in cells of a ray whose steps grow."""
    out, d = [], 1.5
    while d < longest:
        out.append(d)
        d += 1 + 0.02 * d
    return np.array(out)


def _shaded(z0: np.ndarray, y: np.ndarray, x: np.ndarray, ground: np.ndarray, there: tuple[int, int], tile: tuple[int, int], beam: tuple[float, float, float], steps: np.ndarray, cell: float, size: _Extent) -> np.ndarray:
    """Which cells the ground of the tile at ``there`` shades at one of the steps from a beam (east, north, rise).

    Cells are asked for as long as they are lit, their way passes the tile, and under a rising beam no longer than until it is above all ground.
    """
    east, north, rise = beam
    dark = np.zeros(len(y), bool)
    if not len(steps):
        return dark
    passes = np.ones(len(y), bool)
    for at, way, place, side in ((y, -north, there[0], tile[0]), (x, east, there[1], tile[1])):
        ends = at + way * steps[0], at + way * steps[-1]
        passes &= (np.maximum(*ends) >= place * side - 1) & (np.minimum(*ends) <= (place + 1) * side + 1)
    lit = np.flatnonzero(passes)
    for d in steps:
        px, py = x[lit] + east * d, y[lit] - north * d
        height = z0[lit] + 1 + d * cell * rise + curvature_drop(d * cell)
        low = height <= size.top
        over = np.flatnonzero(low & (px >= 0) & (py >= 0) & (px <= size.width - 1) & (py <= size.height - 1))
        cx, cy = size.clipped(px[over], py[over])
        on = _in_tile(cx, cy, *there, tile)
        over = over[on]
        under = over[_sampled(ground, cx[on], cy[on], *there, tile) > height[over]]
        dark[lit[under]] = True
        keep = low if rise > 0 else np.ones(len(lit), bool)
        keep[under] = False
        lit = lit[keep]
        if not len(lit):
            break
    return dark


def sun_exposure(grid: DataFrame, sun: list[tuple[float, float, float]], cell: float, step_hours: float, value: str = "z", tile: int = TILE) -> DataFrame:
    """y, x, first, last (hours of the first and last sample lit, null if never) and hours lit; ``sun`` holds (hour, azimuth, altitude).

    The grid carries nx, ny, nz: slopes that face away are dark without a ray. A tile meets each tile that lies towards the sun from it, for the samples
    for which it does, as far as ground may still stand above the beam; a task has two tiles. Tiles are no wider or longer than the grid.
    """
    size = _extent(grid, value)
    rows, columns = area = min(tile, size.height), min(tile, size.width)
    planes = ["z", "nx", "ny", "nz"]
    tiles = materialise(pack(grid.select("y", "x", F.col(value).alias("z"), "nx", "ny", "nz"), planes, 1, area), "tiles")
    beams = []
    for _, azimuth, altitude in sun:
        az, al = math.radians(azimuth), math.radians(altitude)
        rise = math.tan(al)
        across = math.hypot(size.height, size.width)
        beams.append((math.sin(az), math.cos(az), rise, al, min(across, (size.top - size.low) / (cell * rise)) if rise > 0 else across))
    spans = [(k, east, -north, reach) for k, (east, north, _, _, reach) in enumerate(beams)]
    dealt = tiles.select("ty", "tx", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(e).alias("dx"), F.lit(s).alias("dy"), F.lit(r).alias("reach")) for k, e, s, r in spans))).alias("_b")).select("ty", "tx", "_b.*")
    middle = lambda c: (F.col(c) + 0.5) * (rows if c.endswith("y") else columns)
    ends = dealt.withColumns({"_ey": middle("ty") + F.col("dy") * F.col("reach"), "_ex": middle("tx") + F.col("dx") * F.col("reach")})
    for axis, side in zip("yx", area):
        here, there = F.col(f"t{axis}"), tile_of(f"_e{axis}", side)
        ends = ends.withColumn(f"r{axis}", F.explode(F.sequence(F.least(here, there) - 1, F.greatest(here, there) + 1)))
    on_way = ends.where(_near_line(middle("ty"), middle("tx"), F.col("_ey"), F.col("_ex"), middle("ry"), middle("rx")) <= math.hypot(rows, columns) + 2)
    pairs = on_way.groupBy("ty", "tx", "ry", "rx").agg(F.sort_array(F.collect_set("k")).alias("samples"))
    pairs = pairs.join(tiles.select("ty", "tx", "z"), ["ty", "tx"]).join(tiles.select(F.col("ty").alias("ry"), F.col("tx").alias("rx"), F.col("z").alias("ground")), ["ry", "rx"])
    steps = ray_steps(math.hypot(size.height, size.width))

    def shade(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        z, ground = plane(row["z"], area, 1)[1:-1, 1:-1], plane(row["ground"], area, 1)
        y, x = np.nonzero(~np.isnan(z))
        z0, y_, x_ = z[y, x], y + key[0] * rows, x + key[1] * columns
        nearest = math.hypot(*(max(abs(key[i + 2] - key[i]) - 1, 0) * area[i] for i in (0, 1)))
        farthest = math.hypot(*((abs(key[i + 2] - key[i]) + 1) * area[i] for i in (0, 1)))
        out = []
        for k in row["samples"]:
            east, north, rise, _, reach = beams[k]
            asked = steps[(steps >= nearest - 1) & (steps <= min(farthest, reach) + 1)]
            dark = _shaded(z0, y_, x_, ground, (key[2], key[3]), area, (east, north, rise), asked, cell, size)
            whole = np.zeros(area, bool)
            whole[y, x] = dark
            if dark.any():
                out.append((key[0], key[1], int(k), np.packbits(whole).tobytes()))
        return pd.DataFrame(out, columns=["ty", "tx", "k", "hidden"])

    shadows = pairs.groupBy("ty", "tx", "ry", "rx").applyInPandas(shade, "ty int, tx int, k int, hidden binary")

    def expose(key: tuple, job: pd.Series, found: pd.DataFrame) -> pd.DataFrame:
        z, nx, ny, nz = (plane(job[c], area, 1)[1:-1, 1:-1] for c in planes)
        y, x = np.nonzero(~np.isnan(z))
        first, last, n = np.full(len(y), np.nan), np.full(len(y), np.nan), np.zeros(len(y))
        for k, (hour, _, _) in enumerate(sun):
            east, north, _, al, _ = beams[k]
            facing = nx[y, x] * east * math.cos(al) + ny[y, x] * north * math.cos(al) + nz[y, x] * math.sin(al)
            lit = (facing > 0) & ~_any(found["hidden"][found["k"] == k], area)[y, x]
            first = np.where(lit & np.isnan(first), hour, first)
            last = np.where(lit, hour, last)
            n += lit
        return pd.DataFrame({"y": y + key[0] * rows, "x": x + key[1] * columns, "first": first, "last": last, "hours": n * step_hours})

    out = with_cells(tiles, shadows, ["ty", "tx"], expose, "y int, x int, first double, last double, hours double")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("first", "last")})


def wind_shelter(grid: DataFrame, wind_from: float, reach_m: float, cell: float, width: int, height: int, value: str = "z", tile: int = TILE) -> DataFrame:
    """y, x, shelter: mean over five rays about the wind of the largest upward angle within reach; null for a cell without a value.

    A task holds a tile and what rays reach about it. Samples that lack one of their four cells don't count.
    """
    steps = math.ceil(reach_m / cell)
    halo = steps + 2
    rays = [(math.sin(math.radians(wind_from + off)), math.cos(math.radians(wind_from + off))) for off in (-15.0, -7.5, 0.0, 7.5, 15.0)]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = key[0] * tile - halo, key[1] * tile - halo
        z = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        z[pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0] = pdf["z"].to_numpy(float)
        y, x = np.nonzero(~np.isnan(z[halo:-halo, halo:-halo]))
        z0, y, x = z[y + halo, x + halo], y + key[0] * tile, x + key[1] * tile
        total, n = np.zeros(len(y)), np.zeros(len(y))
        for east, north in rays:
            steepest = np.full(len(y), -np.inf)
            for s in range(1, steps + 1):
                px, py = np.clip(x + east * s, 0.0, width - 1.001), np.clip(y - north * s, 0.0, height - 1.001)
                rise = (bilinear(z, px - x0, py - y0) - z0) / (s * cell)
                steepest = np.fmax(steepest, rise)
            met = steepest > -np.inf
            total[met] += np.degrees(np.arctan(steepest[met]))
            n += met
        with np.errstate(invalid="ignore"):
            return pd.DataFrame({"y": y, "x": x, "shelter": total / n})

    cells = touched(grid.where(F.col(value).isNotNull()).select(F.col("y").cast("int"), F.col("x").cast("int"), F.col(value).cast("double").alias("z")), halo, tile)
    out = cells.groupBy("ty", "tx").applyInPandas(run, "y int, x int, shelter double").withColumn("shelter", F.nanvl("shelter", F.lit(None).cast("double")))
    return out.unionByName(grid.where(F.col(value).isNull()).select(F.col("y").cast("int"), F.col("x").cast("int"), F.lit(None).cast("double").alias("shelter")))


#: Halvings between the last step above the ground and the first below.
PICK_HALVINGS = 18


def pick_distances(cell: float, far: float) -> list[float]:
    """Metres along a picking ray at which the ground is asked: steps grow with the distance."""
    out, t, step = [], 0.0, max(8.0, cell * 0.5)
    while t < far:
        out.append(t)
        t += step
        step = max(8.0, min(60.0, t * 0.004 + cell * 0.4))
    return out


#: Rays that a task takes over one tile, and steps that it works out at once.
RAYS_A_TASK, STEPS_AT_ONCE = 20_000, 500_000


def ray_pick(picks: DataFrame, grid: DataFrame, width: int, height: int, cell: float, value: str = "z", key: str = "id", tile: int = TILE) -> DataFrame:
    """key, t, px, py, z: where rays (ox, oy in cells, oz in metres, dx, dy, dz a direction in metres) first go under the ground; t in metres, null with the rest if they don't.

    A ray is marched until it is under; a ray that has come over the grid and leaves it, or comes over a cell without a value, hits nothing. The crossing is halved between the
    last two steps. Rays are dealt to the tiles that they pass, those of a tile in parts of some ``RAYS_A_TASK``; each tile says over which steps it has ground below a ray and which is the first under it. Where
    the whole grid has values, rays are dealt no further than down to its lowest ground.
    """
    kind = dict(picks.dtypes)[key]
    valued, low = grid.where(F.col(value).isNotNull()).agg(F.count(F.lit(1)), F.min(value)).first()
    rays = picks.select(key, *(F.col(c).cast("double") for c in ("ox", "oy", "oz", "dx", "dy", "dz")))
    steepest = rays.agg(F.max(F.greatest(F.abs("dx"), F.abs("dy")))).first()[0] or 0.0
    longest = 60.0  # metres of the longest step
    halo = int(longest * steepest / cell) + 3
    far = np.array(pick_distances(cell, max(width, height) * cell * 3))

    def slab(axis: str, most: int) -> tuple[Column, Column]:
        """Metres at which a ray comes over the cells 0 to most and at which it leaves them."""
        ends = [F.try_divide((v - F.col(f"o{axis}")) * cell, F.col(f"d{axis}")) for v in (F.lit(0.0), F.lit(float(most)))]
        over = F.col(f"o{axis}").between(0, most)
        return F.coalesce(F.least(*ends), F.when(over, F.lit(0.0)).otherwise(F.lit(math.inf))), F.coalesce(F.greatest(*ends), F.when(over, F.lit(math.inf)).otherwise(F.lit(-math.inf)))

    (x_in, x_out), (y_in, y_out) = slab("x", width - 1), slab("y", height - 1)
    spans = rays.withColumns({"_in": F.greatest(x_in, y_in, F.lit(0.0)) - 1, "_out": F.least(x_out, y_out, F.lit(float(far[-1]) if len(far) else 0.0)) + 1})
    if valued == width * height:
        down = F.when(F.col("dz") < 0, F.greatest(F.try_divide(F.lit(float(low)) - F.col("oz"), F.col("dz")), F.col("_in")) + longest + 2)
        spans = spans.withColumn("_out", F.least("_out", down))
    spans = spans.where("_in <= _out")
    at = lambda axis, t: F.col(f"o{axis}") + F.col(f"d{axis}") * F.col(t) / cell
    dealt = spans.withColumns({f"_{axis}{n}": at(axis, t) for axis in "yx" for n, t in enumerate(("_in", "_out"))})
    for axis, most in (("y", height - 1), ("x", width - 1)):
        first, last = F.least(f"_{axis}0", f"_{axis}1") - 2, F.greatest(f"_{axis}0", f"_{axis}1") + 2
        edge = lambda c, most=most: tile_of(F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most))), tile)
        dealt = dealt.withColumn(f"t{axis}", F.explode(F.sequence(edge(first), edge(last))))
    middle = lambda c: (F.col(c) + 0.5) * tile
    dealt = dealt.where(_near_line(F.col("_y0"), F.col("_x0"), F.col("_y1"), F.col("_x1"), middle("ty"), middle("tx")) <= 0.7072 * tile + 4).select(key, "ox", "oy", "oz", "dx", "dy", "dz", "_in", "_out", "ty", "tx")
    parts = dealt.groupBy("ty", "tx").agg(F.ceil(F.count(F.lit(1)) / RAYS_A_TASK).cast("int").alias("_parts"))
    dealt = dealt.join(F.broadcast(parts), ["ty", "tx"]).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    tiles = pack(grid.select("y", "x", F.col(value).alias("z")), ["z"], halo, tile)
    jobs = tiles.join(parts, ["ty", "tx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select("part", "ty", "tx", "z")

    def pick(place: tuple, job: pd.Series, own: pd.DataFrame) -> pd.DataFrame:
        ground = plane(job["z"], tile, halo)
        x0, y0 = place[2] * tile - halo, place[1] * tile - halo
        ox, oy, oz, dx, dy, dz, start, end = (own[c].to_numpy() for c in ("ox", "oy", "oz", "dx", "dy", "dz", "_in", "_out"))
        for o, d, first in ((ox, dx, place[2] * tile), (oy, dy, place[1] * tile)):
            with np.errstate(divide="ignore", invalid="ignore"):
                ends = np.array([(first - 1 - o) * cell / d, (first + tile + 1 - o) * cell / d])
            start = np.where(d == 0, start, np.fmax(start, ends.min(0)))
            end = np.where(d == 0, end, np.fmin(end, ends.max(0)))
        i0, i1 = np.searchsorted(far, start - 1), np.searchsorted(far, end + 1)
        n = np.maximum(i1 - i0, 0)

        def under(r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """For rays at metres: whether there is ground, whether they are under it, and the cell (y, x) it lies in."""
            px, py = ox[r] + dx[r] * t / cell, oy[r] + dy[r] * t / cell
            over = (px >= 0) & (px <= width - 1) & (py >= 0) & (py <= height - 1)
            gx, gy = np.minimum(np.floor(np.where(over, px, 0.0)), width - 2).astype(int), np.minimum(np.floor(np.where(over, py, 0.0)), height - 2).astype(int)
            held = over & (gx >= max(x0, 0)) & (gx < x0 + tile + 2 * halo - 1) & (gy >= max(y0, 0)) & (gy < y0 + tile + 2 * halo - 1)
            j, i = np.where(held, gy - y0, 0), np.where(held, gx - x0, 0)
            u, v = px - gx, py - gy
            g = (ground[j, i] * (1 - u) + ground[j, i + 1] * u) * (1 - v) + (ground[j + 1, i] * (1 - u) + ground[j + 1, i + 1] * u) * v
            known = held & ~np.isnan(g)
            return known, known & (oz[r] + dz[r] * t <= g), gy, gx

        out, many = [], np.cumsum(n)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(many, np.arange(STEPS_AT_ONCE, many[-1] if len(many) else 0, STEPS_AT_ONCE)) + 1, [len(n)]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            r = np.repeat(np.arange(a, b), n[a:b])
            i = np.arange(len(r)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b]) + i0[r]
            known, hit, gy, gx = under(r, far[i])
            here = known & (gy // tile == place[1]) & (gx // tile == place[2])
            r, i, hit = r[here], i[here], hit[here]
            if not len(r):
                continue
            # steps of a ray stand together and in order
            whose, begin = np.unique(r, return_index=True)
            never = np.iinfo(np.int64).max
            first_hit = np.minimum.reduceat(np.where(hit, i, never), begin)
            steps = np.add.reduceat((i <= np.repeat(first_hit, np.diff(np.append(begin, len(r))))).astype(int), begin)
            struck = first_hit < never
            hits = np.where(struck, first_hit, 0)
            t0, t1 = np.where(hits > 0, far[hits - 1], 0.0), far[hits]
            for _ in range(PICK_HALVINGS):
                t = (t0 + t1) / 2
                below = under(whose, t)[1]
                t0, t1 = np.where(below, t0, t), np.where(below, t, t1)
            out.append(pd.DataFrame({key: own[key].to_numpy()[whose], "_first": i[begin], "_n": steps, "_hit": pd.array(np.where(struck, first_hit, 0), "Int64"), "t": t1}).assign(_hit=lambda f, struck=struck: f["_hit"].where(struck), t=lambda f, struck=struck: f["t"].where(struck)))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in (key, "_first", "_n", "_hit", "t")})

    told = with_cells(jobs, dealt, ["part", "ty", "tx"], pick, f"{key} {kind}, _first long, _n long, _hit long, t double")
    # steps over ground follow one another until the ray leaves it: what is missing before the hit ended the march
    by_ray = told.groupBy(key).agg(F.min("_first").alias("_came"), F.min(F.when(F.col("_hit").isNotNull(), F.struct("_hit", "t"))).alias("_h"), F.collect_list(F.struct("_first", "_n")).alias("_runs"))
    before = F.aggregate(F.filter("_runs", lambda run: run["_first"] <= F.col("_h._hit")), F.lit(0).cast("long"), lambda s, run: s + run["_n"])
    hits = by_ray.where(F.col("_h").isNotNull()).where(before == F.col("_h._hit") - F.col("_came") + 1).select(key, F.col("_h.t").alias("t"))
    spot = rays.join(hits, key).select(key, "t", (F.col("ox") + F.col("dx") * F.col("t") / cell).alias("px"), (F.col("oy") + F.col("dy") * F.col("t") / cell).alias("py"), (F.col("oz") + F.col("dz") * F.col("t")).alias("z"))
    return picks.select(key).join(spot, key, "left")


def profile_points(pairs: DataFrame, samples: Column | int, key: str = "id") -> DataFrame:
    """Points (key, seq, px, py) at even steps of the straight line from (ox, oy) to (tx, ty), both ends included."""
    n = samples if isinstance(samples, Column) else F.lit(samples)
    each = pairs.withColumn("_n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    f = F.col("seq") / F.col("_n")
    return each.select(key, "seq", (F.col("ox") + (F.col("tx") - F.col("ox")) * f).alias("px"), (F.col("oy") + (F.col("ty") - F.col("oy")) * f).alias("py"))
