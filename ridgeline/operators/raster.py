"""Rasters as long tables (y, x, value): sampling, stencils, shading, focal means.

North is towards smaller y. A missing value is null. Stencils are two passes of lag and lead, along rows and along columns; a row or a column
of the grid is a window partition, so no task needs more than one row or column of it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_window():
    return Window.partitionBy("y").orderBy("x")


def column_window():
    return Window.partitionBy("x").orderBy("y")


def neighbours(df: DataFrame, value: str) -> DataFrame:
    """The table with the eight neighbours of each cell as columns nw n ne w e sw s se; outside the grid the nearest cell stands in.

    A neighbour that exists and is null stays null.
    """
    one = F.lit(1)
    along, down = row_window(), column_window()
    at_edge = lambda move, w, c: F.when(move(one).over(w).isNull(), F.col(c)).otherwise(move(c).over(w))
    wide = df.withColumns({"w": at_edge(F.lag, along, value), "e": at_edge(F.lead, along, value)})
    names = {"n": value, "nw": "w", "ne": "e"}
    out = {k: at_edge(F.lag, down, c) for k, c in names.items()} | {k.replace("n", "s", 1): at_edge(F.lead, down, c) for k, c in names.items()}
    return wide.withColumns(out)


def horn(df: DataFrame, value: str, cell: Column | float, flat: float = 1e-4) -> DataFrame:
    """Slope in degrees, aspect in degrees from north (-1 where flat) and the unit normal (nx, ny, nz) by Horn's weights."""
    c = lambda *names: sum(F.col(n) for n in names)
    wide = neighbours(df, value).withColumns({"_gx": (c("ne", "e", "e", "se") - c("nw", "w", "w", "sw")) / (8 * cell), "_gy": (c("nw", "n", "n", "ne") - c("sw", "s", "s", "se")) / (8 * cell)})
    gx, gy = F.col("_gx"), F.col("_gy")
    steep = F.sqrt(gx * gx + gy * gy)
    norm = F.sqrt(gx * gx + gy * gy + 1)
    out = wide.withColumns({
        "slope": F.degrees(F.atan(steep)),
        "aspect": F.when(steep < flat, F.lit(-1.0)).otherwise((F.degrees(F.atan2(-gx, -gy)) + 360) % 360),
        "nx": -gx / norm, "ny": -gy / norm, "nz": 1 / norm,
    })
    return out.drop("nw", "n", "ne", "w", "e", "sw", "s", "se", "_gx", "_gy")


def hillshade(azimuth: float, altitude: float, exaggeration: float = 1.0) -> Column:
    """Lambert shade from nx, ny, nz, floored at zero."""
    az, al = math.radians(azimuth), math.radians(altitude)
    x, y, z = F.col("nx") * exaggeration, F.col("ny") * exaggeration, F.col("nz")
    dot = x * (math.sin(az) * math.cos(al)) + y * (math.cos(az) * math.cos(al)) + z * math.sin(al)
    return F.greatest(F.lit(0.0), dot / F.sqrt(x * x + y * y + z * z))


#: Azimuth, altitude and share of the four lights.
RELIEF = ((315.0, 45.0, 0.55), (270.0, 40.0, 0.18), (0.0, 40.0, 0.18), (225.0, 35.0, 0.09))


def relief(exaggeration: float = 1.0) -> Column:
    return sum(share * hillshade(az, al, exaggeration) for az, al, share in RELIEF)


def cell_of(position: Column) -> Column:
    return F.floor(position).cast("int")


def sample_nearest(points: DataFrame, grid: DataFrame, value: str, px: str = "px", py: str = "py", out: str = "value") -> DataFrame:
    """The cell that holds each point; null outside."""
    keyed = points.withColumns({"_x": cell_of(F.col(px)), "_y": cell_of(F.col(py))})
    cells = grid.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(value).alias(out))
    return keyed.join(cells, ["_x", "_y"], "left").drop("_x", "_y")


def _weighted(points: DataFrame, grid: DataFrame, value: str, key: str, offsets: Column, out: str, whole: int) -> DataFrame:
    """Weighted sums of cells around each point; null unless all of them have values."""
    cells = grid.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(value).alias("_v"))
    near = points.select(key, F.explode(offsets).alias("_o")).select(key, F.col("_o.x").alias("_x"), F.col("_o.y").alias("_y"), F.col("_o.w").alias("_w"))
    sums = near.join(cells, ["_x", "_y"], "left").groupBy(key).agg(F.sum(F.col("_v") * F.col("_w")).alias("_s"), F.count("_v").alias("_n"))
    return points.join(sums.select(key, F.when(F.col("_n") == whole, F.col("_s")).alias(out)), key, "left")


def _offset(x: Column, y: Column, w: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("double").alias("w"))


def sample_bilinear(points: DataFrame, grid: DataFrame, value: str, width: int, height: int, key: str = "id", px: str = "px", py: str = "py", out: str = "value") -> DataFrame:
    """Bilinear between the four cells around a point; positions are clamped into the grid, to just under the last cell."""
    x = F.least(F.greatest(F.col(px), F.lit(0.0)), F.lit(width - 1.001))
    y = F.least(F.greatest(F.col(py), F.lit(0.0)), F.lit(height - 1.001))
    fx, fy = x - F.floor(x), y - F.floor(y)
    corners = F.array(*(_offset(F.floor(x) + i, F.floor(y) + j, (fx if i else 1 - fx) * (fy if j else 1 - fy)) for i in (0, 1) for j in (0, 1)))
    return _weighted(points, grid, value, key, corners, out, 4)


def _cubic(f: Column) -> list[Column]:
    """Catmull-Rom weights of the cells -1, 0, 1, 2."""
    return [
        -0.5 * f + f * f - 0.5 * f * f * f,
        1 - 2.5 * f * f + 1.5 * f * f * f,
        0.5 * f + 2 * f * f - 1.5 * f * f * f,
        -0.5 * f * f + 0.5 * f * f * f,
    ]


def sample_bicubic(points: DataFrame, grid: DataFrame, value: str, width: int, height: int, key: str = "id", px: str = "px", py: str = "py", out: str = "value") -> DataFrame:
    """Catmull-Rom over 4 x 4 cells, centres at half cells, edges clamped; null beyond one cell outside."""
    x, y = F.col(px) - 0.5, F.col(py) - 0.5
    wx, wy = _cubic(x - F.floor(x)), _cubic(y - F.floor(y))
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    taps = F.array(*(_offset(clamp(F.floor(x) + i - 1, width), clamp(F.floor(y) + j - 1, height), wx[i] * wy[j]) for i in range(4) for j in range(4)))
    inside = (x >= -1) & (y >= -1) & (x <= width) & (y <= height)
    return _weighted(points, grid, value, key, F.when(inside, taps), out, 16)


def sample_layer(points: DataFrame, grid: DataFrame, value: str, width: int, height: int, key: str = "id", px: str = "px", py: str = "py", out: str = "value") -> DataFrame:
    """Bilinear where all four cells have values, else the nearest cell; null at the border."""
    inside = (F.col(px) >= 0) & (F.col(py) >= 0) & (F.col(px) < width - 1) & (F.col(py) < height - 1)
    both = sample_nearest(sample_bilinear(points, grid, value, width, height, key, px, py, "_four"), grid, value, px, py, "_one")
    return both.withColumn(out, F.when(inside, F.coalesce("_four", "_one"))).drop("_four", "_one")


def resize(grid: DataFrame, value: str, width: int, height: int, to_width: int, to_height: int) -> DataFrame:
    """Bilinear onto another grid over the same box."""
    spark = grid.sparkSession
    cells = spark.range(to_width * to_height).select(F.col("id"), (F.col("id") % to_width).cast("int").alias("x"), F.floor(F.col("id") / to_width).cast("int").alias("y"))
    placed = cells.withColumns({"px": (F.col("x") + 0.5) * width / to_width - 0.5, "py": (F.col("y") + 0.5) * height / to_height - 0.5})
    return sample_bilinear(placed, grid, value, width, height, out=value).select("y", "x", value)


def box_blur(grid: DataFrame, value: str, radius: int) -> DataFrame:
    """Mean of a square, separable, cut off at the edges."""
    along = row_window().rowsBetween(-radius, radius)
    down = column_window().rowsBetween(-radius, radius)
    return grid.withColumn("_b", F.avg(value).over(along)).withColumn(value, F.avg("_b").over(down)).drop("_b")


def focal_mean(grid: DataFrame, value: str, radius: int, out: str = "mean") -> DataFrame:
    """Mean of the (2 radius + 1) square cut off at the grid, at a cost that doesn't depend on the radius: differences of running sums."""
    upto = Window.unboundedPreceding
    run, n = F.sum(value).over(row_window().rowsBetween(upto, 0)), F.count(value).over(row_window().rowsBetween(upto, 0))
    table = grid.withColumns({"_rs": run, "_rn": n})
    last, first = F.last, F.first
    ahead = row_window().rowsBetween(0, radius)
    behind = row_window()
    strip = table.withColumns({
        "_s": last("_rs").over(ahead) - F.coalesce(F.lag("_rs", radius + 1).over(behind), F.lit(0)),
        "_n": last("_rn").over(ahead) - F.coalesce(F.lag("_rn", radius + 1).over(behind), F.lit(0)),
    })
    strip = strip.withColumns({"_rs": F.sum("_s").over(column_window().rowsBetween(upto, 0)), "_rn": F.sum("_n").over(column_window().rowsBetween(upto, 0))})
    ahead, behind = column_window().rowsBetween(0, radius), column_window()
    total = last("_rs").over(ahead) - F.coalesce(F.lag("_rs", radius + 1).over(behind), F.lit(0))
    count = last("_rn").over(ahead) - F.coalesce(F.lag("_rn", radius + 1).over(behind), F.lit(0))
    return strip.withColumn(out, F.try_divide(total, count)).drop("_rs", "_rn", "_s", "_n")


def tpi(grid: DataFrame, value: str, radius: int, out: str = "tpi") -> DataFrame:
    """Height over the mean of its surroundings, scaled by mean and deviation over the whole grid (one row, bounded, cross-joined as a scalar)."""
    raw = focal_mean(grid, value, radius, "_mean").withColumn("_d", F.col(value) - F.col("_mean"))
    whole = raw.agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_sd"))
    return raw.join(F.broadcast(whole)).withColumn(out, F.try_divide(F.col("_d") - F.col("_m"), F.col("_sd"))).drop("_mean", "_d", "_m", "_sd")


def landform(small: Column, large: Column, slope: Column) -> Column:
    """Class 1 to 10 from two position indices and the slope."""
    low, high = large <= -1, large >= 1
    hollow = F.when(low, 1).when(high, 3).otherwise(2)
    level = F.when(low, 4).when(high, 7).when(slope <= 5, 5).otherwise(6)
    raised = F.when(low, 8).when(high, 10).otherwise(9)
    return F.when(small <= -1, hollow).when(small >= 1, raised).otherwise(level)


#: The eight moves in row-major order: name, dx, dy.
MOVES = (("nw", -1, -1), ("n", 0, -1), ("ne", 1, -1), ("w", -1, 0), ("e", 1, 0), ("sw", -1, 1), ("s", 0, 1), ("se", 1, 1))


def steepest_descent(grid: DataFrame, value: str, cell: float) -> DataFrame:
    """The table with ``to_y``, ``to_x`` and ``drop`` (per metre) of the steepest lower neighbour, the first in row-major order on ties; null in a pit."""
    wide = neighbours(grid, value)
    options = [F.struct(((F.col(value) - F.col(k)) / (cell * math.hypot(dx, dy))).alias("drop"), F.lit(-i).alias("order"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (k, dx, dy) in enumerate(MOVES)]
    # outside the grid a clamped neighbour is another cell of the border, which an inner move reaches as well or better
    best = F.array_max(F.filter(F.array(*options), lambda o: o["drop"] > 0))
    inside = wide.withColumn("_o", best)
    return inside.withColumns({"to_y": F.col("y") + F.col("_o.dy"), "to_x": F.col("x") + F.col("_o.dx"), "drop": F.col("_o.drop")}).drop("_o", *(k for k, _, _ in MOVES))


def ramp(value: Column, stops: list[tuple[float, tuple[int, int, int]]], stepped: bool = False) -> Column:
    """Colour [r, g, b] of a value: between stops, or that of the last stop reached."""
    colour = lambda c: F.array(*(F.lit(float(v)) for v in c))
    out = colour(stops[-1][1])
    for (a, c), (b, d) in reversed(list(zip(stops, stops[1:]))):
        share = (value - a) / (b - a)
        between = colour(c) if stepped else F.array(*(x + (y - x) * share for x, y in zip(map(float, c), map(float, d))))
        out = F.when(value < b, between).otherwise(out)
    return F.when(value < stops[0][0], colour(stops[0][1])).otherwise(out)


def shade_colour(channel: Column, shade: Column, flat: float, depth: float) -> Column:
    """Darker below the shade of flat ground, lighter above it by at most 0.6."""
    dark = channel * (1 - depth * (flat - shade) / flat)
    light = channel + (255 - channel) * F.least(F.lit(0.6), depth * (shade - flat) / (1 - flat))
    return F.when(shade < flat, dark).otherwise(light)


def over(base: Column, top: Column, alpha: Column) -> Column:
    return base + (top - base) * alpha


def tone(reflectance: Column, gamma: float = 0.46) -> Column:
    return F.pow(F.least(F.greatest(reflectance, F.lit(0.0)), F.lit(1.0)), F.lit(gamma))


def rasterise(lines: DataFrame, key: str = "line_id") -> DataFrame:
    """Cells (line id, y, x) on polylines (seq, px, py): each segment in max(|dx|, |dy|) steps."""
    w = Window.partitionBy(key).orderBy("seq")
    ends = lines.withColumns({"_qx": F.lead("px").over(w), "_qy": F.lead("py").over(w)}).where("_qx IS NOT NULL")
    dx, dy = F.col("_qx") - F.col("px"), F.col("_qy") - F.col("py")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(dx), F.abs(dy)))).cast("int")
    along = ends.withColumn("_n", steps).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("_t") / F.col("_n")
    return along.select(key, cell_of(F.col("py") + (F.col("_qy") - F.col("py")) * share).alias("y"), cell_of(F.col("px") + (F.col("_qx") - F.col("px")) * share).alias("x")).distinct()


def buffer_cells(cells: DataFrame, reach: int) -> DataFrame:
    """Cells within a square of ``reach`` of any cell."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return cells.select(F.col("y"), F.explode(span).alias("_d"), "x").select((F.col("y") + F.col("_d")).alias("y"), F.col("x"), F.explode(span).alias("_e")).select("y", (F.col("x") + F.col("_e")).alias("x")).distinct()


def split_at_mask(points: DataFrame, mask: DataFrame, key: str = "line_id") -> DataFrame:
    """Runs of two points or more of a polyline outside a mask: (line id, run, seq, ...). Gaps and islands."""
    w = Window.partitionBy(key).orderBy("seq")
    hit = points.join(mask.select("y", "x").distinct().withColumn("_m", F.lit(1)), ["y", "x"], "left")
    runs = hit.withColumn("run", F.sum(F.coalesce("_m", F.lit(0))).over(w)).where("_m IS NULL").drop("_m")
    return runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key, "run"))).where("_n >= 2").drop("_n")


def disc(grid: DataFrame, y: int, x: int, radius: float) -> DataFrame:
    """Cells within a radius, in cells."""
    dy, dx = F.col("y") - y, F.col("x") - x
    reach = math.ceil(radius)
    box = F.col("y").between(y - reach, y + reach) & F.col("x").between(x - reach, x + reach)
    return grid.where(box & (dx * dx + dy * dy <= radius * radius))


def mosaic(scenes: DataFrame, bands: tuple[str, ...], offset_col: str = "offset_applied") -> DataFrame:
    """First clear scene wins per cell, by rank; zero is missing; scenes without their offset get -1000, held within 1 to 65535."""
    fixed = scenes.where(F.array_min(F.array(*map(F.col, bands))) > 0)
    shifted = fixed.withColumns({b: F.least(F.greatest(F.when(F.col(offset_col), F.col(b)).otherwise(F.col(b) - 1000), F.lit(1)), F.lit(65535)) for b in bands})
    best = shifted.groupBy("y", "x").agg(F.min(F.struct("rank", *bands)).alias("_b"))
    return best.select("y", "x", F.col("_b.rank").alias("rank"), *(F.col(f"_b.{b}").alias(b) for b in bands))


def local_high(points: DataFrame, grid: DataFrame, value: str, reach: int) -> DataFrame:
    """The highest cell within ``reach`` of each candidate (y, x), the first in row-major order on ties: candidates meet cells by tiles."""
    size = 2 * reach + 1
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    near = points.withColumn("_ty", F.explode(F.sequence(F.floor((F.col("y") - reach) / size), F.floor((F.col("y") + reach) / size)))).withColumn(
        "_tx", F.explode(F.sequence(F.floor((F.col("x") - reach) / size), F.floor((F.col("x") + reach) / size)))
    )
    cells = grid.select(F.col("y").alias("_y"), F.col("x").alias("_x"), F.col(value).alias("_v"), tile("y").cast("long").alias("_ty"), tile("x").cast("long").alias("_tx"))
    met = near.join(cells, ["_ty", "_tx"]).where((F.abs(F.col("_y") - F.col("y")) <= reach) & (F.abs(F.col("_x") - F.col("x")) <= reach))
    best = met.groupBy("y", "x").agg(F.max(F.struct(F.col("_v").alias("v"), (-F.col("_y")).alias("ny"), (-F.col("_x")).alias("nx"))).alias("_b"))
    return best.select("y", "x", (-F.col("_b.ny")).alias("high_y"), (-F.col("_b.nx")).alias("high_x"), F.col("_b.v").alias("high"))
