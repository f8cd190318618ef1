"""Facts about places: discs and extremes around them, snow dates, layers laid over each other, labels that don't overlap."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import View, bearing, haversine
from . import raster, vector
from .tiles import TILE, tile_of, touched


def seen_area(view: DataFrame, seen: str, cell: float) -> DataFrame:
    """share and km2 of the seen cells (1) among those that have a verdict (0 or 1); the share is null if none has."""
    return view.agg(F.try_divide(F.sum(seen), F.count(seen)).alias("share"), (F.coalesce(F.sum(seen), F.lit(0)) * (cell * cell / 1e6)).alias("km2"))


def highest_within(points: DataFrame, grid: DataFrame, value: str, metres: float, cell: float, view: View, tile: int = TILE) -> DataFrame:
    """id, z, bearing and metres of the highest cell (the first in row-major order of equals) within a disc of whole cells around the cell (y, x) of each place.

    A task holds the cells of a tile and as far about it as discs reach, and the cells of the tile that have a place, each once however many places it has.
    """
    reach = int(metres / cell)
    disc = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1) if dy * dy + dx * dx <= reach * reach]
    spots = points.where("y IS NOT NULL AND x IS NOT NULL").select(F.col("y").cast("int"), F.col("x").cast("int")).distinct()
    cells = touched(grid.where(F.col(value).isNotNull()).select(F.col("y").cast("int"), F.col("x").cast("int"), F.col(value).cast("double").alias("v")), reach, tile)

    def run(key: tuple, own: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        heights = np.full((tile + 2 * reach, tile + 2 * reach), np.nan)
        heights[about["y"].to_numpy() - key[0] * tile + reach, about["x"].to_numpy() - key[1] * tile + reach] = about["v"].to_numpy()
        y, x = own["y"].to_numpy(), own["x"].to_numpy()
        best, at_y, at_x = np.full(len(own), np.nan), y.copy(), x.copy()
        for dy, dx in disc:
            near = heights[y + dy - key[0] * tile + reach, x + dx - key[1] * tile + reach]
            better = (near > best) | (np.isnan(best) & ~np.isnan(near))
            best[better], at_y[better], at_x[better] = near[better], y[better] + dy, x[better] + dx
        found = ~np.isnan(best)
        return pd.DataFrame({"y": y[found], "x": x[found], "_v": best[found], "_hy": at_y[found], "_hx": at_x[found]})

    dealt = spots.withColumns({"ty": tile_of("y", tile), "tx": tile_of("x", tile)})
    tops = dealt.groupBy("ty", "tx").cogroup(cells.groupBy("ty", "tx")).applyInPandas(run, "y int, x int, _v double, _hy int, _hx int")
    best = points.join(tops, ["y", "x"]).groupBy("id", "lon", "lat").agg(F.max(F.struct(F.col("_v").alias("v"), (-F.col("_hy")).alias("ny"), (-F.col("_hx")).alias("nx"))).alias("_b"))
    lon, lat = view.lonlat(-F.col("_b.nx") + 0.5, -F.col("_b.ny") + 0.5)
    at = best.withColumns({"_lon": lon, "_lat": lat})
    here, there = (F.col("lon"), F.col("lat")), (F.col("_lon"), F.col("_lat"))
    return at.select("id", F.col("_b.v").cast(dict(grid.dtypes)[value]).alias("z"), bearing(*here, *there).alias("bearing"), haversine(*here, *there).alias("metres"))


def cover_about(cells: DataFrame, name: str, is_open: str, y: int, x: int, metres: float, cell: float) -> DataFrame:
    """name (the most frequent in a disc of whole cells; of equals the last by name), open (at least half of the cells are) and n."""
    near = raster.disc(cells, y, x, int(metres / cell))
    kinds = near.groupBy(name).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(is_open).cast("int")).alias("_o"))
    return kinds.agg(F.max(F.struct("_n", name))[name].alias("name"), (F.sum("_o") * 2 >= F.sum("_n")).alias("open"), F.sum("_n").alias("n"))


def snow_by_winter(layers: DataFrame, places: DataFrame) -> DataFrame:
    """id, winter, first, uncertainty and lasting of each place and winter: layers (winter, y, x, first, unc, lasting) count days from 31 December of the winter's first year.

    A missing or not-a-number day is null; so is the uncertainty of a missing first day.
    """
    day = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("int"))
    base = F.make_date(F.col("winter"), F.lit(12), F.lit(31))
    met = places.select("id", "y", "x").join(layers, ["y", "x"])
    return met.select("id", F.format_string("%d-%d", F.col("winter"), F.col("winter") + 1).alias("winter"), F.date_add(base, day("first")).alias("first"), F.when(day("first").isNotNull(), F.col("unc")).alias("unc"), F.date_add(base, day("lasting")).alias("lasting"))


def snow_span(winters: DataFrame, most_uncertain: float = 15.0, year: int = 2026) -> DataFrame:
    """id, earliest and latest first snow of all winters that are certain, folded onto one autumn as days after 31 August of the year of the date."""
    sure = winters.where(F.col("first").isNotNull() & (F.col("unc") <= most_uncertain))
    folded = F.datediff("first", F.make_date(F.year("first"), F.lit(8), F.lit(31)))
    base = F.make_date(F.lit(year), F.lit(8), F.lit(31))
    return sure.groupBy("id").agg(F.date_add(base, F.min(folded)).alias("earliest"), F.date_add(base, F.max(folded)).alias("latest"))


def first_index(df: DataFrame, order: str, found: Column) -> DataFrame:
    """How many rows stand before the first one that meets a condition, in an order; null if none does. One aggregate, then one count; no sort."""
    first = df.agg(F.min(F.when(found, F.col(order))).alias("_first"))
    return df.join(F.broadcast(first)).agg(F.when(F.max("_first").isNotNull(), F.count_if(F.col(order) < F.col("_first"))).alias("at"))


def share_from(bands: DataFrame, edge: Column, up: bool = False, band: int = 100) -> DataFrame:
    """Share of the bands at or above the one that holds an edge, or (``up``) of those wholly at or above it."""
    least = (F.ceil(edge / band) if up else F.floor(edge / band)) * band
    return bands.agg(F.coalesce(F.sum(F.when(F.col("band") >= least, F.col("share"))), F.lit(0.0)).alias("share"))


def share_named(shares: DataFrame, name: str, part: str) -> DataFrame:
    return shares.agg(F.coalesce(F.sum(F.when(F.contains(F.col(name), F.lit(part)), F.col("share"))), F.lit(0.0)).alias("share"))


def by_group(items: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """How many items each of the listed groups has, zero included; items of other groups are left out."""
    listed = items.sparkSession.createDataFrame(list(enumerate(groups)), f"seq int, {group} string")
    counts = items.where(F.col(group).isin(*groups)).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return listed.join(counts, group, "left").select("seq", group, F.coalesce("n", F.lit(0)).alias("n"))


def deepest_open(saddles: DataFrame, depth: str = "depth", order: str = "seq") -> DataFrame:
    """The deepest open saddle, the last of equals."""
    best = saddles.where("open").agg(F.max_by(F.struct(*saddles.columns), F.struct(depth, order)).alias("_b"))
    return best.where("_b IS NOT NULL").select("_b.*")


def window_of_box(view: View, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Struct (x0, y0, x1, y1) of the cells of a grid that cover a box, clamped to it; the ends are exclusive."""
    (x0, y0), (x1, y1) = view.pixel(west, north), view.pixel(east, south)
    held = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most)).cast("int")
    return F.struct(held(F.floor(x0), view.width).alias("x0"), held(F.floor(y0), view.height).alias("y0"), held(F.ceil(x1), view.width).alias("x1"), held(F.ceil(y1), view.height).alias("y1"))


def view_grid(spark, view: View, source: DataFrame, value: str, source_view: View) -> DataFrame:
    """y, x, value of every cell of a view, bilinear in another grid at the cell's middle."""
    cells = spark.range(view.width * view.height).select("id", (F.col("id") % view.width).cast("int").alias("x"), F.floor(F.col("id") / view.width).cast("int").alias("y"))
    lon, lat = view.lonlat(F.col("x") + 0.5, F.col("y") + 0.5)
    px, py = source_view.pixel(lon, lat)
    placed = cells.withColumns({"px": px - 0.5, "py": py - 0.5})
    return raster.sample_bilinear(placed, source, value, source_view.width, source_view.height, out=value).select("y", "x", value)


def aligned(grid: DataFrame, layer: DataFrame, value: str, size: tuple[int, int], layer_size: tuple[int, int]) -> DataFrame:
    """The grid with the layer's nearest value at the middle of each cell; both cover the same box, sizes are (width, height). Null where the layer has none."""
    (w, h), (lw, lh) = size, layer_size
    placed = grid.withColumns({"_px": (F.col("x") + 0.5) * lw / w, "_py": (F.col("y") + 0.5) * lh / h})
    return raster.sample_nearest(placed, layer, value, "_px", "_py", value).drop("_px", "_py")


def sample_bands(points: DataFrame, scene: DataFrame, bands: tuple[str, ...], width: int, height: int) -> DataFrame:
    """id and all bands, bilinear around positions whose cells have their middle at half; null where any of the four cells misses any band (0) or lies outside.

    One join by place fetches all bands of a corner.
    """
    x, y = F.col("px") - 0.5, F.col("py") - 0.5
    inside = (x >= 0) & (y >= 0) & (x < width - 1) & (y < height - 1)
    fx, fy = x - F.floor(x), y - F.floor(y)
    corner = lambda i, j: F.struct((F.floor(x) + i).cast("int").alias("x"), (F.floor(y) + j).cast("int").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
    near = points.where(inside).select("id", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("_c")).select("id", "_c.*")
    met = near.join(scene.select("y", "x", *bands).where(F.least(*map(F.col, bands)) > 0), ["y", "x"])
    sums = met.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), *(F.sum(F.col(b) * F.col("w")).alias(b) for b in bands)).where("_n = 4").drop("_n")
    return points.select("id").join(sums, "id", "left")


def blit(base: DataFrame, top: DataFrame, value: str, ox: int, oy: int) -> DataFrame:
    """The base with the cells of another raster in place of its own from (ox, oy) on; what lies outside the base is cut off."""
    moved = top.select((F.col("y") + oy).cast("int").alias("y"), (F.col("x") + ox).cast("int").alias("x"), F.lit(True).alias("_hit"), F.col(value).alias("_top"))
    return base.join(moved, ["y", "x"], "left").withColumn(value, F.when(F.col("_hit"), F.col("_top")).otherwise(F.col(value))).drop("_hit", "_top")


def resized_rgb(picture: DataFrame, width: int, height: int, to_width: int, to_height: int, bands: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Bilinear resize of all bands at once, edges held."""
    spark = picture.sparkSession
    hold = lambda v, n: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(n - 1)))
    cells = spark.range(to_width * to_height).select((F.col("id") % to_width).cast("int").alias("x"), F.floor(F.col("id") / to_width).cast("int").alias("y"))
    placed = cells.withColumns({"fx": hold((F.col("x") + 0.5) * width / to_width - 0.5, width), "fy": hold((F.col("y") + 0.5) * height / to_height - 0.5, height)})
    tx, ty = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
    corner = lambda i, j: F.struct(F.least(F.floor("fx") + i, F.lit(width - 1)).cast("int").alias("sx"), F.least(F.floor("fy") + j, F.lit(height - 1)).cast("int").alias("sy"), ((tx if i else 1 - tx) * (ty if j else 1 - ty)).alias("w"))
    near = placed.select("y", "x", F.explode(F.array(*(corner(i, j) for i in (0, 1) for j in (0, 1)))).alias("_c")).select("y", "x", "_c.*")
    met = near.join(picture.select(F.col("y").alias("sy"), F.col("x").alias("sx"), *bands), ["sy", "sx"])
    return met.groupBy("y", "x").agg(*(F.sum(F.col(b) * F.col("w")).alias(b) for b in bands))


def topo_tint(cells: DataFrame, value: str, shade: str, blur: int, flat: float, depth: float = 0.62, light: tuple[float, float, float] = (252.0, 250.0, 244.0), low: float = 1700.0, span: float = 1400.0, most: float = 0.35) -> DataFrame:
    """r, g, b: the class colour (columns r, g, b) lightened with height, blurred over a square, then shaded."""
    share = F.least(F.greatest((F.col(value) - low) / span, F.lit(0.0)), F.lit(most))
    lit = cells.withColumns({b: raster.over(F.col(b), F.lit(to), share) for b, to in zip("rgb", light)})
    soft = reduce(lambda t, b: raster.box_blur(t, b, blur), "rgb", lit)
    return soft.select("y", "x", *(raster.shade_colour(F.col(b), F.col(shade), flat, depth).alias(b) for b in "rgb"))


#: The grey of ground without a value.
GREY = (236.0, 236.0, 232.0)


def over_relief(colour: Column, alpha: float) -> Column:
    """[r, g, b]: grey mixed with a colour, or grey where the colour is null."""
    return F.array(*(F.coalesce(raster.over(F.lit(g), colour[i], F.lit(alpha)), F.lit(g)) for i, g in enumerate(GREY)))


def edge_distance(rings: Column, lon: Column, lat: Column) -> Column:
    """Metres from a place to the nearest edge of any ring."""

    def gap(p: Column, q: Column) -> Column:
        return vector.segment_distance(*vector.plane(p["lon"], p["lat"], lon, lat), *vector.plane(q["lon"], q["lat"], lon, lat))[0]

    return F.array_min(F.transform(rings, lambda ring: F.array_min(F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), gap))))


def not_holding(polygons: DataFrame, lon: float, lat: float) -> DataFrame:
    """fid and metres of every polygon that doesn't hold a place, however far; one pass over the polygons, without a join."""
    at = F.lit(lon), F.lit(lat)
    return polygons.where(~vector.in_rings(F.col("rings"), *at)).select("fid", edge_distance(F.col("rings"), *at).alias("metres"))


def lettered_line(points: DataFrame, lines: DataFrame, area: str, least_km2: float, metres: float = 400.0) -> DataFrame:
    """id, fid and metres of the nearest line that drains at least an area and passes closer than a distance; the first of equals."""
    wide = lines.where(F.col(area) >= least_km2)
    return vector.nearest_within(points, wide, metres).where(F.col("metres") < metres).select("id", "fid", "metres")


def label_points(polygons: DataFrame, box: tuple[float, float, float, float], n: int, apart: float, least: float = 900.0, parts: int = 14) -> DataFrame:
    """fid, rank, lon, lat, score: up to n well separated points inside both polygon and sheet, those farthest from edges first.

    Candidates are the inner points of a lattice over the sheet, (parts - 1) squared for a polygon, so the list that is folded has a fixed bound. The score is the
    distance to the polygon's edge or 1.5 times that to the sheet's, whichever is less; equal ones keep the lattice's order.
    """
    west, south, east, north = box
    spots = polygons.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((parts - 1) ** 2 - 1))))
    lon = west + (east - west) * (F.col("_k") % (parts - 1) + 1) / parts
    lat = south + (north - south) * (F.floor(F.col("_k") / (parts - 1)) + 1) / parts
    inside = spots.withColumns({"lon": lon, "lat": lat}).where(vector.in_rings(F.col("rings"), F.col("lon"), F.col("lat")))
    sheet = F.least(F.least(F.col("lon") - west, east - F.col("lon")) * 65000.0, F.least(F.col("lat") - south, north - F.col("lat")) * 111000.0)
    scored = inside.withColumn("score", F.round(F.least(edge_distance(F.col("rings"), F.col("lon"), F.col("lat")), sheet * 1.5), 6)).where(F.col("score") >= least)
    listed = scored.groupBy("fid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "_k", "lon", "lat"))).alias("_c"))

    def take(kept: Column, c: Column) -> Column:
        free = F.forall(kept, lambda o: haversine(o["lon"], o["lat"], c["lon"], c["lat"]) > apart)
        return F.when((F.size(kept) < n) & free, F.concat(kept, F.array(c))).otherwise(kept)

    chosen = listed.select("fid", F.aggregate("_c", F.slice("_c", 1, 0), take).alias("_c"))
    return chosen.select("fid", F.posexplode("_c").alias("rank", "_p")).select("fid", "rank", "_p.lon", "_p.lat", (-F.col("_p.s")).alias("score"))


def placed_labels(labels: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Labels (sheet, rank, west, south, east, north) that overlap none placed before, by rank: each sheet's boxes are folded in order.

    A sheet is a page, whose labels are few; sheets are dealt over tasks. Boxes that only touch don't overlap.
    """
    listed = labels.groupBy(sheet).agg(F.array_sort(F.collect_list(F.struct("rank", "west", "south", "east", "north"))).alias("_l"))

    def take(kept: Column, c: Column) -> Column:
        hit = F.exists(kept, lambda o: (c["west"] < o["east"]) & (c["east"] > o["west"]) & (c["south"] < o["north"]) & (c["north"] > o["south"]))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(c)))

    return listed.select(sheet, F.explode(F.aggregate("_l", F.slice("_l", 1, 0), take)).alias("_p")).select(sheet, "_p.*")


def height_order(grid: DataFrame, value: str, step: float = 10.0) -> DataFrame:
    """The grid with ``rank`` from 0, highest first, then row-major: counts of bands of heights give each band its start, ranks inside follow in the band's own window."""
    banded = grid.where(F.col(value).isNotNull()).withColumn("_band", F.floor(F.col(value) / step))
    counts = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.orderBy(F.desc("_band"))) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_band").orderBy(F.desc(value), "y", "x"))
    return banded.join(starts, "_band").withColumn("rank", (F.col("_start") + inside - 1).cast("long")).drop("_band", "_start")


def all_places(*sources: DataFrame) -> DataFrame:
    """Rows of sources with different columns, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def two_point(pairs: DataFrame, cell: float, key: str = "id") -> DataFrame:
    """key, m and bearing from (ox, oy) to (tx, ty), in cells; as doubles, since squares of whole numbers overflow."""
    across, up = (F.col(a).cast("double") - F.col(b) for a, b in (("tx", "ox"), ("oy", "ty")))
    return pairs.select(key, (F.sqrt(across * across + up * up) * cell).alias("m"), ((F.degrees(F.atan2(across, up)) + 360) % 360).alias("bearing"))


def measured(profile: DataFrame, key: str, order: str, far: str, z: str) -> DataFrame:
    """Climb, descent, the path along the ground, rise and shot angle of profiles (metres from the start in ``far``); points without a height are left out."""
    known = profile.where(F.col(z).isNotNull())
    w = Window.partitionBy(key).orderBy(order)
    steps = known.withColumns({"_dz": F.col(z) - F.lag(z).over(w), "_dd": F.col(far) - F.lag(far).over(w)})
    out = steps.groupBy(key).agg(
        F.max(far).alias("metres"), F.coalesce(F.sum(F.greatest("_dz", F.lit(0.0))), F.lit(0.0)).alias("climb"), F.coalesce(F.sum(F.greatest(-F.col("_dz"), F.lit(0.0))), F.lit(0.0)).alias("descent"),
        F.sum(F.sqrt(F.col("_dz") * F.col("_dz") + F.col("_dd") * F.col("_dd"))).alias("path"), (F.max_by(z, order) - F.min_by(z, order)).alias("rise"),
    )
    return out.withColumn("shot", F.degrees(F.atan2("rise", "metres")))
