"""Vector predicates and spatial joins. Features are (fid, seq within the layer, rings or pts, props); points are (id, lon, lat).

Joins of points with features go through tiles of the plane: a feature is dealt to the tiles its box touches, a point to its own, so neither
side is broadcast or crossed, and a large feature is split over its tiles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEAN_RADIUS_M, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON
from ..storage import discard, materialise

TILE_DEGREES = 0.1


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_rings(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd over all rings, so holes are outside."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)
        nexts = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, F.least(n, F.lit(1))))
        cross = F.zip_with(ring, nexts, lambda p, q: ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]))
        return F.size(F.filter(cross, lambda c: F.coalesce(c, F.lit(False))))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, c: s + c) % 2 == 1


def bounds(points: Column) -> Column:
    """Box of an array of (lon, lat)."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"))


def _tiles(box: Column, size: float) -> Column:
    span = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(span(box["west"], box["east"]), lambda x: F.transform(span(box["south"], box["north"]), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def containing(points: DataFrame, polygons: DataFrame, tile: float = TILE_DEGREES) -> DataFrame:
    """All (point columns, fid, seq, props) pairs where the polygon holds the point."""
    dealt = polygons.withColumn("_box", bounds(F.flatten("rings"))).withColumn("_t", F.explode(_tiles(F.col("_box"), tile))).withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")}).drop("_t")
    keyed = points.withColumns({"_tx": F.floor(F.col("lon") / tile), "_ty": F.floor(F.col("lat") / tile)})
    met = keyed.join(dealt, ["_tx", "_ty"]).where(in_box_of(F.col("lon"), F.col("lat"), F.col("_box")))
    return met.where(in_rings(F.col("rings"), F.col("lon"), F.col("lat"))).drop("_tx", "_ty", "_box", "rings")


def in_box_of(lon: Column, lat: Column, box: Column) -> Column:
    return lon.between(box["west"], box["east"]) & lat.between(box["south"], box["north"])


def first_containing(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points with fid and props of the first polygon, in the order of the layer, that holds them; null if none does. What holds a point goes by its place, so ids may repeat or be null."""
    places = points.select("lon", "lat").distinct()
    best = containing(places, polygons).groupBy("lon", "lat").agg(F.min(F.struct("seq", "fid")).alias("_b")).select("lon", "lat", F.col("_b.fid").alias("fid"))
    return points.join(best, ["lon", "lat"], "left").select(*points.columns, "fid")


def inside_any(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points that some polygon holds (semi join, by place)."""
    held = containing(points.select("lon", "lat").distinct(), polygons).select("lon", "lat").distinct()
    return points.join(held, ["lon", "lat"], "left_semi").select(*points.columns)


def outside_all(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """Points that no polygon holds (anti join, by place), those without a place included."""
    held = containing(points.select("lon", "lat").distinct(), polygons).select("lon", "lat").distinct()
    return points.join(held, ["lon", "lat"], "left_anti").select(*points.columns)


def plane(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin, on the local plane."""
    return (lon - lon0) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE_LAT


def segment_distance(ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Distance of the origin from a segment, and the foot point."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    fx, fy = ax + t * dx, ay + t * dy
    return F.sqrt(fx * fx + fy * fy), fx, fy


def line_segments(lines: DataFrame, key: str = "fid") -> DataFrame:
    """(fid, n, lon1, lat1, lon2, lat2) of lines with arrays ``pts``."""
    at = lines.select(key, F.posexplode("pts").alias("n", "p"))
    w = Window.partitionBy(key).orderBy("n")
    return at.select(key, "n", F.col("p.lon").alias("lon1"), F.col("p.lat").alias("lat1"), F.lead("p.lon").over(w).alias("lon2"), F.lead("p.lat").over(w).alias("lat2")).where("lon2 IS NOT NULL")


def _near_segments(points: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """Points beside each segment whose box, grown by the distance, holds them, with the distance _d and the foot _fx, _fy on a plane around the point.

    Boxes are dealt to tiles about as large as the distance. How many degrees of longitude that is follows from the latitude farthest from the equator
    that a point within the distance can have; next to a pole a box goes all around. Boxes are tested before any distance is worked out. A segment goes the short way round:
    one that crosses the 180th meridian, or whose box does, is dealt to both sides of it.
    """
    short = F.when(F.col("lon2") - F.col("lon1") > 180, F.col("lon2") - 360).when(F.col("lon2") - F.col("lon1") < -180, F.col("lon2") + 360).otherwise(F.col("lon2"))
    segments = segments.withColumn("lon2", short)
    size = metres / METRES_PER_DEGREE_LAT
    farthest = F.greatest(F.abs("lat1"), F.abs("lat2")) + size
    wide = F.when(farthest < 89.9, metres / (METRES_PER_DEGREE_LON * F.cos(F.radians(farthest))) * (1 + 1e-9)).otherwise(360.0)
    edges = {"west": F.least("lon1", "lon2") - wide, "south": F.least("lat1", "lat2") - size, "east": F.greatest("lon1", "lon2") + wide, "north": F.greatest("lat1", "lat2") + size}
    turned = segments.withColumns({f"_{name}": c for name, c in edges.items()}).withColumn("_turn", F.explode(F.array(*(F.lit(t) for t in (0.0, 360.0, -360.0)))))
    turned = turned.withColumns({"lon1": F.col("lon1") + F.col("_turn"), "lon2": F.col("lon2") + F.col("_turn"), "_west": F.greatest(F.col("_west") + F.col("_turn"), F.lit(-180.0)), "_east": F.least(F.col("_east") + F.col("_turn"), F.lit(180.0))})
    boxed = turned.where("_west <= _east").withColumn("_box", F.struct(*(F.col(f"_{name}").alias(name) for name in edges))).drop("_turn", *(f"_{name}" for name in edges))
    tile = max(size, 0.01)
    dealt = boxed.withColumn("_t", F.explode(_tiles(F.col("_box"), tile))).withColumns({"_tx": F.col("_t.tx"), "_ty": F.col("_t.ty")}).drop("_t")
    met = points.withColumns({"_tx": F.floor(F.col("lon") / tile), "_ty": F.floor(F.col("lat") / tile)}).join(dealt, ["_tx", "_ty"])
    met = met.where(F.col("lon").between(F.col("_box.west"), F.col("_box.east")) & F.col("lat").between(F.col("_box.south"), F.col("_box.north")))
    ax, ay = plane(F.col("lon1"), F.col("lat1"), F.col("lon"), F.col("lat"))
    bx, by = plane(F.col("lon2"), F.col("lat2"), F.col("lon"), F.col("lat"))
    d, fx, fy = segment_distance(ax, ay, bx, by)
    return met.withColumns({"_d": d, "_fx": fx, "_fy": fy}).where(F.col("_d") <= metres)


def _within_180(lon: Column) -> Column:
    return F.when(lon > 180, lon - 360).when(lon < -180, lon + 360).otherwise(lon)


def _spacing(spots: DataFrame, lon: str, lat: str) -> float:
    """Degrees of latitude of the side of a square that holds one of the spots, were they spread evenly over their box; 0 if there are none."""
    n, west, south, east, north = spots.agg(F.count(F.lit(1)), F.min(lon), F.min(lat), F.max(lon), F.max(lat)).first()
    if not n or None in (west, south, east, north):
        return 0.0
    return math.sqrt((east - west) * math.cos(math.radians((south + north) / 2)) * (north - south) / n)


def nearest_within(points: DataFrame, lines: DataFrame, metres: float) -> DataFrame:
    """id, fid, metres, bearing, foot_lon, foot_lat of the nearest line within a distance; ties by fid and segment.

    Places are looked up once each, and of segments that lie on one another the first is asked. The first round looks about as far as segments stand apart, each further one
    four times as far, for the places that have found none yet; so the pairs met grow with the places, not with the density of lines. Rounds are written to the shared folder.
    """
    ends = ["lon1", "lat1", "lon2", "lat2"]
    segments = line_segments(lines).groupBy(*ends).agg(F.min(F.struct("fid", "n")).alias("_f")).select(*ends, "_f.fid", "_f.n")
    segments = materialise(segments, "segments")
    rows = points.where("lon IS NOT NULL AND lat IS NOT NULL").select("id", "lon", "lat").distinct()
    left = rows.select("lon", "lat").distinct()
    far, found, passed = min(metres, max(metres / 4096, 3 * _spacing(segments, "lon1", "lat1") * METRES_PER_DEGREE_LAT)), [], []
    while True:
        near = _near_segments(left, segments, far)
        best = near.groupBy("lon", "lat").agg(F.min(F.struct(F.round("_d", 6).alias("metres"), "fid", "n", "_fx", "_fy")).alias("_b"))
        # at the very end of what was looked at there may be an equal one beyond
        found.append(materialise(best if far >= metres else best.where(F.col("_b.metres") < far - 1e-3), "nearest"))
        if far >= metres:
            break
        left = materialise(left.join(found[-1], ["lon", "lat"], "left_anti"), "left")
        passed.append(left)
        if left.isEmpty():
            break
        far = min(metres, 4 * far)
    discard(segments, *passed)
    best = rows.join(reduce(DataFrame.unionByName, found), ["lon", "lat"])
    east, north = F.col("_b._fx"), F.col("_b._fy")
    return best.select(
        "id", F.col("_b.fid").alias("fid"), F.col("_b.metres").alias("metres"), ((F.degrees(F.atan2(east, north)) + 360) % 360).alias("bearing"),
        _within_180(F.col("lon") + east / (METRES_PER_DEGREE_LON * F.cos(F.radians("lat")))).alias("foot_lon"), (F.col("lat") + north / METRES_PER_DEGREE_LAT).alias("foot_lat"),
    )


def boundary_lines(polygons: DataFrame) -> DataFrame:
    """Rings as closed lines (fid, pts), numbered by ring in ``part``."""
    ring = polygons.select("fid", F.posexplode("rings").alias("part", "_r"))
    return ring.select("fid", "part", F.concat("_r", F.slice("_r", 1, 1)).alias("pts"))


def distance_to_polygons(points: DataFrame, polygons: DataFrame, metres: float) -> DataFrame:
    """Of polygons that don't hold a point, those within a distance, nearest first: id, fid, metres."""
    lines = boundary_lines(polygons).select(F.concat_ws("/", F.col("fid").cast("string"), F.col("part").cast("string")).alias("_line"), "fid", "pts")
    segments = line_segments(lines.select(F.col("_line").alias("fid"), "pts")).withColumn("poly", F.substring_index("fid", "/", 1).cast("long")).drop("fid")
    near = _near_segments(points, segments, metres)
    held = containing(points, polygons).select("id", F.col("fid").alias("poly"))
    return near.groupBy("id", "poly").agg(F.round(F.min("_d"), 6).alias("metres")).join(held, ["id", "poly"], "left_anti").withColumnRenamed("poly", "fid")


def areal_share(spark, polygons: DataFrame, box: tuple[float, float, float, float], side: int = 40) -> DataFrame:
    """Share of a lattice of side x side points in the middle of equal parts of a box that any polygon holds."""
    west, south, east, north = box
    lattice = spark.range(side * side).select("id", (west + (F.col("id") % side + 0.5) * (east - west) / side).alias("lon"), (south + (F.floor(F.col("id") / side) + 0.5) * (north - south) / side).alias("lat"))
    held = containing(lattice, polygons).select("id").distinct().withColumn("_in", F.lit(1))
    return lattice.join(held, "id", "left").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("share"))


def touches_box(points: Column, box: tuple[float, float, float, float], margin: float = 0.02) -> Column:
    """Whether any vertex lies inside the grown box; on its border is outside."""
    west, south, east, north = (round(edge + grow, 9) for edge, grow in zip(box, (-margin, -margin, margin, margin)))  # -119.4 + 0.02 is not -119.38
    return F.exists(points, lambda p: (p["lon"] > west) & (p["lon"] < east) & (p["lat"] > south) & (p["lat"] < north))


def _at_least() -> Column:
    """Metres that a place (lon, lat) lies from any spot of a box (_min_lon, _max_lon, _min_lat, _max_lat), or less: the way along its meridian, or straight to the box's nearest meridian."""
    gap = lambda c: F.greatest(F.col(f"_min_{c}") - F.col(c), F.col(c) - F.col(f"_max_{c}"), F.lit(0.0))
    aside = F.asin(F.sin(F.radians(F.least(gap("lon"), F.lit(90.0)))) * F.cos(F.radians("lat")))
    return F.greatest(F.radians(gap("lat")), F.when(gap("lon") < 90, aside).otherwise(F.lit(0.0))) * MEAN_RADIUS_M * (1 - 1e-9)


#: Cells of a ring's reach and how many times larger than the smallest they are, one round after the other.
VERTEX_RINGS = ((1, 1), (4, 1), (16, 1), (16, 8), (16, 64))


def nearest_vertex(points: DataFrame, lines: DataFrame, cell: float = 0.02, rings: tuple[tuple[int, float], ...] = VERTEX_RINGS) -> DataFrame:
    """id, lon, lat, vertex_lon, vertex_lat, metres of the nearest vertex: rings of cells around the point until one holds a vertex that nothing outside can beat.

    Places without one get larger rings, of larger cells. Beyond the last ring (16 cells of 1.28 degrees, as parameters stand), and for a point without a place, the vertex is null.
    Places are looked up once each, and of vertices in one spot the first; where they stand close, smaller cells come before the rings. Places are joined back, so every row of points has its row, whatever its id. Only the ring's inner border bounds what is certain,
    in longitude that of the latitude where meridians are closest. Vertices near the 180th meridian stand on both sides of it. Rounds are written to the shared folder.
    """
    from ..functions.geodesy import haversine

    vertices = lines.select(F.posexplode("pts").alias("n", "p"), "fid").groupBy(F.col("p.lon").alias("vertex_lon"), F.col("p.lat").alias("vertex_lat")).agg(F.min(F.struct("fid", "n")).alias("_f"))
    vertices = materialise(vertices.where("vertex_lon IS NOT NULL AND vertex_lat IS NOT NULL").select("_f.fid", "_f.n", "vertex_lon", "vertex_lat"), "vertices")
    # where vertices stand close, cells that hold a few come first
    apart = 2 * _spacing(vertices, "vertex_lon", "vertex_lat") / cell
    fine = [apart * 4**i for i in range(6) if apart * 4**i < 0.6] if apart > 1e-3 else []
    rings = (*((1, larger) for larger in fine), *rings)
    left, found = points.where("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct(), []
    passed = []
    for reach, larger in rings:
        size = cell * larger
        seam = (reach + 1) * size
        copies = F.array_compact(F.array(F.lit(0.0), F.when(F.col("vertex_lon") < -180 + seam, 360.0), F.when(F.col("vertex_lon") > 180 - seam, -360.0)))
        keyed = vertices.withColumn("_lon", F.explode(F.transform(copies, lambda turn: F.col("vertex_lon") + turn))).withColumns({"_tx": F.floor(F.col("_lon") / size), "_ty": F.floor(F.col("vertex_lat") / size)})
        span = F.sequence(F.lit(-reach), F.lit(reach))
        around = left.withColumn("_dx", F.explode(span)).withColumn("_dy", F.explode(span)).withColumns({"_tx": F.floor(F.col("lon") / size) + F.col("_dx"), "_ty": F.floor(F.col("lat") / size) + F.col("_dy")})
        # one vertex of each cell says how far the nearest may lie at most; cells that lie farther aren't opened
        first = F.min(F.struct("vertex_lon", "vertex_lat"))
        cells = keyed.groupBy("_tx", "_ty").agg(first["vertex_lon"].alias("_one_lon"), first["vertex_lat"].alias("_one_lat"), *(f(c).alias(f"_{f.__name__}_{name}") for f in (F.min, F.max) for c, name in (("_lon", "lon"), ("vertex_lat", "lat"))))
        near = around.join(cells, ["_tx", "_ty"]).withColumns({"_most": haversine(F.col("lon"), F.col("lat"), F.col("_one_lon"), F.col("_one_lat")), "_least": _at_least()})
        bound = near.groupBy("lon", "lat").agg(F.min("_most").alias("_bound"))
        opened = near.join(bound, ["lon", "lat"]).where(F.col("_least") <= F.col("_bound") + 1e-3).select("lon", "lat", "_tx", "_ty")
        met = opened.join(keyed, ["_tx", "_ty"]).withColumn("_m", haversine(F.col("lon"), F.col("lat"), F.col("vertex_lon"), F.col("vertex_lat")))
        best = met.groupBy("lon", "lat").agg(F.min(F.struct(F.round("_m", 6).alias("metres"), "fid", "n", "vertex_lon", "vertex_lat")).alias("_b"))
        # where meridians are closest within the distance that is asked for
        pole = F.least(F.abs("lat") + F.col("_b.metres") / METRES_PER_DEGREE_LAT, F.lit(90.0))
        safe = reach * size * METRES_PER_DEGREE_LON * F.cos(F.radians(pole)) * 0.98
        found.append(materialise(best.where(F.col("_b.metres") <= safe).select("lon", "lat", "_b.vertex_lon", "_b.vertex_lat", "_b.metres"), "sure"))
        left = materialise(left.join(found[-1], ["lon", "lat"], "left_anti"), "left")
        passed.append(left)
        if left.isEmpty():
            break
    discard(vertices, *passed)
    done = found[0]
    for more in found[1:]:
        done = done.unionByName(more)
    return points.join(done, ["lon", "lat"], "left").select("id", "lon", "lat", "vertex_lon", "vertex_lat", "metres")


def interior_points(spark, polygons: DataFrame, lattice: int = 13, aspect_cap: float = 1.5) -> DataFrame:
    """fid, lon, lat, score: of a lattice over a polygon's box the inside point farthest from its edges, the first of equals."""
    boxed = polygons.withColumn("_b", bounds(F.flatten("rings")))
    spots = boxed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(lattice * lattice - 1))))
    lon = F.col("_b.west") + (F.col("_k") % lattice + 0.5) * (F.col("_b.east") - F.col("_b.west")) / lattice
    lat = F.col("_b.south") + (F.floor(F.col("_k") / lattice) + 0.5) * (F.col("_b.north") - F.col("_b.south")) / lattice
    inside = spots.withColumns({"lon": lon, "lat": lat}).where(in_rings(F.col("rings"), F.col("lon"), F.col("lat")))

    def edge_distance(ring: Column, x: Column, y: Column) -> Column:
        n = F.size(ring)
        nexts = F.concat(F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))

        def gap(p: Column, q: Column) -> Column:
            ax, ay = plane(p["lon"], p["lat"], x, y)
            bx, by = plane(q["lon"], q["lat"], x, y)
            return segment_distance(ax, ay, bx, by)[0]

        return F.array_min(F.zip_with(ring, nexts, gap))

    score = F.array_min(F.transform("rings", lambda r: edge_distance(r, F.col("lon"), F.col("lat"))))
    best = inside.withColumn("_s", F.round(score, 6)).groupBy("fid").agg(F.max(F.struct(F.col("_s").alias("score"), (-F.col("_k")).alias("k"), "lon", "lat")).alias("_m"))
    return best.select("fid", "_m.lon", "_m.lat", "_m.score")


def has_tag(props: Column, key: str, *values: str) -> Column:
    """Whether a property has one of the values, or any."""
    found = props[key]
    return found.isin(*values) if values else found.isNotNull()


def capped_names(features: DataFrame, taken: DataFrame, cap: int, rank: Column, name: str = "name") -> DataFrame:
    """Features whose name isn't taken, ``cap`` of a name at most, by rank."""
    free = features.join(taken.select(name).distinct(), name, "left_anti")
    return free.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(rank))).where(F.col("_r") <= cap).drop("_r")
