"""Named queries of facts about places, layers and labels, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import GRS80_A
from ..functions import astro, geodesy, text
from ..lookups import COVER, LANDFORMS, WEATHER, cover_table, landform_table, road_table, weather_table, with_lookup
from ..operators import places, raster, rays, stats, vector
from . import fixtures as fx
from .fixtures import CELL, HERE, SQL_COVER, SQL_DAYS, SQL_DEM, SQL_POINTS, WIDTH
from .queries import _FOOT, _INSIDE, _NAMES, _PAIRS, _PLANE, _SEGS, _bilinear_sql, _pairs, _sql_polygons, query, r

_AT = (15, 60)
_OPEN = "code NOT IN (0,1,2,5,6,18)"
_HAV = lambda x1, y1, x2, y2: f"2*6371008.8*asin(sqrt(pow(sin(radians({y2} - {y1})/2), 2) + cos(radians({y1}))*cos(radians({y2}))*pow(sin(radians({x2} - {x1})/2), 2)))"


@query(f"WITH {SQL_DEM}, v AS (SELECT CASE WHEN (x + y) % 13 <> 0 THEN CAST((x*7 + y*3) % 11 < 4 AS INT) END AS s FROM dem) SELECT round(sum(s)/count(s), 6) AS share, round(sum(s)*900/1e6, 6) AS km2 FROM v")
def s_seen_area(spark, d):
    """Share and area of seen ground; cells without a verdict don't count."""
    x, y = F.col("x"), F.col("y")
    view = fx.dem(spark, d).withColumn("seen", F.when((x + y) % 13 != 0, ((x * 7 + y * 3) % 11 < 4).cast("int")))
    return places.seen_area(view, "seen", CELL).select(r(F.col("share")).alias("share"), r(F.col("km2")).alias("km2"))


_GRID_VIEW = lambda h: geodesy.View(*fx.BOX, WIDTH, h)
_X0, _Y1, _DX, _ = geodesy.View(*fx.BOX, WIDTH, 1)._frame()
_TALL = geodesy.View(*fx.BOX, WIDTH, 1)._frame()[3]
_MIDDLE = lambda x, y: (f"degrees(({_X0!r}e0 + ({x} + 0.5)*{_DX!r}e0)/{GRS80_A})", f"degrees(2*atan(exp(({_Y1!r}e0 - ({y} + 0.5)*({_TALL!r}e0/h))/{GRS80_A})) - pi()/2)")


@query(f"""WITH {SQL_DEM}, {fx.SQL_POINTS.replace(fx.SQL_SIZE + ', ', '')}, p AS (SELECT id, lon, lat, CAST(floor(px) AS INT) AS x, CAST(floor(py) AS INT) AS y FROM pts), m AS (SELECT p.*, dem.x AS hx, dem.y AS hy, z, row_number() OVER (PARTITION BY id ORDER BY z DESC, dem.y, dem.x) AS i FROM p JOIN dem ON abs(dem.x - p.x) <= 10 AND abs(dem.y - p.y) <= 10 AND (dem.x - p.x)*(dem.x - p.x) + (dem.y - p.y)*(dem.y - p.y) <= 100),
  a AS (SELECT m.*, {_MIDDLE("hx", "hy")[0]} AS lon2, {_MIDDLE("hx", "hy")[1]} AS lat2 FROM m, size WHERE i = 1)
  SELECT id, z, round((degrees(atan2(sin(radians(lon2 - lon))*cos(radians(lat2)), cos(radians(lat))*sin(radians(lat2)) - sin(radians(lat))*cos(radians(lat2))*cos(radians(lon2 - lon)))) + 360) % 360, 4) AS bearing, round({_HAV("lon", "lat", "lon2", "lat2")}, 3) AS metres FROM a""")
def s_highest_within(spark, d):
    """The highest ground within 300 m of every place."""
    at = fx.points(spark, d).withColumns({"x": F.floor("px").cast("int"), "y": F.floor("py").cast("int")})
    out = places.highest_within(at, fx.dem(spark, d), "z", 300.0, CELL, _GRID_VIEW(fx.height(spark, d)))
    return out.select("id", "z", r(F.col("bearing"), 4).alias("bearing"), r(F.col("metres"), 3).alias("metres"))


@query(f"WITH {SQL_COVER}, k AS (SELECT {_NAMES} AS name, count(*) AS n, sum(CAST({_OPEN} AS INT)) AS o FROM cover WHERE (y - 15)*(y - 15) + (x - 60)*(x - 60) <= 100 GROUP BY 1) SELECT max_by(name, (n, name)) AS name, sum(o)*2 >= sum(n) AS open, CAST(sum(n) AS BIGINT) AS n FROM k")
def s_cover_about(spark, d):
    named = with_lookup(fx.cover(spark, d), cover_table(spark), "code", "code", {"name": "Other", "open": True})
    return places.cover_about(named, "name", "open", *_AT, 300.0, CELL)


_WINTERS = f"""{fx.SQL_SIZE}, pl AS (SELECT s_suppkey AS id, CAST((s_suppkey*7) % {WIDTH} AS INT) AS x, CAST((s_suppkey*11) % h AS INT) AS y FROM supplier, size),
  wi AS (SELECT id, w, CASE WHEN (w + x + y) % 5 <> 0 THEN (w*13 + x*3 + y*5) % 90 - 70 END AS f, (w*7 + x + y) % 30 AS unc, CASE WHEN (w + x) % 4 <> 0 THEN (w*11 + x + y) % 60 END AS l FROM pl, (SELECT CAST(unnest(range(2015, 2022)) AS INT) AS w)),
  sn AS (SELECT id, w || '-' || (w + 1) AS winter, make_date(w, 12, 31) + CAST(f AS INT) AS first, CASE WHEN f IS NOT NULL THEN unc END AS unc, make_date(w, 12, 31) + CAST(l AS INT) AS lasting FROM wi)"""


def _winters(spark, d):
    h, k = fx.height(spark, d), F.col("s_suppkey")
    at = fx.table(spark, d, "supplier").select(k.alias("id"), ((k * 7) % WIDTH).cast("int").alias("x"), ((k * 11) % h).cast("int").alias("y"))
    w, x, y = F.col("winter"), F.col("x"), F.col("y")
    nan = F.lit(float("nan"))
    layers = fx.dem(spark, d).withColumn("winter", F.explode(F.sequence(F.lit(2015), F.lit(2021)))).select(
        "winter", "y", "x", F.when((w + x + y) % 5 != 0, (w * 13 + x * 3 + y * 5) % 90 - 70).otherwise(nan).alias("first"), ((w * 7 + x + y) % 30).alias("unc"), F.when((w + x) % 4 != 0, (w * 11 + x + y) % 60).otherwise(nan).alias("lasting"),
    )
    return places.snow_by_winter(layers, at)


@query(f"WITH {_WINTERS} SELECT id, winter, CAST(first AS DATE) AS first, unc, CAST(lasting AS DATE) AS lasting FROM sn")
def s_snow_winters(spark, d):
    """First and lasting snow of each winter at each place."""
    return _winters(spark, d)


@query(f"WITH {_WINTERS}, f AS (SELECT id, date_diff('day', make_date(year(first), 8, 31), CAST(first AS DATE)) AS k FROM sn WHERE first IS NOT NULL AND unc <= 15) SELECT id, CAST(DATE '2026-08-31' + CAST(min(k) AS INT) AS DATE) AS earliest, CAST(DATE '2026-08-31' + CAST(max(k) AS INT) AS DATE) AS latest FROM f GROUP BY id")
def s_snow_span(spark, d):
    return places.snow_span(_winters(spark, d))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders WHERE month(o_orderdate) >= 9 AND year(o_orderdate) = 1995), n AS (SELECT make_date(1995, 11, 1) + CAST((7 - dayofweek(make_date(1995, 11, 1))) % 7 AS INT) AS stop), f AS (SELECT min(date) AS first FROM d, n WHERE date >= stop)
  SELECT CASE WHEN max(first) IS NOT NULL THEN count(*) FILTER (date < first) END AS at FROM d, f""")
def s_clock_change(spark, d):
    """Which day of an autumn's table is the first in winter time."""
    autumn = fx.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).where("month(date) >= 9 AND year(date) = 1995").distinct()
    return places.first_index(autumn.withColumn("zone", astro.mountain_zone(F.col("date"))), "date", F.col("zone") == "MST")


@query(f"""WITH {SQL_COVER}, b AS (SELECT floor(z/100)*100 AS band, count(*) AS n FROM dem GROUP BY 1), s AS (SELECT band, n/sum(n) OVER () AS share FROM b), k AS (SELECT {_NAMES} AS name, count(*) AS n FROM cover GROUP BY 1), f AS (SELECT name, n/sum(n) OVER () AS share FROM k)
  SELECT 'at or above 1650' AS what, round(sum(share) FILTER (band >= 1600), 6) AS share FROM s UNION ALL SELECT 'wholly above 1650', round(coalesce(sum(share) FILTER (band >= 1700), 0), 6) FROM s UNION ALL SELECT 'forest', round(sum(share) FILTER (name LIKE '%forest%'), 6) FROM f""")
def s_ground_shares(spark, d):
    """Ground from a band on, and forest by name."""
    bands = stats.height_bands(fx.dem(spark, d), "z")
    kinds = stats.shares(with_lookup(fx.cover(spark, d), cover_table(spark), "code", "code", {"name": "Other"}), "name")
    rows = (("at or above 1650", places.share_from(bands, F.lit(1650.0))), ("wholly above 1650", places.share_from(bands, F.lit(1650.0), up=True)), ("forest", places.share_named(kinds, "name", "forest")))
    return places.all_places(*(t.select(F.lit(name).alias("what"), r(F.col("share")).alias("share")) for name, t in rows))


_GROUPS = ("Brand#11", "Brand#32", "none", "Brand#55")


@query("WITH g AS (SELECT * FROM (VALUES (0, 'Brand#11'), (1, 'Brand#32'), (2, 'none'), (3, 'Brand#55')) v(seq, p_brand)) SELECT CAST(seq AS INT) AS seq, g.p_brand, count(part.p_brand) AS n FROM g LEFT JOIN part ON part.p_brand = g.p_brand GROUP BY 1, 2")
def s_by_group(spark, d):
    """Items of listed groups, in their order, zero included."""
    return places.by_group(fx.table(spark, d, "part"), "p_brand", list(_GROUPS))


@query("SELECT s_suppkey AS seq, CAST(s_suppkey * 37 % 50 AS BIGINT) AS depth FROM supplier WHERE s_suppkey % 3 = 0 ORDER BY 2 DESC, 1 DESC LIMIT 1")
def s_deepest_open(spark, d):
    """The deepest open saddle, the last of equals."""
    k = F.col("s_suppkey")
    saddles = fx.table(spark, d, "supplier").select(k.alias("seq"), (k * 37 % 50).alias("depth"), (k % 3 == 0).alias("open"))
    return places.deepest_open(saddles).select("seq", "depth")


def _cases(pairs, column):
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in pairs)


@query(f"""WITH {SQL_DAYS} SELECT id, {_cases(WEATHER, "id % 103")} ELSE 'Mixed' END AS words, {_cases(enumerate(LANDFORMS, 1), "id % 12")} ELSE '' END AS landform, {_cases(COVER, "id % 21")} ELSE 'Other' END AS cover, id % 21 NOT IN (0,1,2,5,6,18) AS open,
  CASE id % 4 WHEN 1 THEN 16 WHEN 2 THEN 40 ELSE 10 END AS tenths FROM days""")
def s_lookups(spark, d):
    """Weather, landform, cover with its open flag and road cost by their codes; unknown codes get defaults. Code 0 and those not listed keep the flag's own rule."""
    k = F.col("id")
    at = fx.days(spark, d).select("id", (k % 103).cast("int").alias("wmo"), (k % 12).cast("int").alias("form"), (k % 21).cast("int").alias("cov"), F.element_at(F.array(*map(F.lit, ("highway", "gravel", "track", "path"))), (k % 4 + 1).cast("int")).alias("road"))
    out = with_lookup(at, weather_table(spark).withColumnRenamed("code", "c1"), "wmo", "c1", {"words": "Mixed"})
    out = with_lookup(out, landform_table(spark).withColumnsRenamed({"id": "c2", "name": "landform"}), "form", "c2", {"landform": ""})
    out = with_lookup(out, cover_table(spark).withColumnsRenamed({"code": "c3", "name": "cover"}), "cov", "c3", {"cover": "Other"})
    out = with_lookup(out, road_table(spark).withColumnRenamed("kind", "c4"), "road", "c4", {"tenths": 10})
    return out.select("id", "words", "landform", "cover", F.coalesce("open", F.col("cov") != 0).alias("open"), "tenths")


_V = geodesy.View.of_box(fx.BOX, 30.0)
_VX0, _VY1, _VDX, _VDY = _V._frame()
_MX, _MY = f"({GRS80_A}*radians(%s) - ({_VX0!r}))/{_VDX!r}", f"({_VY1!r} - {GRS80_A}*ln(tan(pi()/4 + radians(%s)/2)))/{_VDY!r}"


@query(f"""WITH {SQL_POINTS}, b AS (SELECT id, {_MX % "(lon - 0.05)"} AS x0, {_MY % "(lat + 0.03)"} AS y0, {_MX % "(lon + 0.05)"} AS x1, {_MY % "(lat - 0.03)"} AS y1 FROM pts)
  SELECT id, CAST(least(greatest(floor(x0), 0), {_V.width}) AS INT) AS x0, CAST(least(greatest(floor(y0), 0), {_V.height}) AS INT) AS y0, CAST(least(greatest(ceil(x1), 0), {_V.width}) AS INT) AS x1, CAST(least(greatest(ceil(y1), 0), {_V.height}) AS INT) AS y1 FROM b""")
def s_box_window(spark, d):
    """The window of a grid that covers a box around each place, clamped."""
    lon, lat = F.col("lon"), F.col("lat")
    return fx.points(spark, d).select("id", places.window_of_box(_V, lon - 0.05, lat - 0.03, lon + 0.05, lat + 0.03).alias("w")).select("id", "w.*")


@query(f"""WITH {SQL_DEM}, cells AS (SELECT y * {WIDTH // 2} + x AS cid, y, x, (x + 0.5) * 2 - 0.5 AS px, (y + 0.5)*h/(h // 2) - 0.5 AS py FROM (SELECT CAST(unnest(range(h // 2)) AS INT) AS y, h FROM size), (SELECT CAST(unnest(range({WIDTH // 2})) AS INT) AS x)), {_bilinear_sql("cells", "cid")}
  SELECT y, x, round(v, 4) AS z FROM cells JOIN bil USING (cid)""")
def r_view_grid(spark, d):
    """Heights of a coarser view over the same box, by longitude and latitude of each cell."""
    h = fx.height(spark, d)
    return places.view_grid(spark, geodesy.View(*fx.BOX, WIDTH // 2, h // 2), fx.dem(spark, d), "z", _GRID_VIEW(h)).select("y", "x", r(F.col("z"), 4).alias("z"))


@query(f"""WITH {SQL_COVER} SELECT y, x, z, list_extract([1,2,5,6,8,10,13,14,16,18], (CAST(floor((x + 0.5)*50/{WIDTH}) AS INT)*7 + CAST(floor((y + 0.5)*40/h) AS INT)*3) % 10 + 1) AS code FROM dem, size""")
def j_aligned_layer(spark, d):
    """A coarse layer laid over the grid, cell by cell."""
    codes = F.array(*(F.lit(c) for c in (1, 2, 5, 6, 8, 10, 13, 14, 16, 18)))
    layer = spark.range(50 * 40).select(F.floor(F.col("id") / 50).cast("int").alias("y"), (F.col("id") % 50).cast("int").alias("x")).withColumn("code", F.element_at(codes, ((F.col("x") * 7 + F.col("y") * 3) % 10 + 1).cast("int")))
    return places.aligned(fx.dem(spark, d), layer, "code", (WIDTH, fx.height(spark, d)), (50, 40)).select("y", "x", "z", "code")


_BANDS = ("red", "green", "blue", "nir")
_BAND_SQL = ", ".join(f"CASE WHEN (x*{3 + k} + y*{7 - k}) % 41 = 0 THEN 0 ELSE (x*{13 + k} + y*{7 + k}) % 900 + 100 END AS {b}" for k, b in enumerate(_BANDS))


def _scene(spark, d):
    x, y = F.col("x"), F.col("y")
    return fx.dem(spark, d).select("y", "x", *(F.when((x * (3 + k) + y * (7 - k)) % 41 == 0, 0).otherwise((x * (13 + k) + y * (7 + k)) % 900 + 100).alias(b) for k, b in enumerate(_BANDS)))


@query(f"""WITH {SQL_DEM}, {fx.SQL_POINTS.replace(fx.SQL_SIZE + ', ', '')}, sc AS (SELECT y, x, {_BAND_SQL} FROM dem), p AS (SELECT id, px - 0.5 AS fx, py - 0.5 AS fy FROM pts), c AS (SELECT id, CAST(floor(fx) AS INT) + i AS x, CAST(floor(fy) AS INT) + j AS y,
  CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS w FROM p, size, (VALUES (0,0),(0,1),(1,0),(1,1)) k(i, j) WHERE fx >= 0 AND fy >= 0 AND fx < {WIDTH - 1} AND fy < h - 1),
  s AS (SELECT id, {", ".join(f"round(sum({b}*w), 6) AS {b}" for b in _BANDS)} FROM c JOIN sc USING (x, y) WHERE least({", ".join(_BANDS)}) > 0 GROUP BY id HAVING count(*) = 4) SELECT pts.id, {", ".join(_BANDS)} FROM pts LEFT JOIN s ON s.id = pts.id""")
def r_band_sample(spark, d):
    """Four bands at once; null where any corner misses any band."""
    out = places.sample_bands(fx.points(spark, d).select("id", "px", "py"), _scene(spark, d), _BANDS, WIDTH, fx.height(spark, d))
    return out.select("id", *(r(F.col(b)).alias(b) for b in _BANDS))


@query(f"WITH {SQL_DEM}, t AS (SELECT y + 5 AS y, x + 100 AS x, z + 1000 AS t FROM dem WHERE x < 40 AND y < 20) SELECT dem.y, dem.x, coalesce(t, z) AS z FROM dem LEFT JOIN t ON t.y = dem.y AND t.x = dem.x")
def r_blit(spark, d):
    grid = fx.dem(spark, d)
    return places.blit(grid, grid.where("x < 40 AND y < 20").withColumn("z", F.col("z") + 1000), "z", 100, 5).select("y", "x", "z")


@query(f"""WITH {SQL_DEM}, sc AS (SELECT y, x, {_BAND_SQL} FROM dem), p AS (SELECT y, x, least(greatest((x + 0.5)*{WIDTH}/200e0 - 0.5, 0), {WIDTH - 1}) AS fx, least(greatest((y + 0.5)*h/20e0 - 0.5, 0), h - 1) AS fy, h FROM size, (SELECT CAST(unnest(range(20)) AS INT) AS y), (SELECT CAST(unnest(range(200)) AS INT) AS x)),
  c AS (SELECT y AS ty, x AS tx, least(CAST(floor(fx) AS INT) + i, {WIDTH - 1}) AS x, least(CAST(floor(fy) AS INT) + j, h - 1) AS y, CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END * CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END AS w FROM p, (VALUES (0,0),(0,1),(1,0),(1,1)) k(i, j))
  SELECT ty AS y, tx AS x, round(sum(red*w), 6) AS red, round(sum(green*w), 6) AS green, round(sum(blue*w), 6) AS blue FROM c JOIN sc USING (x, y) GROUP BY 1, 2""")
def r_resize_rgb(spark, d):
    out = places.resized_rgb(_scene(spark, d), WIDTH, fx.height(spark, d), 200, 20, _BANDS[:3])
    return out.select("y", "x", *(r(F.col(b)).alias(b) for b in _BANDS[:3]))


_TINT = "code*9 + 40 AS r, code*5 + 100 AS g, code*3 + 150 AS b"


def _blur_sql(c):
    return f"avg({c}) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {c}", f"avg({c}) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS {c}"


@query(f"""WITH {SQL_COVER}, t AS (SELECT y, x, (x*7 + y*3) % 97/97e0 AS s, least(greatest((z - 1503.3)/617, 0), 0.35) AS k, {_TINT} FROM cover), l AS (SELECT y, x, s, r + (252 - r)*k AS r, g + (250 - g)*k AS g, b + (244 - b)*k AS b FROM t),
  u AS (SELECT y, x, s, {", ".join(_blur_sql(c)[0] for c in "rgb")} FROM l), v AS (SELECT y, x, s, {", ".join(_blur_sql(c)[1] for c in "rgb")} FROM u)
  SELECT y, x, {", ".join(f"round(CASE WHEN s < 0.7 THEN {c}*(1 - 0.62*(0.7 - s)/0.7) ELSE {c} + (255 - {c})*least(0.6, 0.62*(s - 0.7)/0.3) END, 4) AS {c}" for c in "rgb")} FROM v""")
def r_topo_tint(spark, d):
    """Class colours lightened with height, blurred and shaded."""
    c = F.col("code")
    cells = fx.cover(spark, d).withColumns({"shade": (F.col("x") * 7 + F.col("y") * 3) % 97 / 97.0, "r": c * 9 + 40, "g": c * 5 + 100, "b": c * 3 + 150})
    return places.topo_tint(cells, "z", "shade", 2, 0.7, low=1503.3, span=617.0).select("y", "x", *(r(F.col(k), 4).alias(k) for k in "rgb"))


@query(f"WITH {SQL_COVER} SELECT y, x, {', '.join(f'CASE WHEN code = 18 THEN {g} ELSE round({g} + (code*{k} - {g})*0.4, 6) END AS {c}' for c, g, k in (('r', 236.0, 9), ('g', 236.0, 5), ('b', 232.0, 3)))} FROM cover")
def r_over_relief(spark, d):
    """Colours of values mixed over grey; water has none and stays grey."""
    c = F.col("code")
    mixed = places.over_relief(F.when(c != 18, F.array((c * 9).cast("double"), (c * 5).cast("double"), (c * 3).cast("double"))), 0.4)
    return fx.cover(spark, d).withColumn("c", mixed).select("y", "x", *(r(F.col("c")[i]).alias(k) for i, k in enumerate("rgb")))


_ONE = f"pts AS (SELECT 0 AS id, {HERE[0]!r}e0 AS lon, {HERE[1]!r}e0 AS lat)"
_GAPS = f"a AS (SELECT id, CAST(fid AS BIGINT) AS fid, lon, lat, {_PLANE} FROM pts, edge), b AS (SELECT *, {_FOOT} FROM a), c AS (SELECT id, fid, lon, lat, min(sqrt(pow(ax + t*(gx-ax), 2) + pow(ay + t*(gy-ay), 2))) AS metres FROM b GROUP BY ALL)"


@query(f"WITH {_ONE}, {_sql_polygons()}, ins AS (SELECT CAST(fid AS BIGINT) AS fid FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)*(lat - y1)/(y2 - y1) + x1 GROUP BY fid HAVING count(*) % 2 = 1), {_GAPS} SELECT fid, round(metres, 3) AS metres FROM c WHERE fid NOT IN (SELECT fid FROM ins)")
def j_not_holding(spark, d):
    """Every polygon that doesn't hold a place, with its distance."""
    return places.not_holding(fx.polygons(spark, d), *HERE).select("fid", r(F.col("metres"), 3).alias("metres"))


@query(f"WITH {_INSIDE} SELECT id, fid FROM ins WHERE fid % 3 = 1")
def j_filtered_containing(spark, d):
    """Polygons of one tag that hold a point; the tag is tested before the join."""
    return vector.containing(fx.points(spark, d).select("id", "lon", "lat"), fx.polygons(spark, d).where(vector.has_tag(F.col("props"), "name", "unit 1"))).select("id", "fid")


@query(f"""WITH {SQL_POINTS}, {_SEGS}, a AS (SELECT id, lon, lat, fid, n, {_PLANE} FROM pts JOIN sg ON abs(sg.y1 - lat) < 0.02 AND abs(sg.x1 - lon) < 0.03 WHERE fid % 10 >= 3), b AS (SELECT *, {_FOOT} FROM a), e AS (SELECT *, round(sqrt(pow(ax + t*(gx-ax), 2) + pow(ay + t*(gy-ay), 2)), 6) AS m FROM b),
  f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, fid, n) AS i FROM e WHERE m < 400) SELECT id, fid, round(m, 3) AS metres FROM f WHERE i = 1""")
def j_lettered_line(spark, d):
    """The nearest stream of some size within 400 m of a name."""
    lines = fx.lines(spark, d).select("fid", "pts", (F.col("fid") % 10).cast("double").alias("km2"))
    return places.lettered_line(fx.points(spark, d).select("id", "lon", "lat"), lines, "km2", 3.0).select("id", "fid", r(F.col("metres"), 3).alias("metres"))


@query(f"WITH {_SEGS}, v AS (SELECT fid, x1 AS x, y1 AS y FROM sg UNION ALL SELECT fid, x2, y2 FROM sg) SELECT DISTINCT fid FROM v WHERE x > -119.62 AND x < -119.38 AND y > 53.93 AND y < 54.07")
def j_touching(spark, d):
    """Lines with a vertex in a grown box."""
    return fx.lines(spark, d).where(vector.touches_box(F.col("pts"), (-119.6, 53.95, -119.4, 54.05))).select("fid")


_STEP_X, _STEP_Y = (fx.BOX[2] - fx.BOX[0]), (fx.BOX[3] - fx.BOX[1])


@query(f"""WITH RECURSIVE {_sql_polygons()}, pts AS (SELECT k AS id, {fx.BOX[0]}e0 + {_STEP_X!r}e0*(k % 13 + 1)/14 AS lon, {fx.BOX[1]}e0 + {_STEP_Y!r}e0*(k // 13 + 1)/14 AS lat FROM (SELECT unnest(range(169)) AS k)),
  ins AS (SELECT id, CAST(fid AS BIGINT) AS fid FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)*(lat - y1)/(y2 - y1) + x1 GROUP BY id, fid HAVING count(*) % 2 = 1), {_GAPS},
  s AS (SELECT c.*, round(least(metres, 1.5*least(least(lon - ({fx.BOX[0]}), {fx.BOX[2]} - lon)*65000, least(lat - {fx.BOX[1]}, {fx.BOX[3]} - lat)*111000)), 6) AS score FROM c JOIN ins USING (id, fid)),
  o AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY score DESC, id) AS i FROM s WHERE score >= 900),
  go AS (SELECT DISTINCT fid, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(lon DOUBLE, lat DOUBLE, score DOUBLE)[]) AS kept FROM o
    UNION ALL SELECT go.fid, o.i, CASE WHEN len(kept) < 6 AND len(list_filter(kept, lambda p: {_HAV("p.lon", "p.lat", "o.lon", "o.lat")} <= 3000)) = 0 THEN list_append(kept, struct_pack(lon := o.lon, lat := o.lat, score := o.score)) ELSE kept END FROM go JOIN o ON o.fid = go.fid AND o.i = go.i + 1),
  l AS (SELECT fid, max_by(kept, i) AS kept FROM go GROUP BY fid), u AS (SELECT fid, unnest(range(len(kept))) AS k, kept FROM l) SELECT fid, CAST(k AS INT) AS rank, round(kept[k + 1].lon, 6) AS lon, round(kept[k + 1].lat, 6) AS lat, round(kept[k + 1].score, 3) AS score FROM u""")
def j_label_points(spark, d):
    """Places for labels inside polygons, well apart and far from edges."""
    return places.label_points(fx.polygons(spark, d), fx.BOX, 6, 3000.0).select("fid", "rank", r(F.col("lon")).alias("lon"), r(F.col("lat")).alias("lat"), r(F.col("score"), 3).alias("score"))


@query("""WITH RECURSIVE l AS (SELECT c_nationkey AS sheet, c_custkey AS rank, CAST((c_custkey*7919) % 200 AS DOUBLE) AS west, CAST((c_custkey*104729) % 100 AS DOUBLE) AS south FROM customer), b AS (SELECT *, west + 10 + rank % 20 AS east, south + 4 AS north, row_number() OVER (PARTITION BY sheet ORDER BY rank) AS i FROM l),
  go AS (SELECT DISTINCT sheet, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(rank BIGINT, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE)[]) AS kept FROM b UNION ALL
    SELECT go.sheet, b.i, CASE WHEN len(list_filter(kept, lambda p: b.west < p.east AND b.east > p.west AND b.south < p.north AND b.north > p.south)) = 0 THEN list_append(kept, struct_pack(rank := b.rank, west := b.west, south := b.south, east := b.east, north := b.north)) ELSE kept END FROM go JOIN b ON b.sheet = go.sheet AND b.i = go.i + 1),
  e AS (SELECT sheet, max_by(kept, i) AS kept FROM go GROUP BY sheet) SELECT sheet, u.* FROM (SELECT sheet, unnest(kept) AS u FROM e)""")
def k_placed_labels(spark, d):
    """Labels of each sheet by rank, without overlaps."""
    k = F.col("c_custkey")
    labels = fx.table(spark, d, "customer").select(F.col("c_nationkey").alias("sheet"), k.alias("rank"), ((k * 7919) % 200).cast("double").alias("west"), ((k * 104729) % 100).cast("double").alias("south"))
    return places.placed_labels(labels.withColumns({"east": F.col("west") + 10 + F.col("rank") % 20, "north": F.col("south") + 4}))


@query(f"WITH {SQL_DEM} SELECT y, x, z, row_number() OVER (ORDER BY z DESC, y, x) - 1 AS rank FROM dem")
def k_height_order(spark, d):
    """All cells from the highest down, without a sort in one task."""
    return places.height_order(fx.dem(spark, d), "z").select("y", "x", "z", "rank")


@query("""SELECT 'customer' AS source, c_name AS name, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT 'part', p_name, NULL, p_size FROM part UNION ALL SELECT 'nation', n_name, NULL, NULL FROM nation""")
def k_all_places(spark, d):
    """Rows of sources of different columns in one list."""
    c, p, n = (fx.table(spark, d, t) for t in ("customer", "part", "nation"))
    return places.all_places(
        c.select(F.lit("customer").alias("source"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), p.select(F.lit("part").alias("source"), F.col("p_name").alias("name"), F.col("p_size").alias("size")),
        n.select(F.lit("nation").alias("source"), F.col("n_name").alias("name")),
    ).select("source", "name", "balance", "size")


@query(f"""WITH {_PAIRS}, pp AS (SELECT id, seq, id * 100 + seq AS k, ox, oy, tx, ty, ox + (tx - ox) * (seq / 20e0) AS px, oy + (ty - oy) * (seq / 20e0) AS py, sqrt((tx-ox)*(tx-ox) + (ty-oy)*(ty-oy)) * 30 AS m FROM pairs, (SELECT CAST(unnest(range(21)) AS INT) AS seq)), {_bilinear_sql("pp", "k")},
  z AS (SELECT *, v - lag(v) OVER (PARTITION BY id ORDER BY seq) AS dz FROM pp JOIN bil USING (k))
  SELECT id, round(max(m), 6) AS metres, round(sum(greatest(dz, 0)), 6) AS climb, round(sum(greatest(-dz, 0)), 6) AS descent, round(sum(sqrt(dz*dz + (m/20)*(m/20))), 6) AS path, round(sum(dz), 6) AS rise, round(degrees(atan2(round(sum(dz), 9), max(m))), 6) AS shot, round((degrees(atan2(max(tx - ox), max(oy - ty))) + 360) % 360, 6) AS bearing FROM z GROUP BY id""")
def v_measure(spark, d):
    """Two-point measure: distance, bearing, climb, descent, the path along the ground and the angle of a shot; v_line_of_sight has the sight of the same pairs."""
    p = _pairs(spark, d)
    line = places.two_point(p, CELL)
    at = rays.profile_points(p, 20).withColumn("k", F.col("id") * 100 + F.col("seq"))
    z = raster.sample_bilinear(at, fx.dem(spark, d), "z", WIDTH, fx.height(spark, d), "k", out="v").join(line, "id").withColumn("far", F.col("m") * F.col("seq") / 20)
    out = places.measured(z, "id", "seq", "far", "v").join(line.select("id", "bearing"), "id")
    return out.select("id", *(r(F.col(c)).alias(c) for c in ("metres", "climb", "descent", "path", "rise", "shot", "bearing")))


@query(f"""WITH {SQL_POINTS} SELECT id, '11N ' || CAST(round(px*100) AS BIGINT) || ' ' || CAST(round(py*1000) AS BIGINT) AS utm, 'Road ' || upper(substr(['north fork','OLD MILL','x'][id % 3 + 1], 1, 1)) || ['orth Fork','ld Mill',''][id % 3 + 1] AS title, round(16 + (240 - 16)*0.25, 6) AS mixed_r, round(32 + (0 - 32)*0.25, 6) AS mixed_g, round(255 + (128 - 255)*0.25, 6) AS mixed_b FROM pts""")
def x_places(spark, d):
    """Grid references, titles and mixed colours as text."""
    k = F.col("id")
    names = F.element_at(F.array(*map(F.lit, ("north fork", "OLD MILL", "x"))), (k % 3 + 1).cast("int"))
    mixed = text.mix_channels(text.hex_channels(F.lit("#1020ff")), text.hex_channels(F.lit("#f00080")), F.lit(0.25))
    return fx.points(spark, d).select("id", text.utm_text(F.lit(11), F.col("px") * 100, F.col("py") * 1000).alias("utm"), text.title_case(F.concat(F.lit("road "), names)).alias("title"), *(r(mixed[i]).alias(f"mixed_{c}") for i, c in enumerate("rgb")))
