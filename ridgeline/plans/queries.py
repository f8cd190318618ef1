"""Named queries over the fixtures, and the same in SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GRS80_A
from ..functions import astro, geodesy, text
from ..lookups import COVER, FOREST, cover_table, with_lookup
from ..operators import contour, flood, network, packed, peaks, raster, rays, sheets, stats, vector, walks
from ..storage import materialise
from . import fixtures as fx
from .fixtures import CELL, HERE, SQL_COVER, SQL_DAYS, SQL_DEM, SQL_POINTS, WIDTH

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(c, digits) + F.lit(0.0)


# ---- geodesy

_N, _R, _O = geodesy.Lcc().constants()
_E = repr(geodesy.E1)
_LCC_T = f"tan(pi()/4 - radians(lat)/2) / pow((1 - {_E}*sin(radians(lat))) / (1 + {_E}*sin(radians(lat))), {_E}/2)"


@query(f"""WITH {SQL_POINTS}, f AS (SELECT id, lon, lat, {_R!r} * pow({_LCC_T}, {_N!r}) AS rho, {_N!r} * radians(lon + 95) AS th FROM pts)
  SELECT id, round(rho * sin(th), 3) + 0 AS x, round({_O!r} - rho * cos(th), 3) + 0 AS y, round(lon, 6) AS back_lon, round(lat, 6) AS back_lat FROM f""")
def g_lambert(spark, d):
    """Lambert conformal there and back."""
    p = fx.points(spark, d)
    lcc = geodesy.Lcc()
    x, y = lcc.forward(F.col("lon"), F.col("lat"))
    at = p.withColumns({"x": x, "y": y})
    lon, lat = lcc.inverse(F.col("x"), F.col("y"))
    return at.select("id", r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"), r(lon).alias("back_lon"), r(lat).alias("back_lat"))


def _series(table, a, b, fa, fb):
    return " + ".join(f"({c!r}) * {fa}({2 * j} * {a}) * {fb}({2 * j} * {b})" for j, c in enumerate(geodesy.krueger(table), 1))


_RAD = repr(0.9996 * geodesy.rectifying_radius())


@query(f"""WITH {SQL_POINTS}, a AS (SELECT *, radians(lon) - radians(-117) AS l, tan(radians(lat)) AS tau FROM pts),
  b AS (SELECT *, sinh({_E} * atanh({_E} * tau / sqrt(1 + tau*tau))) AS sigma FROM a),
  c AS (SELECT *, tau * sqrt(1 + sigma*sigma) - sigma * sqrt(1 + tau*tau) AS tp FROM b),
  e AS (SELECT *, atan2(tp, cos(l)) AS xi, asinh(sin(l) / sqrt(tp*tp + cos(l)*cos(l))) AS eta FROM c)
  SELECT id, round(500000 + {_RAD} * (eta + {_series(geodesy.KRUEGER_FORWARD, "xi", "eta", "cos", "sinh")}), 3) AS easting,
    round({_RAD} * (xi + {_series(geodesy.KRUEGER_FORWARD, "xi", "eta", "sin", "cosh")}), 3) AS northing,
    CAST(floor((lon + 180) / 6) AS INT) % 60 + 1 AS zone, round(degrees(atan(tan(l) * sin(radians(lat)))), 6) + 0 AS convergence,
    round(lon, 6) AS back_lon, round(lat, 6) AS back_lat FROM e""")
def g_utm(spark, d):
    """UTM there and back, zone and convergence."""
    e, n = geodesy.utm_forward(F.col("lon"), F.col("lat"), 11)
    at = fx.points(spark, d).withColumns({"e": e, "n": n})
    lon, lat = geodesy.utm_inverse(F.col("e"), F.col("n"), 11)
    return at.select("id", r(F.col("e"), 3).alias("easting"), r(F.col("n"), 3).alias("northing"), geodesy.utm_zone(F.col("lon")).alias("zone"), r(geodesy.grid_convergence(F.col("lon"), F.col("lat"), 11)).alias("convergence"), r(lon).alias("back_lon"), r(lat).alias("back_lat"))


@query(f"""WITH {SQL_POINTS}, m AS (SELECT id, lon, lat, {GRS80_A} * radians(lon) AS x, {GRS80_A} * ln(tan(pi()/4 + radians(lat)/2)) AS y FROM pts)
  SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(lon, 6) AS back_lon, round(lat, 6) AS back_lat FROM m""")
def g_mercator(spark, d):
    x, y = geodesy.mercator_forward(F.col("lon"), F.col("lat"))
    at = fx.points(spark, d).withColumns({"x": x, "y": y})
    lon, lat = geodesy.mercator_inverse(F.col("x"), F.col("y"))
    return at.select("id", r(F.col("x"), 3).alias("x"), r(F.col("y"), 3).alias("y"), r(lon).alias("back_lon"), r(lat).alias("back_lat"))


def _utm_sql(source: str) -> str:
    """Rows of a source with lon and lat, and their easting x and northing y."""
    return f"""SELECT * EXCLUDE (l, tau, sigma, tp, xi, eta), 500000 + {_RAD} * (eta + {_series(geodesy.KRUEGER_FORWARD, "xi", "eta", "cos", "sinh")}) AS x, {_RAD} * (xi + {_series(geodesy.KRUEGER_FORWARD, "xi", "eta", "sin", "cosh")}) AS y
      FROM (SELECT *, atan2(tp, cos(l)) AS xi, asinh(sin(l) / sqrt(tp*tp + cos(l)*cos(l))) AS eta FROM (SELECT *, tau * sqrt(1 + sigma*sigma) - sigma * sqrt(1 + tau*tau) AS tp FROM (SELECT *, sinh({_E} * atanh({_E} * tau / sqrt(1 + tau*tau))) AS sigma FROM (SELECT *, radians(lon) - radians(-117) AS l, tan(radians(lat)) AS tau FROM {source}))))"""


_SHEETS = "sheets AS (SELECT n_nationkey AS sheet, -119.85 + (n_nationkey % 5) * 0.17 AS west, 53.80 + (n_nationkey // 5) * 0.11 AS south, -119.85 + (n_nationkey % 5) * 0.17 + 0.2 + n_nationkey % 3 * 0.3 AS east, 53.80 + (n_nationkey // 5) * 0.11 + 0.12 AS north, CASE n_nationkey % 2 WHEN 0 THEN 2000e0 ELSE 5000e0 END AS step FROM nation)"


@query(f"""WITH RECURSIVE {_SHEETS}, co AS (SELECT sheet, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({_utm_sql("(SELECT sheet, unnest([west, west, east, east]) AS lon, unnest([south, north, south, north]) AS lat FROM sheets)")}) GROUP BY sheet),
  n AS (SELECT sheets.*, CAST(floor(x0/step) AS BIGINT) AS e0, CAST(ceil(x1/step) AS BIGINT) AS e1, CAST(floor(y0/step) AS BIGINT) AS n0, CAST(ceil(y1/step) AS BIGINT) AS n1 FROM sheets JOIN co USING (sheet)),
  m AS (SELECT *, CASE WHEN step < 5000 AND e1 - e0 > 16 THEN 2 ELSE 1 END AS every FROM n),
  ln AS (SELECT sheet, 'E' AS axis, (e0 + k) * step AS metres, edge, west AS a, east AS b, CASE edge WHEN 'S' THEN south ELSE north END AS fix FROM (SELECT *, unnest(range(0, e1 - e0 + 1, every)) AS k FROM m), (VALUES ('S'), ('N')) v(edge)
    UNION ALL SELECT sheet, 'N', (n0 + k) * step, edge, south, north, CASE edge WHEN 'W' THEN west ELSE east END FROM (SELECT *, unnest(range(0, n1 - n0 + 1, every)) AS k FROM m), (VALUES ('W'), ('E')) v(edge)),
  en AS (SELECT sheet, axis, metres, edge, sign(max(off) FILTER (w = 0)) AS here, sign(max(off) FILTER (w = 1)) AS there FROM (SELECT *, CASE axis WHEN 'E' THEN x ELSE y END - metres AS off FROM ({_utm_sql("(SELECT *, CASE axis WHEN 'E' THEN e ELSE fix END AS lon, CASE axis WHEN 'E' THEN fix ELSE e END AS lat FROM (SELECT *, unnest([a, b]) AS e, unnest([0, 1]) AS w FROM ln))")})) GROUP BY ALL),
  hv(sheet, axis, metres, edge, fix, here, k, a, b) AS (SELECT sheet, axis, metres, edge, fix, here, 0, CAST(a AS DOUBLE), CAST(b AS DOUBLE) FROM ln JOIN en USING (sheet, axis, metres, edge) WHERE here * there <= 0
    UNION ALL SELECT sheet, axis, metres, edge, fix, here, k + 1, CASE WHEN sign(CASE axis WHEN 'E' THEN x ELSE y END - metres) * here <= 0 THEN a ELSE mid END, CASE WHEN sign(CASE axis WHEN 'E' THEN x ELSE y END - metres) * here <= 0 THEN mid ELSE b END
      FROM ({_utm_sql("(SELECT *, CASE axis WHEN 'E' THEN mid ELSE fix END AS lon, CASE axis WHEN 'E' THEN fix ELSE mid END AS lat FROM (SELECT *, (a + b) / 2 AS mid FROM hv WHERE k < 40))")}))
  SELECT sheet, axis, metres, edge, round(CASE axis WHEN 'E' THEN (a + b) / 2 ELSE fix END, 6) AS lon, round(CASE axis WHEN 'E' THEN fix ELSE (a + b) / 2 END, 6) AS lat, CAST(CAST(round(metres / 1000) AS BIGINT) // 100 AS VARCHAR) AS small, lpad(CAST(CAST(round(metres / 1000) AS BIGINT) % 100 AS VARCHAR), 2, '0') AS principal FROM hv WHERE k = 40""")
def x_grid_ticks(spark, d):
    """Where grid lines meet the frames of one sheet a nation."""
    k = F.col("n_nationkey")
    west, south = -119.85 + (k % 5) * 0.17, 53.80 + F.floor(k / 5) * 0.11
    frames = fx.table(spark, d, "nation").select(k.alias("sheet"), west.alias("west"), south.alias("south"), (west + 0.2 + k % 3 * 0.3).alias("east"), (south + 0.12).alias("north"), F.when(k % 2 == 0, 2000.0).otherwise(5000.0).alias("step"))
    return sheets.grid_ticks(frames, 11).withColumns({c: r(F.col(c)) for c in ("lon", "lat")})


_HAV = f"2 * 6371008.8 * asin(sqrt(pow(sin(radians({HERE[1]} - lat)/2), 2) + cos(radians(lat)) * cos(radians({HERE[1]})) * pow(sin(radians({HERE[0]} - lon)/2), 2)))"
_BEAR = f"(degrees(atan2(sin(radians({HERE[0]} - lon)) * cos(radians({HERE[1]})), cos(radians(lat)) * sin(radians({HERE[1]})) - sin(radians(lat)) * cos(radians({HERE[1]})) * cos(radians({HERE[0]} - lon)))) + 360) % 360"
_W16 = "['" + "','".join(geodesy.COMPASS_16) + "']"
_W8 = "['" + "','".join(geodesy.COMPASS_8_WORDS) + "']"


@query(f"""WITH {SQL_POINTS}, b AS (SELECT id, {_HAV} AS m, {_BEAR} AS b FROM pts)
  SELECT id, round(m, 3) AS metres, round(b, 6) AS bearing, {_W16}[CAST(floor((b + 11.25) / 22.5) AS INT) % 16 + 1] AS compass, {_W8}[CAST(floor((b + 22.5) / 45) AS INT) % 8 + 1] AS words,
    round((b - 15.66 + 360) % 360, 6) AS magnetic FROM b""")
def g_distance_bearing(spark, d):
    """Distance, bearing, compass words and magnetic bearing to a place."""
    lon, lat = F.lit(HERE[0]), F.lit(HERE[1])
    at = fx.points(spark, d).withColumns({"m": geodesy.haversine(F.col("lon"), F.col("lat"), lon, lat), "b": geodesy.bearing(F.col("lon"), F.col("lat"), lon, lat)})
    b = F.col("b")
    return at.select("id", r(F.col("m"), 3).alias("metres"), r(b).alias("bearing"), geodesy.compass16(b).alias("compass"), geodesy.compass8_word(b).alias("words"), r(geodesy.magnetic_bearing(b, F.lit(15.66))).alias("magnetic"))


@query(f"""WITH {SQL_POINTS}, t AS (SELECT id, lat, CAST(round(abs(lat) * 36000) AS BIGINT) AS n, CAST(round(abs(lon) * 36000) AS BIGINT) AS w FROM pts)
  SELECT id, printf('%d°%02d''%04.1f" N', n // 36000, (n // 600) % 60, (n % 600) / 10e0) AS lat_text, printf('%d°%02d''%04.1f" W', w // 36000, (w // 600) % 60, (w % 600) / 10e0) AS lon_text FROM t""")
def g_dms(spark, d):
    return fx.points(spark, d).select("id", text.dms(F.col("lat"), "N", "S").alias("lat_text"), text.dms(F.col("lon"), "E", "W").alias("lon_text"))


_VIEW = geodesy.View.of_box(fx.BOX, 30.0)
_VX, _VY, _VDX, _VDY = _VIEW._frame()


@query(f"""WITH {SQL_POINTS}, p AS (SELECT *, ({GRS80_A} * radians(lon) - ({_VX!r})) / {_VDX!r} AS vx, ({_VY!r} - {GRS80_A} * ln(tan(pi()/4 + radians(lat)/2))) / {_VDY!r} AS vy FROM pts)
  SELECT id, round(vx, 4) AS vx, round(vy, 4) AS vy, round(lon, 6) AS back_lon, round(lat, 6) AS back_lat, round({_VDX!r} * cos(2 * atan(exp(({_VY!r} - (py + 0.5) * {_VDY!r}) / {GRS80_A})) - pi()/2), 6) AS ground FROM p""")
def g_view(spark, d):
    """Places on a Mercator grid, back again, and the ground size of a row."""
    x, y = _VIEW.pixel(F.col("lon"), F.col("lat"))
    at = fx.points(spark, d).withColumns({"vx": x, "vy": y})
    lon, lat = _VIEW.lonlat(F.col("vx"), F.col("vy"))
    return at.select("id", r(F.col("vx"), 4).alias("vx"), r(F.col("vy"), 4).alias("vy"), r(lon).alias("back_lon"), r(lat).alias("back_lat"), r(_VIEW.ground_metres(F.col("py"))).alias("ground"))


# ---- calendar, sun and moon

_DATES = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), dd AS (SELECT date, date_diff('day', DATE '1970-01-01', date) AS n FROM dates)"


def _dates(spark, d):
    return fx.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


@query(f"""WITH {_DATES}, m AS (SELECT *, make_date(year(date), 3, 1) AS m1, make_date(year(date), 11, 1) AS n1 FROM dd),
  s AS (SELECT *, m1 + CAST((7 - dayofweek(m1)) % 7 + 7 AS INT) AS start, n1 + CAST((7 - dayofweek(n1)) % 7 AS INT) AS stop FROM m)
  SELECT date, CAST(n AS INT) AS days, strftime(date, '%a') AS weekday, strftime(date, '%a %-d %b %Y') AS long_text, strftime(date, '%-d %b') AS short_text, n + 2440587.5 + 6 / 24e0 AS jd,
    CASE WHEN date >= start AND date < stop THEN 'MDT' ELSE 'MST' END AS zone, CAST(date_diff('day', make_date(year(date), 8, 31), date) AS INT) AS autumn_day, date AS back FROM s""")
def t_calendar(spark, d):
    """Day numbers, names, Julian day, clock zone, autumn day."""
    c = F.col("date")
    return _dates(spark, d).select(
        "date", astro.days_of(c).alias("days"), astro.weekday(c).alias("weekday"), astro.date_long(c).alias("long_text"), astro.date_short(c).alias("short_text"),
        astro.julian_day(astro.days_of(c), F.lit(6.0)).alias("jd"), astro.mountain_zone(c).alias("zone"), astro.autumn_day(c).alias("autumn_day"), astro.date_of(astro.days_of(c)).alias("back"),
    )


def sql_solar(jd: str, source: str, p: str = "") -> str:
    """CTEs p_a, p_b, p_solar over a table: declination (degrees) and equation of time (minutes) as decl and eqt."""
    return f"""{p}a AS (SELECT *, (({jd}) - 2451545) / 36525 AS t FROM {source}),
  {p}b AS (SELECT *, ((280.46646 + t*(36000.76983 + t*0.0003032)) % 360 + 360) % 360 AS l0, 357.52911 + t*(35999.05029 - 0.0001537*t) AS m, 0.016708634 - t*(0.000042037 + 0.0000001267*t) AS e, 125.04 - 1934.136*t AS om FROM {p}a),
  {p}c AS (SELECT *, l0 + sin(radians(m))*(1.914602 - t*(0.004817 + 0.000014*t)) + sin(radians(2*m))*(0.019993 - 0.000101*t) + sin(radians(3*m))*0.000289 - 0.00569 - 0.00478*sin(radians(om)) AS lam,
    23 + (26 + (21.448 - t*(46.815 + t*(0.00059 - t*0.001813)))/60)/60 + 0.00256*cos(radians(om)) AS eps FROM {p}b),
  {p}solar AS (SELECT * EXCLUDE (t, l0, m, e, om, lam, eps), degrees(asin(sin(radians(eps))*sin(radians(lam)))) AS decl,
    4*degrees(pow(tan(radians(eps/2)),2)*sin(radians(2*l0)) - 2*e*sin(radians(m)) + 4*e*pow(tan(radians(eps/2)),2)*sin(radians(m))*cos(radians(2*l0)) - 0.5*pow(tan(radians(eps/2)),4)*sin(radians(4*l0)) - 1.25*e*e*sin(radians(2*m))) AS eqt FROM {p}c)"""


@query(f"WITH {_DATES}, {sql_solar('n + 2440587.5 + 0.5', 'dd')} SELECT date, round(decl, 6) + 0 AS declination, round(eqt, 6) + 0 AS equation FROM solar")
def t_solar(spark, d):
    decl, eqt = astro.solar(astro.julian_day(astro.days_of(F.col("date")), F.lit(12.0)))
    return _dates(spark, d).select("date", r(decl).alias("declination"), r(eqt).alias("equation"))


_POS = """q AS (SELECT *, (((hour*60 + eqt + 4*lon) % 1440 + 1440) % 1440)/4 - 180 AS ha FROM solar),
  z AS (SELECT *, 90 - degrees(acos(least(1.0, greatest(-1.0, sin(radians(lat))*sin(radians(decl)) + cos(radians(lat))*cos(radians(decl))*cos(radians(ha)))))) AS h,
    ((degrees(atan2(sin(radians(ha)), cos(radians(ha))*sin(radians(lat)) - tan(radians(decl))*cos(radians(lat)))) + 180) % 360 + 360) % 360 AS az FROM q),
  w AS (SELECT *, tan(radians(h)) AS te FROM z),
  pos AS (SELECT *, h + CASE WHEN h > 85 THEN 0 WHEN h > 5 THEN (58.1/te - 0.07/pow(te,3) + 0.000086/pow(te,5))/3600 WHEN h > -0.575 THEN (1735 + h*(-518.2 + h*(103.4 + h*(-12.79 + h*0.711))))/3600 ELSE -20.774/te/3600 END AS alt FROM w)"""


@query(f"""WITH {_DATES}, hh AS (SELECT date, n, CAST(unnest(range(24)) AS DOUBLE) AS hour, {HERE[0]} AS lon, {HERE[1]} AS lat FROM dd), {sql_solar("n + 2440587.5 + hour/24", "hh")}, {_POS}
  SELECT date, CAST(hour AS INT) AS hour, round(az, 5) AS azimuth, round(alt, 5) + 0 AS altitude, round(h, 5) + 0 AS bare FROM pos""")
def t_sun_position(spark, d):
    """Azimuth and altitude every hour, with and without refraction."""
    each = _dates(spark, d).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    args = astro.days_of(F.col("date")), F.col("hour").cast("double"), F.lit(HERE[0]), F.lit(HERE[1])
    bare = astro.sun_position(each, *args, refracted=False).withColumnRenamed("altitude", "bare").drop("azimuth")
    return astro.sun_position(bare, *args).select("date", "hour", r(F.col("azimuth"), 5).alias("azimuth"), r(F.col("altitude"), 5).alias("altitude"), r(F.col("bare"), 5).alias("bare"))


def _sql_crossing(zenith: float = 90.833, tag: str = "") -> str:
    parts, source = [], f"(SELECT date, n, 12 - ({HERE[0]})/15e0 + off AS hour, k, true AS ok FROM dd, (VALUES ('rise', -6e0), ('set', 6e0), ('noon', 0e0)) v(k, off))"
    for i in range(4):
        parts.append(sql_solar("n + 2440587.5 + hour/24", source, f"{tag}p{i}"))
        parts.append(f"{tag}x{i} AS (SELECT *, (cos(radians({zenith})) - sin(radians({HERE[1]}))*sin(radians(decl)))/(cos(radians({HERE[1]}))*cos(radians(decl))) AS c FROM {tag}p{i}solar)")
        parts.append(f"{tag}y{i} AS (SELECT date, n, k, (720 - 4*({HERE[0]}) - eqt)/60 + CASE k WHEN 'rise' THEN -1 WHEN 'set' THEN 1 ELSE 0 END * degrees(acos(c))/15 AS hour FROM {tag}x{i})")
        source = f"{tag}y{i}"
    return ", ".join(parts)


@query(f"""WITH {_DATES}, {_sql_crossing()} SELECT date, round(max(hour) FILTER (k = 'rise'), 5) AS rise, round(max(hour) FILTER (k = 'set'), 5) AS set, round(max(hour) FILTER (k = 'noon'), 5) AS noon FROM y3 GROUP BY date""")
def t_sun_crossing(spark, d):
    out = astro.sun_crossing(_dates(spark, d), astro.days_of(F.col("date")), F.lit(HERE[0]), F.lit(HERE[1]))
    return out.select("date", *(r(F.col(c), 5).alias(c) for c in ("rise", "set", "noon")))


_PHASES = " ".join(f"WHEN el >= {a} THEN '{n}'" for a, n in reversed(astro.MOON_PHASES))


def _sql_moon(hours: str, source: str) -> str:
    """CTE moons (date, lit, age, phase) over a table with date and n."""
    return f"""ma AS (SELECT date, (n + 2440587.5 + ({hours})/24e0 - 2451545)/36525e0 AS t FROM {source}),
  mb AS (SELECT date, ((297.8501921 + 445267.1114034*t) % 360 + 360) % 360 AS d, ((357.5291092 + 35999.0502909*t) % 360 + 360) % 360 AS m, ((134.9633964 + 477198.8675055*t) % 360 + 360) % 360 AS p FROM ma),
  mc AS (SELECT date, (1 + cos(radians(180 - d - 6.289*sin(radians(p)) + 2.1*sin(radians(m)) - 1.274*sin(radians(2*d - p)) - 0.658*sin(radians(2*d)) - 0.214*sin(radians(2*p)) - 0.11*sin(radians(d)))))/2 AS lit,
    ((d + 6.289*sin(radians(p)) - 2.1*sin(radians(m)) + 1.274*sin(radians(2*d - p)) + 0.658*sin(radians(2*d))) % 360 + 360) % 360 AS el FROM mb),
  moons AS (SELECT date, lit, el/360*29.530588 AS age, CASE {_PHASES} ELSE 'new' END AS phase FROM mc)"""


@query(f"WITH {_DATES}, {_sql_moon('6', 'dd')} SELECT date, round(lit, 6) AS lit, round(age, 5) AS age, phase FROM moons")
def t_moon(spark, d):
    lit, age, name = astro.moon(astro.days_of(F.col("date")), F.lit(6.0))
    return _dates(spark, d).select("date", r(lit).alias("lit"), r(age, 5).alias("age"), name.alias("phase"))


@query(f"""WITH days AS (SELECT DISTINCT DATE '2026-09-28' + CAST(o_orderkey % 64 AS INT) AS date FROM orders), dd AS (SELECT date, date_diff('day', DATE '1970-01-01', date) AS n, CASE WHEN date < DATE '2026-11-01' THEN -6 ELSE -7 END AS utc FROM days), {_sql_crossing()}, {_sql_crossing(96.0, "v")}, {_sql_moon("24 - utc", "dd")},
  s AS (SELECT date, max(hour) FILTER (k = 'rise') AS rise, max(hour) FILTER (k = 'set') AS set FROM y3 GROUP BY date), c AS (SELECT date, max(hour) FILTER (k = 'rise') AS rise, max(hour) FILTER (k = 'set') AS set FROM vy3 GROUP BY date)
  SELECT dd.date, CASE utc WHEN -6 THEN 'MDT' ELSE 'MST' END AS zone, phase AS moon_phase, round(s.rise + utc, 5) AS rise, round(s.set + utc, 5) AS set, round(s.rise + utc - 0.5, 5) AS legal_from, round(s.set + utc + 0.5, 5) AS legal_to, round(c.rise + utc, 5) AS civil_rise, round(c.set + utc, 5) AS civil_set, round(lit, 5) AS moon_lit, round(age, 5) AS moon_age
  FROM dd JOIN s ON s.date = dd.date JOIN c ON c.date = dd.date JOIN moons ON moons.date = dd.date""")
def t_day_table(spark, d):
    """Rise, set, legal light, twilight, zone and moon of each date of the season."""
    days = fx.table(spark, d, "orders").select(F.date_add(F.lit("2026-09-28").cast("date"), (F.col("o_orderkey") % 64).cast("int")).alias("date")).distinct()
    out = astro.day_table(days, *HERE)
    return out.select("date", "zone", "moon_phase", *(r(F.col(c), 5).alias(c) for c in ("rise", "set", "legal_from", "legal_to", "civil_rise", "civil_set", "moon_lit", "moon_age")))


@query(f"""WITH {_DATES}, {_sql_crossing()}, rs AS (SELECT date, max(hour) FILTER (k = 'rise') + 0.02 AS start, max(hour) FILTER (k = 'set') AS set FROM y3 GROUP BY date),
  step AS (SELECT rs.date, n, start, set, unnest(range(0, CAST(floor((set - start) * 6) AS INT) + 1)) AS i FROM rs JOIN dd ON dd.date = rs.date), pth AS (SELECT date, n, i, start + i / 6e0 AS hour, {HERE[0]} AS lon, {HERE[1]} AS lat FROM step WHERE start + i / 6e0 < set), {sql_solar("n + 2440587.5 + hour/24", "pth")}, {_POS}
  SELECT date, CAST(i AS INT) AS i, round(hour, 5) AS hour, round(az, 4) AS azimuth, round(alt, 4) + 0 AS altitude FROM pos WHERE alt > 0""")
def t_sun_path(spark, d):
    """Samples every ten minutes from just after sunrise while the sun is up, on each distinct date."""
    days = astro.days_of(F.col("date"))
    # written out: a filter on the result would be pushed into the passes and multiply their expressions
    risen = materialise(astro.sun_crossing(_dates(spark, d), days, F.lit(HERE[0]), F.lit(HERE[1])), "crossing")
    day = risen.withColumn("start", F.col("rise") + 0.02)
    each = day.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("set") - F.col("start")) * 6).cast("int")))).withColumn("hour", F.col("start") + F.col("i") / 6)
    up = materialise(astro.sun_position(each.where("hour < set"), days, F.col("hour"), F.lit(HERE[0]), F.lit(HERE[1])), "sun").where("altitude > 0")
    return up.select("date", "i", r(F.col("hour"), 5).alias("hour"), r(F.col("azimuth"), 4).alias("azimuth"), r(F.col("altitude"), 4).alias("altitude"))


# ---- text

@query("""SELECT o_orderkey AS id, printf('%d:%02d', (CAST(round(h * 60) AS BIGINT) // 60) % 24, CAST(round(h * 60) AS BIGINT) % 60) AS clock, format('{:,}', CAST(round(o_totalprice) AS BIGINT)) AS price,
  CAST(CAST(round(o_custkey % 101 / 101e0 * 100) AS BIGINT) AS VARCHAR) || '%' AS share, upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) AS raw_title,
  replace(replace('<' || o_orderstatus || '> & "x"', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('"', '&quot;') AS html
  FROM (SELECT *, (o_orderkey % 2400) / 100e0 AS h FROM orders)""")
def x_text(spark, d):
    """Clock times, thousands, percents, escapes."""
    o = fx.table(spark, d, "orders")
    p = F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"), text.hours_minutes(F.col("o_orderkey") % 2400 / 100.0).alias("clock"), text.thousands(F.col("o_totalprice")).alias("price"), text.percent(F.col("o_custkey") % 101 / 101.0).alias("share"),
        F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 100))).alias("raw_title"), text.html_escape(F.concat(F.lit("<"), "o_orderstatus", F.lit('> & "x"'))).alias("html"),
    )


# ---- rasters

_NEIGHBOURS = """near AS (SELECT y, x, z, coalesce(lag(z) OVER r, z) AS w, coalesce(lead(z) OVER r, z) AS e FROM dem WINDOW r AS (PARTITION BY y ORDER BY x)),
  nine AS (SELECT *, coalesce(lag(w) OVER c, w) AS nw, coalesce(lag(z) OVER c, z) AS n, coalesce(lag(e) OVER c, e) AS ne, coalesce(lead(w) OVER c, w) AS sw, coalesce(lead(z) OVER c, z) AS s, coalesce(lead(e) OVER c, e) AS se FROM near WINDOW c AS (PARTITION BY x ORDER BY y)),
  g AS (SELECT y, x, z, ((ne + 2*e + se) - (nw + 2*w + sw)) / 240 AS gx, ((nw + 2*n + ne) - (sw + 2*s + se)) / 240 AS gy FROM nine),
  horn AS (SELECT y, x, z, degrees(atan(sqrt(gx*gx + gy*gy))) AS slope, CASE WHEN sqrt(gx*gx + gy*gy) < 1e-4 THEN -1 ELSE (degrees(atan2(-gx, -gy)) + 360) % 360 END AS aspect,
    -gx / sqrt(gx*gx + gy*gy + 1) AS nx, -gy / sqrt(gx*gx + gy*gy + 1) AS ny, 1 / sqrt(gx*gx + gy*gy + 1) AS nz FROM g)"""


def _terrain(spark, d):
    return raster.horn(fx.dem(spark, d), "z", CELL)


@query(f"WITH {SQL_DEM}, {_NEIGHBOURS} SELECT y, x, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(nx, 6) + 0 AS nx, round(ny, 6) + 0 AS ny, round(nz, 6) AS nz FROM horn")
def r_horn(spark, d):
    return _terrain(spark, d).select("y", "x", *(r(F.col(c)).alias(c) for c in ("slope", "aspect", "nx", "ny", "nz")))


def _sql_shade(az, al):
    a, b = math.radians(az), math.radians(al)
    return f"greatest(0, nx*({math.sin(a) * math.cos(b)!r}) + ny*({math.cos(a) * math.cos(b)!r}) + nz*({math.sin(b)!r}))"


@query(f"WITH {SQL_DEM}, {_NEIGHBOURS} SELECT y, x, round({_sql_shade(315, 45)}, 6) + 0 AS shade, round({' + '.join(f'{w}*{_sql_shade(az, al)}' for az, al, w in raster.RELIEF)}, 6) + 0 AS relief FROM horn")
def r_hillshade(spark, d):
    return _terrain(spark, d).select("y", "x", r(raster.hillshade(315.0, 45.0)).alias("shade"), r(raster.relief()).alias("relief"))


@query(f"WITH {SQL_POINTS}, {SQL_COVER.replace(fx.SQL_SIZE + ', ', '')} SELECT id, z, code FROM pts LEFT JOIN cover ON cover.x = floor(px) AND cover.y = floor(py)")
def r_nearest(spark, d):
    cells = fx.cover(spark, d)
    both = raster.sample_nearest(fx.points(spark, d), cells, "z", out="z")
    return raster.sample_nearest(both, cells, "code", out="code").select("id", "z", "code")


def _bilinear_sql(source: str, key: str, h: str = "(SELECT h FROM size)") -> str:
    return f"""bp AS (SELECT *, least(greatest(px, 0), {WIDTH} - 1.001e0) AS qx, least(greatest(py, 0), {h} - 1.001e0) AS qy FROM {source}),
  bc AS (SELECT {key}, CAST(floor(qx) AS INT) + i AS cx, CAST(floor(qy) AS INT) + j AS cy, CASE i WHEN 1 THEN qx - floor(qx) ELSE 1 - (qx - floor(qx)) END * CASE j WHEN 1 THEN qy - floor(qy) ELSE 1 - (qy - floor(qy)) END AS w FROM bp, (VALUES (0,0),(0,1),(1,0),(1,1)) k(i, j)),
  bil AS (SELECT {key}, sum(z * w) AS v FROM bc JOIN dem ON dem.x = cx AND dem.y = cy GROUP BY {key})"""


_PD = f"{SQL_POINTS}, {SQL_DEM.replace(fx.SQL_SIZE + ', ', '')}"


@query(f"WITH {_PD}, {_bilinear_sql('pts', 'id')} SELECT id, round(v, 6) AS z FROM bil")
def r_bilinear(spark, d):
    return raster.sample_bilinear(fx.points(spark, d), fx.dem(spark, d), "z", WIDTH, fx.height(spark, d), out="z").select("id", r(F.col("z")).alias("z"))


@query(f"""WITH {_PD}, q AS (SELECT id, px - 0.5 AS qx, py - 0.5 AS qy FROM pts), f AS (SELECT *, qx - floor(qx) AS fx, qy - floor(qy) AS fy FROM q),
  w AS (SELECT id, qx, qy, [-0.5*fx + fx*fx - 0.5*fx*fx*fx, 1 - 2.5*fx*fx + 1.5*fx*fx*fx, 0.5*fx + 2*fx*fx - 1.5*fx*fx*fx, -0.5*fx*fx + 0.5*fx*fx*fx] AS wx, [-0.5*fy + fy*fy - 0.5*fy*fy*fy, 1 - 2.5*fy*fy + 1.5*fy*fy*fy, 0.5*fy + 2*fy*fy - 1.5*fy*fy*fy, -0.5*fy*fy + 0.5*fy*fy*fy] AS wy FROM f),
  t AS (SELECT id, least(greatest(CAST(floor(qx) AS INT) + i - 1, 0), {WIDTH - 1}) AS cx, least(greatest(CAST(floor(qy) AS INT) + j - 1, 0), h - 1) AS cy, wx[i + 1] * wy[j + 1] AS k FROM w, size, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j))
  SELECT id, round(sum(z * k), 6) AS z FROM t JOIN dem ON dem.x = cx AND dem.y = cy GROUP BY id""")
def r_bicubic(spark, d):
    return raster.sample_bicubic(fx.points(spark, d), fx.dem(spark, d), "z", WIDTH, fx.height(spark, d), out="z").select("id", r(F.col("z")).alias("z"))


@query(f"""WITH {SQL_DEM}, cells AS (SELECT c AS cid, c % 60 AS x, c // 60 AS y, (c % 60 + 0.5) * 2 - 0.5 AS px, (c // 60 + 0.5) * 3 - 0.5 AS py FROM (SELECT unnest(range(60 * h // 3)) AS c FROM size)), {_bilinear_sql("cells", "cid")}
  SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS z FROM cells JOIN bil USING (cid)""")
def r_resize(spark, d):
    h = fx.height(spark, d)
    return raster.resize(fx.dem(spark, d), "z", WIDTH, h, 60, h // 3).select("y", "x", r(F.col("z")).alias("z"))


@query(f"""WITH {SQL_DEM}, a AS (SELECT y, x, avg(z) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS b FROM dem)
  SELECT y, x, round(avg(b) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS z FROM a""")
def r_blur(spark, d):
    return raster.box_blur(fx.dem(spark, d), "z", 3).select("y", "x", r(F.col("z")).alias("z"))


def _focal_sql(radius: int, name: str) -> str:
    f = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""{name}a AS (SELECT y, x, z, sum(z) OVER (PARTITION BY y ORDER BY x {f}) AS s, count(z) OVER (PARTITION BY y ORDER BY x {f}) AS n FROM dem),
  {name} AS (SELECT y, x, z, sum(s) OVER w / sum(n) OVER w AS m FROM {name}a WINDOW w AS (PARTITION BY x ORDER BY y {f}))"""


@query(f"WITH {SQL_DEM.replace(' / 10e0 AS z', ' AS z')}, {_focal_sql(5, 'f')} SELECT y, x, round(m, 6) AS mean FROM f")
def r_focal_mean(spark, d):
    """Of whole tenths, whose sums are exact."""
    return raster.focal_mean(fx.dem(spark, d).withColumn("z", F.round(F.col("z") * 10).cast("long")), "z", 5).select("y", "x", r(F.col("mean")).alias("mean"))


_TPI = f"""{_focal_sql(4, 'f')}, {_focal_sql(12, 'k')}, d AS (SELECT f.y, f.x, f.z - f.m AS a, k.z - k.m AS b FROM f JOIN k USING (y, x)), w AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM d),
  tpi AS (SELECT y, x, (a - ma)/sa AS small, (b - mb)/sb AS large FROM d, w)"""


@query(f"WITH {SQL_DEM}, {_TPI} SELECT y, x, round(small, 6) + 0 AS small, round(large, 6) + 0 AS large FROM tpi")
def r_tpi(spark, d):
    both = raster.tpi(raster.tpi(fx.dem(spark, d), "z", 4, "small"), "z", 12, "large")
    return both.select("y", "x", r(F.col("small")).alias("small"), r(F.col("large")).alias("large"))


@query(f"""WITH {SQL_DEM}, {_NEIGHBOURS}, {_TPI}, q AS (SELECT y, x, round(small, 9) AS s, round(large, 9) AS l, round(slope, 9) AS slope FROM tpi JOIN horn USING (y, x)),
  lf AS (SELECT y, x, CASE WHEN s <= -1 THEN CASE WHEN l <= -1 THEN 1 WHEN l < 1 THEN 2 ELSE 3 END WHEN s < 1 THEN CASE WHEN l <= -1 THEN 4 WHEN l < 1 THEN CASE WHEN slope <= 5 THEN 5 ELSE 6 END ELSE 7 END ELSE CASE WHEN l <= -1 THEN 8 WHEN l < 1 THEN 9 ELSE 10 END END AS landform FROM q)
  SELECT landform, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lf GROUP BY landform""")
def r_landform_shares(spark, d):
    grid = raster.tpi(raster.tpi(_terrain(spark, d), "z", 4, "small"), "z", 12, "large")
    form = raster.landform(F.round("small", 9), F.round("large", 9), F.round("slope", 9))
    return stats.shares(grid.withColumn("landform", form), "landform").select("landform", "n", r(F.col("share")).alias("share"))


@query(f"""WITH {SQL_DEM}, m AS (SELECT a.y, a.x, b.y AS ty, b.x AS tx, (a.z - b.z) / (30 * sqrt(dy*dy + dx*dx)) AS dr, k.o FROM dem a, (VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) k(o, dy, dx) JOIN dem b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.z > b.z),
  b AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY dr DESC, o) AS i FROM m)
  SELECT dem.y, dem.x, ty AS to_y, tx AS to_x, round(dr, 9) AS drop FROM dem LEFT JOIN b ON b.y = dem.y AND b.x = dem.x AND i = 1""")
def r_descent(spark, d):
    """Where water goes from each cell."""
    return raster.steepest_descent(fx.dem(spark, d), "z", CELL).select("y", "x", F.col("to_y").cast("int").alias("to_y"), F.col("to_x").cast("int").alias("to_x"), r(F.col("drop"), 9).alias("drop"))


_STOPS = [(1500.0, (40, 90, 60)), (1550.0, (200, 180, 120)), (1600.0, (250, 250, 250))]


@query(f"""WITH {SQL_DEM} SELECT y, x, round(CASE WHEN z < 1500 THEN 40 WHEN z < 1550 THEN 40 + 160*(z - 1500)/50 WHEN z < 1600 THEN 200 + 50*(z - 1550)/50 ELSE 250 END, 6) AS red, CAST(CASE WHEN z < 1550 THEN 40 WHEN z < 1600 THEN 200 ELSE 250 END AS DOUBLE) AS stepped FROM dem""")
def r_ramp(spark, d):
    return fx.dem(spark, d).select("y", "x", r(raster.ramp(F.col("z"), _STOPS)[0]).alias("red"), raster.ramp(F.col("z"), _STOPS, True)[0].alias("stepped"))


_LINE_POINTS = f"{fx.SQL_SIZE}, lp AS (SELECT s_suppkey AS line_id, j AS seq, ((s_suppkey * 37 + j * 23) % 1190) / 10e0 AS px, ((s_suppkey * 53 + j * 17) % (h * 10 - 10)) / 10e0 AS py FROM supplier, size, (SELECT unnest(range(4)) AS j))"


def _line_points(spark, d):
    h = fx.height(spark, d)
    k, j = F.col("s_suppkey"), F.col("j")
    return fx.table(spark, d, "supplier").select(k.alias("s_suppkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select(k.alias("line_id"), j.alias("seq"), ((k * 37 + j * 23) % 1190 / 10.0).alias("px"), ((k * 53 + j * 17) % (h * 10 - 10) / 10.0).alias("py"))


_RAST = f"""{_LINE_POINTS}, sg AS (SELECT *, lead(px) OVER w AS qx, lead(py) OVER w AS qy FROM lp WINDOW w AS (PARTITION BY line_id ORDER BY seq)), sn AS (SELECT *, CAST(greatest(1, ceil(greatest(abs(qx - px), abs(qy - py)))) AS INT) AS n FROM sg WHERE qx IS NOT NULL),
  st AS (SELECT *, unnest(range(n + 1)) AS t FROM sn), ras AS (SELECT DISTINCT line_id, CAST(floor(py + (qy - py) * (t / CAST(n AS DOUBLE))) AS INT) AS y, CAST(floor(px + (qx - px) * (t / CAST(n AS DOUBLE))) AS INT) AS x FROM st)"""


@query(f"WITH {_RAST} SELECT * FROM ras")
def r_rasterise(spark, d):
    return raster.rasterise(_line_points(spark, d))


@query(f"WITH {_RAST} SELECT DISTINCT CAST(y + a AS INT) AS y, CAST(x + b AS INT) AS x FROM ras, (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-2, 3)) AS b)")
def r_buffer(spark, d):
    return raster.buffer_cells(raster.rasterise(_line_points(spark, d)), 2).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


@query(f"""WITH {_RAST}, o AS (SELECT line_id, seq * 10 + k AS seq, CAST(floor(py) AS INT) AS y, CAST(floor(px) AS INT) + k AS x FROM lp, (SELECT unnest(range(10)) AS k)), hit AS (SELECT *, CAST((x * 7 + y) % 5 = 0 AS INT) AS m FROM o),
  rn AS (SELECT *, sum(m) OVER (PARTITION BY line_id ORDER BY seq) AS run FROM hit), kept AS (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS n FROM rn WHERE m = 0) SELECT line_id, CAST(run AS BIGINT) AS run, seq, y, x FROM kept WHERE n >= 2""")
def r_split_at_mask(spark, d):
    """Parts of lines outside a mask."""
    at = _line_points(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select("line_id", (F.col("seq") * 10 + F.col("k")).cast("long").alias("seq"), F.floor("py").cast("int").alias("y"), (F.floor("px") + F.col("k")).cast("long").alias("x"))
    mask = at.where((F.col("x") * 7 + F.col("y")) % 5 == 0).select("y", "x")
    return raster.split_at_mask(at, mask).select("line_id", F.col("run").cast("long").alias("run"), "seq", "y", "x")


@query(f"WITH {SQL_DEM} SELECT count(*) AS n, round(avg(z), 6) AS mean, min(z) AS least, max(z) AS most, round(count(*) * 900 / 1e6, 6) AS km2 FROM dem WHERE (y - 15)*(y - 15) + (x - 60)*(x - 60) <= 144")
def r_disc(spark, d):
    return raster.disc(fx.dem(spark, d), 15, 60, 12).agg(F.count(F.lit(1)).alias("n"), r(F.avg("z")).alias("mean"), F.min("z").alias("least"), F.max("z").alias("most"), r(F.count(F.lit(1)) * 900 / 1e6).alias("km2"))


@query(f"""WITH {SQL_DEM}, sc AS (SELECT y, x, k AS rank, CASE WHEN (x + y + k) % 3 = 0 THEN 0 ELSE (x * 13 + y * 7 + k * 101) % 9000 + 500 END AS red, (x * 3 + y * 5 + k) % 9000 + 500 AS nir, k = 1 AS ok FROM dem, (SELECT CAST(unnest(range(3)) AS INT) AS k)),
  f AS (SELECT y, x, rank, least(greatest(CASE WHEN ok THEN red ELSE red - 1000 END, 1), 65535) AS red, least(greatest(CASE WHEN ok THEN nir ELSE nir - 1000 END, 1), 65535) AS nir FROM sc WHERE red > 0), b AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY rank) AS i FROM f)
  SELECT y, x, rank, red, nir FROM b WHERE i = 1""")
def r_mosaic(spark, d):
    """First clear scene of three."""
    k, x, y = F.col("rank"), F.col("x"), F.col("y")
    scenes = fx.dem(spark, d).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumns({"red": F.when((x + y + k) % 3 == 0, 0).otherwise((x * 13 + y * 7 + k * 101) % 9000 + 500), "nir": (x * 3 + y * 5 + k) % 9000 + 500, "offset_applied": k == 1})
    return raster.mosaic(scenes, ("red", "nir"))


@query(f"""WITH {SQL_DEM}, c AS (SELECT y, x FROM dem WHERE y % 6 = 0 AND x % 6 = 0), m AS (SELECT c.y, c.x, b.y AS hy, b.x AS hx, b.z, row_number() OVER (PARTITION BY c.y, c.x ORDER BY b.z DESC, b.y, b.x) AS i FROM c JOIN dem b ON b.y BETWEEN c.y - 3 AND c.y + 3 AND b.x BETWEEN c.x - 3 AND c.x + 3)
  SELECT y, x, hy AS high_y, hx AS high_x, z AS high FROM m WHERE i = 1""")
def r_local_high(spark, d):
    grid = fx.dem(spark, d)
    return raster.local_high(grid.where("y % 6 = 0 AND x % 6 = 0").select("y", "x"), grid, "z", 3)


# ---- rays

_PAIRS = f"{SQL_DEM}, pairs AS (SELECT s_suppkey AS id, CAST((s_suppkey * 7) % {WIDTH} AS INT) AS ox, CAST((s_suppkey * 11) % h AS INT) AS oy, CAST((s_suppkey * 7 + 13 + s_suppkey % 17) % {WIDTH} AS INT) AS tx, CAST((s_suppkey * 11 + s_suppkey % 23) % h AS INT) AS ty FROM supplier, size)"


def _pairs(spark, d):
    h, k = fx.height(spark, d), F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), ((k * 7) % WIDTH).cast("int").alias("ox"), ((k * 11) % h).cast("int").alias("oy"), ((k * 7 + 13 + k % 17) % WIDTH).cast("int").alias("tx"), ((k * 11 + k % 23) % h).cast("int").alias("ty"))


#: The first step that blocks each of the pairs (id, ox, oy, tx, ty) that one blocks, as bl (id, s).
_BLOCKED = f"""e AS (SELECT p.*, sqrt((tx-ox)*(tx-ox) + (ty-oy)*(ty-oy)) AS far, a.z + 1.7 AS z0, b.z + 1.0 AS z1 FROM pairs p JOIN dem a ON a.x = ox AND a.y = oy JOIN dem b ON b.x = tx AND b.y = ty),
  n AS (SELECT *, CAST(ceil(far) AS INT) AS n, z1 - pow(far*30, 2)/(2*6371000)*0.87 AS aim FROM e), s AS (SELECT *, unnest(range(1, n)) AS s FROM n WHERE n > 1 AND far >= 1.5), sp AS (SELECT *, ox + (tx-ox)*(s/CAST(n AS DOUBLE)) AS px, oy + (ty-oy)*(s/CAST(n AS DOUBLE)) AS py, id * 1000 + s AS k FROM s), {_bilinear_sql("sp", "k")},
  bl AS (SELECT id, min(s) AS s FROM sp JOIN bil USING (k) WHERE round(v - pow(far*(s/CAST(n AS DOUBLE))*30, 2)/(2*6371000)*0.87 - z0 - (aim - z0)*(s/CAST(n AS DOUBLE)), 9) > 0 GROUP BY id)"""


@query(f"""WITH {_PAIRS}, {_BLOCKED} SELECT pairs.id, CAST(bl.s IS NULL AS INT) AS seen, CAST(bl.s AS INT) AS first_block FROM pairs LEFT JOIN bl ON bl.id = pairs.id""")
def v_line_of_sight(spark, d):
    return rays.line_of_sight(_pairs(spark, d), fx.dem(spark, d), WIDTH, fx.height(spark, d), CELL)


def _eyes(spark, d):
    """A place for each of three suppliers."""
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").where("s_suppkey BETWEEN 1 AND 3").select(k.cast("int").alias("eye"), (k * 10 - 5).cast("int").alias("y"), (k * 40 - 20).cast("int").alias("x"))


def _looked_at(reach: int) -> str:
    return f"""{SQL_DEM}, pairs AS (SELECT eye, d.y, d.x, ox, oy, d.x AS tx, d.y AS ty, (eye * 10000000 + CAST(d.y AS BIGINT)) * {WIDTH} + d.x AS id FROM (SELECT s_suppkey AS eye, s_suppkey * 10 - 5 AS oy, s_suppkey * 40 - 20 AS ox FROM supplier WHERE s_suppkey BETWEEN 1 AND 3) JOIN dem d
      ON (d.y - oy) * (d.y - oy) + (d.x - ox) * (d.x - ox) <= {reach * reach}), {_BLOCKED}"""


@query(f"""WITH {_looked_at(50)} SELECT CAST(eye AS INT) AS eye, y, x, CAST(bl.s IS NULL AS INT) AS seen FROM pairs LEFT JOIN bl USING (id)""")
def v_viewshed(spark, d):
    return rays.viewsheds(fx.dem(spark, d), _eyes(spark, d), 1500.0, CELL)


@query(f"""WITH {_looked_at(40)} SELECT y, x, CAST(sum(CAST(bl.s IS NULL AS INT)) AS BIGINT) AS n_seen FROM pairs LEFT JOIN bl USING (id) GROUP BY y, x""")
def v_seen_count(spark, d):
    """How many of three eyes see each cell."""
    return rays.seen_count([rays.viewsheds(fx.dem(spark, d), _eyes(spark, d), 1200.0, CELL)])


_PICK_STEPS = rays.pick_distances(CELL, 3 * CELL * WIDTH)
_PICKS = f"""{SQL_DEM}, picks AS (SELECT c_custkey AS id, (c_custkey * 7919) % 12000 / 100e0 AS ox, (c_custkey * 31) % 2900 / 100e0 AS oy, 1700 + c_custkey % 400 + 0e0 AS oz, cos(c_custkey * 0.7) * 0.97 AS dx, sin(c_custkey * 0.7) * 0.97 AS dy, -0.02e0 - (c_custkey % 23) * 0.01e0 AS dz FROM customer),
  lm AS (SELECT h FROM size)"""


def _pick_ground(source: str) -> str:
    """Ground under rows (id, t, ...) of a source, null off the grid, as v."""
    return f"""SELECT s.*, CASE WHEN px BETWEEN 0 AND {WIDTH - 1} AND py BETWEEN 0 AND h - 1 THEN (a.z * (1 - fx) + b.z * fx) * (1 - fy) + (c.z * (1 - fx) + d.z * fx) * fy END AS v
      FROM (SELECT *, px - gx AS fx, py - gy AS fy FROM (SELECT q.*, CAST(least(floor(px), {WIDTH - 2}) AS INT) AS gx, CAST(least(floor(py), h - 2) AS INT) AS gy, h FROM (SELECT r.*, ox + dx * t / 30 AS px, oy + dy * t / 30 AS py FROM {source} r) q, lm)) s
      LEFT JOIN dem a ON a.x = gx AND a.y = gy LEFT JOIN dem b ON b.x = gx + 1 AND b.y = gy LEFT JOIN dem c ON c.x = gx AND c.y = gy + 1 LEFT JOIN dem d ON d.x = gx + 1 AND d.y = gy + 1"""


def _picks(spark, d):
    """Rays of customers; angles are whole tenths, as SQL's decimals are."""
    k = F.col("c_custkey")
    return fx.table(spark, d, "customer").select(
        k.alias("id"), ((k * 7919) % 12000 / 100.0).alias("ox"), ((k * 31) % 2900 / 100.0).alias("oy"), (1700 + k % 400).cast("double").alias("oz"),
        (F.cos(k * 7 / 10.0) * 0.97).alias("dx"), (F.sin(k * 7 / 10.0) * 0.97).alias("dy"), (-0.02 - (k % 23) * 0.01).alias("dz"),
    )


@query(f"""WITH RECURSIVE {_PICKS}, ts AS MATERIALIZED (SELECT unnest(range({len(_PICK_STEPS)})) AS i, unnest(CAST({_PICK_STEPS!r} AS DOUBLE[])) AS t), st AS (SELECT picks.*, i, t FROM picks, ts), gr AS MATERIALIZED (SELECT id, i, oz + dz * t AS ray, v FROM ({_pick_ground("st")})),
  f AS (SELECT id, min(i) FILTER (v IS NOT NULL) AS came, min(i) FILTER (ray <= v) AS hit FROM gr GROUP BY id), ok AS (SELECT f.id, hit FROM f WHERE hit IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gr WHERE gr.id = f.id AND gr.i > came AND gr.i < hit AND v IS NULL)),
  hv(id, ox, oy, oz, dx, dy, dz, k, a, b) AS (SELECT picks.*, 0, coalesce(p.t, 0e0), ts.t FROM ok JOIN picks USING (id) JOIN ts ON ts.i = hit LEFT JOIN ts p ON p.i = hit - 1
    UNION ALL SELECT id, ox, oy, oz, dx, dy, dz, k + 1, CASE WHEN coalesce(oz + dz * t <= v, false) THEN a ELSE t END, CASE WHEN coalesce(oz + dz * t <= v, false) THEN t ELSE b END FROM ({_pick_ground("(SELECT *, (a + b) / 2 AS t FROM hv WHERE k < 18)")}))
  SELECT picks.id, round(b, 4) AS t, round(hv.ox + hv.dx * b / 30, 6) + 0 AS px, round(hv.oy + hv.dy * b / 30, 6) + 0 AS py, round(hv.oz + hv.dz * b, 4) AS z FROM picks LEFT JOIN hv ON hv.id = picks.id AND k = 18""")
def v_ray_pick(spark, d):
    """Where slanting rays of customers go under the ground."""
    found = rays.ray_pick(_picks(spark, d), fx.dem(spark, d).where(f"x < {WIDTH}"), WIDTH, fx.height(spark, d), CELL)
    return found.select("id", r(F.col("t"), 4).alias("t"), r(F.col("px")).alias("px"), r(F.col("py")).alias("py"), r(F.col("z"), 4).alias("z"))


@query()
def v_best_vantages(spark, d):
    """Of a lattice of cells the best on open ground, apart from one another."""
    grid = fx.cover(spark, d).withColumn("open", F.col("code").isin(8, 10, 13))
    return rays.best_vantages(grid, grid.where("y % 30 = 0 AND x % 30 = 0"), CELL, open_col="open")


@query()
def v_sun_exposure(spark, d):
    sun = [(8 + i / 2, 110 + 8.0 * i, 5 + 3.0 * min(i, 16 - i)) for i in range(17)]
    return rays.sun_exposure(_terrain(spark, d), sun, CELL, 0.5)


_FAN = ", ".join(f"({k}, {math.sin(math.radians(270 + o))!r}, {math.cos(math.radians(270 + o))!r})" for k, o in enumerate((-15.0, -7.5, 0.0, 7.5, 15.0)))


@query(f"""WITH {SQL_DEM}, ray AS (SELECT y, x, z AS z0, k, s, x + e*s AS px, y - n*s AS py, ((CAST(y AS BIGINT)*{WIDTH} + x)*5 + k)*4 + s - 1 AS key FROM dem, (VALUES {_FAN}) f(k, e, n), (SELECT unnest(range(1, 5)) AS s)), {_bilinear_sql("ray", "key")},
  a AS (SELECT y, x, k, max(degrees(atan((v - z0)/(s*30)))) AS a FROM ray JOIN bil USING (key) GROUP BY y, x, k) SELECT y, x, round(avg(a), 6) + 0 AS shelter FROM a GROUP BY y, x""")
def v_wind_shelter(spark, d):
    return rays.wind_shelter(fx.dem(spark, d), 270.0, 120.0, CELL, WIDTH, fx.height(spark, d)).select("y", "x", r(F.col("shelter")).alias("shelter"))


@query(f"""WITH {SQL_DEM}, sc AS (SELECT y, x, z FROM dem WHERE y % 9 = 4 AND x % 9 = 4), m AS (SELECT dem.y, dem.x, sc.z, (sc.y - dem.y)*(sc.y - dem.y) + (sc.x - dem.x)*(sc.x - dem.x) AS d2 FROM dem JOIN sc ON sc.y BETWEEN dem.y - 10 AND dem.y + 10 AND sc.x BETWEEN dem.x - 10 AND dem.x + 10)
  SELECT y, x, round(sum(exp(-d2/18e0) * z) / sum(exp(-d2/18e0)), 6) AS z FROM m WHERE d2 <= 100 GROUP BY y, x""")
def v_kernel_smooth(spark, d):
    grid = fx.dem(spark, d)
    return rays.kernel_smooth(grid.where("y % 9 = 4 AND x % 9 = 4"), grid.select("y", "x"), "z").select("y", "x", r(F.col("z")).alias("z"))


# ---- flood, cost, contours

@query("SELECT s_suppkey AS id, round(6 * exp(-3.5 * abs((s_suppkey % 41 - 20) / 20e0 + 0.05)), 9) AS kmh FROM supplier")
def f_tobler(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), r(walks.tobler_speed((k % 41 - 20) / 20.0), 9).alias("kmh"))


_WALK = "CASE WHEN code = 18 THEN 0.0 WHEN code IN (1, 2) THEN 0.5 ELSE 0.8 END"


def _walk_grid(spark, d):
    return fx.cover(spark, d).withColumn("factor", F.when(F.col("code") == 18, 0.0).when(F.col("code").isin(1, 2), 0.5).otherwise(0.8)).withColumn("size", CELL + F.col("y") % 7 / 100)


def _walk_starts(spark, d):
    """There and back, from a place for each of a few suppliers."""
    s = fx.table(spark, d, "supplier").where("s_suppkey = 1")
    way = F.explode(F.array(F.lit(False), F.lit(True))).alias("reverse")
    return s.select((F.col("s_suppkey") * 2).alias("_k"), (F.col("s_suppkey") * 7 % 30).cast("int").alias("sy"), (F.col("s_suppkey") * 41 % WIDTH).cast("int").alias("sx"), way).select((F.col("_k") + F.col("reverse").cast("int")).cast("int").alias("start"), "sy", "sx", "reverse")


_MOVES = ", ".join(f"({dy}, {dx}, {walks.LENGTHS[dy * dy + dx * dx]!r})" for dy, dx in walks.MOVES)
#: Hours of every move between cells, and the least hours from each start, corrected until nothing gets shorter.
_SQL_HOURS = f"""{SQL_COVER}, g AS (SELECT CAST(y AS BIGINT) * {WIDTH} + x AS id, y, x, z, {_WALK} AS factor, 30 + y % 7 / 100e0 AS size FROM cover),
  st AS (SELECT CAST(s_suppkey * 2 + CAST(back AS INT) AS INT) AS start, back, (s_suppkey * 7 % 30) * {WIDTH} + s_suppkey * 41 % {WIDTH} AS id FROM supplier, (VALUES (false), (true)) AS r(back) WHERE s_suppkey = 1),
  mv AS (SELECT a.id, b.id AS dst, len * a.size AS run, b.z - a.z AS up, (a.factor + b.factor) / 2 AS mean FROM g a, (VALUES {_MOVES}) m(dy, dx, len) JOIN g b ON b.y = a.y + dy AND b.x = a.x + dx WHERE a.factor + b.factor > 0),
  co AS MATERIALIZED (SELECT back, id, dst, run / 1000 / (6 * exp(-3.5 * abs(CASE WHEN back THEN -up ELSE up END / run + 0.05)) * mean) AS cost FROM mv, (VALUES (false), (true)) AS r(back)),
  walked(start, id, back, h) USING KEY (start, id) AS (SELECT start, id, back, 0e0 FROM st
  UNION SELECT w.start, co.dst, w.back, min(w.h + co.cost) FROM walked w JOIN co ON co.id = w.id AND co.back = w.back LEFT JOIN recurring.walked k ON k.start = w.start AND k.id = co.dst GROUP BY w.start, co.dst, w.back, k.h HAVING min(w.h + co.cost) < coalesce(k.h, 1e300))"""


@query(f"WITH RECURSIVE {_SQL_HOURS} SELECT start, back AS reverse, CAST(id // {WIDTH} AS INT) AS y, CAST(id % {WIDTH} AS INT) AS x, round(h, 6) AS hours FROM walked")
def f_travel_time(spark, d):
    """Hours from a few starts, and back to them."""
    return walks.travel_table(_walk_grid(spark, d), _walk_starts(spark, d), "size").select("start", "reverse", "y", "x", r(F.col("hours")).alias("hours"))


@query()
def f_travel_path(spark, d):
    """The ways from each start to the corners of a lattice of cells."""
    table = walks.travel_table(_walk_grid(spark, d), _walk_starts(spark, d), "size").withColumn("hours", r(F.col("hours")))
    ends = table.where("y % 20 = 19 AND x % 20 = 19").select(F.concat_ws(":", "start", "y", "x").alias("path"), "start", "y", "x")
    return walks.path_table(table, ends).select("path", "seq", "y", "x", "hours")


_SQL_NEAR = ", ".join(f"({dy}, {dx})" for dy, dx in flood.STEPS_8)
#: Levels by correction until nothing falls; the steepest way or the lowest neighbour; areas along ways to ever later cells, and what earlier cells get besides.
_SQL_DRAINED = f"""{SQL_DEM}, g AS MATERIALIZED (SELECT CAST(y AS BIGINT) * {WIDTH} + x AS id, y, x, z, y IN (0, h - 1) OR x IN (0, {WIDTH - 1}) AS rim FROM dem, size),
  nb AS MATERIALIZED (SELECT a.id, b.id AS dst, b.z, sqrt(dy * dy + dx * dx) AS len, a.z AS z0, a.rim FROM g a, (VALUES {_SQL_NEAR}) m(dy, dx) JOIN g b ON b.y = a.y + dy AND b.x = a.x + dx),
  fill(id, f) USING KEY (id) AS (SELECT id, z FROM g WHERE rim
    UNION SELECT nb.id, min(greatest(nb.z0, fill.f + 1e-3)) FROM fill JOIN nb ON nb.dst = fill.id AND NOT nb.rim LEFT JOIN recurring.fill k ON k.id = nb.id GROUP BY nb.id, k.f HAVING min(greatest(nb.z0, fill.f + 1e-3)) < coalesce(k.f, 1e300)),
  steep AS (SELECT id, arg_max(dst, (drop_, -dst)) AS dst, max(drop_) AS most FROM (SELECT id, dst, (z0 - z) / (30 * len) AS drop_ FROM nb) GROUP BY id),
  back AS (SELECT nb.id, arg_min(nb.dst, (f, nb.dst)) AS dst FROM nb JOIN fill ON fill.id = nb.dst WHERE NOT rim GROUP BY nb.id),
  down AS MATERIALIZED (SELECT fill.id, f, CASE WHEN abs(f - z) < 0.01 AND most > 0 THEN steep.dst ELSE back.dst END AS down FROM fill JOIN g USING (id) JOIN steep USING (id) LEFT JOIN back USING (id)),
  onward AS MATERIALIZED (SELECT a.id, a.down AS dst FROM down a JOIN down b ON b.id = a.down WHERE a.f > b.f OR (a.f = b.f AND a.id < b.id)),
  way(id, dst) AS (SELECT id, id FROM down UNION ALL SELECT way.id, onward.dst FROM way JOIN onward ON onward.id = way.dst),
  up AS (SELECT dst AS id, count(*) * 900 / 1e6 AS km2 FROM way GROUP BY dst),
  late AS (SELECT down.down AS id, sum(km2) AS km2 FROM down JOIN up USING (id) LEFT JOIN onward USING (id) WHERE down.down IS NOT NULL AND onward.id IS NULL GROUP BY down.down),
  drained AS MATERIALIZED (SELECT down.id, f, down, up.km2 + coalesce(late.km2, 0) AS km2 FROM down JOIN up USING (id) LEFT JOIN late USING (id))"""


@query(f"""WITH RECURSIVE {_SQL_DRAINED} SELECT CAST(id // {WIDTH} AS INT) AS y, CAST(id % {WIDTH} AS INT) AS x, round(f, 6) AS filled, CAST(down // {WIDTH} AS INT) AS down_y, CAST(down % {WIDTH} AS INT) AS down_x, round(km2, 6) AS area_km2 FROM drained""")
def f_drainage(spark, d):
    return flood.drainage_table(fx.dem(spark, d), CELL).withColumns({c: r(F.col(c)) for c in ("filled", "area_km2")})


@query(f"""WITH RECURSIVE {_SQL_DRAINED}, ch AS MATERIALIZED (SELECT * FROM drained WHERE km2 >= 0.04), n AS (SELECT a.down AS id, count(*) AS n FROM ch a JOIN ch b ON b.id = a.down GROUP BY a.down),
  link AS MATERIALIZED (SELECT ch.id, ch.down, coalesce(n, 0) <> 1 AS tip FROM ch LEFT JOIN n USING (id)),
  reach(head, seq, id, down, stop) AS (SELECT id, 0, id, down, false FROM link WHERE tip UNION ALL SELECT head, seq + 1, reach.down, link.down, coalesce(link.tip, true) FROM reach LEFT JOIN link ON link.id = reach.down WHERE NOT stop AND reach.down IS NOT NULL),
  e AS (SELECT head, max(seq) AS n, arg_max(id, seq) AS last FROM reach GROUP BY head HAVING max(seq) > 0)
  SELECT head // {WIDTH} || ':' || head % {WIDTH} AS reach, CAST(seq AS INT) AS seq, CAST(reach.id // {WIDTH} AS INT) AS y, CAST(reach.id % {WIDTH} AS INT) AS x, round(km2, 6) AS km2 FROM reach JOIN e USING (head) JOIN drained ON drained.id = e.last""")
def f_streams(spark, d):
    return flood.stream_table(flood.drainage_table(fx.dem(spark, d), CELL), 0.04).withColumn("km2", r(F.col("km2")))


@query()
def f_summits(spark, d):
    return peaks.summit_table(fx.dem(spark, d), 5.0)


@query()
def f_saddles(spark, d):
    """Key saddles of all peaks within a box, spaced, with whether they are open ground."""
    cover = fx.cover(spark, d).withColumn("open", F.col("code").isin(8, 10, 13))
    return peaks.chosen_saddles(peaks.summit_table(cover, 3.0, None), cover, CELL, (15.0, 60.0), (2, 2, fx.height(spark, d) - 2, WIDTH - 2))


_RING = ", ".join(f"({k}, {s}, {s * 5 * math.sin(math.radians(5 * k))!r}, {-s * 5 * math.cos(math.radians(5 * k))!r})" for k in range(36) for s in (1, -1))


@query(f"""WITH {SQL_DEM}, c AS (SELECT y, x, z, CAST(y AS BIGINT)*{WIDTH} + x AS id FROM dem WHERE y % 10 = 5 AND x % 10 = 5), rg AS (SELECT id, k, s, (id*36 + k)*2 + (s + 1)//2 AS key, x + dx AS px, y + dy AS py FROM c, (VALUES {_RING}) v(k, s, dx, dy)), {_bilinear_sql("rg", "key")},
  b AS (SELECT id, k, max(v) FILTER (s = 1) AS a, max(v) FILTER (s = -1) AS b FROM rg JOIN bil USING (key) GROUP BY id, k), m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(greatest(a, b), 9), k) AS i FROM b)
  SELECT c.id, CAST(k * 5 AS INT) AS angle, round(c.z - a, 6) + 0 AS drop_a, round(c.z - b, 6) + 0 AS drop_b FROM m JOIN c ON c.id = m.id WHERE i = 1""")
def f_saddle_axis(spark, d):
    grid = fx.dem(spark, d)
    at = grid.where("y % 10 = 5 AND x % 10 = 5").select("y", "x", (F.col("y").cast("long") * WIDTH + F.col("x")).alias("id"))
    return peaks.saddle_axis(at, grid, WIDTH, fx.height(spark, d), 5.0).select("id", "angle", r(F.col("drop_a")).alias("drop_a"), r(F.col("drop_b")).alias("drop_b"))


_CASES = " ".join(f"WHEN {c} THEN ['{s[0]}']" for c, s in contour.CASES.items())
_SPOT = {"T": ("x + ((lv - a)/(b - a) + 0.5)", "y + 0.5"), "B": ("x + ((lv - d)/(c - d) + 0.5)", "y + 1.5"), "L": ("x + 0.5", "y + ((lv - a)/(d - a) + 0.5)"), "R": ("x + 1.5", "y + ((lv - b)/(c - b) + 0.5)")}


def _spot_sql(side: str, axis: int) -> str:
    return "CASE " + side + " " + " ".join(f"WHEN '{k}' THEN {v[axis]}" for k, v in _SPOT.items()) + " END"


_SEGMENTS_SQL = f"""WITH {SQL_DEM}, w AS (SELECT y, x, z AS a, lead(z) OVER (PARTITION BY y ORDER BY x) AS b FROM dem), q AS (SELECT * FROM (SELECT *, lead(a) OVER (PARTITION BY x ORDER BY y) AS d, lead(b) OVER (PARTITION BY x ORDER BY y) AS c FROM w) WHERE a + b + c + d IS NOT NULL),
  l AS (SELECT *, unnest(range(CAST(ceil((least(a,b,c,d) - {contour.NUDGE})/20) AS BIGINT), CAST(floor((greatest(a,b,c,d) - {contour.NUDGE})/20) AS BIGINT) + 1)) * 20 + {contour.NUDGE}e0 AS lv FROM q),
  k AS (SELECT *, CAST(a > lv AS INT) + 2*CAST(b > lv AS INT) + 4*CAST(c > lv AS INT) + 8*CAST(d > lv AS INT) AS ca, (a + b + c + d)/4 > lv AS mid FROM l),
  s AS (SELECT *, unnest(CASE ca WHEN 5 THEN CASE WHEN mid THEN ['TR','LB'] ELSE ['LT','RB'] END WHEN 10 THEN CASE WHEN mid THEN ['LT','RB'] ELSE ['TR','LB'] END {_CASES} END) AS sd FROM k), t AS (SELECT *, substr(sd, 1, 1) AS sa, substr(sd, 2, 1) AS sb FROM s)
  , raw AS (SELECT round(lv - {contour.NUDGE}e0, {{digits}}) AS level, y, x, sa AS side_a, sb AS side_b, round({_spot_sql("sa", 0)}, {{digits}}) AS ax, round({_spot_sql("sa", 1)}, {{digits}}) AS ay, round({_spot_sql("sb", 0)}, {{digits}}) AS bx, round({_spot_sql("sb", 1)}, {{digits}}) AS by FROM t)"""


@query(_SEGMENTS_SQL.format(digits=6) + " SELECT * FROM raw")
def f_contour_segments(spark, d):
    return contour.segments(fx.dem(spark, d), "z", 20.0).select(r(F.col("level")).alias("level"), "y", "x", "side_a", "side_b", *(r(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")))


_SQL_SEGMENTS = f"""seg AS MATERIALIZED (SELECT level, (y + CAST(side_a = 'B' AS INT)) * 4294967296 + (x + CAST(side_a = 'R' AS INT)) * 2 + CAST(side_a IN ('L', 'R') AS INT) AS a, (y + CAST(side_b = 'B' AS INT)) * 4294967296 + (x + CAST(side_b = 'R' AS INT)) * 2 + CAST(side_b IN ('L', 'R') AS INT) AS b,
  sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS len FROM raw), both_ AS MATERIALIZED (SELECT level, a, b FROM seg UNION ALL SELECT level, b, a FROM seg)"""


@query(f"""WITH RECURSIVE {_SEGMENTS_SQL.format(digits=12)[5:]}, {_SQL_SEGMENTS},
  low(level, side, low) USING KEY (level, side) AS (SELECT level, a, min(least(a, b)) FROM both_ GROUP BY level, a
    UNION SELECT low.level, both_.b, min(low.low) FROM low JOIN both_ ON both_.level = low.level AND both_.a = low.side JOIN recurring.low k ON k.level = low.level AND k.side = both_.b GROUP BY low.level, both_.b, k.low HAVING min(low.low) < k.low),
  deg AS (SELECT level, a AS side, count(*) AS n FROM both_ GROUP BY level, a), ring AS (SELECT low.level, low, min(n) = 2 AS closed FROM low JOIN deg USING (level, side) GROUP BY low.level, low)
  SELECT seg.level, ring.low AS line_id, closed, CAST(count(*) + 1 AS INT) AS n, round(sum(len), 6) AS length FROM seg JOIN low ON low.level = seg.level AND low.side = seg.a JOIN ring ON ring.level = seg.level AND ring.low = low.low GROUP BY seg.level, ring.low, closed""")
def f_contours(spark, d):
    """Whole contour lines with their lengths."""
    found = contour.contours(fx.dem(spark, d), "z", 20.0)
    return found.select(r(F.col("level")).alias("level"), "line_id", "closed", F.size("pts").alias("n"), r(contour.polyline_length(F.col("pts"))).alias("length"))


@query()
def f_contours_thinned(spark, d):
    """Contour lines with the points that a tenth of a cell keeps."""
    found = contour.contours(fx.dem(spark, d), "z", 20.0, 0.1)
    return found.select(r(F.col("level")).alias("level"), "line_id", "closed", F.size("pts").alias("n"))


@query(f"""WITH {_LINE_POINTS}, m AS (SELECT *, avg(px) OVER w AS ax, avg(py) OVER w AS ay, lag(seq) OVER o IS NULL OR lead(seq) OVER o IS NULL AS tip FROM lp WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), o AS (PARTITION BY line_id ORDER BY seq))
  SELECT line_id, CAST(seq AS INT) AS seq, round(CASE WHEN tip THEN px ELSE ax END, 6) AS px, round(CASE WHEN tip THEN py ELSE ay END, 6) AS py FROM m""")
def f_smooth_line(spark, d):
    return contour.smooth_line(_line_points(spark, d), 1).select("line_id", "seq", r(F.col("px")).alias("px"), r(F.col("py")).alias("py"))


# ---- vectors

def _sql_polygons() -> str:
    """Edges (fid, x1, y1, x2, y2) of the fixture's rings, moved by their regions."""
    d = 0.00005
    box = lambda w, s, e, n: [(w + d, s + d), (e + d, s + d), (e + d, n + d), (w + d, n + d)]
    shapes = [
        [box(-119.80, 53.85, -119.50, 54.00)], [box(-119.60, 53.95, -119.30, 54.20)], [box(-119.20, 53.82, -119.00, 54.28), box(-119.15, 53.90, -119.05, 54.10)],
        [[(-119.75 + d, 54.05 + d), (-119.45 + d, 54.05 + d), (-119.45 + d, 54.10 + d), (-119.65 + d, 54.10 + d), (-119.65 + d, 54.25 + d), (-119.75 + d, 54.25 + d)]], [box(-119.40, 54.10, -119.10, 54.15)],
    ]
    rows = [f"({f}, {a[0]!r}e0, {a[1]!r}e0, {b[0]!r}e0, {b[1]!r}e0)" for f, rings in enumerate(shapes) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1])]
    return f"corner(fid, x1, y1, x2, y2) AS (VALUES {', '.join(rows)}), edge AS (SELECT fid, x1 + m AS x1, y1 + m AS y1, x2 + m AS x2, y2 + m AS y2 FROM corner JOIN (SELECT r_regionkey, length(r_name) / 1000000e0 AS m FROM region) ON r_regionkey = fid)"


_INSIDE = f"{SQL_POINTS}, {_sql_polygons()}, ins AS (SELECT id, CAST(fid AS BIGINT) AS fid FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)*(lat - y1)/(y2 - y1) + x1 GROUP BY id, fid HAVING count(*) % 2 = 1)"


@query(f"WITH {_INSIDE} SELECT id, fid FROM ins")
def j_containing(spark, d):
    """All polygons that hold a point."""
    return vector.containing(fx.points(spark, d).select("id", "lon", "lat"), fx.polygons(spark, d)).select("id", "fid")


@query(f"WITH {_INSIDE} SELECT pts.id, min(fid) AS fid FROM pts LEFT JOIN ins ON ins.id = pts.id GROUP BY pts.id")
def j_first_containing(spark, d):
    return vector.first_containing(fx.points(spark, d).select("id", "lon", "lat"), fx.polygons(spark, d)).select("id", "fid")


@query(f"WITH {_INSIDE} SELECT id, 'in' AS side FROM pts WHERE id IN (SELECT id FROM ins) UNION ALL SELECT id, 'out' FROM pts WHERE id NOT IN (SELECT id FROM ins)")
def j_semi_anti(spark, d):
    p, g = fx.points(spark, d).select("id", "lon", "lat"), fx.polygons(spark, d)
    return vector.inside_any(p, g).select("id", F.lit("in").alias("side")).unionByName(vector.outside_all(p, g).select("id", F.lit("out").alias("side")))


_PLANE = "(x1 - lon)*111320*cos(radians(lat)) AS ax, (y1 - lat)*111200 AS ay, (x2 - lon)*111320*cos(radians(lat)) AS gx, (y2 - lat)*111200 AS gy"
_FOOT = "least(greatest(coalesce((0 - ax*(gx-ax) - ay*(gy-ay))/nullif((gx-ax)*(gx-ax) + (gy-ay)*(gy-ay), 0), 0), 0), 1) AS t"


@query(f"""WITH {_INSIDE}, a AS (SELECT id, CAST(fid AS BIGINT) AS fid, {_PLANE} FROM pts, edge), b AS (SELECT *, {_FOOT} FROM a), c AS (SELECT id, fid, round(min(sqrt(pow(ax + t*(gx-ax), 2) + pow(ay + t*(gy-ay), 2))), 6) AS metres FROM b GROUP BY id, fid)
  SELECT c.id, c.fid, round(metres, 3) AS metres FROM c LEFT JOIN ins ON ins.id = c.id AND ins.fid = c.fid WHERE ins.id IS NULL AND metres <= 2000""")
def j_near_polygons(spark, d):
    """Polygons within two kilometres of a point that they don't hold."""
    return vector.distance_to_polygons(fx.points(spark, d).select("id", "lon", "lat"), fx.polygons(spark, d), 2000.0).select("id", "fid", r(F.col("metres"), 3).alias("metres"))


_SEGS = """sg AS (SELECT s_suppkey AS fid, j AS n, -119.80e0 + ((s_suppkey*613)%7000 + 20*j)/10000e0 AS x1, 53.85e0 + ((s_suppkey*271)%4000 + 15*(j%2))/10000e0 AS y1, -119.80e0 + ((s_suppkey*613)%7000 + 20*(j+1))/10000e0 AS x2, 53.85e0 + ((s_suppkey*271)%4000 + 15*((j+1)%2))/10000e0 AS y2 FROM supplier, (SELECT unnest(range(4)) AS j))"""


@query(f"""WITH {SQL_POINTS}, {_SEGS}, a AS (SELECT id, lon, lat, fid, n, {_PLANE} FROM pts JOIN sg ON abs(sg.y1 - lat) < 0.05 AND abs(sg.x1 - lon) < 0.09), b AS (SELECT *, {_FOOT} FROM a), c AS (SELECT *, ax + t*(gx-ax) AS fx, ay + t*(gy-ay) AS fy FROM b), e AS (SELECT *, round(sqrt(fx*fx + fy*fy), 6) AS m FROM c),
  f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, fid, n) AS i FROM e WHERE m <= 3000) SELECT id, fid, round(m, 3) AS metres, round((degrees(atan2(fx, fy)) + 360) % 360, 4) AS bearing FROM f WHERE i = 1""")
def j_nearest_line(spark, d):
    return vector.nearest_within(fx.points(spark, d).select("id", "lon", "lat"), fx.lines(spark, d).select("fid", "pts"), 3000.0).select("id", "fid", r(F.col("metres"), 3).alias("metres"), r(F.col("bearing"), 4).alias("bearing"))


@query(f"""WITH {_sql_polygons()}, pts AS (SELECT i AS id, {fx.BOX[0]} + (i % 40 + 0.5)*({fx.BOX[2]} - {fx.BOX[0]})/40e0 AS lon, {fx.BOX[1]} + (i // 40 + 0.5)*({fx.BOX[3]} - {fx.BOX[1]})/40e0 AS lat FROM (SELECT unnest(range(1600)) AS i)),
  ins AS (SELECT id FROM pts, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1)*(lat - y1)/(y2 - y1) + x1 GROUP BY id, fid HAVING count(*) % 2 = 1) SELECT round(count(DISTINCT id)/1600e0, 6) AS share FROM ins""")
def j_areal_share(spark, d):
    return vector.areal_share(spark, fx.polygons(spark, d), fx.BOX).select(r(F.col("share")).alias("share"))


@query(f"""WITH {SQL_POINTS}, {_SEGS}, v AS (SELECT DISTINCT x, y FROM (SELECT x1 AS x, y1 AS y FROM sg UNION ALL SELECT x2, y2 FROM sg)), m AS (SELECT id, min(2*6371008.8*asin(sqrt(pow(sin(radians(y - lat)/2), 2) + cos(radians(lat))*cos(radians(y))*pow(sin(radians(x - lon)/2), 2)))) AS m FROM pts, v GROUP BY id)
  SELECT id, round(round(m, 6), 3) AS metres FROM m""")
def j_nearest_vertex(spark, d):
    return vector.nearest_vertex(fx.points(spark, d), fx.lines(spark, d)).select("id", r(F.col("metres"), 3).alias("metres"))


@query()
def j_interior_points(spark, d):
    return vector.interior_points(spark, fx.polygons(spark, d)).select("fid", r(F.col("lon")).alias("lon"), r(F.col("lat")).alias("lat"), r(F.col("score"), 3).alias("score"))


@query(f"WITH {SQL_POINTS} SELECT id FROM pts WHERE lon BETWEEN -119.6 AND -119.3 AND lat BETWEEN 53.95 AND 54.2")
def j_in_box(spark, d):
    return fx.points(spark, d).where(vector.in_box(F.col("lon"), F.col("lat"), (-119.6, 53.95, -119.3, 54.2))).select("id")


@query(f"""WITH {_SEGS}, f AS (SELECT fid, min(n) AS n FROM sg GROUP BY fid), k AS (SELECT fid, 'road ' || (fid % 4) AS name, row_number() OVER (PARTITION BY fid % 4 ORDER BY fid) AS i FROM f WHERE fid % 4 <> 2) SELECT fid, name FROM k WHERE i <= 3""")
def j_capped_names(spark, d):
    """Three of a name at most, taken names left out."""
    taken = spark.createDataFrame([("road 2",)], "name string")
    return vector.capped_names(fx.lines(spark, d).select("fid", "name"), taken, 3, F.col("fid")).select("fid", "name")


# ---- networks

_EDGES = """k AS (SELECT count(*) AS n FROM supplier), one AS (SELECT s_suppkey AS src, (s_suppkey - 1 + hop) % n + 1 AS dst, (1000 + (s_suppkey*613)%4000)*hop AS metres, ['highway','gravel','track'][s_suppkey%3+1] AS kind, (1000 + (s_suppkey*613)%4000)*hop*[10,16,40][s_suppkey%3+1]/10e0 AS cost FROM supplier, k, (VALUES (1), (7)) h(hop)),
  edges AS (SELECT * FROM one UNION ALL SELECT dst, src, metres, kind, cost FROM one)"""


@query(f"""WITH RECURSIVE {_EDGES}, dist(node, cost) USING KEY (node) AS (SELECT CAST(1 AS BIGINT), 0e0 UNION SELECT e.dst, min(d.cost + e.cost) FROM dist d JOIN edges e ON e.src = d.node LEFT JOIN recurring.dist r ON r.node = e.dst WHERE r.node IS NULL OR d.cost + e.cost < r.cost GROUP BY e.dst)
  SELECT node, round(cost, 3) AS cost FROM dist""")
def n_distances(spark, d):
    """Costs from a node to all others, by rounds of joins."""
    return network.distances_from(fx.edges(spark, d).select("src", "dst", "step"), 1).select("node", r(F.col("cost"), 3).alias("cost"))


@query(f"""WITH RECURSIVE {_EDGES}, n AS (SELECT count(*) AS n FROM supplier), trips AS MATERIALIZED (SELECT c_custkey AS trip, (c_custkey * 7) % n + 1 AS start, (c_custkey * 31) % n + 1 AS goal FROM customer, n WHERE c_custkey % 25 = 1),
  way(trip, node, cost, before) USING KEY (trip, node) AS (SELECT trip, start, 0e0, CAST(-1 AS BIGINT) FROM trips
    UNION SELECT w.trip, e.dst, min(w.cost + e.cost), arg_min(w.node, (w.cost + e.cost, w.node)) FROM way w JOIN edges e ON e.src = w.node LEFT JOIN recurring.way k ON k.trip = w.trip AND k.node = e.dst
      GROUP BY w.trip, e.dst, k.cost, k.before HAVING min((w.cost + e.cost, w.node)) < coalesce((k.cost, k.before), (1e300, 0))),
  back(trip, k, node, cost, before) AS (SELECT way.trip, 0, node, cost, before FROM way JOIN trips ON trips.trip = way.trip AND goal = node UNION ALL SELECT way.trip, k + 1, way.node, way.cost, way.before FROM back JOIN way ON way.trip = back.trip AND way.node = back.before)
  SELECT trip, CAST(max(k) OVER (PARTITION BY trip) - k AS INT) AS seq, node, round(cost, 3) AS cost FROM back""")
def n_shortest_path(spark, d):
    """The ways of a trip for some customers, all at once."""
    n = fx.table(spark, d, "supplier").count()
    k = F.col("c_custkey")
    trips = fx.table(spark, d, "customer").where("c_custkey % 25 = 1").select(k.alias("trip"), ((k * 7) % n + 1).alias("start"), ((k * 31) % n + 1).alias("goal"))
    return network.shortest_paths(fx.edges(spark, d), trips, digits=3).select("trip", "seq", "node", "cost")


def _trip_steps(spark, d):
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("highway", "gravel", "track")))
    return o.select((k % 50).alias("trip"), k.alias("seq"), F.element_at(kinds, (F.floor(k / 150) % 3 + 1).cast("int")).alias("kind"), (100 + k % 700).alias("metres"))


_STEPS = "st AS (SELECT o_orderkey % 50 AS trip, o_orderkey AS seq, ['highway','gravel','track'][(o_orderkey // 150) % 3 + 1] AS kind, 100 + o_orderkey % 700 AS metres FROM orders)"


@query(f"""WITH {_STEPS}, f AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS nw FROM st WINDOW w AS (PARTITION BY trip ORDER BY seq)), g AS (SELECT *, sum(nw) OVER (PARTITION BY trip ORDER BY seq) AS leg FROM f), m AS (SELECT trip, leg, kind, sum(metres)/1000e0 AS km FROM g GROUP BY trip, leg, kind)
  SELECT trip, CAST(leg AS INT) AS leg, kind, round(km, 6) AS km, round(sum(km) OVER (PARTITION BY trip ORDER BY leg), 6) AS upto_km FROM m""")
def n_legs(spark, d):
    """Runs of one kind, with running kilometres."""
    steps = _trip_steps(spark, d).withColumn("km", F.col("metres") / 1000)
    return network.running_km(network.merged(steps, order="seq")).select("trip", "leg", "kind", r(F.col("km")).alias("km"), r(F.col("upto_km")).alias("upto_km"))


@query(f"""WITH {_STEPS}, f AS (SELECT *, CASE WHEN kind = lag(kind) OVER w THEN 0 ELSE 1 END AS nw FROM st WINDOW w AS (PARTITION BY trip ORDER BY seq)), g AS (SELECT *, sum(nw) OVER (PARTITION BY trip ORDER BY seq) AS leg FROM f), m AS (SELECT trip, leg, kind, sum(metres)/1000e0 AS km FROM g GROUP BY trip, leg, kind),
  h AS (SELECT *, min(CASE WHEN kind = 'highway' AND km >= 0.8 THEN leg END) OVER (PARTITION BY trip) AS fl FROM m), t AS (SELECT trip, CASE WHEN leg < fl THEN 'town' ELSE kind END AS kind, km FROM h)
  SELECT trip, round(sum(CASE WHEN kind = 'town' THEN km ELSE 0 END), 6) AS town_km, round(sum(CASE WHEN kind = 'highway' THEN km ELSE 0 END), 6) AS highway_km, round(sum(CASE WHEN kind = 'gravel' THEN km ELSE 0 END), 6) AS gravel_km, round(sum(CASE WHEN kind = 'track' THEN km ELSE 0 END), 6) AS track_km, round(sum(km), 6) AS km FROM t GROUP BY trip""")
def n_km_by_kind(spark, d):
    parts = network.merged(_trip_steps(spark, d).withColumn("km", F.col("metres") / 1000), order="seq")
    out = network.km_by_kind(network.town_first(parts, 0.8))
    return out.select("trip", *(r(F.col(c)).alias(c) for c in out.columns if c != "trip"))


@query(f"""WITH {_SEGS}, dd AS (SELECT *, 2*6371008.8*asin(sqrt(pow(sin(radians(y2 - y1)/2), 2) + cos(radians(y1))*cos(radians(y2))*pow(sin(radians(x2 - x1)/2), 2))) AS m FROM sg), t AS (SELECT *, CAST(greatest(1, ceil(m/40)) AS INT) AS k FROM dd)
  SELECT fid, CAST(sum(k) + 1 AS BIGINT) AS samples, round(sum(m)/1000, 6) AS km FROM t GROUP BY fid""")
def n_densify(spark, d):
    """Samples every forty metres along lines."""
    at = fx.lines(spark, d).select(F.col("fid").alias("line_id"), F.posexplode("pts").alias("seq", "p")).select("line_id", "seq", F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))
    return network.densify(at, 40.0).groupBy(F.col("line_id").alias("fid")).agg(F.count(F.lit(1)).alias("samples"), r(F.max("km")).alias("km"))


@query("""WITH p AS (SELECT o_orderkey % 20 AS line_id, o_orderkey AS i, o_totalprice / 1000 AS z, o_orderkey * 0.01 AS km FROM orders), s AS (SELECT *, avg(z) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS f FROM p), g AS (SELECT *, f - lag(f) OVER (PARTITION BY line_id ORDER BY i) AS dz FROM s)
  SELECT line_id, round(sum(CASE WHEN dz > 0 THEN dz ELSE 0 END), 4) AS gain, round(sum(CASE WHEN dz < 0 THEN -dz ELSE 0 END), 4) AS loss, round(min(z), 6) AS least, round(max(z), 6) AS most FROM g GROUP BY line_id""")
def n_profile(spark, d):
    """Gain and loss on the moving average."""
    k = F.col("o_orderkey")
    p = fx.table(spark, d, "orders").select((k % 20).alias("line_id"), k.alias("i"), (F.col("o_totalprice") / 1000).alias("z"), (k * 0.01).alias("km"))
    return network.smoothed_profile(p, 40.0, 200.0).select("line_id", r(F.col("gain"), 4).alias("gain"), r(F.col("loss"), 4).alias("loss"), r(F.col("least")).alias("least"), r(F.col("most")).alias("most"))


@query("""WITH p AS (SELECT o_orderkey % 20 AS g, o_orderkey AS i, row_number() OVER (PARTITION BY o_orderkey % 20 ORDER BY o_orderkey) - 1 AS k, greatest(1, floor(count(*) OVER (PARTITION BY o_orderkey % 20) / 48)) AS n FROM orders) SELECT g, i FROM p WHERE k % n = 0""")
def n_thin(spark, d):
    k = F.col("o_orderkey")
    return network.every_nth(fx.table(spark, d, "orders").select((k % 20).alias("g"), k.alias("i")), 48, "i", "g")


# ---- statistics

@query(f"WITH {SQL_DEM} SELECT CAST(floor(z/100)*100 AS INT) AS band, count(*) AS n, round(count(*)/sum(count(*)) OVER (), 6) AS share FROM dem GROUP BY 1")
def s_height_bands(spark, d):
    return stats.height_bands(fx.dem(spark, d), "z").select("band", "n", r(F.col("share")).alias("share"))


@query(f"""WITH {SQL_DEM}, {_NEIGHBOURS}, c AS (SELECT CAST(floor((round(aspect, 9) + 22.5)/45) AS INT) % 8 AS sector, count(*) AS n FROM horn WHERE round(slope, 9) >= 5 GROUP BY 1)
  SELECT CAST(s AS INT) AS sector, coalesce(n, 0) AS n, round(coalesce(n/sum(n) OVER (), 0), 6) AS share FROM (SELECT unnest(range(8)) AS s) LEFT JOIN c ON c.sector = s""")
def s_aspect_shares(spark, d):
    return stats.aspect_shares(_terrain(spark, d)).select("sector", "n", r(F.col("share")).alias("share"))


@query(f"""WITH {SQL_DEM}, {_NEIGHBOURS} SELECT CAST(round(slope, 9) >= 10 AS INT) + CAST(round(slope, 9) >= 20 AS INT) + CAST(round(slope, 9) >= 30 AS INT) + CAST(round(slope, 9) >= 40 AS INT) AS class, count(*) AS n FROM horn GROUP BY 1""")
def s_slope_classes(spark, d):
    return _terrain(spark, d).groupBy(stats.slope_class(F.col("slope")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_NAMES = "CASE " + " ".join(f"WHEN code = {c} THEN '{n}'" for c, n in COVER) + " ELSE 'Other' END"


@query(f"WITH {SQL_COVER} SELECT {_NAMES} AS name, code NOT IN (0,1,2,5,6,18) AS open, count(*) AS n FROM cover WHERE (y - 15)*(y - 15) + (x - 60)*(x - 60) <= 400 GROUP BY 1, 2")
def s_cover_shares(spark, d):
    """Cover names about a place, by lookup."""
    near = raster.disc(fx.cover(spark, d), 15, 60, 20)
    named = with_lookup(near, cover_table(spark), "code", "code", {"name": "Other", "open": True})
    return named.groupBy("name", "open").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_COVER}, f AS (SELECT z, row_number() OVER (ORDER BY z) - 1 AS i, count(*) OVER () AS n FROM cover WHERE code IN (1, 2, 6)) SELECT z FROM f WHERE i = floor(n * 0.95)")
def s_treeline(spark, d):
    return stats.at_rank(fx.cover(spark, d).where(F.col("code").isin(*FOREST)), "z", 0.95)


@query(f"WITH {SQL_DEM} SELECT y, x, z FROM dem ORDER BY z DESC, y, x LIMIT 1")
def s_highest(spark, d):
    return stats.first_highest(fx.dem(spark, d), "z")


@query(f"WITH {SQL_DEM}, {_NEIGHBOURS}, t AS (SELECT sum(nx) AS a, sum(ny) AS b, sum(nz) AS c FROM horn WHERE y BETWEEN 10 AND 14 AND x BETWEEN 50 AND 54) SELECT round(degrees(atan2(sqrt(a*a + b*b), c)), 6) AS slope, round((degrees(atan2(a, b)) + 360) % 360, 6) AS aspect FROM t")
def s_mean_aspect(spark, d):
    return stats.mean_aspect(_terrain(spark, d).where("y BETWEEN 10 AND 14 AND x BETWEEN 50 AND 54")).select(r(F.col("slope")).alias("slope"), r(F.col("aspect")).alias("aspect"))


@query(f"WITH {SQL_COVER}, c AS (SELECT {_NAMES} AS name, count(*) AS n FROM cover GROUP BY 1) SELECT name, n FROM c ORDER BY n DESC, name DESC LIMIT 1")
def s_modal_cover(spark, d):
    return stats.modal(with_lookup(fx.cover(spark, d), cover_table(spark), "code", "code", {"name": "Other"}), "name")


_SNOW = f"{SQL_DEM}, snow AS (SELECT y, x, w, CASE WHEN (w + x + y) % 11 <> 0 THEN -120 + (w*13 + x*3 + y*5) % 90 END AS f, (w*7 + x + y) % 30 AS unc FROM dem, (SELECT CAST(unnest(range(7)) AS INT) AS w))"


@query(f"WITH {_SNOW}, s AS (SELECT y, x, list_sort(list(f)) AS v FROM snow WHERE f IS NOT NULL AND unc <= 15 GROUP BY y, x) SELECT y, x, CAST(v[len(v)//2 + 1] + 122 AS DOUBLE) AS day, CAST(len(v) AS INT) AS winters FROM s WHERE len(v) >= 3")
def s_snow_median(spark, d):
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    layers = fx.dem(spark, d).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumns({"first": F.when((w + x + y) % 11 != 0, -120 + (w * 13 + x * 3 + y * 5) % 90), "unc": (w * 7 + x + y) % 30})
    return stats.snow_median(layers)


@query(f"""WITH {SQL_DAYS}, o AS (SELECT *, date_diff('day', make_date(year(date), 9, 1), date) AS k FROM days WHERE tmax IS NOT NULL) SELECT CAST(k // 7 AS INT) AS week, round(avg(tmax), 6) AS tmax, round(avg(tmin), 6) AS tmin, round(max(tmax), 6) AS warmest, round(min(tmin), 6) AS coldest, round(avg(gust), 6) AS gust, max(gust) AS top_gust,
  round(avg(CAST(snow >= 1 AS INT)), 6) AS snow_share, round(avg(CAST(precip >= 1 AS INT)), 6) AS wet_share, count(*) AS n FROM o WHERE k >= 0 AND k < 91 GROUP BY 1""")
def s_climate_weeks(spark, d):
    out = stats.climate_weeks(fx.days(spark, d))
    return out.select("week", *(r(F.col(c)).alias(c) for c in ("tmax", "tmin", "warmest", "coldest", "gust", "snow_share", "wet_share")), "top_gust", "n")


_ROSE = f"{SQL_DAYS}, rose AS (SELECT CAST(floor((dir + 22.5)/45) AS INT) % 8 AS sector, count(*) AS n, avg(wind) AS mw FROM days WHERE month(date)*100 + day(date) BETWEEN 915 AND 1130 GROUP BY 1)"


@query(f"WITH {_ROSE} SELECT sector, n, round(mw, 6) AS mean_wind, round(n/sum(n) OVER (), 6) AS share FROM rose")
def s_wind_rose(spark, d):
    return stats.wind_rose(fx.days(spark, d)).select("sector", "n", r(F.col("mean_wind")).alias("mean_wind"), r(F.col("share")).alias("share"))


@query(f"WITH {_ROSE} SELECT sector * 45 AS degrees FROM rose ORDER BY n DESC, sector DESC LIMIT 1")
def s_prevailing(spark, d):
    return stats.prevailing(stats.wind_rose(fx.days(spark, d)))


_DAILY = f"{SQL_DAYS}, daily AS (SELECT date, max(snow) AS snow, min(tmin) AS tmin, max(gust) AS gust, max(precip) AS rain FROM days GROUP BY date)"


def _daily(spark, d):
    return fx.days(spark, d).groupBy("date").agg(F.max("snow").alias("snow"), F.min("tmin").alias("tmin"), F.max("gust").alias("gust"), F.max("precip").alias("rain"))


@query(f"WITH {_DAILY}, k AS (SELECT *, row_number() OVER (ORDER BY date) AS i FROM daily) SELECT CAST(sum(snow) FILTER (i <= 4) AS BIGINT) AS snow4, round(min(tmin), 6) AS tmin7, max(gust) AS gust7 FROM k WHERE i <= 7")
def s_forecast(spark, d):
    return stats.forecast_rollup(_daily(spark, d)).select("snow4", r(F.col("tmin7")).alias("tmin7"), "gust7")


@query(f"WITH {_DAILY} SELECT date, CASE WHEN snow >= 0.1 THEN 'Snow ' || snow || ' cm' WHEN rain >= 0.1 THEN 'Rain ' || rain || ' mm' ELSE 'Dry' END AS words FROM daily")
def s_day_text(spark, d):
    return _daily(spark, d).select("date", stats.day_text(F.col("snow"), F.col("rain")).alias("words"))


@query(f"WITH {_DAILY} SELECT date, gust FROM daily WHERE date = (SELECT coalesce(max(date) FILTER (date <= DATE '1998-05-17'), min(date)) FROM daily)")
def s_latest(spark, d):
    """As-of lookup."""
    return stats.latest_not_after(_daily(spark, d), "date", F.lit("1998-05-17").cast("date")).select("date", "gust")


@query(f"WITH {_DAILY} SELECT CAST(min(date) AS DATE) AS first_day, min(year(date)) AS from_year, max(year(date)) AS to_year FROM daily WHERE date >= DATE '1998-11-01'")
def s_year_span(spark, d):
    """Span of the record from the first day of standard time on."""
    kept = _daily(spark, d).where(F.col("date") >= F.lit("1998-11-01").cast("date"))
    return kept.agg(F.min("date").alias("first_day"), F.min(F.year("date")).cast("long").alias("from_year"), F.max(F.year("date")).cast("long").alias("to_year"))


_SCENES = "sc AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice % 100 AS cloud, ['A','B','C'][o_custkey % 3 + 1] AS tile FROM orders WHERE o_totalprice % 100 < 15)"


@query(f"""WITH {_SCENES}, k AS (SELECT * FROM sc WHERE tile IN ('A', 'B')), w AS (SELECT max(day) AS d0 FROM (SELECT day FROM k GROUP BY day HAVING count(DISTINCT tile) = 2)), z AS (SELECT day, count(*) AS n FROM k, w WHERE day <= d0 GROUP BY day), b AS (SELECT day, coalesce(sum(n) OVER (ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM z)
  SELECT id, day, tile, CAST(row_number() OVER (ORDER BY day DESC, cloud, id) AS INT) AS rank FROM k JOIN b USING (day) WHERE bf < 8""")
def s_scene_choice(spark, d):
    """Relational division and a running count."""
    o = fx.table(spark, d, "orders")
    tiles = F.array(*map(F.lit, ("A", "B", "C")))
    sc = o.select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") % 100).alias("cloud"), F.element_at(tiles, (F.col("o_custkey") % 3 + 1).cast("int")).alias("tile")).where("cloud < 15")
    return stats.chosen_scenes(sc, ["A", "B"]).select("id", "day", "tile", "rank")


@query("""WITH a AS (SELECT s_suppkey AS id, (s_suppkey % 997 + 1) * 1.7 AS span FROM supplier), b AS (SELECT *, pow(10, floor(log10(span / 6))) AS p FROM a) SELECT id, round(p * CASE WHEN round(span/6/p, 9) <= 1 THEN 1 WHEN round(span/6/p, 9) <= 2 THEN 2 WHEN round(span/6/p, 9) <= 5 THEN 5 ELSE 10 END, 9) AS step FROM b""")
def s_nice_step(spark, d):
    k = F.col("s_suppkey")
    return fx.table(spark, d, "supplier").select(k.alias("id"), r(stats.nice_step((k % 997 + 1) * 1.7, 6), 9).alias("step"))


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))""")
def s_rollup(spark, d):
    e = fx.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e.rollup("event_type", "day").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


def _packed_cells(spark, d):
    x, y = F.col("x"), F.col("y")
    return fx.cover(spark, d).select(
        "y", "x", ((x * 7 + y) % 90 / 2.0).alias("slope"), ((x * 11 + y * 3) % 360).cast("double").alias("aspect"), F.col("code").alias("cover"), ((x + y) % 10 + 1).alias("landform"), (4 + (x + y) % 180 / 12.0).alias("first_sun"), ((x * y) % 200 / 16.0).alias("sun_hours"),
        ((x + 3 * y) % 122 + 1).alias("snow_day"), ((x * 5 + y) % 240 / 20.0).alias("walk_hours"), ((x + y) % 2).alias("seen"), ((x + y) % 15).alias("n_seen"), ((x - y) % 25 / 4.0).alias("shelter"), ((x * 3 - y) % 90 / 32.0).alias("tpi300"), ((x - 2 * y) % 90 / 32.0).alias("tpi2000"),
    )


_CLIP = lambda e: f"least(greatest(round({e}), 0), 255)"


@query(f"""WITH {SQL_COVER}, p AS (SELECT y, x, {_CLIP("(x*7 + y) % 90/2e0*2")} AS a_r, CASE WHEN (x*7 + y) % 90/2e0 < 2 THEN 255 ELSE {_CLIP("(x*11 + y*3) % 360/1.5e0")} END AS a_g, CAST(code AS INT) AS cover, CAST((x + y) % 10 + 1 AS INT) AS landform,
    {_CLIP("(4 + (x + y) % 180/12e0 - 4)*12")} AS b_g, {_CLIP("(x*y) % 200/16e0*16")} AS b_b, CAST((x + 3*y) % 122 + 1 AS INT) AS snow_day, {_CLIP("(x*5 + y) % 240/20e0*60/3")} AS c_g, CAST((x + y) % 2 AS INT) AS seen, CAST((x + y) % 15 AS INT) AS n_seen,
    {_CLIP("(x - y) % 25/4e0*4 + 128")} AS d_r, {_CLIP("(x*3 - y) % 90/32e0*32 + 128")} AS d_g, {_CLIP("(x - 2*y) % 90/32e0*32 + 128")} AS d_b FROM cover)
  SELECT y, x, a_r/2 AS slope, CASE WHEN a_g <> 255 THEN a_g*1.5e0 END AS aspect, cover, landform, CASE WHEN b_g <> 255 THEN b_g/12 + 4 END AS first_sun, b_b/16 AS sun_hours, snow_day, CASE WHEN c_g <> 255 THEN c_g*3/60 END AS walk_hours, seen, n_seen,
    CASE WHEN d_r <> 0 THEN (d_r - 128)/4 END AS shelter, (d_g - 128)/32 AS tpi300, (d_b - 128)/32 AS tpi2000 FROM p""")
def s_packed_round_trip(spark, d):
    """Channels of the packed grids, unpacked again."""
    return packed.unpack(packed.pack(_packed_cells(spark, d)))


@query(f"WITH {SQL_DEM}, p AS (SELECT y, x, CAST(round((z + 32768)*256) AS BIGINT) AS v FROM dem) SELECT y, x, CAST(v // 65536 AS INT) AS r, CAST((v // 256) % 256 AS INT) AS g, CAST(v % 256 AS INT) AS b, (v // 65536)*256 + (v // 256) % 256 + (v % 256)/256e0 - 32768 AS back FROM p")
def s_packed_height(spark, d):
    red, green, blue = packed.pack_height(F.col("z"))
    at = fx.dem(spark, d).withColumns({"r": red, "g": green, "b": blue})
    return at.select("y", "x", "r", "g", "b", packed.unpack_height(F.col("r"), F.col("g"), F.col("b")).alias("back"))


@query(f"WITH {SQL_DEM}, k AS (SELECT y, x, z, row_number() OVER (ORDER BY z DESC, y, x) AS i FROM dem) SELECT CAST(i AS INT) AS rank, y, x, z FROM k WHERE i <= 160")
def k_top(spark, d):
    """Best 160 cells, numbered."""
    top = fx.dem(spark, d).orderBy(F.desc("z"), "y", "x").limit(160)
    return top.select(F.row_number().over(Window.orderBy(F.desc("z"), "y", "x")).alias("rank"), "y", "x", "z")


# ---- flagship

@query(f"""WITH {_PD}, {_NEIGHBOURS}, {_bilinear_sql("pts", "id")}, q AS (SELECT pts.id, v, slope, aspect, {_HAV} AS m, {_BEAR} AS b FROM pts JOIN bil ON bil.id = pts.id JOIN horn ON horn.x = floor(px) AND horn.y = floor(py))
  SELECT id, round(v, 6) AS height, round(slope, 6) AS slope, round(aspect, 6) AS aspect, CASE WHEN aspect < 0 THEN 'flat' ELSE {_W8}[CAST(floor((round(aspect, 9) + 22.5)/45) AS INT) % 8 + 1] END AS facing, round(m, 3) AS metres, round(b, 6) AS bearing, {_W16}[CAST(floor((b + 11.25)/22.5) AS INT) % 16 + 1] AS compass FROM q""")
def describe_points(spark, d):
    """What the ground is like at each point, and how far and in which direction a place lies."""
    p = raster.sample_bilinear(fx.points(spark, d), fx.dem(spark, d), "z", WIDTH, fx.height(spark, d), out="height")
    cells = _terrain(spark, d).select(F.col("y").alias("_y"), F.col("x").alias("_x"), "slope", "aspect")
    at = p.withColumns({"_x": F.floor("px").cast("int"), "_y": F.floor("py").cast("int")}).join(cells, ["_x", "_y"])
    b = geodesy.bearing(F.col("lon"), F.col("lat"), F.lit(HERE[0]), F.lit(HERE[1]))
    m = geodesy.haversine(F.col("lon"), F.col("lat"), F.lit(HERE[0]), F.lit(HERE[1]))
    facing = F.when(F.col("aspect") < 0, "flat").otherwise(geodesy.pick(geodesy.COMPASS_8_WORDS, stats.sector8(F.round("aspect", 9))))
    return at.select("id", r(F.col("height")).alias("height"), r(F.col("slope")).alias("slope"), r(F.col("aspect")).alias("aspect"), facing.alias("facing"), r(m, 3).alias("metres"), r(b).alias("bearing"), geodesy.compass16(b).alias("compass"))


@query(f"""WITH b AS ({ORACLE_SQL["describe_points"]}) SELECT id, CAST(seq AS INT) AS seq, name, value, note FROM (
  SELECT id, 0 AS seq, 'Height' AS name, CAST(round(height) AS VARCHAR) AS value, 'm' AS note FROM b UNION ALL SELECT id, 1, 'Slope', CAST(round(slope) AS VARCHAR), facing FROM b UNION ALL SELECT id, 2, 'Distance', CAST(round(metres) AS VARCHAR), compass FROM b) WHERE value IS NOT NULL""")
def describe_rows(spark, d):
    """The same, unpivoted to named facts."""
    p = describe_points(spark, d)
    facts = [("Height", F.round("height"), F.lit("m")), ("Slope", F.round("slope"), F.col("facing")), ("Distance", F.round("metres"), F.col("compass"))]
    return stats.describe(p, "id", facts)


# ---- more of the same families

@query(f"""WITH {SQL_COVER}, {fx.SQL_POINTS.replace(fx.SQL_SIZE + ', ', '')}, gz AS (SELECT y, x, CASE WHEN code <> 18 THEN z END AS zz FROM cover), f AS (SELECT id, px, py, CAST(floor(px) AS INT) + i AS cx, CAST(floor(py) AS INT) + j AS cy, i, j,
  CASE i WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END * CASE j WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END AS w FROM pts, size, (VALUES (0,0),(0,1),(1,0),(1,1)) k(i, j) WHERE px < {WIDTH - 1} AND py < h - 1),
  s AS (SELECT id, CASE WHEN count(zz) = 4 THEN sum(zz * w) ELSE max(zz) FILTER (i = 0 AND j = 0) END AS v FROM f JOIN gz ON gz.x = cx AND gz.y = cy GROUP BY id) SELECT pts.id, round(v, 6) AS z FROM pts LEFT JOIN s ON s.id = pts.id""")
def r_layer_sample(spark, d):
    """Bilinear where all four cells have values, else the nearest; water has none."""
    grid = fx.cover(spark, d).withColumn("z", F.when(F.col("code") != 18, F.col("z")))
    return raster.sample_layer(fx.points(spark, d), grid, "z", WIDTH, fx.height(spark, d), out="v").select("id", r(F.col("v")).alias("z"))


@query(f"""WITH {SQL_DEM}, {_NEIGHBOURS}, s AS (SELECT y, x, {_sql_shade(315, 45)} AS s FROM horn), c AS (SELECT y, x, CASE WHEN s < 0.7 THEN 120*(1 - 0.8*(0.7 - s)/0.7) ELSE 120 + 135*least(0.6, 0.8*(s - 0.7)/0.3) END AS c FROM s)
  SELECT y, x, round(c, 6) AS shaded, round(c + (255 - c)*0.25, 6) AS blended, round(pow(least(greatest(c/255, 0), 1), 0.46), 6) AS tone FROM c""")
def r_shade_colour(spark, d):
    """Shading composite, alpha over, tone curve."""
    c = raster.shade_colour(F.lit(120.0), raster.hillshade(315.0, 45.0), 0.7, 0.8)
    at = _terrain(spark, d).withColumn("c", c)
    return at.select("y", "x", r(F.col("c")).alias("shaded"), r(raster.over(F.col("c"), F.lit(255.0), F.lit(0.25))).alias("blended"), r(raster.tone(F.col("c") / 255)).alias("tone"))


@query(f"""WITH {_SEGS}, e AS (SELECT ['highway','gravel','track'][fid % 3 + 1] AS kind, 2*6371008.8*asin(sqrt(pow(sin(radians(y2 - y1)/2), 2) + cos(radians(y1))*cos(radians(y2))*pow(sin(radians(x2 - x1)/2), 2))) AS m FROM sg)
  SELECT kind, 2*count(*) AS edges, round(2*sum(m), 3) AS metres, round(2*sum(m*CASE kind WHEN 'highway' THEN 10 WHEN 'gravel' THEN 16 ELSE 40 END/10e0), 3) AS cost FROM e GROUP BY kind""")
def n_graph(spark, d):
    """Edges of the road graph, both directions, by kind."""
    _, edges = network.build_graph(fx.lines(spark, d))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), r(F.sum("metres"), 3).alias("metres"), r(F.sum(network.edge_cost(F.col("metres"), F.col("kind"))), 3).alias("cost"))


@query(f"""WITH {_STEPS}, nm AS (SELECT *, CASE WHEN seq % 3 <> 0 THEN 'road ' || seq // 400 END AS name FROM st), a AS (SELECT *, coalesce(CAST(kind <> lag(kind) OVER w AS INT), 1) AS nw FROM nm WINDOW w AS (PARTITION BY trip ORDER BY seq)), b AS (SELECT *, sum(nw) OVER (PARTITION BY trip ORDER BY seq) AS run FROM a),
  c AS (SELECT *, last_value(name IGNORE NULLS) OVER (PARTITION BY trip, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b), e AS (SELECT *, sum(greatest(nw, coalesce(CAST(name <> held AS INT), 0))) OVER (PARTITION BY trip ORDER BY seq) AS leg FROM c)
  SELECT trip, CAST(leg AS INT) AS leg, kind, coalesce(max(name), '') AS name, round(sum(metres) / 1000e0, 6) AS km FROM e GROUP BY trip, leg, kind""")
def n_named_legs(spark, d):
    """Legs by kind and compatible name, empty names taking over the leg's."""
    steps = _trip_steps(spark, d).withColumn("name", F.when(F.col("seq") % 3 == 0, "").otherwise(F.concat(F.lit("road "), F.floor(F.col("seq") / 400).cast("string"))))
    return network.legs(steps).select("trip", "leg", "kind", "name", r(F.col("km")).alias("km"))


@query("""SELECT o_orderkey AS id, CASE p WHEN 'primary' THEN 'highway' WHEN 'residential' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'highway' ELSE 'gravel' END WHEN 'track' THEN 'track' END AS kind
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE ['primary','residential','track','path'][o_orderkey % 4 + 1] END AS p FROM orders)""")
def n_road_kind(spark, d):
    """Road kinds from tags; private ways are none."""
    k = F.col("o_orderkey")
    road = F.element_at(F.array(*map(F.lit, ("primary", "residential", "track", "path"))), (k % 4 + 1).cast("int"))
    props = F.create_map(F.lit("highway"), road, F.lit("surface"), F.when(k % 2 == 0, "asphalt").otherwise("dirt"), F.lit("access"), F.when(k % 7 == 0, "private").otherwise("yes"))
    return fx.table(spark, d, "orders").select(k.alias("id"), network.road_kind(props).alias("kind"))


@query("""SELECT DISTINCT name, kind FROM (SELECT c_mktsegment AS name, 'customer' AS kind FROM customer UNION ALL SELECT p_brand, 'part' FROM part)""")
def k_union_distinct(spark, d):
    """Union of sources and distinct names."""
    a = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("customer").alias("kind"))
    return a.unionByName(fx.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.lit("part").alias("kind"))).dropDuplicates(["name", "kind"])


@query("SELECT event_id AS id, CASE WHEN json_extract_string(props, '$.k') = '' THEN NULL ELSE trim(json_extract_string(props, '$.k')) END AS k FROM events")
def a_properties(spark, d):
    """Properties from JSON text, trimmed, empty ones dropped."""
    from ..sources.vector_io import clean_props

    props = clean_props(F.from_json("props", "map<string,string>"))
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), props["k"].alias("k"))


@query("""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY 1, 2""")
def e_stream_windows(spark, d):
    """Tumbling windows of a stream, read once through; beyond the batch operators."""
    import uuid

    from ..storage import shared_path
    from ..streaming.weather import tumbling

    batch = fx.table(spark, d, "events")
    source = shared_path(spark, "events")
    batch.write.parquet(source)
    name = f"windows_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(batch.schema).parquet(source)
    run = tumbling(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.to_date("start").alias("day"), "event_type", "n", r(F.col("total"), 4).alias("total"), "largest")
