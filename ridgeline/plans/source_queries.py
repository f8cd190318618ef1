"""Sources and sinks as queries: what the tables say is written as documents or rasters into the shared folder and read again by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks import export
from ..sources import strips, vector_io
from ..storage import shared_path
from . import fixtures as fx
from .fixtures import CELL, SQL_COVER, SQL_DEM
from .queries import query, r


#: Items of a document: a document is one row of one task wherever it is written or read.
ITEMS = 10_000


def _documents(items: DataFrame, n: int, name: str, label: str) -> str:
    """The folder of JSON documents {name: [...]} of n items in order, dealt by their text to as many documents as ``ITEMS`` asks for."""
    dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item.text"), F.lit(max(8, -(-n // ITEMS)))))
    docs = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list("item")).alias("_l")).select(F.concat(F.lit(f'{{"{name}":['), F.array_join(F.transform("_l", lambda i: i["text"]), ","), F.lit("]}")).alias("value"))
    path = shared_path(items.sparkSession, label)
    docs.write.option("maxRecordsPerFile", 1).text(path)
    return path


def _item(order, text):
    return F.struct(order.alias("order"), text.alias("text")).alias("item")


@query("""SELECT name, round(lon, 6) AS lon, round(lat, 6) AS lat, bal FROM (SELECT c_name AS name, -119.85e0 + (c_custkey * 7919) % 9000 / 10000e0 AS lon, 53.80e0 + (c_custkey * 104729) % 5000 / 10000e0 AS lat, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS bal FROM customer)""")
def a_geojson(spark, d):
    """Places written as GeoJSON features and read again: texts are trimmed, empty ones go."""
    names = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("bal"))
    features = export.geojson_features(fx.points(spark, d).select("id", "lon", "lat").join(names, "id"))
    path = _documents(features.select(_item(F.lit(0), F.col("value"))), names.count(), "features", "geojson")
    got = vector_io.read_geojson(spark, path)
    return got.select(F.col("props")["name"].alias("name"), r(F.col("pts")[0]["lon"]).alias("lon"), r(F.col("pts")[0]["lat"]).alias("lat"), F.col("props")["bal"].alias("bal"))


@query("""SELECT s_suppkey AS fid, CASE WHEN s_suppkey % 4 = 0 THEN 'point' WHEN s_suppkey % 4 = 1 THEN 'line' ELSE CASE WHEN s_suppkey % 8 < 4 THEN 'poly' ELSE 'line' END END AS kind, CASE WHEN s_suppkey % 4 = 0 THEN 1 WHEN s_suppkey % 4 = 1 THEN 3 ELSE 4 END AS n, s_name AS name,
  CASE WHEN s_suppkey % 8 < 4 THEN 'water' ELSE 'wood' END AS nature FROM supplier WHERE s_suppkey % 4 <> 3""")
def a_elements(spark, d):
    """Map elements: nodes, open ways and closed ways, of which those of water are areas; ways of one point are dropped."""
    k = F.col("s_suppkey")
    tags = F.struct(F.col("s_name").alias("name"), F.when(k % 8 < 4, "water").otherwise("wood").alias("natural"))
    spot = lambda i: F.struct((53.0 + k % 50 / 100 + (i % 2) / 1000).alias("lat"), (-119.0 - k % 70 / 100 - i / 1000).alias("lon"))
    ways = {1: F.array(spot(0), spot(1), spot(2)), 2: F.array(spot(0), spot(1), spot(2), spot(0)), 3: F.array(spot(0))}
    node = F.to_json(F.struct(F.lit("node").alias("type"), k.alias("id"), F.lit(53.5).alias("lat"), F.lit(-119.0).alias("lon"), tags.alias("tags")))
    text = F.when(k % 4 == 0, node)
    for i, points in ways.items():
        text = text.when(k % 4 == i, F.to_json(F.struct(F.lit("way").alias("type"), k.alias("id"), tags.alias("tags"), points.alias("geometry"))))
    rows = fx.table(spark, d, "supplier")
    path = _documents(rows.select(_item(k, text)), rows.count(), "elements", "elements")
    got = vector_io.read_elements(spark, path)
    n = F.when(F.col("kind") == "poly", F.size(F.col("rings")[0])).otherwise(F.size("pts"))
    return got.select("fid", "kind", n.alias("n"), F.col("props")["name"].alias("name"), F.col("props")["natural"].alias("nature"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS fid, p_name AS name, round(-119 - p_partkey % 100 / 100e0, 6) AS lon, round(53 + p_partkey % 70 / 100e0, 6) AS lat, ['RIV','LAKE','MTN'][p_partkey % 3 + 1] AS code, p_type AS generic FROM part WHERE p_partkey % 5 > 0""")
def a_names(spark, d):
    """A gazetteer; items without a place are dropped."""
    k = F.col("p_partkey")
    place = F.when(k % 5 > 0, 53 + k % 70 / 100)
    code = F.element_at(F.array(*map(F.lit, ("RIV", "LAKE", "MTN"))), (k % 3 + 1).cast("int"))
    text = F.to_json(F.struct(k.cast("string").alias("id"), F.concat(F.col("p_name"), F.lit(" ")).alias("name"), place.alias("latitude"), (-119 - k % 100 / 100).alias("longitude"), F.struct(code.alias("code")).alias("concise"), F.struct(F.col("p_type").alias("code")).alias("generic")))
    rows = fx.table(spark, d, "part")
    path = _documents(rows.select(_item(k, text)), rows.count(), "items", "names")
    return vector_io.read_names(spark, path).select("fid", "name", r(F.col("lon")).alias("lon"), r(F.col("lat")).alias("lat"), "code", "generic")


@query("""SELECT date, round(max(tmax), 6) AS tmax, CAST(max(gust) AS DOUBLE) AS gust, CAST(sum(snow) AS DOUBLE) AS snow FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice / 10000 AS tmax, o_custkey % 120 AS gust, o_orderkey % 5 AS snow FROM orders) GROUP BY date""")
def a_daily(spark, d):
    """Daily weather as parallel arrays, a document a year; arrays that a document lacks are null."""
    days = fx.days(spark, d).groupBy("date").agg(F.max("tmax").alias("tmax"), F.max("gust").alias("gust"), F.sum("snow").alias("snow"))
    rows = days.groupBy(F.year("date").alias("y")).agg(F.array_sort(F.collect_list(F.struct("date", "tmax", "gust", "snow"))).alias("l"))
    part = lambda c: F.transform("l", lambda x: x[c])
    body = F.struct(F.transform("l", lambda x: x["date"].cast("string")).alias("time"), part("tmax").alias("temperature_2m_max"), part("gust").alias("wind_gusts_10m_max"), part("snow").alias("snowfall_sum"))
    path = shared_path(spark, "daily")
    rows.select(F.to_json(F.struct(body.alias("daily"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return vector_io.read_daily(spark, path).select("date", r(F.col("tmax")).alias("tmax"), "gust", "snow")


@query("""SELECT 'scene ' || o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_custkey % 100 / 2e0 AS cloud, '11U' || ['LA','MA','NA'][o_orderkey % 3 + 1] AS tile, o_orderkey % 2 = 0 AS offset_applied, 'r' || o_orderkey AS red FROM orders
  WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1998-02-28' AND o_custkey % 100 / 2e0 < 20 ORDER BY day DESC, id LIMIT 200""")
def a_scene_search(spark, d):
    """Of a catalogue the newest scenes of a season with little cloud."""
    k = F.col("o_orderkey")
    square = F.element_at(F.array(*map(F.lit, ("LA", "MA", "NA"))), (k % 3 + 1).cast("int"))
    # names with colons don't go into columns: the text is put together
    props = F.concat(F.lit('{"datetime":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T18:00:00Z","eo:cloud_cover":'), (F.col("o_custkey") % 100 / 2).cast("string"), F.lit(',"mgrs:utm_zone":11,"mgrs:latitude_band":"U","mgrs:grid_square":"'), square, F.lit('"'), F.when(k % 2 == 0, ',"earthsearch:boa_offset_applied":true').otherwise(""), F.lit("}"))
    assets = F.concat(*(F.concat(F.lit(f'{"," if i else ""}"{b}":{{"href":"{b[0]}'), k.cast("string"), F.lit('"}')) for i, b in enumerate(("red", "green", "blue", "nir"))))
    text = F.concat(F.lit('{"id":"scene '), k.cast("string"), F.lit('","properties":'), props, F.lit(',"assets":{'), assets, F.lit("}}"))
    rows = fx.table(spark, d, "orders")
    path = _documents(rows.select(_item(k, text)), rows.count(), "features", "scenes")
    found = vector_io.searched(vector_io.read_scenes(spark, path), "1997-03-01", "1998-02-28", 20.0)
    return found.select("id", "day", "cloud", "tile", "offset_applied", F.col("hrefs")[0].alias("red"))


@query(f"WITH {SQL_DEM} SELECT y, x, CASE WHEN (x + y) % 13 > 0 THEN round(z, 1) END AS value FROM dem WHERE y BETWEEN 20 AND 85")
def a_height_strips(spark, d):
    """Heights as 16-bit strips with a sidecar, written and read again by a filter on rows, which leaves out strips."""
    grid = fx.dem(spark, d).where("(x + y) % 13 > 0 OR y >= 0").withColumn("z", F.when((F.col("x") + F.col("y")) % 13 > 0, F.col("z")))
    path = shared_path(spark, "heights")
    strips.write_strips(grid, path, {"crs": "local", "x0": 0.0, "y0": 0.0, "res": CELL, "source": "fixture"}, rows=32)
    return strips.read_strips(spark, path).where("y BETWEEN 20 AND 85").select("y", "x", r(F.col("value"), 1).alias("value"))


@query(f"WITH {SQL_COVER} SELECT y, x, code * 100 AS red, CAST(round(z * 10) AS INT) AS green, CASE WHEN x > 0 THEN x END AS blue, CAST(NULL AS INT) AS nir FROM cover")
def a_band_strips(spark, d):
    """Four bands as 16-bit strips, 0 for none."""
    grid = fx.cover(spark, d).select("y", "x", (F.col("code") * 100).alias("red"), F.round(F.col("z") * 10).cast("int").alias("green"), F.col("x").alias("blue"), F.lit(0).alias("nir"))
    path = shared_path(spark, "bands")
    strips.write_strips(grid, path, {"crs": "UTM zone 11 north, WGS84", "zone": 11, "x0": 0.0, "y0": 0.0, "res": CELL, "scenes": []}, bands=4, rows=64)
    return strips.read_strips(spark, path)
