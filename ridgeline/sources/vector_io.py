"""Vector and gazetteer scans from JSON: GeoJSON, map-data elements, place names. Built-in readers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<lon:double,lat:double>"
#: A character that JSON has nowhere: a whole document is one record, parsed from memory. By multiLine each value that is kept as JSON text is read from the file a second time, with blocks about it.
NOWHERE = "\x01"


def clean_props(props: Column) -> Column:
    """Trimmed; nulls and empty values dropped."""
    return F.map_filter(F.transform_values(props, lambda _, v: F.trim(v)), lambda _, v: v.isNotNull() & (v != ""))


def _points(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(fid, seq, part, kind, pts, rings, props): one row per part of a feature, other geometry types dropped. Values that aren't text become JSON text."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    each = spark.read.schema(shape).option("lineSep", NOWHERE).json(path).select(F.posexplode("features").alias("seq", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point, line, area = "array<double>", "array<array<double>>", "array<array<array<double>>>"
    parts = {
        "Point": (F.array(F.array(F.array(F.from_json(raw, point)))), "point"),
        "MultiPoint": (F.transform(F.from_json(raw, line), lambda p: F.array(F.array(p))), "point"),
        "LineString": (F.array(F.array(F.from_json(raw, line))), "line"),
        "MultiLineString": (F.transform(F.from_json(raw, area), lambda p: F.array(p)), "line"),
        "Polygon": (F.array(F.from_json(raw, area)), "poly"),
        "MultiPolygon": (F.from_json(raw, "array<array<array<array<double>>>>"), "poly"),
    }
    shapes = word = None
    for name, (column, k) in parts.items():
        shapes = F.when(kind == name, column) if shapes is None else shapes.when(kind == name, column)
        word = F.when(kind == name, k) if word is None else word.when(kind == name, k)
    flat = each.withColumns({"kind": word, "_p": shapes}).where("kind IS NOT NULL").select("seq", "kind", F.posexplode("_p").alias("part", "_g"), clean_props(F.coalesce("f.properties", F.create_map().cast("map<string,string>"))).alias("props"))
    rings = F.transform("_g", _points)
    return flat.select((F.col("seq") * 1000 + F.col("part")).cast("long").alias("fid"), "seq", "part", "kind", F.when(F.col("kind") != "poly", rings[0]).alias("pts"), F.when(F.col("kind") == "poly", rings).alias("rings"), "props")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(fid, seq, kind, pts, rings, props) of map-data elements: closed ways of land use or water are areas, ways of one point are dropped."""
    shape = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>>"
    each = spark.read.schema(shape).option("multiLine", True).json(path).select(F.posexplode("elements").alias("seq", "e")).select("seq", "e.*")
    points = F.transform("geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    tags = clean_props(F.coalesce("tags", F.create_map().cast("map<string,string>")))
    at = each.withColumns({"pts": F.when(F.col("type") == "node", F.array(F.struct("lon", "lat"))).otherwise(points), "props": F.map_concat(tags, F.create_map(F.lit("osm_id"), F.col("id").cast("string")))})
    closed = (F.size("pts") > 3) & (F.element_at("pts", 1) == F.element_at("pts", -1))
    area = closed & (F.col("props")["landuse"].isNotNull() | (F.coalesce(F.col("props")["natural"], F.lit("")) == "water"))
    kind = F.when(F.col("type") == "node", F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), "point")).when((F.col("type") == "way") & (F.size("pts") >= 2), F.when(area, "poly").otherwise("line"))
    kept = at.withColumn("kind", kind).where("kind IS NOT NULL")
    return kept.select(F.col("id").alias("fid"), "seq", "kind", F.when(F.col("kind") != "poly", F.col("pts")).alias("pts"), F.when(F.col("kind") == "poly", F.array("pts")).alias("rings"), "props")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(fid, lon, lat, name, code, generic) of a gazetteer; items without a place are dropped."""
    shape = "items array<struct<id:string,name:string,latitude:double,longitude:double,concise:struct<code:string>,generic:struct<code:string>>>"
    each = spark.read.schema(shape).option("multiLine", True).json(path).select(F.posexplode("items").alias("seq", "i"))
    return each.where("i.latitude IS NOT NULL AND i.longitude IS NOT NULL").select("seq", F.col("i.id").alias("fid"), F.col("i.longitude").alias("lon"), F.col("i.latitude").alias("lat"), F.trim("i.name").alias("name"), F.col("i.concise.code").alias("code"), F.col("i.generic.code").alias("generic"))


DAILY = {"temperature_2m_max": "tmax", "temperature_2m_min": "tmin", "precipitation_sum": "precip", "snowfall_sum": "snow", "wind_speed_10m_max": "wind", "wind_gusts_10m_max": "gust", "wind_direction_10m_dominant": "dir", "weather_code": "code", "precipitation_probability_max": "pop"}


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """(date, tmax, tmin, precip, snow, wind, gust, dir, code, pop) of parallel arrays; missing arrays are null columns."""
    fields = ",".join(f"{k}:array<double>" for k in DAILY)
    raw = spark.read.schema(f"daily struct<time:array<string>,{fields}>").option("multiLine", True).json(path)
    at = raw.select("daily", F.posexplode("daily.time").alias("_i", "_t"))
    return at.select(F.expr("try_cast(_t AS date)").alias("date"), *(F.get(F.col(f"daily.{k}"), F.col("_i")).alias(v) for k, v in DAILY.items()))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """(id, day, cloud, zone, tile, offset_applied, hrefs) of a scene catalogue."""
    shape = "features array<struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double,`mgrs:utm_zone`:int,`mgrs:latitude_band`:string,`mgrs:grid_square`:string,`earthsearch:boa_offset_applied`:boolean>,assets:map<string,struct<href:string>>>>"
    each = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    p = "f.properties"
    tile = F.concat(F.col(f"{p}.`mgrs:utm_zone`").cast("string"), F.col(f"{p}.`mgrs:latitude_band`"), F.col(f"{p}.`mgrs:grid_square`"))
    hrefs = F.array(*(F.col("f.assets")[b]["href"] for b in ("red", "green", "blue", "nir")))
    return each.select(F.col("f.id").alias("id"), F.to_date(F.substring(F.col(f"{p}.datetime"), 1, 10)).alias("day"), F.col(f"{p}.`eo:cloud_cover`").alias("cloud"), F.col(f"{p}.`mgrs:utm_zone`").alias("zone"), tile.alias("tile"), F.coalesce(F.col(f"{p}.`earthsearch:boa_offset_applied`"), F.lit(False)).alias("offset_applied"), hrefs.alias("hrefs"))


def searched(scenes: DataFrame, start: str, end: str, most_cloud: float, most: int = 200) -> DataFrame:
    """Scenes between two days with less cloud than a bound, newest first."""
    kept = scenes.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("cloud") < most_cloud))
    return kept.orderBy(F.desc("day"), "id").limit(most)
