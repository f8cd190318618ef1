"""Deterministic inputs that the queries derive from the driver's tables; the same integer arithmetic in Spark and in SQL.

Heights are whole tenths of metres, so that comparisons and orders are exact. The grid grows with the number of suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 120
CELL = 30.0
ROWS_PER_SUPPLIER = 3
BOX = (-119.85, 53.80, -118.95, 54.30)
HERE = (-119.390728, 54.062707)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height(spark: SparkSession, sf_dir: str) -> int:
    return ROWS_PER_SUPPLIER * table(spark, sf_dir, "supplier").count()


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, z: valleys and ridges, and on them the cents of an order's price where there is one (for two cells of five or so), else a pattern."""
    n = height(spark, sf_dir) * WIDTH
    cells = spark.range(n).select("id", F.floor(F.col("id") / WIDTH).cast("int").alias("y"), (F.col("id") % WIDTH).cast("int").alias("x"))
    priced = table(spark, sf_dir, "orders").where(F.col("o_orderkey") * 2 < n).select((F.col("o_orderkey") * 2).alias("id"), (F.round(F.col("o_totalprice") * 100).cast("long") % 97).alias("_cents"))
    rough = F.coalesce("_cents", (F.col("x") * 31 + F.col("y") * 17) % 97)
    tenths = 15000 + 40 * F.abs(F.col("x") % 40 - 20) + 30 * F.abs(F.col("y") % 30 - 15) + rough
    return cells.join(priced, "id", "left").select("y", "x", (tenths / 10.0).alias("z"))


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*(F.lit(c) for c in (1, 2, 5, 6, 8, 10, 13, 14, 16, 18)))
    return dem(spark, sf_dir).withColumn("code", F.element_at(codes, ((F.floor(F.col("x") / 6) * 7 + F.floor(F.col("y") / 6) * 3) % 10 + 1).cast("int")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lon, lat and the place px, py on the grid, of every customer."""
    h = height(spark, sf_dir)
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (-119.85 + (k * 7919) % 9000 / 10000.0).alias("lon"), (53.80 + (k * 104729) % 5000 / 10000.0).alias("lat"),
        ((k * 7919) % (WIDTH * 100) / 100.0).alias("px"), ((k * 104729) % (h * 100) / 100.0).alias("py"),
    )


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of weather for every order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 10000).alias("tmax"), (F.col("o_totalprice") / 10000 - 9).alias("tmin"),
        (F.col("o_custkey") % 120).alias("gust"), ((F.col("o_custkey") * 37) % 360).alias("dir"), (F.col("o_orderkey") % 5).alias("snow"), (F.col("o_custkey") % 4).alias("precip"), (F.col("o_custkey") % 40).alias("wind"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, seq, rings, props of each region: rectangles, one with a hole, and an L, moved a little by the length of the region's name; no point of the fixtures lies on an edge."""
    d = 0.00005
    box = lambda w, s, e, n: [(w + d, s + d), (e + d, s + d), (e + d, n + d), (w + d, n + d)]
    shapes = [
        [box(-119.80, 53.85, -119.50, 54.00)],
        [box(-119.60, 53.95, -119.30, 54.20)],
        [box(-119.20, 53.82, -119.00, 54.28), box(-119.15, 53.90, -119.05, 54.10)],
        [[(-119.75 + d, 54.05 + d), (-119.45 + d, 54.05 + d), (-119.45 + d, 54.10 + d), (-119.65 + d, 54.10 + d), (-119.65 + d, 54.25 + d), (-119.75 + d, 54.25 + d)]],
        [box(-119.40, 54.10, -119.10, 54.15)],
    ]
    moved = F.length("r_name") / 1000000.0
    spot = lambda x, y: F.struct((F.lit(x) + moved).alias("lon"), (F.lit(y) + moved).alias("lat"))
    k = F.col("r_regionkey")
    rings = None
    for i, shape in enumerate(shapes):
        found = F.array(*(F.array(*(spot(x, y) for x, y in ring)) for ring in shape))
        rings = F.when(k == i, found) if rings is None else rings.when(k == i, found)
    return table(spark, sf_dir, "region").where(k < len(shapes)).select(k.cast("long").alias("fid"), k.cast("int").alias("seq"), rings.alias("rings"), F.create_map(F.lit("name"), F.concat(F.lit("unit "), (k % 3).cast("string"))).alias("props"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid, kind, name, pts: a zigzag of five points for each supplier."""
    k = F.col("s_suppkey")
    point = lambda j: F.struct((-119.80 + ((k * 613) % 7000 + 20 * j) / 10000.0).alias("lon"), (53.85 + ((k * 271) % 4000 + 15 * (j % 2)) / 10000.0).alias("lat"))
    kinds = F.array(*map(F.lit, ("highway", "gravel", "track")))
    return table(spark, sf_dir, "supplier").select(k.alias("fid"), F.element_at(kinds, (k % 3 + 1).cast("int")).alias("kind"), F.concat(F.lit("road "), (k % 4).cast("string")).alias("name"), F.array(*(point(j) for j in range(5))).alias("pts"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, step, cost, kind, name: a ring of the suppliers with chords, both directions."""
    s = table(spark, sf_dir, "supplier")
    n = s.count()
    kinds, tenths = F.array(*map(F.lit, ("highway", "gravel", "track"))), F.array(*map(F.lit, (10, 16, 40)))
    k = F.col("s_suppkey")
    at = (k % 3 + 1).cast("int")
    metres = 1000 + (k * 613) % 4000
    one = s.select(k.alias("src"), F.explode(F.array(F.lit(1), F.lit(7))).alias("hop"), metres.alias("metres"), F.element_at(kinds, at).alias("kind"), F.element_at(tenths, at).alias("tenths"))
    one = one.select("src", ((F.col("src") - 1 + F.col("hop")) % n + 1).alias("dst"), (F.col("metres") * F.col("hop")).alias("metres"), "kind", (F.col("metres") * F.col("hop") * F.col("tenths") / 10.0).alias("cost"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "metres", "kind", "cost"))
    return both.withColumn("step", F.col("cost"))


SQL_SIZE = f"size AS (SELECT {ROWS_PER_SUPPLIER} * count(*) AS h FROM supplier)"
SQL_DEM = f"""{SQL_SIZE}, dem AS (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, (15000 + 40 * abs(x % 40 - 20) + 30 * abs(y % 30 - 15) + coalesce(CAST(round(o_totalprice * 100) AS BIGINT) % 97, (x * 31 + y * 17) % 97)) / 10e0 AS z
  FROM (SELECT * FROM (SELECT unnest(range(h)) AS y FROM size), (SELECT unnest(range({WIDTH})) AS x)) LEFT JOIN orders ON o_orderkey * 2 = y * {WIDTH} + x)"""
SQL_COVER = f"{SQL_DEM}, cover AS (SELECT y, x, z, list_extract([1,2,5,6,8,10,13,14,16,18], ((x // 6) * 7 + (y // 6) * 3) % 10 + 1) AS code FROM dem)"
SQL_POINTS = f"""{SQL_SIZE}, pts AS (SELECT c_custkey AS id, -119.85e0 + (c_custkey * 7919) % 9000 / 10000e0 AS lon, 53.80e0 + (c_custkey * 104729) % 5000 / 10000e0 AS lat,
  (c_custkey * 7919) % {WIDTH * 100} / 100e0 AS px, (c_custkey * 104729) % (h * 100) / 100e0 AS py FROM customer, size)"""
SQL_DAYS = """days AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_totalprice / 10000 AS tmax, o_totalprice / 10000 - 9 AS tmin, o_custkey % 120 AS gust,
  (o_custkey * 37) % 360 AS dir, o_orderkey % 5 AS snow, o_custkey % 4 AS precip, o_custkey % 40 AS wind FROM orders)"""
