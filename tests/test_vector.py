"""Distances to lines and vertices against brute force, far from the equator and from any line."""

import math
import random

from pyspark.sql import functions as F

from ridgeline.operators import vector

LINES = "fid long, pts array<struct<lon:double,lat:double>>"


def test_nearest_line_at_high_latitudes(spark):
    r = random.Random(4)
    lines = [(i, [(lon, lat), (lon + r.uniform(-0.05, 0.05), lat + r.uniform(-0.02, 0.02))]) for i, (lon, lat) in enumerate((r.uniform(10, 11), r.choice((0, 60, 75, 85)) + r.uniform(0, 0.3)) for _ in range(300))]
    points = [(i, r.uniform(10, 11), r.choice((0, 60, 75, 85)) + r.uniform(0, 0.3)) for i in range(300)]
    got = {x["id"]: x for x in vector.nearest_within(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, LINES), 2500.0).collect()}

    def distance(p, line):
        scale = (vector.METRES_PER_DEGREE_LON * math.cos(math.radians(p[2])), vector.METRES_PER_DEGREE_LAT)
        (ax, ay), (bx, by) = (((x - p[1]) * scale[0], (y - p[2]) * scale[1]) for x, y in line[1])
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.hypot(ax + t * dx, ay + t * dy)

    near = 0
    for p in points:
        best = min(distance(p, line) for line in lines)
        if best < 2499.999:
            near += p[2] > 74
            assert abs(got[p[0]]["metres"] - best) < 1e-3
        elif best > 2500.001:
            assert p[0] not in got
    assert near > 20


def test_nearest_vertex_of_far_points(spark):
    lines = [(1, [(10.0, 50.0), (10.01, 50.01)]), (2, [(12.0, 50.0), (12.5, 80.0)])]
    points = [(1, 10.004, 50.004), (2, 11.2, 50.0), (3, 20.0, 51.0), (4, 10.0, 79.0), (5, -170.0, -60.0)]
    got = {x["id"]: x for x in vector.nearest_vertex(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, LINES)).collect()}
    assert [(got[i]["vertex_lon"], got[i]["vertex_lat"]) for i in (1, 2, 3, 4)] == [(10.0, 50.0), (12.0, 50.0), (12.0, 50.0), (12.5, 80.0)]
    assert got[5]["metres"] is None and len(got) == 5


def test_nearest_vertex_by_place_and_across_the_180th_meridian(spark):
    lines = [(1, [(10.0, 50.0), (10.01, 50.01)]), (2, [(-179.999, 0.0), (-179.9, 0.1)]), (3, [(179.5, 70.0), (179.6, 70.1)])]
    points = [(1, 10.001, 50.0), (1, 20.0, 50.0), (None, 10.001, 50.0), (None, 10.001, 50.0), (2, 179.9995, 0.0), (3, -179.9, 70.0), (4, None, 50.0)]
    got = vector.nearest_vertex(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, LINES)).collect()
    assert sorted((r["id"] or 0, r["lon"] or 0, r["vertex_lon"]) for r in got) == [(0, 10.001, 10.0), (0, 10.001, 10.0), (1, 10.001, 10.0), (1, 20.0, 10.01), (2, 179.9995, -179.999), (3, -179.9, 179.6), (4, 0, None)]
    assert 160 < next(r["metres"] for r in got if r["id"] == 2) < 170


def test_nearest_line_across_the_180th_meridian(spark):
    lines = [(1, [(179.99, 10.0), (-179.99, 10.0)]), (2, [(-179.995, -20.0), (-179.99, -20.0)]), (3, [(179.995, -40.0), (179.99, -40.0)])]
    points = [(1, 179.999, 10.01), (2, -179.999, 10.01), (3, 179.999, -20.0), (4, -179.999, -40.0), (5, 0.0, 10.0)]
    got = {r["id"]: r for r in vector.nearest_within(spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(lines, LINES), 2000.0).collect()}
    assert {i: r["fid"] for i, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: 3}
    assert abs(got[1]["metres"] - 1112) < 1 and abs(got[2]["metres"] - 1112) < 1 and abs(got[3]["metres"] - 0.006 * 111_320 * math.cos(math.radians(20))) < 1
    assert all(-180 <= r["foot_lon"] <= 180 for r in got.values()) and got[3]["foot_lon"] < 0


def test_places_decide_what_holds_a_point(spark):
    square = spark.createDataFrame([(7, 0, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]], {"name": "a"})], "fid long, seq int, rings array<array<struct<lon:double,lat:double>>>, props map<string,string>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 5.0, 5.0), (None, 0.5, 0.5), (None, 6.0, 6.0), (2, None, 0.5)], "id long, lon double, lat double")
    key = lambda r: (r["id"] or 0, r["lon"] or 0)
    assert sorted(map(key, vector.inside_any(points, square).collect())) == [(0, 0.5), (1, 0.5)]
    assert sorted(map(key, vector.outside_all(points, square).collect())) == [(0, 6.0), (1, 5.0), (2, 0)]
    assert sorted((*key(r), r["fid"]) for r in vector.first_containing(points, square).collect()) == [(0, 0.5, 7), (0, 6.0, None), (1, 0.5, 7), (1, 5.0, None), (2, 0, None)]


def test_a_vertex_on_the_border_of_a_grown_box_is_outside(spark):
    box = (-119.6, 53.95, -119.4, 54.05)
    rows = [(1, [(-119.38, 54.0)]), (2, [(-119.62, 54.0)]), (3, [(-119.5, 53.93)]), (4, [(-119.5, 54.07)]), (5, [(-119.381, 54.069)]), (6, [(-119.619, 53.931)]), (7, [(-119.8 + 0.18, 54.0)])]
    got = spark.createDataFrame(rows, LINES).where(vector.touches_box(F.col("pts"), box)).collect()
    assert sorted(r["fid"] for r in got) == [5, 6, 7]  # -119.8 + 0.18 lies just inside of -119.62


def test_nearest_among_copies_and_clusters(spark):
    """Close and far places, repeated points and lines: as brute force says, and pairs don't grow with copies."""
    r = random.Random(12)
    lines = [(i, [(lon, lat), (lon + r.uniform(-0.002, 0.002), lat + r.uniform(-0.002, 0.002))]) for i, (lon, lat) in enumerate((10 + r.choice((0, 0.3)) + r.uniform(0, 0.02), 50 + r.uniform(0, 0.02)) for _ in range(200))]
    spots = [(10 + r.choice((0, 0.01, 0.28, 0.33)) + r.uniform(0, 0.02), 50 + r.uniform(-0.02, 0.04)) for _ in range(150)]
    copies = [(i + 200 * k, pts) for k in (1, 2, 0) for i, pts in lines]
    points = spark.createDataFrame([(i + 150 * k, *p) for k in range(3) for i, p in enumerate(spots)], "id long, lon double, lat double")
    layer = spark.createDataFrame(copies, LINES)
    got = {x["id"]: x for x in vector.nearest_within(points, layer, 3000.0).collect()}
    corners = {x["id"]: x["metres"] for x in vector.nearest_vertex(points, layer).collect()}

    def distance(p, pts):
        scale = (vector.METRES_PER_DEGREE_LON * math.cos(math.radians(p[1])), vector.METRES_PER_DEGREE_LAT)
        (ax, ay), (bx, by) = (((x - p[0]) * scale[0], (y - p[1]) * scale[1]) for x, y in pts)
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        return math.hypot(ax + t * dx, ay + t * dy)

    def arc(p, q):
        a, b, c, d = map(math.radians, (*p, *q))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2))

    for i, p in enumerate(spots):
        least, fid = min((round(distance(p, pts), 6), fid) for fid, pts in lines)
        for k in range(3):
            assert (i + 150 * k in got) == (least <= 3000)
            if least <= 3000:
                assert (got[i + 150 * k]["fid"], round(got[i + 150 * k]["metres"], 4)) == (fid, round(least, 4))
            assert math.isclose(corners[i + 150 * k], min(arc(p, q) for _, pts in lines for q in pts), abs_tol=1e-4)
