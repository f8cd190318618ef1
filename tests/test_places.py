"""Requests, fetched files, and facts about places against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import View
from ridgeline.operators import peaks, places
from ridgeline.sources import requests

BOX = (-119.85, 53.8, -118.95, 54.3)


def test_requests():
    assert "geometry=-119.85,53.8,-118.95,54.3&" in requests.feature_query("http://x/0", BOX) and requests.feature_query("http://x/0", BOX).startswith("http://x/0/query?")
    assert requests.names_query("http://n", BOX) == "http://n?bbox=-119.85,53.8,-118.95,54.3&num=1000"
    asked = requests.elements_query(BOX)
    assert asked.count("(53.8,-119.85,54.3,-118.95);") == len(requests.SELECTORS) == 18 and asked.startswith("[out:json][timeout:120];(way[")
    body = json.loads(requests.scene_query("c", 1.5, 2.5, "2026-09-01", "2026-09-30", 20.0))
    assert body["intersects"]["coordinates"] == [1.5, 2.5] and body["query"]["eo:cloud_cover"]["lt"] == 20.0 and body["limit"] == 200


def test_hosts_take_over():
    asked, waits = [], []

    def ask(host):
        asked.append(host)
        if len(asked) == 4:
            return " {}"
        if host == "a":
            raise OSError("down")
        return "<html>"

    assert requests.first_reply(["a", "b", "c"], ask, pause=waits.append) == " {}" and asked == ["a", "b", "c", "a"] and waits == [5, 5, 5]
    with pytest.raises(OSError):
        requests.first_reply(["a"], lambda h: (_ for _ in ()).throw(OSError("down")), pause=waits.append)
    assert waits[3:] == [5, 15, 25]
    with pytest.raises(ValueError):
        requests.first_reply([], ask)


def test_fetched(tmp_path):
    path = str(tmp_path / "f")

    def fails():
        raise OSError("down")

    with pytest.raises(OSError):
        requests.fetched(path, fails)
    requests.fetched(path, lambda: b"one")
    requests.fetched(path, lambda: b"two")
    assert open(path, "rb").read() == b"one"
    requests.fetched(path, fails, refresh=True)
    assert open(path, "rb").read() == b"one"
    requests.fetched(path, lambda: b"two", refresh=True)
    assert open(path, "rb").read() == b"two"


def test_labels_never_overlap(spark):
    r = random.Random(2)
    rows = [(s, i, x := r.uniform(0, 50), y := r.uniform(0, 50), x + r.uniform(1, 9), y + r.uniform(1, 9)) for s in range(3) for i in range(60)]
    got = {(x["sheet"], x["rank"]) for x in places.placed_labels(spark.createDataFrame(rows, "sheet int, rank int, west double, south double, east double, north double")).collect()}
    for s in range(3):
        kept = []
        for row in (x for x in rows if x[0] == s):
            if not any(row[2] < o[4] and row[4] > o[2] and row[3] < o[5] and row[5] > o[3] for o in kept):
                kept.append(row)
        assert {(s, k[1]) for k in kept} == {g for g in got if g[0] == s}


def test_empty_and_missing(spark):
    none = spark.createDataFrame([], "seq int, depth double, open boolean")
    assert places.deepest_open(none).count() == 0
    view = places.seen_area(spark.createDataFrame([(None,)], "seen int"), "seen", 30.0).first()
    assert view["share"] is None and view["km2"] == 0
    assert places.first_index(spark.createDataFrame([(1, "a"), (2, "a")], "i int, z string"), "i", F.col("z") == "b").first()["at"] is None
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 0, 5.0), (1, 1, 5.0)], "y int, x int, z double")
    assert [(x["y"], x["x"]) for x in places.height_order(grid, "z").orderBy("rank").collect()] == [(1, 0), (1, 1), (0, 0)]
    v = View(*BOX, 100, 80)
    w = spark.range(1).select(places.window_of_box(v, F.lit(-130.0), F.lit(10.0), F.lit(-110.0), F.lit(80.0)).alias("w")).first()["w"]
    assert tuple(w) == (0, 0, 100, 80)
    profile = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 5.0, None), (1, 2, 30.0, 50.0), (2, 0, 0.0, 3.0)], "id int, seq int, far double, z double")
    got = {x["id"]: x for x in places.measured(profile, "id", "seq", "far", "z").collect()}
    assert (got[1]["climb"], got[1]["path"], got[1]["rise"]) == (40.0, 50.0, 40.0) and got[2]["climb"] == 0 and got[2]["path"] is None


def test_two_points_far_apart(spark):
    row = places.two_point(spark.createDataFrame([(1, 0, 0, 30_000, 40_000)], "id long, ox int, oy int, tx int, ty int"), 30.0).first()
    assert row["m"] == 1_500_000.0 and math.isclose(row["bearing"], 90 + math.degrees(math.atan2(4, 3)))


def test_saddles_far_apart(spark):
    rows = [(y, 0, 9.0, 5.0, y, 1, False) for y in (10, 60_000, 120_000)]
    found = spark.createDataFrame(rows, "y int, x int, height double, prominence double, saddle_y int, saddle_x int, edge boolean")
    grid = spark.createDataFrame([(y, 1, True) for y in (10, 60_000, 120_000)], "y int, x int, open boolean")
    got = peaks.chosen_saddles(found, grid, 30.0, (0, 0)).orderBy("number").collect()
    assert [r["saddle_y"] for r in got] == [10, 60_000, 120_000]


@pytest.mark.parametrize("tile", [4, 64])
def test_highest_by_tiles(spark, tile):
    r = random.Random(8)
    z = {(y, x): float(r.randrange(6)) for y in range(15) for x in range(18) if (y * 18 + x) % 7}
    spots = [(i, r.randrange(-5, 20), r.randrange(-5, 23)) for i in range(150)] + [(7, None, 3)]
    view = View(*BOX, 18, 15)
    points = spark.createDataFrame([(i, -119.0, 54.0, y, x) for i, y, x in spots], "id long, lon double, lat double, y int, x int")
    grid = spark.createDataFrame([(y, x, v) for (y, x), v in z.items()], "y int, x int, z double")
    found = places.highest_within(points, grid, "z", 95.0, 30.0, view, tile=tile)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(-3" not in plan  # places aren't multiplied by the cells of a disc
    got = {row["id"]: row["z"] for row in found.collect()}
    for i, y, x in spots[:-1]:
        near = [z[y + dy, x + dx] for dy in range(-3, 4) for dx in range(-3, 4) if dy * dy + dx * dx <= 9 and (y + dy, x + dx) in z]
        assert got.get(i) == (max(near) if near else None)
