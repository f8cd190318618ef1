"""Operators by tiles and by pointer jumping against whole-grid loops."""

import math

import numpy as np
import pytest
import whole_grids as whole
from pyspark.sql import functions as F

from ridgeline import storage
from ridgeline.operators import contour, flood, jumping, peaks, raster, rays, tiles, walks


def grid_of(spark, z):
    return spark.createDataFrame([(y, x, None if z[y, x] != z[y, x] else float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1])], "y int, x int, z double")


def rough(seed, shape=(23, 31), most=12):
    return np.random.default_rng(seed).integers(0, most, shape).astype(float)


def test_subtree_sums(spark):
    parent = {i: (i * 7 % i if i % 5 else i - 1) if i else None for i in range(200)} | {300: 301, 301: None}
    want = dict.fromkeys(parent, 0.0)
    for i in parent:
        j = i
        while j is not None:
            want[j] += i
            j = parent[j]
    got = jumping.subtree_sums(spark.createDataFrame([(i, p, float(i)) for i, p in parent.items()], "id long, next long, weight double"))
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_chain_ranks_leave_circles_out(spark):
    links = [(i, i - 1) for i in range(1, 40)] + [(101, 100)] + [(200 + i, 200 + (i + 1) % 3) for i in range(3)]
    got = jumping.chain_ranks(spark.createDataFrame(links, "id long, up long")).collect()
    assert {tuple(r) for r in got} == {(i, 0, i) for i in range(1, 40)} | {(101, 100, 1)}
    assert jumping.chain_ranks(spark.createDataFrame([], "id long, up long")).count() == 0


@pytest.mark.parametrize(("seed", "tile"), [(1, 5), (2, 8), (3, 64)])
def test_drainage_and_streams_by_tiles(spark, seed, tile):
    z = rough(seed) + (5 * np.hypot(*(np.indices((23, 31)) - np.array([11, 15])[:, None, None])) if seed == 2 else 0)  # the second is a bowl: ways through many tiles
    filled, down, area = whole.drainage(z, np.array(30.0))
    table = flood.drainage_table(grid_of(spark, z), 30.0, tile=tile)
    got = {(r["y"], r["x"]): r for r in table.collect()}
    assert len(got) == z.size
    for (y, x), r in got.items():
        assert r["filled"] == filled[y, x]
        assert (-1 if r["down_y"] is None else r["down_y"] * 31 + r["down_x"]) == down[y, x]
        assert math.isclose(r["area_km2"], area[y, x], rel_tol=1e-12)
    reaches = {}
    for r in flood.stream_table(table, 0.01).orderBy("reach", "seq").collect():
        reaches.setdefault((r["reach"], round(r["km2"], 9)), []).append((r["seq"], r["y"] * 31 + r["x"]))
    want = {(f"{c[0] // 31}:{c[0] % 31}", round(km2, 9)): list(enumerate(c)) for c, km2 in whole.streams(down, area, 0.01)}
    assert reaches == want and want


def test_drainage_with_gaps_and_cell_sizes_by_row(spark):
    z = rough(4, (12, 14))
    z[4:7, 4:7] = np.nan
    z[5, 5] = 3.0  # shut in
    grid = grid_of(spark, z).where("NOT (y = 2 AND x = 3)").withColumn("size", 20.0 + F.col("y"))
    got = {(r["y"], r["x"]): r for r in flood.drainage_table(grid, "size", tile=4).collect()}
    assert len(got) == 12 * 14 - 1 and got[5, 5]["filled"] is None and got[5, 5]["down_y"] is None
    assert math.isclose(got[5, 5]["area_km2"], 25.0**2 / 1e6)
    assert all(got[r["down_y"], r["down_x"]]["filled"] is not None for r in got.values() if r["down_y"] is not None)
    level = np.full(z.shape, np.inf)
    ground = z.copy()
    ground[2, 3] = np.nan
    for y, x in np.ndindex(*z.shape):
        if y in (0, 11) or x in (0, 13):
            level[y, x] = z[y, x]
    for _ in range(100):
        for y, x in np.ndindex(*z.shape):
            if ground[y, x] == ground[y, x] and 0 < y < 11 and 0 < x < 13:
                level[y, x] = min(level[y, x], max(ground[y, x], min(level[y + a, x + b] for a, b in flood.STEPS_8) + 1e-3))
    assert all(math.isclose(got[k]["filled"], v) for k, v in np.ndenumerate(level) if k in got and v < np.inf)


def test_nothing_to_drain(spark):
    empty = grid_of(spark, np.zeros((0, 0)))
    assert flood.drainage_table(empty, 30.0).count() == 0
    assert flood.stream_table(flood.drainage_table(empty, 30.0), 1.0).count() == 0


@pytest.mark.parametrize(("seed", "tile", "most"), [(1, 3, 6), (2, 4, 60), (3, 7, 3), (4, 5, 1000), (5, 64, 60)])
def test_summits_by_merge_tree(spark, seed, tile, most):
    z = rough(seed, (25, 29), most)
    if seed == 4:
        z += 100 * np.hypot(*(np.indices((25, 29)) - np.array([12, 14])[:, None, None])) * -1 + 5000  # one mountain, many shoulders
    got = peaks.summit_table(grid_of(spark, z), 1.0, None, tile=tile).collect()
    want = whole.summits(z, 1.0)
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3


def test_summits_with_gaps_and_of_nothing(spark):
    z = rough(8, (16, 18), 40)
    z[5:9, 3:15] = np.nan
    got = peaks.summit_table(grid_of(spark, z), 1.0, None, tile=4).collect()
    assert sorted(map(tuple, got)) == sorted(whole.summits(z, 1.0))
    assert peaks.summit_table(grid_of(spark, z).limit(0), 1.0).count() == 0
    assert peaks.summit_table(grid_of(spark, np.full((9, 9), 7.0)), 1.0, tile=3).count() == 0


def test_saddles_are_spaced_and_numbered(spark):
    z = rough(6, (40, 40), 50)
    grid = grid_of(spark, z).withColumn("open", F.col("x") % 2 == 0)
    every = sorted((p for p in whole.summits(z, 3.0) if not p[6] and 5 <= p[4] < 35 and 5 <= p[5] < 38), key=lambda p: (-p[3], p[0], p[1]))
    kept = []
    for p in every:
        if len(kept) < 14 and all(math.hypot(p[4] - k[4], p[5] - k[5]) * 30 >= 200 for k in kept):
            kept.append(p)
    kept.sort(key=lambda p: (math.hypot(p[4] - 20, p[5] - 20), p[4], p[5]))
    got = peaks.chosen_saddles(peaks.summit_table(grid, 3.0, None, tile=16), grid, 30.0, (20, 20), (5, 5, 35, 38), 200.0).orderBy("number").collect()
    assert [(r["saddle_y"], r["saddle_x"], r["depth"], r["open"]) for r in got] == [(p[4], p[5], p[3], p[5] % 2 == 0) for p in kept] and len(got) > 5
    assert [r["number"] for r in got] == list(range(1, len(got) + 1))


@pytest.mark.parametrize("tile", [4, 9, 64])
def test_travel_by_tiles(spark, tile):
    z, factor = rough(7, (21, 26), 40), np.ones((21, 26))
    factor[4:18, 12] = factor[4:18, 13] = -1  # a wall to walk round
    factor[0:5, 5] = 0.4
    z[19, 20] = np.nan
    size = 20.0 + np.arange(21) / 10
    rows = [(y, x, None if z[y, x] != z[y, x] else z[y, x], factor[y, x], size[y]) for y, x in np.ndindex(*z.shape)]
    grid = spark.createDataFrame([tuple(None if v is None else v.item() if hasattr(v, "item") else v for v in r) for r in rows], "y int, x int, z double, factor double, size double")
    starts = spark.createDataFrame([(1, 3, 3, False), (2, 3, 3, True), (3, 20, 25, False), (4, 19, 20, False)], "start int, sy int, sx int, reverse boolean")
    table = walks.travel_table(grid, starts, "size", tile=tile)
    got = {(r["start"], r["y"], r["x"]): r for r in table.collect()}
    ends = spark.createDataFrame([(1, 1, 20, 25), (2, 2, 20, 25), (3, 3, 0, 0), (4, 4, 0, 0), (5, 1, 3, 3)], "path int, start int, y int, x int")
    paths = {}
    for r in walks.path_table(table, ends, tile).orderBy("path", "seq").collect():
        paths.setdefault(r["path"], []).append((r["y"], r["x"]))
    for start, at, reverse, end in ((1, (3, 3), False, (20, 25)), (2, (3, 3), True, (20, 25)), (3, (20, 25), False, (0, 0))):
        hours, before = whole.travel_time(z, factor, size, at, reverse)
        assert sum(k[0] == start for k in got) == np.isfinite(hours).sum()
        for y, x in zip(*np.nonzero(np.isfinite(hours))):
            r = got[start, y, x]
            assert math.isclose(r["hours"], hours[y, x], rel_tol=1e-12)
            b = before[y, x]
            if (r["before_y"], r["before_x"]) != (tuple(divmod(int(b), 26)) if b >= 0 else (-1, -1)):
                assert False, (start, y, x)
        assert paths[start] == whole.path_to(before, end)
    assert not any(k[0] == 4 for k in got) and 4 not in paths and paths[5] == [(3, 3)]


def test_ring_minima(spark):
    rings = [list(range(10, 10 + n)) for n in (1,)] + [list(range(100 * k, 100 * k + n)) for k, n in ((1, 2), (2, 3), (3, 8), (4, 13))]
    links = []
    for ring in rings:
        shuffled = list(np.random.default_rng(len(ring)).permutation(ring))
        links += [(int(a), int(b)) for a, b in zip(shuffled, shuffled[1:] + shuffled[:1])]
    got = {r["id"]: r["least"] for r in jumping.ring_minima(spark.createDataFrame(links, "id long, up long")).collect()}
    assert got == {i: min(ring) for ring in rings for i in ring}


def lines_by_walking(rows):
    """Lines of segments (side, side, point, point) as lists of points, walked one by one."""
    at = {}
    for i, r in enumerate(rows):
        at.setdefault(r[0], []).append(i)
        at.setdefault(r[1], []).append(i)
    todo, out = set(range(len(rows))), []

    def follow(i, side):
        points = [rows[i][2] if rows[i][0] == side else rows[i][3]]
        low = side
        while i is not None:
            todo.discard(i)
            a, b, p, q = rows[i]
            side, point = (b, q) if side == a else (a, p)
            points.append(point)
            low = min(low, side)
            i = next((j for j in at[side] if j in todo), None)
        return low, points

    for side, held in at.items():
        if len(held) == 1 and held[0] in todo:
            out.append((False, *follow(held[0], side)))
    while todo:
        i = min(todo)
        out.append((True, *follow(i, rows[i][0])))
    return out


@pytest.mark.parametrize(("seed", "tile"), [(1, 4), (2, 7), (3, 64)])
def test_contours_by_tiles(spark, seed, tile):
    z = rough(seed, (19, 23), 50)
    if seed == 2:
        z = z / 25 + 8 * np.hypot(*(np.indices((19, 23)) - np.array([9, 11])[:, None, None]))  # rings through many tiles
    grid = grid_of(spark, z)
    number = {"T": (0, 0, 0), "B": (1, 0, 0), "L": (0, 0, 1), "R": (0, 1, 1)}
    side = lambda r, s: (r["y"] + number[s][0]) * 2**32 + (r["x"] + number[s][1]) * 2 + number[s][2]
    levels = {}
    for r in contour.segments(grid, "z", 10.0).collect():
        levels.setdefault(r["level"], []).append((side(r, r["side_a"]), side(r, r["side_b"]), (r["ax"], r["ay"]), (r["bx"], r["by"])))
    want = {(level, low): (closed, points) for level, rows in levels.items() for closed, low, points in lines_by_walking(rows)}
    got = {(r["level"], r["line_id"]): (r["closed"], [(p["x"], p["y"]) for p in r["pts"]]) for r in contour.contours(grid, "z", 10.0, tile=tile).collect()}
    assert got.keys() == want.keys() and any(c for c, _ in got.values()) and any(not c for c, _ in got.values())
    for k, (closed, points) in want.items():
        assert got[k][0] == closed
        if not closed:
            assert got[k][1] in (points, points[::-1])
        else:
            mine, theirs = got[k][1], points
            assert mine[0] == mine[-1] and theirs[0] == theirs[-1]
            turns = [theirs[:-1][j:] + theirs[:-1][:j] for j in range(len(theirs) - 1)]
            assert mine[:-1] in turns or mine[:-1] in [t[::-1] for t in turns]
    assert contour.contours(grid.limit(0), "z", 10.0).count() == 0


@pytest.mark.parametrize("tile", [5, 11, 64])
def test_viewsheds_by_tiles(spark, tile):
    z = rough(9, (33, 37), 40) + 10
    z[20:22, 30] = np.nan
    eyes = [(1, 16, 18), (2, 0, 0), (3, 32, 36)]
    got = {(r["eye"], r["y"], r["x"]): r["seen"] for r in rays.viewsheds(grid_of(spark, z), spark.createDataFrame([*eyes, (4, 99, 0)], "eye int, y int, x int"), 600.0, 30.0, tile=tile).collect()}
    for e, oy, ox in eyes:
        yy, xx = (a.ravel() for a in np.indices(z.shape))
        on = ((yy - oy) ** 2 + (xx - ox) ** 2 <= 400) & ~np.isnan(z.ravel())
        seen = whole.visible(z, ox, oy, xx[on].astype(float), yy[on].astype(float), 30.0, 1.7, 1.0)
        assert {k[1:]: v for k, v in got.items() if k[0] == e} == {(int(y), int(x)): int(s) for y, x, s in zip(yy[on], xx[on], seen)}
        assert 0 < seen.sum() < len(seen)
    assert not any(k[0] == 4 for k in got)


@pytest.mark.parametrize("open_col", [None, "open"])
def test_vantages_by_tiles(spark, open_col):
    z = rough(10, (30, 34), 60)
    grid = grid_of(spark, z).withColumn("open", (F.col("x") + F.col("y")) % 3 > 0)
    at = [(y, x) for y in range(0, 30, 7) for x in range(0, 34, 6)]
    got = {(r["y"], r["x"]): r for r in rays.vantage_scores(grid, spark.createDataFrame(at, "y int, x int"), 30.0, 2, 90.0, 300.0, open_col=open_col, tile=9).collect()}
    assert len(got) == len(at)
    for y, x in at:
        yy, xx = (a.ravel() for a in np.indices(z.shape))
        d = np.hypot(yy - y, xx - x) * 30
        on = ((yy - y) % 2 == 0) & ((xx - x) % 2 == 0) & (d >= 90) & (d <= 300)
        if open_col:
            on &= (xx + yy) % 3 > 0
        seen = whole.visible(z, x, y, xx[on].astype(float), yy[on].astype(float), 30.0, 1.7, 1.0)
        assert math.isclose(got[y, x]["share"], seen.mean()) and math.isclose(got[y, x]["area_km2"], seen.sum() * 0.0036)


def test_best_vantages_stand_on_open_ground_apart(spark):
    z = rough(12, (40, 40), 60)
    grid = grid_of(spark, z).withColumn("open", F.col("x") % 2 == 0)
    got = rays.best_vantages(grid, grid.where("y % 5 = 0 AND x % 5 = 0"), 30.0, top=20, apart_m=200.0, picks=5, near_m=60.0, far_m=240.0, open_col="open", tile=16).orderBy("rank").collect()
    assert len(got) == 5 and all(r["x"] % 2 == 0 for r in got) and [r["area_km2"] for r in got] == sorted((r["area_km2"] for r in got), reverse=True)
    assert all(math.hypot(a["y"] - b["y"], a["x"] - b["x"]) * 30 > 200 for a in got for b in got if a != b)


@pytest.mark.parametrize("tile", [6, 64])
def test_sun_by_tiles(spark, tile):
    z = rough(11, (24, 29), 80)
    grid = raster.horn(grid_of(spark, z), "z", 30.0).select("y", "x", "z", "nx", "ny", "nz")
    normals = {(r["y"], r["x"]): (r["nx"], r["ny"], r["nz"]) for r in grid.collect()}
    planes = [np.array([[normals[y, x][i] if normals[y, x][i] is not None else np.nan for x in range(29)] for y in range(24)]).ravel() for i in range(3)]
    sun = [(6.0, 80.0, 8.0), (9.0, 130.0, 25.0), (12.0, 180.0, 40.0), (18.0, 275.0, 6.0)]
    first, last, n = whole.sunlit(z, planes, sun, 30.0)
    got = {(r["y"], r["x"]): r for r in rays.sun_exposure(grid, sun, 30.0, 0.5, tile=tile).collect()}
    assert len(got) == z.size
    for i, (y, x) in enumerate(np.ndindex(*z.shape)):
        r = got[y, x]
        assert (r["first"], r["last"], r["hours"]) == (None if np.isnan(first[i]) else first[i], None if np.isnan(last[i]) else last[i], n[i] / 2)
    assert 0 < n.sum() < 4 * z.size


def test_ways_along_a_narrow_grid_pass_few_tiles(spark, monkeypatch):
    assert walks._long_tile(180_000, 120) == (8738, 120) and walks._long_tile(7, 5000) == (7, 5000) and walks._long_tile(9000, 9000) == (1024, 1024)
    monkeypatch.setattr(walks, "CELLS", 100)
    z = rough(3, (60, 5), 40)
    z[25, 0:3] = np.nan
    rows = [(y, x, None if z[y, x] != z[y, x] else float(z[y, x]), 1.0) for y, x in np.ndindex(*z.shape)]
    grid = spark.createDataFrame(rows, "y int, x int, z double, factor double")
    starts = spark.createDataFrame([(1, 2, 2, False)], "start int, sy int, sx int, reverse boolean")
    rounds = []
    monkeypatch.setattr(tiles, "materialise", lambda df, label: (rounds.append(label), storage.materialise(df, label))[1])
    got = {(r["y"], r["x"]): (r["hours"], r["before_y"], r["before_x"]) for r in walks.travel_table(grid, starts, 30.0).collect()}
    hours, before = whole.travel_time(z, np.ones(z.shape), np.full(60, 30.0), (2, 2), False)
    assert set(got) == {(int(y), int(x)) for y, x in zip(*np.nonzero(np.isfinite(hours)))}
    for (y, x), (h, by, bx) in got.items():
        assert math.isclose(h, hours[y, x], rel_tol=1e-12) and (by, bx) == (tuple(divmod(int(before[y, x]), 5)) if before[y, x] >= 0 else (-1, -1))
    assert len(rounds) <= 5  # three tiles of 20 rows; squares of 10 cells make a round for each ten rows


def test_shade_is_asked_no_further_than_ground_can_stand_above_the_beam(monkeypatch):
    size, steps = rays._Extent(64, 32, 200.0, 100.0), rays.ray_steps(70.0)
    y, x = (a.ravel() for a in np.indices((32, 32)))
    z0, ground, asked = np.full(y.size, 100.0), np.full((34, 34), 200.0), []
    real = rays._in_tile
    monkeypatch.setattr(rays, "_in_tile", lambda px, *a: (asked.append(len(px)), real(px, *a))[1])
    # a beam to the south that rises by 30 m a cell is above all ground after 3.3 cells: only the last rows can be in the shade of the tile below
    dark = rays._shaded(z0, y, x, ground, (1, 0), 32, (0.0, -1.0, 1.0), steps, 30.0, size)
    assert set(y[dark]) == {30, 31} and sum(asked) <= 32 * 32 * 3
    level = rays._shaded(z0, y, x, ground, (1, 0), 32, (0.0, -1.0, 0.0), steps, 30.0, size)
    assert level.all()


def test_levels_that_wind_across_a_border_settle_in_few_rounds(spark, monkeypatch):
    z = np.full((24, 40), 90.0)
    z[11, 1::4], z[12, 1::4] = 5.0, 5.0
    z[12, 0::4], z[12, 2::4] = 5.0, 5.0
    for x in range(2, 40, 4):  # a ditch that runs over rows 11 and 12 by turns, from the left border
        z[12, x], z[11, x], z[11, x + 1] = 90.0, 5.0, 5.0
        z[12, x + 1] = 5.0
    z[:, 39] = 95.0
    rounds = []
    monkeypatch.setattr(tiles, "materialise", lambda df, label: (rounds.append(label), storage.materialise(df, label))[1])
    got = {(r["y"], r["x"]): r for r in flood.drainage_table(grid_of(spark, z), 30.0, tile=12).collect()}
    filled, down, area = whole.drainage(z, np.array(30.0))
    for (y, x), r in got.items():
        assert r["filled"] == filled[y, x] and math.isclose(r["area_km2"], area[y, x], rel_tol=1e-12)
    assert len(got) == z.size and len(rounds) <= 6


def test_ways_share_pieces_and_tiles_are_read_once(spark, monkeypatch):
    monkeypatch.setattr(walks, "CHUNK", 4)
    monkeypatch.setattr(walks, "WAYS", 3)
    z = rough(5, (90, 6), 30)
    rows = [(y, x, float(z[y, x]), 1.0) for y, x in np.ndindex(*z.shape)]
    grid = spark.createDataFrame(rows, "y int, x int, z double, factor double")
    starts = spark.createDataFrame([("a", 2, 2, False), ("b", 80, 3, True)], "start string, sy int, sx int, reverse boolean")
    table = walks.travel_table(grid, starts, 30.0)
    ends = table.where("y % 3 = 1").select(F.concat_ws(":", "start", "y", "x").alias("path"), "start", "y", "x")
    steps = []
    monkeypatch.setattr(walks, "materialise", lambda df, label: (steps.append((label, out := storage.materialise(df, label))), out)[1])
    got = {}
    for r in walks.path_table(table, ends, (9, 6)).orderBy("path", "seq").collect():
        got.setdefault(r["path"], []).append((r["seq"], r["y"], r["x"], r["hours"]))
    came = {(r["start"], r["y"], r["x"]): r for r in table.collect()}
    assert len(got) == 2 * 30 * 6
    for path, way in got.items():
        start, y, x = path.split(":")
        want, at = [], (int(y), int(x))
        while at != (-1, -1):
            r = came[start, *at]
            want.append((*at, r["hours"]))
            at = r["before_y"], r["before_x"]
        assert way == [(i, *w) for i, w in enumerate(want[::-1])]
    labels = [label for label, _ in steps]
    assert labels.count("pieces") == 1 and labels.count("reach") <= 6  # ten tiles: a logarithm of rounds
    pieces = next(out for label, out in steps if label == "pieces").where("piece IS NOT NULL")
    # a cell is stored once however many ways pass it
    assert pieces.select("start", F.explode("cells").alias("c")).groupBy("start", "c.y", "c.x").count().where("count > 1").count() == 0
    assert pieces.select(F.sum(F.size("cells"))).first()[0] < sum(map(len, got.values())) / 10


def test_sun_on_a_narrow_grid_has_tiles_no_wider_than_it(spark, monkeypatch):
    z = rough(13, (70, 5), 90)
    grid = raster.horn(grid_of(spark, z), "z", 30.0).select("y", "x", "z", "nx", "ny", "nz")
    sun = [(7.0, 20.0, 8.0), (9.0, 130.0, 25.0), (12.0, 180.0, 12.0), (18.0, 275.0, 6.0)]
    want = {tuple(r) for r in rays.sun_exposure(grid, sun, 30.0, 0.5, tile=128).collect()}
    kept = []
    monkeypatch.setattr(rays, "materialise", lambda df, label: (kept.append(out := storage.materialise(df, label)), out)[1])
    got = {tuple(r) for r in rays.sun_exposure(grid, sun, 30.0, 0.5, tile=16).collect()}
    assert got == want and len(got) == z.size
    # 16 x 5 cells and one about them, not 16 x 16
    assert {r[0] for r in kept[0].select(F.length("z")).distinct().collect()} == {18 * 7 * 8}
