"""Kernels against naive versions and analytic surfaces on small grids."""

import math

import numpy as np
import pytest
import whole_grids as whole
from pyspark.sql import functions as F

from ridgeline.operators import contour, flood, packed, raster, rays, stats, walks


def grid_of(spark, z):
    return spark.createDataFrame([(y, x, None if z[y, x] != z[y, x] else float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1])], "y int, x int, z double")


@pytest.fixture(scope="module")
def rough():
    return np.random.default_rng(5).integers(0, 60, (14, 17)).astype(float)


def test_plane_has_one_slope(spark):
    y, x = np.indices((6, 7))
    row = raster.horn(grid_of(spark, 3.0 * x + 2.0 * y), "z", 1.0).where("y = 3 AND x = 3").first()
    assert math.isclose(row["slope"], math.degrees(math.atan(math.hypot(3, 2))), abs_tol=1e-9)
    assert math.isclose(row["aspect"], math.degrees(math.atan2(-3, 2)) % 360, abs_tol=1e-9)


def test_null_neighbour_gives_null(spark):
    z = np.zeros((4, 4))
    z[1, 1] = np.nan
    assert raster.horn(grid_of(spark, z), "z", 1.0).where("y = 2 AND x = 2").first()["slope"] is None


def test_whole_grid_travel_time_against_relaxation(rough):
    z, factor = rough[:8, :8], np.ones((8, 8))
    factor[2, 3:6] = -1
    for reverse in (False, True):
        hours, before = whole.travel_time(z, factor, np.array(30.0), (1, 1), reverse)
        naive = np.full(z.shape, np.inf)
        naive[1, 1] = 0
        for _ in range(80):
            for y, x in np.ndindex(*z.shape):
                for dy, dx in walks.MOVES:
                    v, u = y + dy, x + dx
                    if 0 <= v < 8 and 0 <= u < 8 and (mean := (factor[y, x] + factor[v, u]) / 2) > 0:
                        run = walks.LENGTHS[dy * dy + dx * dx] * 30
                        rise = (z[v, u] - z[y, x]) / run * (-1 if reverse else 1)
                        naive[v, u] = min(naive[v, u], naive[y, x] + run / 1000 / (walks.tobler_speed(rise) * mean))
        assert np.allclose(hours, naive)
        path = whole.path_to(before, (7, 7))
        assert path[0] == (1, 1) and path[-1] == (7, 7)


def test_whole_grid_flood_is_the_fixpoint_and_area_is_kept(rough):
    filled, down, area = whole.drainage(rough, np.array(30.0))
    z = np.full(rough.shape, np.inf)
    z[0], z[-1], z[:, 0], z[:, -1] = rough[0], rough[-1], rough[:, 0], rough[:, -1]
    for _ in range(300):
        pad = np.pad(z, 1, constant_values=np.inf)
        low = np.min([pad[1 + a : 1 + a + z.shape[0], 1 + b : 1 + b + z.shape[1]] for a, b in flood.STEPS_8], axis=0)
        z[1:-1, 1:-1] = np.minimum(z, np.maximum(rough, low + 1e-3))[1:-1, 1:-1]
    assert np.allclose(filled, z)
    yy, xx = np.indices(rough.shape)
    sloping = 3.0 * xx + 2.0 * yy + rough / 100  # without pits, where steepest descent and flood would meet, all area leaves
    _, away, drained = whole.drainage(sloping, np.array(30.0))
    assert math.isclose(drained[away < 0].sum(), rough.size * 900 / 1e6)
    for cells, _ in whole.streams(down, area, 0.005):
        assert all(down.ravel()[a] == b for a, b in zip(cells, cells[1:]))


def test_two_hills_meet_at_their_saddle():
    y, x = np.indices((21, 41))
    z = 100 * np.exp(-((x - 10) ** 2 + (y - 10) ** 2) / 40) + 80 * np.exp(-((x - 30) ** 2 + (y - 10) ** 2) / 40)
    found = whole.summits(z, 5.0)
    low = next(p for p in found if not p[6])
    assert low[:2] == (10, 30) and low[4] == 10 and 15 < low[5] < 25 and math.isclose(low[3], z[10, 30] - z[low[4], low[5]])
    assert next(p for p in found if p[6])[:2] == (10, 10)


def test_viewshed_agrees_with_exploded_form(spark, rough):
    grid = grid_of(spark, rough)
    seen = {(r["y"], r["x"]): r["seen"] for r in rays.viewshed(grid, 7, 8, 200.0, 30.0).collect()}
    pairs = spark.createDataFrame([(i, 8, 7, x, y) for i, (y, x) in enumerate(seen)], "id int, ox int, oy int, tx int, ty int")
    got = {r["id"]: r["seen"] for r in rays.line_of_sight(pairs, grid, 17, 14, 30.0).collect()}
    assert [got[i] for i in range(len(seen))] == list(seen.values())


def test_sun_leaves_shadow_behind_a_wall(spark):
    z = np.zeros((9, 9))
    z[:, 4:6] = 50.0
    lit = {(r["y"], r["x"]): r["hours"] for r in rays.sun_exposure(raster.horn(grid_of(spark, z), "z", 30.0), [(12.0, 90.0, 20.0)], 30.0, 1.0).collect()}
    assert lit[4, 1] == 0 and lit[4, 7] == 1


def test_contours_of_a_cone_close(spark):
    y, x = np.indices((21, 21))
    lines = contour.contours(grid_of(spark, 100 - 5 * np.hypot(x - 10, y - 10)), "z", 20.0).collect()
    rings = [r for r in lines if r["closed"]]
    assert rings and all(r["pts"][0] == r["pts"][-1] for r in rings)


def test_simplify_keeps_corners():
    assert contour.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]


def test_packing_round_trips(spark):
    row = spark.range(1).select(*packed.pack_height(F.lit(1234.5))).first()
    assert spark.range(1).select(packed.unpack_height(*map(F.lit, row))).first()[0] == 1234.5


def test_greedy_spacing():
    assert rays.greedy_spaced([(0, 0), (0, 1), (5, 5), (9, 9)], lambda p: p, 3, 2) == [(0, 0), (5, 5)]


def test_landforms_partition(spark, rough):
    both = raster.tpi(raster.tpi(raster.horn(grid_of(spark, rough), "z", 30.0), "z", 2, "s"), "z", 5, "l")
    out = stats.shares(both.withColumn("k", raster.landform(F.col("s"), F.col("l"), F.col("slope"))), "k").collect()
    assert math.isclose(sum(r["share"] for r in out), 1) and all(1 <= r["k"] <= 10 for r in out)
    m = both.agg(F.avg("s"), F.stddev_pop("s")).first()
    assert abs(m[0]) < 1e-9 and math.isclose(m[1], 1)


def test_rank_without_a_window(spark):
    r = np.random.default_rng(3)
    for values in (r.normal(size=900).round(2), r.integers(0, 5, 300).astype(float), np.array([1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 1e300, -1e300]), np.array([7.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for share in (0.0, 0.05, 0.5, 0.95, 0.999):
            assert stats.at_rank(df, "v", share).first()[0] == np.sort(values)[int(len(values) * share)]
        assert stats.at_rank(df, "v", 1.0).first()[0] is None
    assert stats.at_rank(df.limit(0), "v", 0.5).first()[0] is None
    plan = stats.at_rank(df, "v", 0.5)._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_rays_are_picked_by_tiles_as_by_marching(spark, rough, tile):
    """Rays that begin outside, run along an axis, leave the grid, or come over a cell without a value before or after ground."""
    z = np.kron(rough, np.ones((3, 3)))[:40, :50]
    z[8:10, 20:26], z[30, 10] = np.nan, np.nan
    h, w = z.shape
    r = np.random.default_rng(9)
    picks = [(i, float(r.uniform(-20, w + 20)), float(r.uniform(-20, h + 20)), float(r.uniform(30, 200)), *(float(c) for c in (*(r.uniform(-1, 1, 2) if i % 5 else ((1, 0), (0, -1))[i % 2]), -r.uniform(0.0, 0.3)))) for i in range(400)]
    far = rays.pick_distances(30.0, max(w, h) * 90.0)

    def height_at(x, y):
        if not (0 <= x <= w - 1 and 0 <= y <= h - 1):
            return None
        i, j = min(int(x), w - 2), min(int(y), h - 2)
        u, v = x - i, y - j
        g = (z[j, i] * (1 - u) + z[j, i + 1] * u) * (1 - v) + (z[j + 1, i] * (1 - u) + z[j + 1, i + 1] * u) * v
        return None if g != g else g

    def marched(ox, oy, oz, dx, dy, dz):
        came = False
        for i, t in enumerate(far):
            g = height_at(ox + dx * t / 30, oy + dy * t / 30)
            if g is None and came:
                return None
            came = came or g is not None
            if g is not None and oz + dz * t <= g:
                a, b = far[i - 1] if i else 0.0, t
                for _ in range(rays.PICK_HALVINGS):
                    m = (a + b) / 2
                    g = height_at(ox + dx * m / 30, oy + dy * m / 30)
                    a, b = (a, m) if g is not None and oz + dz * m <= g else (m, b)
                return b
        return None

    got = {x["id"]: x for x in rays.ray_pick(spark.createDataFrame(picks, "id long, ox double, oy double, oz double, dx double, dy double, dz double"), grid_of(spark, z), w, h, 30.0, tile=tile).collect()}
    wanted = {i: marched(*ray) for i, *ray in picks}
    assert len(got) == 400 and 50 < sum(t is not None for t in wanted.values()) < 350
    for i, t in wanted.items():
        assert (got[i]["t"] is None) == (t is None) and (t is None or math.isclose(got[i]["t"], t, abs_tol=1e-6))


def test_picks_over_a_long_grid_are_not_steps_in_the_plan(spark):
    """The steps of a grid of 180,000 rows stay out of the plan, and a ray is dealt to the tiles that it passes only."""
    grid = spark.range(180_000 * 2).selectExpr("CAST(id div 2 AS INT) AS y", "CAST(id % 2 AS INT) AS x", "0.0D AS z").where("y < 600 OR y > 179000")
    picks = spark.createDataFrame([(1, 0.5, 10.0, 50.0, 0.0, 1.0, -0.1), (2, 0.5, 179_500.0, 50.0, 0.0, -1.0, -0.1)], "id long, ox double, oy double, oz double, dx double, dy double, dz double")
    found = rays.ray_pick(picks, grid, 2, 180_000, 30.0)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert [round(r["t"], 1) for r in found.orderBy("id").collect()] == [500.0, 500.0]


@pytest.mark.parametrize("tile", [4, 64])
def test_wind_shelter_by_tiles(spark, rough, tile):
    h, w = rough.shape
    found = rays.wind_shelter(grid_of(spark, rough), 250.0, 95.0, 30.0, w, h, tile=tile)
    assert "Generate explode(array(named_struct" not in found._jdf.queryExecution().logical().toString()  # no row for each step of a ray
    got = {(r["y"], r["x"]): r["shelter"] for r in found.collect()}
    assert len(got) == rough.size
    for y, x in np.ndindex(h, w):
        angles = []
        for off in (-15.0, -7.5, 0.0, 7.5, 15.0):
            az = math.radians(250.0 + off)
            rises = []
            for s in range(1, 5):
                px, py = min(max(x + math.sin(az) * s, 0), w - 1.001), min(max(y - math.cos(az) * s, 0), h - 1.001)
                rises.append((float(rays.bilinear(rough, np.array([px]), np.array([py]))[0]) - rough[y, x]) / (s * 30.0))
            angles.append(math.degrees(math.atan(max(rises))))
        assert math.isclose(got[y, x], sum(angles) / 5, abs_tol=1e-9)


def test_thinning_keeps_points_flat():
    import tracemalloc

    import pyarrow as pa

    n = 50_000
    x = np.arange(n, dtype=float)
    y = np.where(np.arange(n) % 1000 == 0, 5.0, np.random.default_rng(1).random(n) / 100)
    lists = pa.ListArray.from_arrays(pa.array([0, 2, 2, n - 1, n], pa.int32()), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    tracemalloc.start()
    got = contour._thinned(lists[1:], 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 * n  # a dict of two floats for each point takes more than 230 bytes
    want = [contour.simplify(list(zip(x[a:b], y[a:b])), 0.1) for a, b in ((2, 2), (2, n - 1), (n - 1, n))]
    assert [[(q["x"], q["y"]) for q in line] for line in got.to_pylist()] == want


def test_directions_of_picks_are_those_of_decimals(spark, tmp_path):
    from ridgeline.plans import queries

    spark.createDataFrame([(k,) for k in (3, 50734, 60807, 68722, 88344)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    for r in queries._picks(spark, str(tmp_path)).collect():
        assert math.isclose(r["dx"], math.cos(r["id"] * 7 / 10) * 0.97, abs_tol=1e-13) and math.isclose(r["dy"], math.sin(r["id"] * 7 / 10) * 0.97, abs_tol=1e-13)
