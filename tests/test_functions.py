"""Golden values, round trips and properties of the scalar functions."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.functions import astro, geodesy, magnetic, text

LON, LAT = -119.390728, 54.062707


@pytest.fixture(scope="module")
def here(spark):
    return spark.createDataFrame([(LON, LAT)], "lon double, lat double")


def test_lambert_matches_published(here):
    lcc = geodesy.Lcc()
    x, y = here.select(*lcc.forward(F.col("lon"), F.col("lat"))).first()
    assert math.isclose(x, -1532407.2453185585, abs_tol=1e-3) and math.isclose(y, 855786.0437462413, abs_tol=1e-3)
    back = here.select(*lcc.inverse(F.lit(x), F.lit(y))).first()
    assert np.allclose(back, (LON, LAT), atol=1e-9)


def test_utm_matches_published(here):
    e, n = here.select(*geodesy.utm_forward(F.col("lon"), F.col("lat"), 11)).first()
    assert math.isclose(e, 343538.58429679496, abs_tol=1e-3) and math.isclose(n, 5993142.099820714, abs_tol=1e-3)
    assert np.allclose(here.select(*geodesy.utm_inverse(F.lit(e), F.lit(n), 11)).first(), (LON, LAT), atol=1e-9)


def test_calendar_and_zone(spark):
    rows = spark.createDataFrame([(datetime.date(2026, 9, 28),), (datetime.date(2026, 10, 31),), (datetime.date(2026, 11, 1),)], "d date")
    got = rows.select(astro.weekday(F.col("d")), astro.mountain_zone(F.col("d"))).collect()
    assert got[0][0] == "Mon" and (got[1][1], got[2][1]) == ("MDT", "MST")


def test_day_near_equinox_has_twelve_hours(spark):
    df = spark.createDataFrame([(datetime.date(2026, 9, 25),)], "d date")
    row = astro.sun_crossing(df, astro.days_of(F.col("d")), F.lit(-119.39), F.lit(54.06)).first()
    assert abs(row["set"] - row["rise"] - 12) < 0.2 and row["rise"] < row["noon"] < row["set"]


def test_sun_does_not_cross_in_polar_night(spark):
    df = spark.createDataFrame([(datetime.date(2026, 12, 21),)], "d date")
    assert astro.sun_crossing(df, astro.days_of(F.col("d")), F.lit(0.0), F.lit(80.0)).first()["rise"] is None


def test_magnetic_dipole(spark, tmp_path):
    """A tilted dipole with secular change, whose field is known in closed form."""
    path = tmp_path / "dipole.txt"
    path.write_text("    2025.0            MODEL     01/01/2025\n  1  0  -29000.0       0.0       10.0        0.0\n  1  1   -1400.0    4500.0        5.0      -20.0\n" + "9" * 48 + "\n")
    table, epoch = magnetic.read_coefficients(spark, str(path))
    assert epoch == 2025.0 and table.count() == 2
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b), float(c), 2025.0 + float(e)) for a, b, c, e in zip(rng.uniform(-80, 80, 20), rng.uniform(-180, 180, 20), rng.uniform(0, 90, 20), rng.uniform(0, 3, 20))]
    got = magnetic.with_field(spark.createDataFrame(rows, "lat double, lon double, alt_km double, year double"), table, epoch).collect()
    for r in got:
        dt = r["year"] - 2025
        m = np.array([-1400 + 5 * dt, 4500 - 20 * dt, -29000 + 10 * dt])
        phi, lam = math.radians(r["lat"]), math.radians(r["lon"])
        e2 = magnetic.WGS84_F * (2 - magnetic.WGS84_F)
        n = magnetic.WGS84_A / math.sqrt(1 - e2 * math.sin(phi) ** 2)
        p = np.array([(n + r["alt_km"]) * math.cos(phi) * math.cos(lam), (n + r["alt_km"]) * math.cos(phi) * math.sin(lam), (n * (1 - e2) + r["alt_km"]) * math.sin(phi)])
        d = np.linalg.norm(p)
        b = magnetic.REFERENCE_KM**3 * (3 * p * (m @ p) / d**5 - m / d**3)
        north = np.array([-math.sin(phi) * math.cos(lam), -math.sin(phi) * math.sin(lam), math.cos(phi)])
        east, down = np.array([-math.sin(lam), math.cos(lam), 0]), -np.array([math.cos(phi) * math.cos(lam), math.cos(phi) * math.sin(lam), math.sin(phi)])
        x, y, z = b @ north, b @ east, b @ down
        assert math.isclose(r["total"], np.linalg.norm(b), rel_tol=1e-9)
        assert math.isclose(r["declination"], math.degrees(math.atan2(y, x)), abs_tol=1e-7)
        assert math.isclose(r["inclination"], math.degrees(math.atan2(z, math.hypot(x, y))), abs_tol=1e-7)


def test_text(spark):
    row = spark.range(1).select(text.hours_minutes(F.lit(25.5)), text.thousands(F.lit(1234567.4)), text.percent(F.lit(0.126)), text.html_escape(F.lit('<a b="&">')), text.hex_channels(F.lit("#0a10ff")), text.hours_about(F.lit(1.51))).first()
    assert list(row) == ["1:30", "1,234,567", "13%", "&lt;a b=&quot;&amp;&quot;&gt;", [10, 16, 255], "1 h 30 min"]
