"""The geomagnetic field from spherical-harmonic coefficients: declination, inclination and total field."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEGREE = 12
#: WGS84 and the model's reference radius, km.
WGS84_A, WGS84_F, REFERENCE_KM = 6378.137, 1 / 298.257223563, 6371.2


def read_coefficients(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """(n, m, g, h, dg, dh) and the epoch of a published coefficient file; lines that aren't six numbers are skipped."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    # the header has three fields, the terminators one
    rows = lines.where(F.size("p") >= 6).select(*(F.expr(f"try_cast(p[{i}] AS {kind})").alias(name) for i, (name, kind) in enumerate((("n", "int"), ("m", "int"), ("g", "double"), ("h", "double"), ("dg", "double"), ("dh", "double")))))
    epoch = lines.where(F.size("p") == 3).select(F.expr("try_cast(p[0] AS double)").alias("e")).where("e IS NOT NULL").first()
    return rows.where(F.col("n").isNotNull() & F.col("m").isNotNull() & (F.col("n") <= DEGREE)), epoch["e"] if epoch else 2025.0


@cache
def _schmidt() -> tuple[np.ndarray, np.ndarray]:
    """Recursion factors of the Schmidt semi-normalised functions."""
    k1, k2 = np.zeros((DEGREE + 1, DEGREE + 1)), np.zeros((DEGREE + 1, DEGREE + 1))
    for n in range(1, DEGREE + 1):
        for m in range(n):
            k1[n, m] = (2 * n - 1) / np.sqrt(n * n - m * m)
            k2[n, m] = np.sqrt(max((n - 1) ** 2 - m * m, 0) / (n * n - m * m))
        k1[n, n] = 1.0 if n == 1 else np.sqrt((2 * n - 1) / (2 * n))
    return k1, k2


def field(coefficients: np.ndarray, epoch: float, lat: np.ndarray, lon: np.ndarray, alt_km: np.ndarray, year: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Declination and inclination in degrees and the total in nanotesla; rows of coefficients are n, m, g, h, dg, dh."""
    k1, k2 = _schmidt()
    phi, lam, dt = np.radians(lat), np.radians(lon), year - epoch
    e2 = WGS84_F * (2 - WGS84_F)
    normal = WGS84_A / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    axis, pole = (normal + alt_km) * np.cos(phi), (normal * (1 - e2) + alt_km) * np.sin(phi)
    radius = np.hypot(axis, pole)
    centric = np.arcsin(pole / radius)
    s, c = np.sin(centric), np.cos(centric)
    p, d = {(0, 0): np.ones_like(s)}, {(0, 0): np.zeros_like(s)}
    zero = np.zeros_like(s)
    for n in range(1, DEGREE + 1):
        for m in range(n):
            p[n, m] = k1[n, m] * s * p.get((n - 1, m), zero) - k2[n, m] * p.get((n - 2, m), zero)
            d[n, m] = k1[n, m] * (s * d.get((n - 1, m), zero) + c * p.get((n - 1, m), zero)) - k2[n, m] * d.get((n - 2, m), zero)
        p[n, n] = k1[n, n] * c * p[n - 1, n - 1]
        d[n, n] = k1[n, n] * (c * d[n - 1, n - 1] - s * p[n - 1, n - 1])
    north, east, down = zero.copy(), zero.copy(), zero.copy()
    for n, m, g, h, dg, dh in coefficients:
        n, m = int(n), int(m)
        g, h = g + dt * dg, h + dt * dh
        scale = (REFERENCE_KM / radius) ** (n + 2)
        wave = g * np.cos(m * lam) + h * np.sin(m * lam)
        north -= scale * wave * d[n, m]
        east += scale * m * (g * np.sin(m * lam) - h * np.cos(m * lam)) * p[n, m] / c
        down -= (n + 1) * scale * wave * p[n, m]
    tilt = centric - phi
    north, down = north * np.cos(tilt) - down * np.sin(tilt), north * np.sin(tilt) + down * np.cos(tilt)
    flat = np.hypot(north, east)
    return np.degrees(np.arctan2(east, north)), np.degrees(np.arctan2(down, flat)), np.hypot(flat, down)


def with_field(points: DataFrame, coefficients: DataFrame, epoch: float, lat: str = "lat", lon: str = "lon", alt_km: str = "alt_km", year: str = "year") -> DataFrame:
    """The table with declination, inclination and total; the 90 coefficients travel in the closure."""
    rows = np.array([tuple(r) for r in coefficients.select("n", "m", "g", "h", "dg", "dh").orderBy("n", "m").collect()], float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            d, i, f = field(rows, epoch, *(part[c].to_numpy(float) for c in (lat, lon, alt_km, year)))
            yield part.assign(declination=d, inclination=i, total=f)

    schema = T.StructType([*points.schema.fields]).add("declination", "double").add("inclination", "double").add("total", "double")
    return points.mapInPandas(run, schema)
