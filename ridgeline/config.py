"""Parameters of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """A place, its boxes (west, south, east, north in degrees), heights in metres and the season looked at."""

    lon: float = -119.390728
    lat: float = 54.062707
    region: tuple[float, float, float, float] = (-119.85, 53.80, -118.95, 54.30)
    eye_m: float = 1.7
    target_m: float = 1.0
    season: tuple[str, str] = ("2026-09-28", "2026-11-30")
    cell_m: float = 30.0


#: Radii and constants that results depend on.
CURVATURE_RADIUS_M = 6_371_000.0
REFRACTION = 0.13
MEAN_RADIUS_M = 6_371_008.8
GRS80_A = 6_378_137.0
GRS80_F = 1 / 298.257222101
UTM_SCALE = 0.9996
METRES_PER_DEGREE_LON = 111_320.0
METRES_PER_DEGREE_LAT = 111_200.0
SUNRISE_ZENITH = 90.833
CIVIL_ZENITH = 96.0
SYNODIC_MONTH = 29.530588

CONFIG = EngineConfig()
