"""Projections and geodesy as Column expressions; constants are computed on the driver and become literals."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GRS80_A, GRS80_F, MEAN_RADIUS_M, UTM_SCALE

E2 = GRS80_F * (2 - GRS80_F)
E1 = math.sqrt(E2)
COMPASS_16 = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
COMPASS_8_WORDS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")


def pick(words: tuple[str, ...], index: Column) -> Column:
    """The word at an index from 0."""
    return F.element_at(F.array(*map(F.lit, words)), index.cast("int") + 1)


@dataclass(frozen=True)
class Lcc:
    """Lambert conformal conic with two standard parallels on GRS80 (degrees); by default the Atlas of Canada grid."""

    lat0: float = 49.0
    lon0: float = -95.0
    south: float = 49.0
    north: float = 77.0

    def constants(self) -> tuple[float, float, float]:
        """Cone constant, scaled radius, radius of the origin."""

        def scale(lat: float) -> float:
            return math.cos(lat) / math.sqrt(1 - E2 * math.sin(lat) ** 2)

        def conformal(lat: float) -> float:
            s = E1 * math.sin(lat)
            return math.tan(math.pi / 4 - lat / 2) * ((1 + s) / (1 - s)) ** (E1 / 2)

        o, p, q = (math.radians(v) for v in (self.lat0, self.south, self.north))
        n = math.log(scale(p) / scale(q)) / math.log(conformal(p) / conformal(q))
        radius = GRS80_A * scale(p) / (n * conformal(p) ** n)
        return n, radius, radius * conformal(o) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, radius, origin = self.constants()
        phi = F.radians(lat)
        s = F.sin(phi) * E1
        t = F.tan(math.pi / 4 - phi / 2) * F.pow((1 + s) / (1 - s), F.lit(E1 / 2))
        rho = radius * F.pow(t, F.lit(n))
        turn = n * (F.radians(lon) - math.radians(self.lon0))
        return rho * F.sin(turn), origin - rho * F.cos(turn)

    def inverse(self, x: Column, y: Column, steps: int = 8) -> tuple[Column, Column]:
        """Fixed-point latitude; each step is nested through a one-element transform, so that the expression stays linear in size."""
        n, radius, origin = self.constants()
        dy = origin - y
        t = F.pow(F.signum(F.lit(n)) * F.sqrt(x * x + dy * dy) / radius, F.lit(1 / n))
        lon = F.degrees(F.atan2(x, dy) / n) + self.lon0
        sharpen = lambda phi, _: math.pi / 2 - 2 * F.atan(t * F.pow((1 - E1 * F.sin(phi)) / (1 + E1 * F.sin(phi)), F.lit(E1 / 2)))
        lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), math.pi / 2 - 2 * F.atan(t), sharpen)
        return lon, F.degrees(lat)


#: Krueger's series to the sixth order in the third flattening; rows are coefficients of n, n^2, ... n^6.
KRUEGER_FORWARD = (
    ("1/2", "-2/3", "5/16", "41/180", "-127/288", "7891/37800"),
    ("0", "13/48", "-3/5", "557/1440", "281/630", "-1983433/1935360"),
    ("0", "0", "61/240", "-103/140", "15061/26880", "167603/181440"),
    ("0", "0", "0", "49561/161280", "-179/168", "6601661/7257600"),
    ("0", "0", "0", "0", "34729/80640", "-3418889/1995840"),
    ("0", "0", "0", "0", "0", "212378941/319334400"),
)
KRUEGER_INVERSE = (
    ("1/2", "-2/3", "37/96", "-1/360", "-81/512", "96199/604800"),
    ("0", "1/48", "1/15", "-437/1440", "46/105", "-1118711/3870720"),
    ("0", "0", "17/480", "-37/840", "-209/4480", "5569/90720"),
    ("0", "0", "0", "4397/161280", "-11/504", "-830251/7257600"),
    ("0", "0", "0", "0", "4583/161280", "-108847/3991680"),
    ("0", "0", "0", "0", "0", "20648693/638668800"),
)
THIRD_FLATTENING = GRS80_F / (2 - GRS80_F)


def krueger(table: tuple[tuple[str, ...], ...]) -> list[float]:
    return [math.fsum(float(Fraction(c)) * THIRD_FLATTENING ** (p + 1) for p, c in enumerate(row)) for row in table]


def rectifying_radius() -> float:
    n2 = THIRD_FLATTENING**2
    return GRS80_A / (1 + THIRD_FLATTENING) * (1 + n2 / 4 + n2**2 / 64 + n2**3 / 256)


def utm_zone(lon: Column) -> Column:
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def _sums(xi: Column, eta: Column, table) -> tuple[Column, Column]:
    """Series terms of northing and easting."""
    y = x = F.lit(0.0)
    for j, c in enumerate(krueger(table), 1):
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return y, x


def utm_forward(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing in metres, northern hemisphere."""
    turn = F.radians(lon) - math.radians(6 * zone - 183)
    tau = F.tan(F.radians(lat))
    root = F.sqrt(1 + tau * tau)
    sigma = F.sinh(E1 * F.atanh(E1 * tau / root))
    conformal = tau * F.sqrt(1 + sigma * sigma) - sigma * root
    xi, eta = F.atan2(conformal, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(conformal * conformal + F.cos(turn) * F.cos(turn)))
    y, x = _sums(xi, eta, KRUEGER_FORWARD)
    radius = UTM_SCALE * rectifying_radius()
    return 500_000 + radius * (eta + x), radius * (xi + y)


def utm_inverse(easting: Column, northing: Column, zone: int, steps: int = 8) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; the latitude by Newton steps from the conformal one."""
    radius = UTM_SCALE * rectifying_radius()
    xi, eta = northing / radius, (easting - 500_000) / radius
    y, x = _sums(xi, eta, KRUEGER_INVERSE)
    xi, eta = xi - y, eta - x
    aim = F.sin(xi) / F.sqrt(F.sinh(eta) * F.sinh(eta) + F.cos(xi) * F.cos(xi))

    def newton(tau: Column, _: Column) -> Column:
        root = F.sqrt(1 + tau * tau)
        sigma = F.sinh(E1 * F.atanh(E1 * tau / root))
        off = tau * F.sqrt(1 + sigma * sigma) - sigma * root - aim
        slope = (F.sqrt(1 + sigma * sigma) * root - sigma * tau) * (1 - E2) * root / (1 + (1 - E2) * tau * tau)
        return tau - off / slope

    tau = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), aim, newton)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (6 * zone - 183), F.degrees(F.atan(tau))


def grid_convergence(lon: Column, lat: Column, zone: int) -> Column:
    """Degrees from true to grid north, east positive."""
    return F.degrees(F.atan(F.tan(F.radians(lon) - math.radians(6 * zone - 183)) * F.sin(F.radians(lat))))


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    return GRS80_A * F.radians(lon), GRS80_A * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / GRS80_A), F.degrees(2 * F.atan(F.exp(y / GRS80_A)) - math.pi / 2)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    across, up = F.sin(F.radians(lon2 - lon1) / 2), F.sin(F.radians(lat2 - lat1) / 2)
    return 2 * MEAN_RADIUS_M * F.asin(F.sqrt(up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    turn, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    east = F.sin(turn) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def compass16(degrees: Column) -> Column:
    return pick(COMPASS_16, F.floor((degrees % 360 + 11.25) / 22.5) % 16)


def compass8_word(degrees: Column) -> Column:
    return pick(COMPASS_8_WORDS, F.floor((degrees % 360 + 22.5) / 45) % 8)


def magnetic_bearing(true: Column, declination: Column) -> Column:
    return (true - declination + 360) % 360


@dataclass(frozen=True)
class View:
    """A north-up Web Mercator grid over a box. Cells are a little off square: the box is kept and the pixels give way."""

    west: float
    south: float
    east: float
    north: float
    width: int
    height: int

    @classmethod
    def of_box(cls, box: tuple[float, float, float, float], ground_m: float) -> View:
        """The grid whose cells are about ``ground_m`` on the ground at the middle latitude."""
        west, south, east, north = box
        x0, x1 = (GRS80_A * math.radians(v) for v in (west, east))
        y0, y1 = (GRS80_A * math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (south, north))
        cell = ground_m / math.cos(math.radians((south + north) / 2))
        return cls(west, south, east, north, round((x1 - x0) / cell), round((y1 - y0) / cell))

    def _frame(self) -> tuple[float, float, float, float]:
        """Left, top, cell width and cell height in Mercator metres."""
        x0, x1 = (GRS80_A * math.radians(v) for v in (self.west, self.east))
        y0, y1 = (GRS80_A * math.log(math.tan(math.pi / 4 + math.radians(v) / 2)) for v in (self.south, self.north))
        return x0, y1, (x1 - x0) / self.width, (y1 - y0) / self.height

    def pixel(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        x, y = mercator_forward(lon, lat)
        x0, y1, dx, dy = self._frame()
        return (x - x0) / dx, (y1 - y) / dy

    def lonlat(self, px: Column, py: Column) -> tuple[Column, Column]:
        x0, y1, dx, dy = self._frame()
        return mercator_inverse(x0 + px * dx, y1 - py * dy)

    def ground_metres(self, row: Column) -> Column:
        """Ground size of a cell of a row, at the row's middle."""
        _, y1, dx, dy = self._frame()
        lat = 2 * F.atan(F.exp((y1 - (row + 0.5) * dy) / GRS80_A)) - math.pi / 2
        return dx * F.cos(lat)
