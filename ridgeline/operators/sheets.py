"""Map sheets: where the lines of a metric grid cross the frame of a sheet, and their labels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import UTM_SCALE
from ..functions.geodesy import E1, KRUEGER_FORWARD, _sums, rectifying_radius

#: Halvings of a frame's edge.
HALVINGS = 40
#: Steps under which every second line of a crowded sheet is left out, and how many lines make it crowded.
FINE_STEP, CROWDED = 5000.0, 16.0


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is worked out once: in lambdas, expressions that stand twice are worked out twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _utm(lon: Column, lat: Column, zone: int, northing: bool) -> Column:
    """Easting or northing as in geodesy.utm_forward, step by step."""
    radius = UTM_SCALE * rectifying_radius()

    def metres(p: Column) -> Column:
        y, x = _sums(p["xi"], p["eta"], KRUEGER_FORWARD)
        return radius * (p["xi"] + y) if northing else 500_000 + radius * (p["eta"] + x)

    def angles(conformal: Column, turn: Column) -> Column:
        return F.struct(F.atan2(conformal, F.cos(turn)).alias("xi"), F.asinh(F.sin(turn) / F.sqrt(conformal * conformal + F.cos(turn) * F.cos(turn))).alias("eta"))

    def from_tau(tau: Column, turn: Column) -> Column:
        root = F.sqrt(1 + tau * tau)
        return _let(F.sinh(E1 * F.atanh(E1 * tau / root)), lambda sigma: _let(tau * F.sqrt(1 + sigma * sigma) - sigma * root, lambda c: _let(angles(c, turn), metres)))

    return _let(F.radians(lon) - math.radians(6 * zone - 183), lambda turn: _let(F.tan(F.radians(lat)), lambda tau: from_tau(tau, turn)))


def _crossing(northing: bool, first: Column, last: Column, at: Column, aim: Column, zone: int) -> Column:
    """Where on an edge the easting (of a parallel, walked by longitude) or northing (of a meridian, by latitude) is ``aim``; null if that isn't between the edge's ends."""

    def off(c: Column) -> Column:
        return (_utm(at, c, zone, True) if northing else _utm(c, at, zone, False)) - aim

    def halve(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2
        # the first end keeps its side
        return _let(F.signum(off(middle)) * s["here"] <= 0, lambda beyond: F.struct(F.when(beyond, s["a"]).otherwise(middle).alias("a"), F.when(beyond, middle).otherwise(s["b"]).alias("b"), s["here"].alias("here")))

    def walk(here: Column) -> Column:
        ends = F.struct(first.cast("double").alias("a"), last.cast("double").alias("b"), here.alias("here"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), ends, halve, lambda s: (s["a"] + s["b"]) / 2)
        return F.when(here * F.signum(off(last)) <= 0, found)

    return _let(F.signum(off(first)), walk)


def grid_ticks(sheets: DataFrame, zone: int, key: str = "sheet") -> DataFrame:
    """sheet, axis (E or N), metres, edge (S, N, W or E), lon, lat, small, principal: where grid lines meet the frames of sheets (sheet, west, south, east, north, step).

    Lines are multiples of the step between the least and largest corner, every second one where there are many of a fine step. A crossing is found by halving the edge; lines that
    don't cross an edge have no row for it. Labels are the hundreds of kilometres and the two digits below, with a nought.
    """
    corners = sheets.select(key, F.explode(F.array(*(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for x in ("west", "east") for y in ("south", "north")))).alias("_c"))
    spans = {axis: _utm(F.col("_c.x"), F.col("_c.y"), zone, axis == "N") for axis in ("E", "N")}
    ends = corners.select(key, *(c.alias(axis) for axis, c in spans.items())).groupBy(key).agg(*(f(axis).alias(f"_{axis}{end}") for axis in spans for end, f in (("lo", F.min), ("hi", F.max))))
    framed = sheets.join(ends, key)
    lines = [framed.withColumns({"_lo": F.floor(F.col(f"_{axis}lo") / F.col("step")).cast("long"), "_hi": F.ceil(F.col(f"_{axis}hi") / F.col("step")).cast("long"), "axis": F.lit(axis)}) for axis in spans]
    # how many lines there are is asked of the eastings, for both axes
    dense = lines[0].select(key, F.when((F.col("step") < FINE_STEP) & (F.col("_hi") - F.col("_lo") > CROWDED), 2).otherwise(1).alias("_every"))
    each = lines[0].unionByName(lines[1]).join(dense, key).withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).where((F.col("_k") - F.col("_lo")) % F.col("_every") == 0)
    each = each.withColumn("metres", F.col("_k") * F.col("step"))
    west, south, east, north = (F.col(c).cast("double") for c in ("west", "south", "east", "north"))
    sides = {"E": (("S", south, west, east), ("N", north, west, east)), "N": (("W", west, south, north), ("E", east, south, north))}
    edges = {axis: F.array(*(F.struct(F.lit(name).alias("edge"), at.alias("at"), a.alias("a"), b.alias("b")) for name, at, a, b in found)) for axis, found in sides.items()}
    on = each.select(key, "axis", "metres", F.explode(F.when(F.col("axis") == "E", edges["E"]).otherwise(edges["N"])).alias("_e"))
    out = []
    for axis, northing in (("E", False), ("N", True)):
        spot = _crossing(northing, F.col("_e.a"), F.col("_e.b"), F.col("_e.at"), F.col("metres"), zone)
        found = on.where(F.col("axis") == axis).select(key, "axis", "metres", F.col("_e.edge").alias("edge"), F.col("_e.at").alias("_at"), spot.alias("_spot")).where("_spot IS NOT NULL")
        out.append(found.select(key, "axis", "metres", "edge", F.col("_at" if northing else "_spot").alias("lon"), F.col("_spot" if northing else "_at").alias("lat")))
    ticks = out[0].unionByName(out[1])
    km = F.round(F.col("metres") / 1000).cast("long")
    return ticks.select("*", F.floor(km / 100).cast("string").alias("small"), F.lpad((km % 100).cast("string"), 2, "0").alias("principal"))
