"""Calendar, sun and moon as Column expressions. Days are counted from 1970-01-01, hours are UTC unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CIVIL_ZENITH, SUNRISE_ZENITH, SYNODIC_MONTH


def days_of(date: Column) -> Column:
    return F.unix_date(date)


def date_of(days: Column) -> Column:
    return F.date_from_unix_date(days)


def weekday(date: Column) -> Column:
    return F.date_format(date, "EEE")


def date_long(date: Column) -> Column:
    return F.date_format(date, "EEE d MMM yyyy")


def date_short(date: Column) -> Column:
    return F.date_format(date, "d MMM")


def julian_day(days: Column, hours: Column) -> Column:
    return days + 2440587.5 + hours / 24


def _polynomial(t: Column, *coefficients: float) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = c + t * out
    return out


def sine(degrees: Column) -> Column:
    return F.sin(F.radians(degrees))


def cosine(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def solar(jd: Column) -> tuple[Column, Column]:
    """Declination in degrees and equation of time in minutes: the published low-precision almanac series."""
    t = (jd - 2451545) / 36525
    # fixed values: mean longitude, mean anomaly, eccentricity, node, obliquity
    longitude = F.pmod(_polynomial(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))
    anomaly = _polynomial(t, 357.52911, 35999.05029, -0.0001537)
    eccentricity = _polynomial(t, 0.016708634, -0.000042037, -0.0000001267)
    node = _polynomial(t, 125.04, -1934.136)
    centre = sine(anomaly) * _polynomial(t, 1.914602, -0.004817, -0.000014) + sine(2 * anomaly) * _polynomial(t, 0.019993, -0.000101) + sine(3 * anomaly) * 0.000289
    apparent = longitude + centre - 0.00569 - 0.00478 * sine(node)
    tilt = 23 + (26 + _polynomial(t, 21.448, -46.815, -0.00059, 0.001813) / 60) / 60 + 0.00256 * cosine(node)
    half = F.tan(F.radians(tilt / 2))
    y = half * half
    time = (
        y * sine(2 * longitude)
        - 2 * eccentricity * sine(anomaly)
        + 4 * eccentricity * y * sine(anomaly) * cosine(2 * longitude)
        - y * y * sine(4 * longitude) / 2
        - 1.25 * eccentricity * eccentricity * sine(2 * anomaly)
    )
    return F.degrees(F.asin(sine(tilt) * sine(apparent))), 4 * F.degrees(time)


def refraction(altitude: Column) -> Column:
    """Degrees that the air lifts the sun by; piecewise."""
    t = F.tan(F.radians(altitude))
    return (
        F.when(altitude > 85, 0.0)
        .when(altitude > 5, (58.1 / t - 0.07 / F.pow(t, F.lit(3)) + 0.000086 / F.pow(t, F.lit(5))) / 3600)
        .when(altitude > -0.575, _polynomial(altitude, 1735.0, -518.2, 103.4, -12.79, 0.711) / 3600)
        .otherwise(-20.774 / t / 3600)
    )


def sun_position(df: DataFrame, days: Column, hours: Column, lon: Column, lat: Column, refracted: bool = True) -> DataFrame:
    """The table with azimuth and altitude in degrees; steps are columns of their own, so that expressions stay small."""
    declination, time = solar(julian_day(days, hours))
    step = df.withColumns({"_decl": declination, "_eqt": time, "_hour": hours, "_lon": lon, "_lat": lat})
    step = step.withColumn("_ha", F.pmod(F.col("_hour") * 60 + F.col("_eqt") + 4 * F.col("_lon"), F.lit(1440.0)) / 4 - 180)
    cos_zenith = sine(F.col("_lat")) * sine(F.col("_decl")) + cosine(F.col("_lat")) * cosine(F.col("_decl")) * cosine(F.col("_ha"))
    step = step.withColumn("_alt", 90 - F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_zenith)))))
    turn = F.atan2(sine(F.col("_ha")), cosine(F.col("_ha")) * sine(F.col("_lat")) - F.tan(F.radians("_decl")) * cosine(F.col("_lat")))
    out = step.withColumn("azimuth", F.pmod(F.degrees(turn) + 180, F.lit(360.0)))
    out = out.withColumn("altitude", F.col("_alt") + refraction(F.col("_alt")) if refracted else F.col("_alt"))
    return out.drop("_decl", "_eqt", "_hour", "_lon", "_lat", "_ha", "_alt")


def sun_crossing(df: DataFrame, days: Column, lon: Column, lat: Column, zenith: float = SUNRISE_ZENITH, prefix: str = "", passes: int = 4) -> DataFrame:
    """The table with {prefix}rise, {prefix}set and {prefix}noon in UTC hours; null where the sun doesn't cross the zenith distance.

    The passes are steps of an aggregate, whose state is bound once, so the expression doesn't grow with their number.
    """
    off = {"rise": -1, "set": 1, "noon": 0}
    start = F.struct(*((12 - lon / 15 + 6.0 * o).alias(k) for k, o in off.items()), F.lit(True).alias("ok"))

    def refine(s: Column, _: Column) -> Column:
        found, reached = [], s["ok"]
        for k, o in off.items():
            declination, time = solar(julian_day(days, s[k]))
            cos_arc = (cosine(F.lit(zenith)) - sine(lat) * sine(declination)) / (cosine(lat) * cosine(declination))
            arc = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos_arc)))) / 15
            found.append(((720 - 4 * lon - time) / 60 + o * arc).alias(k))
            reached = reached & (F.abs(cos_arc) <= 1)
        return F.struct(*found, reached.alias("ok"))

    out = df.withColumn("_c", F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, refine))
    return out.withColumns({f"{prefix}{k}": F.when(F.col("_c.ok"), F.col(f"_c.{k}")) for k in off}).drop("_c")


def mountain_offset(date: Column) -> Column:
    """Hours from UTC: daylight time from the second Sunday of March to the first Sunday of November, by date."""
    first = lambda month: F.next_day(F.date_sub(F.make_date(F.year(date), F.lit(month), F.lit(1)), 1), "Sun")
    return F.when((date >= F.date_add(first(3), 7)) & (date < first(11)), -6.0).otherwise(-7.0)


def mountain_zone(date: Column) -> Column:
    return F.when(mountain_offset(date) == -6, "MDT").otherwise("MST")


#: Elongation, from which on, and name of the phase.
MOON_PHASES = ((11.25, "waxing crescent"), (78.75, "first quarter"), (101.25, "waxing gibbous"), (168.75, "full"), (191.25, "waning gibbous"), (258.75, "last quarter"), (281.25, "waning crescent"), (348.75, "new"))


def moon(days: Column, hours: Column) -> tuple[Column, Column, Column]:
    """Lit fraction, age in days and name of the phase."""
    t = (julian_day(days, hours) - 2451545) / 36525
    # fixed values: mean elongation, the sun's and the moon's mean anomaly
    d, m, a = (F.pmod(_polynomial(t, *c), F.lit(360.0)) for c in ((297.8501921, 445267.1114034), (357.5291092, 35999.0502909), (134.9633964, 477198.8675055)))
    pull = 6.289 * sine(a) - 2.1 * sine(m) + 1.274 * sine(2 * d - a) + 0.658 * sine(2 * d)
    angle = 180 - d - pull - 0.214 * sine(2 * a) - 0.11 * sine(d)
    elongation = F.pmod(d + pull, F.lit(360.0))
    name = F.lit("new")
    for start, word in MOON_PHASES:
        name = F.when(elongation >= start, word).otherwise(name)
    return (1 + cosine(angle)) / 2, elongation / 360 * SYNODIC_MONTH, name


def autumn_day(date: Column) -> Column:
    """Days after 31 August of the date's year."""
    return F.datediff(date, F.make_date(F.year(date), F.lit(8), F.lit(31)))


def day_table(df: DataFrame, lon: float, lat: float, date: str = "date") -> DataFrame:
    """Sunrise, sunset, legal light (half an hour more on both ends), civil twilight, clock zone and moon at local midnight, per date."""
    days = days_of(F.col(date))
    out = sun_crossing(df, days, F.lit(lon), F.lit(lat))
    out = sun_crossing(out, days, F.lit(lon), F.lit(lat), CIVIL_ZENITH, "civil_")
    out = out.withColumns({"offset": mountain_offset(F.col(date)), "zone": mountain_zone(F.col(date))})
    local = {c: F.col(c) + F.col("offset") for c in ("rise", "set", "noon", "civil_rise", "civil_set")}
    out = out.withColumns(local).drop("civil_noon").withColumns({"legal_from": F.col("rise") - 0.5, "legal_to": F.col("set") + 0.5})
    lit, age, name = moon(days, 24 - F.col("offset"))
    return out.withColumns({"moon_lit": lit, "moon_age": age, "moon_phase": name})
