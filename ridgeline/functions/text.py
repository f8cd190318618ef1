"""Numbers, names and colours as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dms(value: Column, positive: str, negative: str) -> Column:
    """Degrees, minutes and tenths of seconds."""
    tenths = F.round(F.abs(value) * 36000).cast("long")
    return F.format_string("%d°%02d'%04.1f\" %s", F.floor(tenths / 36000), F.floor(tenths / 600) % 60, (tenths % 600) / 10.0, F.when(value >= 0, positive).otherwise(negative))


def utm_text(zone: Column, easting: Column, northing: Column) -> Column:
    return F.format_string("%dN %d %d", zone, F.round(easting).cast("long"), F.round(northing).cast("long"))


def thousands(value: Column) -> Column:
    return F.format_number(F.round(value), 0)


def percent(share: Column) -> Column:
    return F.concat(F.round(share * 100).cast("long").cast("string"), F.lit("%"))


def title_case(text: Column) -> Column:
    return F.initcap(F.lower(text))


def hours_minutes(hours: Column) -> Column:
    """h:mm of the day."""
    minutes = F.round(F.pmod(hours, F.lit(24.0)) * 60).cast("long")
    return F.format_string("%d:%02d", F.floor(minutes / 60) % 24, minutes % 60)


def hours_about(hours: Column) -> Column:
    """Hours and minutes, to five minutes."""
    minutes = (F.round(hours * 12) * 5).cast("long")
    return F.when(minutes < 60, F.format_string("%d min", minutes)).otherwise(F.format_string("%d h %02d min", F.floor(minutes / 60), minutes % 60))


def html_escape(text: Column) -> Column:
    out = text
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def hex_channels(colour: Column) -> Column:
    """[r, g, b] as 0 to 255 of '#rrggbb'."""
    return F.array(*(F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("int") for i in range(3)))


def mix_channels(a: Column, b: Column, share: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * share)
