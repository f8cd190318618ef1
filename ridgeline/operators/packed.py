"""Grids packed into bytes for browsers: quantised channels and bit flags, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = 255


def byte(value: Column, missing: int = 0) -> Column:
    """Rounded and held within 0 to 255."""
    return F.coalesce(F.least(F.greatest(F.round(value), F.lit(0)), F.lit(255)).cast("int"), F.lit(missing))


def pack(cells: DataFrame) -> DataFrame:
    """Channels a, b, c, d of three bytes each from slope, aspect, cover, landform, first_sun, sun_hours, snow_day, walk_hours, seen, glass, n_seen, shelter, tpi300, tpi2000."""
    c = F.col
    flags = (
        F.when(c("seen") == 1, 1).otherwise(0)
        .bitwiseOR(F.when(c("seen").isNotNull(), 2).otherwise(0))
        .bitwiseOR(F.when(c("n_seen").isNotNull(), 4).otherwise(0))
        .bitwiseOR(F.shiftleft(F.least(F.coalesce(c("n_seen"), F.lit(0)), F.lit(15)).cast("int"), 4))
    )
    return cells.select(
        "y", "x",
        byte(c("slope") * 2).alias("a_r"), F.when(c("slope") < 2, NONE).otherwise(byte(c("aspect") / 1.5, NONE)).alias("a_g"), byte(c("cover")).alias("a_b"),
        byte(c("landform")).alias("b_r"), byte((c("first_sun") - 4) * 12, NONE).alias("b_g"), byte(c("sun_hours") * 16).alias("b_b"),
        byte(c("snow_day")).alias("c_r"), byte(c("walk_hours") * 60 / 3, NONE).alias("c_g"), flags.alias("c_b"),
        F.when(c("shelter").isNull(), 0).otherwise(byte(c("shelter") * 4 + 128)).alias("d_r"), byte(c("tpi300") * 32 + 128).alias("d_g"), byte(c("tpi2000") * 32 + 128).alias("d_b"),
    )


def unpack(packed: DataFrame) -> DataFrame:
    c = F.col
    known = lambda name, value, missing=NONE: F.when(c(name) != missing, value)
    return packed.select(
        "y", "x",
        (c("a_r") / 2).alias("slope"), known("a_g", c("a_g") * 1.5).alias("aspect"), c("a_b").alias("cover"), c("b_r").alias("landform"),
        known("b_g", c("b_g") / 12 + 4).alias("first_sun"), (c("b_b") / 16).alias("sun_hours"), c("c_r").alias("snow_day"), known("c_g", c("c_g") * 3 / 60).alias("walk_hours"),
        F.when(c("c_b").bitwiseAND(F.lit(2)) != 0, c("c_b").bitwiseAND(F.lit(1))).alias("seen"), F.when(c("c_b").bitwiseAND(F.lit(4)) != 0, F.shiftright("c_b", 4)).alias("n_seen"),
        known("d_r", (c("d_r") - 128) / 4, 0).alias("shelter"), ((c("d_g") - 128) / 32).alias("tpi300"), ((c("d_b") - 128) / 32).alias("tpi2000"),
    )


def pack_height(z: Column) -> tuple[Column, Column, Column]:
    """Three bytes r, g, b of r * 256 + g + b / 256 - 32768."""
    raw = F.round((z + 32768) * 256).cast("long")
    return F.shiftright(raw, 16).cast("int"), (F.floor(raw / 256) % 256).cast("int"), (raw % 256).cast("int")


def unpack_height(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256.0 - 32768
