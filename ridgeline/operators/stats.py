"""Shares, histograms, climate weeks, roses and lookups over cell and day tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """Rows and share of each group; groups are few, so the total is a window over them."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def height_bands(grid: DataFrame, value: str, band: int = 100) -> DataFrame:
    return shares(grid.where(F.col(value).isNotNull()).withColumn("band", (F.floor(F.col(value) / band) * band).cast("int")), "band")


def sector8(degrees: Column) -> Column:
    """0 north to 7 north-west."""
    return (F.floor((degrees + 22.5) / 45) % 8).cast("int")


def aspect_shares(grid: DataFrame, slope: str = "slope", aspect: str = "aspect", least: float = 5.0) -> DataFrame:
    """Shares of the 8 sectors among cells of at least ``least`` degrees; empty sectors are 0."""
    counts = grid.where(F.round(slope, 9) >= least).groupBy(sector8(F.round(aspect, 9)).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    every = grid.sparkSession.range(8).select(F.col("id").cast("int").alias("sector"))
    full = every.join(counts, "sector", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("share", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))


def slope_class(slope: Column) -> Column:
    """0 to 4 at 10, 20, 30 and 40 degrees."""
    return sum((F.round(slope, 9) >= edge).cast("int") for edge in (10, 20, 30, 40))


#: Parts that a range of values is cut into at a time.
BINS = 4096


def at_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The value at trunc(n * share) of the ascending order, as one row; null where there is none.

    The range of values is cut into bins, rows are counted by bin, and the bin that holds the rank is cut again until it holds one value. A bin's number never falls where the
    value rises, so this is exact; a few passes over the rows, of which the driver sees the bins' counts, and no window over them.
    """
    spark = df.sparkSession
    kind = df.select(value).schema[0].dataType
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_kept"), v.alias("_v"))
    low, high, n = rows.agg(F.min("_v"), F.max("_v"), F.count(F.lit(1))).first()
    rank = int(n * share)
    if rank >= n:
        return spark.range(1).select(F.lit(None).cast(kind).alias(value))
    while low < high:
        width = F.lit((high - low) / BINS or high - low)
        bins = rows.where(F.col("_v").between(low, high)).groupBy(F.least(F.floor((F.col("_v") - low) / width), F.lit(BINS)).alias("_bin")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: r["_bin"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        if (r["low"], r["high"]) == (low, high):  # neighbouring numbers that no division keeps apart
            return rows.where(F.col("_v") > low).agg(F.min("_kept").alias(value)) if rank >= rows.where(F.col("_v") == low).count() else rows.where(F.col("_v") == low).agg(F.min("_kept").alias(value))
        low, high = r["low"], r["high"]
    return rows.where(F.col("_v") == low).agg(F.min("_kept").alias(value))


def first_highest(grid: DataFrame, value: str) -> DataFrame:
    """The highest cell, the first in row-major order of equals."""
    best = grid.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("y")).alias("ny"), (-F.col("x")).alias("nx"))).alias("_b"))
    return best.select((-F.col("_b.ny")).alias("y"), (-F.col("_b.nx")).alias("x"), F.col("_b.v").alias(value))


def mean_aspect(cells: DataFrame) -> DataFrame:
    """Slope and aspect of the sum of the normals."""
    total = cells.agg(F.sum("nx").alias("_x"), F.sum("ny").alias("_y"), F.sum("nz").alias("_z"))
    flat = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    return total.select(F.degrees(F.atan2(flat, F.col("_z"))).alias("slope"), ((F.degrees(F.atan2("_x", "_y")) + 360) % 360).alias("aspect"))


def modal(df: DataFrame, name: str) -> DataFrame:
    """The most frequent value; of equals the last by name."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max(F.struct("n", name)).alias("_m")).select(f"_m.{name}", "_m.n")


def snow_median(layers: DataFrame, most_uncertain: float = 15.0, least_winters: int = 3, shift: float = 122.0) -> DataFrame:
    """y, x, day, winters: per cell the upper median of the winters' first snow, where enough of them are certain."""
    sure = layers.where(F.col("first").isNotNull() & (F.col("unc") <= most_uncertain))
    each = sure.groupBy("y", "x").agg(F.sort_array(F.collect_list("first")).alias("_v")).where(F.size("_v") >= least_winters)
    return each.select("y", "x", (F.element_at("_v", F.floor(F.size("_v") / 2).cast("int") + 1) + shift).alias("day"), F.size("_v").alias("winters"))


def climate_weeks(days: DataFrame, weeks: int = 13) -> DataFrame:
    """Thirteen weeks from 1 September over all years: means, extremes, shares of days with snow and rain. Rows need a maximum temperature."""
    off = F.datediff("date", F.make_date(F.year("date"), F.lit(9), F.lit(1)))
    at = days.where("tmax IS NOT NULL").withColumn("_o", off).where((F.col("_o") >= 0) & (F.col("_o") < 7 * weeks))
    share = lambda c, least: F.avg((F.col(c) >= least).cast("int"))
    return at.groupBy(F.floor(F.col("_o") / 7).cast("int").alias("week")).agg(
        F.avg("tmax").alias("tmax"), F.avg("tmin").alias("tmin"), F.max("tmax").alias("warmest"), F.min("tmin").alias("coldest"), F.avg("gust").alias("gust"), F.max("gust").alias("top_gust"),
        share("snow", 1.0).alias("snow_share"), share("precip", 1.0).alias("wet_share"), F.count(F.lit(1)).alias("n"),
    )


def wind_rose(days: DataFrame) -> DataFrame:
    """Share of days and mean speed by sector, 15 September to 30 November."""
    day = F.month("date") * 100 + F.dayofmonth("date")
    kept = days.where("dir IS NOT NULL").where(day.between(915, 1130)).withColumn("sector", sector8(F.col("dir")))
    rose = kept.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.avg("wind").alias("mean_wind"))
    return rose.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def prevailing(rose: DataFrame) -> DataFrame:
    """Direction of the sector with most days, the last of equals."""
    return rose.agg(F.max(F.struct("n", "sector")).alias("_m")).select((F.col("_m.sector") * 45).alias("degrees"))


def forecast_rollup(days: DataFrame) -> DataFrame:
    """Snow of the first four days, least temperature and top gust of the first seven."""
    w = Window.orderBy("date")
    n = days.orderBy("date").limit(7).withColumn("_i", F.row_number().over(w))
    return n.agg(F.sum(F.when(F.col("_i") <= 4, F.col("snow"))).alias("snow4"), F.min("tmin").alias("tmin7"), F.max("gust").alias("gust7"))


def day_text(snow: Column, rain: Column) -> Column:
    return F.when(snow >= 0.1, F.concat(F.lit("Snow "), F.round(snow, 1).cast("string"), F.lit(" cm"))).when(rain >= 0.1, F.concat(F.lit("Rain "), F.round(rain, 1).cast("string"), F.lit(" mm"))).otherwise("Dry")


def latest_not_after(df: DataFrame, order: str, value: Column) -> DataFrame:
    """The last row not after a value, else the first one."""
    before = F.when(F.col(order) <= value, F.col(order))
    return df.join(F.broadcast(df.agg(F.coalesce(F.max(before), F.min(order)).alias("_at"))), F.col(order) == F.col("_at")).drop("_at")


def chosen_scenes(scenes: DataFrame, tiles: list[str], least: int = 8) -> DataFrame:
    """Days newest first from the first that has every tile; of each all scenes by cloud, until at least ``least`` stand in the list.

    The days taken are among the ``least`` newest, as each has a scene, so only those are counted along; scenes are ranked within their day.
    """
    known = scenes.where(F.col("tile").isin(*tiles))
    whole = known.groupBy("day").agg(F.countDistinct("tile").alias("_k")).where(F.col("_k") == len(tiles)).agg(F.max("day").alias("_start"))
    sizes = known.join(F.broadcast(whole)).where("day <= _start").groupBy("day").agg(F.count(F.lit(1)).alias("_n"))
    newest = sizes.orderBy(F.desc("day")).limit(least)
    run = newest.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = known.join(F.broadcast(run.where(F.col("_before") < least)), "day")
    return taken.withColumn("rank", (F.col("_before") + F.row_number().over(Window.partitionBy("day").orderBy("cloud", "id"))).cast("int")).drop("_n", "_before")


def nice_step(span: Column, target: int) -> Column:
    """1, 2, 5 or 10 times a power of ten that cuts a span into about ``target`` parts."""
    raw = span / target
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = F.round(raw / power, 9)
    return power * F.when(lead <= 1, 1).when(lead <= 2, 2).when(lead <= 5, 5).otherwise(10)


def describe(df: DataFrame, key: str, facts: list[tuple[str, Column, Column]]) -> DataFrame:
    """Unpivot: (key, seq, name, value, note) of named facts; null values are left out."""
    rows = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(name).alias("name"), value.cast("string").alias("value"), note.cast("string").alias("note")) for i, (name, value, note) in enumerate(facts)))
    return df.select(key, F.explode(rows).alias("_f")).select(key, "_f.seq", "_f.name", "_f.value", "_f.note").where("value IS NOT NULL")
