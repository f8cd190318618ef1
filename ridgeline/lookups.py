"""Small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of land-cover codes; other codes are "Other".
COVER = ((1, "Conifer forest"), (2, "Conifer forest"), (5, "Deciduous forest"), (6, "Mixed forest"), (8, "Shrub"), (10, "Grass and alpine tundra"), (11, "Shrub"), (12, "Grass and alpine tundra"), (13, "Rock and bare ground"), (14, "Wetland"), (16, "Rock and bare ground"), (17, "Built or disturbed"), (18, "Water"), (19, "Snow and ice"))
#: Codes of ground that is not open.
CLOSED = (0, 1, 2, 5, 6, 18)
#: Landform classes 1 to 10.
LANDFORMS = ("Deep gully or canyon", "Draw on a slope", "Headwater basin", "Valley floor", "Flat", "Open slope", "Upper slope or bench", "Knoll in a valley", "Spur or small ridge", "Summit or main ridge")
#: WMO weather codes in words; other codes are "Mixed".
WEATHER = ((0, "Clear"), (1, "Mostly clear"), (2, "Partly cloudy"), (3, "Overcast"), (45, "Fog"), (48, "Fog"), (51, "Drizzle"), (53, "Drizzle"), (55, "Drizzle"), (56, "Freezing drizzle"), (57, "Freezing drizzle"), (61, "Light rain"), (63, "Rain"), (65, "Heavy rain"), (66, "Freezing rain"), (67, "Freezing rain"), (71, "Light snow"), (73, "Snow"), (75, "Heavy snow"), (77, "Snow grains"), (80, "Rain showers"), (81, "Rain showers"), (82, "Rain showers"), (85, "Snow showers"), (86, "Snow showers"), (95, "Thunderstorm"), (96, "Thunderstorm, hail"), (99, "Thunderstorm, hail"))
#: Road kinds and their cost for a metre, in tenths.
ROAD_COST = (("highway", 10), ("gravel", 16), ("track", 40))
#: Forest codes of the treeline.
FOREST = (1, 2, 6)


def cover_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COVER), "code int, name string").withColumn("open", ~F.col("code").isin(*CLOSED))


def weather_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(WEATHER), "code int, words string")


def landform_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(LANDFORMS, 1)), "id int, name string")


def road_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ROAD_COST), "kind string, tenths int")


def with_lookup(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on a fixed small table, which is broadcast; unmatched rows get the defaults."""
    out = df.join(F.broadcast(lookup), df[key] == lookup[lookup_key], "left").drop(lookup[lookup_key])
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def chain(value: Column, steps: list[tuple[float, object]], default: object) -> Column:
    """The value of the last step that ``value`` reaches."""
    out = F.lit(default)
    for edge, result in steps:
        out = F.when(value >= edge, F.lit(result)).otherwise(out)
    return out
