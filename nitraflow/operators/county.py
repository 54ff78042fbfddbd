"""County tables: areas, fertilizer, intensities, lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitraflow.functions.scalars import area_km2, share_of_area, year_in

YEARS = tuple(range(1987, 2022, 5))
#: State codes outside the contiguous states.
NON_CONUS = ("02", "15", "60", "66", "69", "72", "78")
#: State code and postal abbreviation of the contiguous states.
STATES = {
    "01": "AL", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA",
    "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA",
    "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM",
    "36": "NY", "37": "NC", "38": "ND", "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD",
    "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI", "56": "WY",
}


def state_table(spark) -> DataFrame:
    """STATEFP and STATE of the contiguous states."""
    return spark.createDataFrame(list(STATES.items()), "STATEFP string, STATE string")


def county_areas(geo: DataFrame, farms: DataFrame, *extra: DataFrame) -> DataFrame:
    """geo (FIPS, ALAND, AWATER) with farms and further tables by FIPS, areas in km2 and farm and crop areas."""
    out = geo.join(farms, "FIPS")
    for table in extra:
        out = out.join(table, "FIPS")
    land = area_km2(F.col("ALAND"))
    return out.withColumn("area_land_km2", land).withColumn("area_water_km2", area_km2(F.col("AWATER"))).withColumn("farm_area_km2", share_of_area(land, F.col("farm_acre_as_percent"))).withColumn("crop_area_km2", share_of_area(land, F.col("crop_acre_as_percent")))


def county_characteristics(population: DataFrame, poverty: DataFrame, unemployment: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The three tables by FIPS, and of them the named columns."""
    out = population.join(poverty, "FIPS").join(unemployment, "FIPS")
    return out.select(*columns) if columns else out


def leading_columns(df: DataFrame, key: str, n: int) -> DataFrame:
    """The key and the first n other columns."""
    return df.select(key, *[c for c in df.columns if c != key][:n])


def combine_fertilizer(total: DataFrame, farm: DataFrame, nonfarm: DataFrame, years: Sequence[int] = YEARS, key: str = "fips-int", prefixes: tuple[str, str, str] = ("tot-fertN-kg-", "farmfertN-kg-", "nonffertN-kg-")) -> DataFrame:
    """total with farm plus non-farm nitrogen per year, where both tables have the county; else null."""
    whole, a, b = prefixes
    sums = farm.select(key, *[F.col(f"`{a}{y}`") for y in years]).join(nonfarm.select(key, *[F.col(f"`{b}{y}`") for y in years]), key)
    sums = sums.select(key, *[(F.col(f"`{a}{y}`") + F.col(f"`{b}{y}`")).alias(f"{whole}{y}") for y in years])
    return total.join(sums, key, "left")


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def intensity(farm: DataFrame, county: DataFrame, years: Sequence[int] = YEARS, key: str = "STCOFIPS", source: str = "farmfertN-kg-", out: str = "nitrogen_kg_km_sq_") -> DataFrame:
    """farm with nitrogen per km2 of land for each year; null where the area is 0."""
    joined = farm.join(county, key)
    return joined.select("*", *[F.try_divide(F.col(f"`{source}{y}`"), F.col("area_land_km2")).alias(f"{out}{y}") for y in years])


def intensity_long(df: DataFrame, ids: Sequence[str], prefix: str = "nitrogen_kg_km_sq_", value: str = "nitrogen_kg_km_sq") -> DataFrame:
    """One row per id and year; nulls stay."""
    wide = [c for c in df.columns if c.startswith(prefix)]
    return df.unpivot(list(ids), wide, "year", value).withColumn("year", year_in(F.col("year")))


def value_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("vmin"), F.max(column).alias("vmax"))


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: Column | None = None) -> DataFrame:
    """df with dim's value by key; where it is missing, the default. dim has one row per key; Spark
    broadcasts it if it is small."""
    joined = df.join(dim.select(on, value), on, "left")
    return joined if default is None else joined.withColumn(value, F.coalesce(value, default))


def exclude(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value isn't listed; a null value isn't."""
    return df.where(F.coalesce(~F.col(column).isin(*values), F.lit(True)))
