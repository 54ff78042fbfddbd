"""The county nitrogen panel: pixels of all years in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitraflow.operators.county import NON_CONUS, exclude, lookup
from nitraflow.operators.geo import zonal_stats
from nitraflow.operators.raster import PIXEL_HECTARES


def surplus_panel(pixels: DataFrame, edges: DataFrame, counties: DataFrame, states: DataFrame) -> DataFrame:
    """Mean, sum, total kg of nitrogen and pixel count per contiguous county and year. counties has
    GEOID, STATEFP, COUNTYFP, NAME, NAMELSAD; edges has GEOID as zone."""
    kept = exclude(counties, "STATEFP", NON_CONUS)
    stats = zonal_stats(pixels, edges, kept.withColumnRenamed("GEOID", "zone"))
    named = lookup(stats, states, "STATEFP", "STATE")
    return named.select(
        "year", F.col("zone").alias("GEOID"), "STATEFP", "STATE", "COUNTYFP", "NAME", "NAMELSAD", F.col("mean").alias("mean_surplus_kgha"), F.col("sum").alias("raw_sum"),
        (F.col("sum") * PIXEL_HECTARES).alias("total_kg_N"), F.col("count").alias("pixel_count"),
    )


def county_year_panel(base: DataFrame, *tables: DataFrame, keys: tuple[str, ...] = ("county", "year")) -> DataFrame:
    """base with the columns of further county-year tables; a county-year that one lacks keeps nulls."""
    for t in tables:
        base = base.join(t, list(keys), "left")
    return base
