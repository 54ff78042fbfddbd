"""The soil survey hierarchy: map units, components, horizons, crops, restrictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitraflow.operators.geo import point_in_zone


def map_units_by_area(mapunit: DataFrame, muaggatt: DataFrame, legend: DataFrame, like: str) -> DataFrame:
    """Map units of the legends whose area symbol matches, with their aggregated attributes."""
    areas = legend.where(F.col("areasymbol").like(like))
    return mapunit.join(areas, "lkey").join(muaggatt, "mukey")


def interpretation_names(cointerp: DataFrame, component: DataFrame, mapunit: DataFrame, legend: DataFrame, like: str) -> DataFrame:
    """The distinct interpretation names of an area, in order."""
    areas = legend.where(F.col("areasymbol").like(like)).select("lkey")
    keys = component.join(mapunit.join(areas, "lkey").select("mukey"), "mukey").select("cokey")
    return cointerp.join(keys, "cokey", "left_semi").select("mrulename").distinct().orderBy("mrulename")


def map_unit_of_points(points: DataFrame, edges: DataFrame, point: str = "point_id") -> DataFrame:
    """points with mukey: the smallest map unit that holds the point, null if none does. edges has mukey as zone."""
    hits = point_in_zone(points, edges, point=point).groupBy(point).agg(F.min("zone").alias("mukey"))
    return points.join(hits, point, "left")


def children(keys: DataFrame, component: DataFrame, child: DataFrame) -> DataFrame:
    """The rows of a component's child table for all map units in keys (mukey)."""
    return component.join(keys.select("mukey").distinct(), "mukey", "left_semi").join(child, "cokey")


def soil_profile(points: DataFrame, edges: DataFrame, component: DataFrame, crops: DataFrame, horizons: DataFrame, restrictions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(crops, horizons, restrictions) of the map units below the points, for all points at once."""
    keys = map_unit_of_points(points, edges).where("mukey is not null")
    return tuple(children(keys, component, t) for t in (crops, horizons, restrictions))


def crop_yield_summary(crops: DataFrame) -> DataFrame:
    """Per crop: the smallest unit, and the sums of both yields; text that isn't a number counts as missing."""
    amount = lambda c: F.coalesce(F.sum(F.col(c).try_cast("double")), F.lit(0.0)).alias(c)
    return crops.where("cropname is not null").groupBy("cropname").agg(F.min("yldunits").alias("yldunits"), amount("nonirryield_r"), amount("irryield_r"))


def weighted_means(df: DataFrame, by: str, weight: str, columns: Sequence[str]) -> DataFrame:
    """Weighted means per key; a missing value takes its weight with it."""
    w = F.col(weight)
    return df.groupBy(by).agg(*[F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns])


def depth_weighted(horizons: DataFrame, columns: Sequence[str], top: float = 0, bottom: float | None = None, key: str = "cokey") -> DataFrame:
    """Means over the horizons of a component, weighted by the thickness within top..bottom."""
    upper = F.greatest(F.col("hzdept_r"), F.lit(top))
    lower = F.col("hzdepb_r") if bottom is None else F.least(F.col("hzdepb_r"), F.lit(bottom))
    return weighted_means(horizons.withColumn("_w", lower - upper).where("_w > 0"), key, "_w", columns)


def rollup_to_map_unit(component: DataFrame, columns: Sequence[str]) -> DataFrame:
    return weighted_means(component, "mukey", "comppct_r", columns)


def rollup_to_county(mapunit: DataFrame, overlap: DataFrame, area: str, columns: Sequence[str], county: str = "FIPS") -> DataFrame:
    """overlap has mukey, the county and the area that both share."""
    return weighted_means(mapunit.join(overlap.select("mukey", county, area), "mukey"), county, area, columns)
