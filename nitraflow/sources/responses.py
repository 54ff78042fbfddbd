"""Landed service responses (JSON text, one per row) as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import WEATHER


def table_from_rows(df: DataFrame, columns: list[str], json: str = "json") -> DataFrame:
    """{"Table": [[header], [row], ...]} as string columns by name; an empty response has no rows."""
    rows = F.from_json(json, "Table array<array<string>>")["Table"]
    cells = df.select(rows.alias("rows")).where(F.size("rows") > 1).select(F.element_at("rows", 1).alias("names"), F.explode(F.slice("rows", 2, F.size("rows"))).alias("cells"))
    named = cells.select(F.map_from_arrays("names", "cells").alias("m"))
    return named.select(*[F.try_element_at("m", F.lit(c)).alias(c) for c in columns])


def weather_from_json(df: DataFrame, key: str = "point", json: str = "json") -> DataFrame:
    """properties.parameter[name][YYYYMMDD] as one row per point and date, in date order per file."""
    held = F.from_json(json, "properties struct<parameter: map<string, map<string, double>>>")["properties"]["parameter"]
    long = df.select(key, F.explode(held).alias("parameter", "by_day")).select(key, "parameter", F.explode("by_day").alias("day", "value"))
    long = long.withColumn("date", F.to_date("day", "yyyyMMdd"))
    return long.groupBy(key, "date").pivot("parameter", WEATHER).agg(F.first("value"))


def crop_stats_from_json(df: DataFrame, fields: str = "commodity_desc string, state_name string, year string, county_name string, Value string, unit_desc string", json: str = "json") -> DataFrame:
    """{"data": [record, ...]}; a response without data has no rows. Missing names get defaults."""
    rows = df.select(F.explode(F.from_json(json, f"data array<struct<{fields.replace(' string', ': string')}>>")["data"]).alias("r")).select("r.*")
    for name, default in (("county_name", "N/A"), ("Value", "N/A"), ("unit_desc", "")):
        if name in rows.columns:
            rows = rows.withColumn(name, F.coalesce(name, F.lit(default)))
    return rows


def catalog_from_json(df: DataFrame, json: str = "json") -> DataFrame:
    """[record, ...] as title, id, doi, url; doi and url default to ''."""
    rows = df.select(F.explode(F.from_json(json, "array<struct<title: string, id: long, doi: string, url: string>>")).alias("r")).select("r.*")
    return rows.withColumn("doi", F.coalesce("doi", F.lit(""))).withColumn("url", F.coalesce("url", F.lit("")))
