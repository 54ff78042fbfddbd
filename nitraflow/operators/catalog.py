"""Filters, picks and codes over record tables."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def record_filter(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value; a list means any of its values, None is no condition."""
    tests = [F.col(c).isin(*v) if isinstance(v, list | tuple) else F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def iso_time_filter(df: DataFrame, ts: str, spec: str, now: str) -> DataFrame:
    """Rows within 'start/end' ('..' or nothing is open) or within a duration (PnD, PnM, PnY) up to now."""
    c = F.col(ts)
    if m := re.fullmatch(r"P(\d+)([DMY])", spec):
        unit = {"D": "days", "M": "months", "Y": "years"}[m[2]]
        end = F.lit(now).cast("timestamp")
        return df.where(c.between(end - F.expr(f"interval {m[1]} {unit}"), end))
    start, _, end = spec.partition("/")
    for bound, low in ((start, True), (end, False)):
        if bound not in ("", ".."):
            value = F.lit(bound.replace("Z", "")).cast("timestamp")
            df = df.where(c >= value if low else c <= value)
    return df


def sites_with_data(sites: DataFrame, readings: DataFrame, uid: str = "uid", site: str = "site_uid") -> DataFrame:
    """Sites that occur in the readings, by trimmed id."""
    return sites.withColumn(uid, F.trim(uid)).join(readings.select(F.trim(site).alias(uid)), uid, "left_semi")


def category_codes(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """df with 0-based codes over the sorted distinct values; null is -1. Only the distinct values are
    ranked, in one task: a column with few values is meant."""
    ranks = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(ranks, column, "left").withColumn(out, F.coalesce(out, F.lit(-1)))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a seeded hash of the key as text; the same rows on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def head_with_rest(df: DataFrame, order: list, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n rows, a one-row frame with the number of the others)"""
    return df.orderBy(*order).limit(n), df.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("n_more"))


def first_per_group(df: DataFrame, by: str, order: list[str], last: bool = False) -> DataFrame:
    """One whole row per group: that with the smallest (or largest) order values."""
    pick = (F.max_by if last else F.min_by)(F.struct(*[c for c in df.columns if c != by]), F.struct(*order))
    return df.groupBy(by).agg(pick.alias("_r")).select(by, "_r.*")
