"""Resampling of readings, and what follows a day."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "min": F.min, "max": F.max, "count": F.count,
    "first": F.min, "last": F.max, "median": F.median, "std": F.stddev_samp,
}
#: What an empty bin holds.
EMPTY = {"sum": 0.0, "count": 0}
#: Aggregates made from parts: what is kept of a part, and how parts make the whole.
_PARTS: dict[str, tuple[dict[str, Callable[[Column], Column]], Callable[[str], Column]]] = {
    "sum": ({"sum": F.sum}, lambda i: F.coalesce(F.sum(f"_sum{i}"), F.lit(0.0))), "count": ({"n": F.count}, lambda i: F.sum(f"_n{i}")),
    "min": ({"min": F.min}, lambda i: F.min(f"_min{i}")), "max": ({"max": F.max}, lambda i: F.max(f"_max{i}")),
    "first": ({"min": F.min}, lambda i: F.min(f"_min{i}")), "last": ({"max": F.max}, lambda i: F.max(f"_max{i}")),
    "mean": ({"sum": F.sum, "n": F.count}, lambda i: F.sum(f"_sum{i}") / F.nullif(F.sum(f"_n{i}"), F.lit(0))),
}
SECONDS = {"s": 1, "min": 60, "h": 3600, "D": 86400}


def _day0(seconds: Column) -> Column:
    return seconds - F.pmod(seconds, F.lit(86400))


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def resample(df: DataFrame, ts: str, values: Sequence[str], interval: str, agg: str | Callable[[Column], Column] = "mean", keys: Sequence[str] = (), origin: str = "start_day", fill: bool = True) -> DataFrame:
    """Aggregates of each value column per key and time bin (column `bin`).

    interval is a number and a unit (s, min, h, D), `W` (weeks from Monday, labelled by their Sunday) or
    `M` (calendar months, labelled by the first day). Fixed steps count from midnight of the series'
    first day ('start_day') or from 1970 ('epoch'). Empty bins between the first and the last of a
    series are filled: sum and count with 0, others with null. `first` and `last` mean the smallest and
    largest value, as rows have no order. Rows without key or time are left out. Timestamps with and
    without time zone keep their type; the session's zone should be UTC.

    One shuffle on the keys and bins after partial aggregation. Where steps don't divide a day, rows are first
    aggregated into steps of the greatest common divisor of step and day, which no bin's edge cuts wherever a series
    begins; only those partial bins meet the first day of their series. Medians and functions of the caller's can't be
    put together from parts: their rows are joined with the first days.
    """
    fn = AGGREGATES[agg] if isinstance(agg, str) else agg
    kind = dict(df.dtypes)[ts]
    rows = df.where(F.col(ts).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    measures = [fn(F.col(v)).alias(v) for v in values]
    m = re.fullmatch(r"(\d*)\s*(s|min|h|D|W|M)", interval)
    if not m or m[2] in "WM" and m[1] not in ("", "1"):
        raise ValueError(f"no such interval: {interval}")
    if m[2] in "WM":
        unit = "week" if m[2] == "W" else "month"
        start = F.date_trunc(unit, F.col(ts).cast("timestamp"))
        binned = rows.withColumn("_t", start).groupBy(*keys, "_t").agg(*measures)
        if fill:
            span = binned.groupBy(*keys).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
            span = span.where("_a is not null").select(*keys, F.explode(F.expr(f"sequence(_a, _b, interval 1 {unit})")).alias("_t"))
            binned = _joined(span, binned, keys, "_t")
        label = F.col("_t") + F.expr("interval 6 days") if unit == "week" else F.col("_t")
        out = binned.withColumn("bin", label.cast(kind))
    else:
        step = int(m[1] or 1) * SECONDS[m[2]]
        timed = rows.withColumn("_s", _seconds(F.col(ts)))
        shifted = origin != "epoch" and 86400 % step != 0
        parts = _PARTS.get(agg) if shifted and isinstance(agg, str) else None
        if parts:
            fine = math.gcd(step, 86400)
            stored = [fn(F.col(v)).alias(f"_{p}_{i}") for i, v in enumerate(values) for p, fn in parts[0].items()]
            timed = timed.withColumn("_s", F.floor(F.col("_s") / fine) * fine).groupBy(*keys, "_s").agg(*stored)
            measures = [parts[1](f"_{i}").alias(v) for i, v in enumerate(values)]
        base: Column = F.lit(0)
        if shifted:
            first = timed.groupBy(*keys).agg(_day0(F.min("_s")).alias("_day0"))
            timed = timed.join(first, list(keys)) if keys else timed.crossJoin(F.broadcast(first))  # one row
            base = F.col("_day0")
        at = base + F.floor((F.col("_s") - base) / step) * step
        binned = timed.withColumn("_t", at).groupBy(*keys, "_t").agg(*measures)
        if fill:
            span = binned.groupBy(*keys).agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
            span = span.where("_a is not null").select(*keys, F.explode(F.sequence("_a", "_b", F.lit(step).cast("long"))).alias("_t"))
            binned = _joined(span, binned, keys, "_t")
        out = binned.withColumn("bin", F.timestamp_seconds("_t").cast(kind))
    if fill and isinstance(agg, str) and agg in EMPTY:
        out = out.fillna(EMPTY[agg], list(values))
    return out.select(*keys, "bin", *values)


def _joined(span: DataFrame, binned: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    return span.join(binned, [*keys, at], "left")


def daily(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The largest value of each key and day."""
    return df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, F.to_date(ts).alias("date")).agg(F.max(value).alias(value))


def over_next_period(rows: DataFrame, measures: dict[str, Column], key: str, at: str, period: int) -> DataFrame:
    """rows with each measure, an aggregate over the rows of the same key in the `period` units after each row; `at`
    holds whole units.

    A range join by buckets of one period: the rows that a row looks at lie in its own bucket or the next, so every row is
    also carried to the bucket before. Windows then run within a key's bucket, and a key with a third of all
    rows is spread over as many tasks as it has periods. Rows without key or unit have nothing after them."""
    bucket, carried = "_bucket", "_carried"
    own = rows.withColumn(bucket, F.floor(F.col(at) / period)).withColumn(carried, F.lit(False))
    both = own.unionByName(own.withColumn(bucket, F.col(bucket) - 1).withColumn(carried, F.lit(True)).where(F.col(key).isNotNull() & F.col(at).isNotNull()))
    after = Window.partitionBy(key, bucket).orderBy(at).rangeBetween(1, period)
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    return both.withColumns({c: F.when(known, m.over(after)) for c, m in measures.items()}).where(~F.col(carried)).drop(bucket, carried)


def _days(date: str) -> Column:
    return F.datediff(date, F.lit("1970-01-01"))


def next_period_max(days: DataFrame, key: str = "site_uid", date: str = "date", value: str = "nitrate_con", period: int = 30) -> DataFrame:
    """days with next_max: the largest value in the `period` days after each day."""
    return over_next_period(days.withColumn("_at", _days(date)), {"next_max": F.max(value)}, key, "_at", period).drop("_at")


def next_period_of_readings(readings: DataFrame, threshold: float = 10.0, period: int = 30, key: str = "site_uid", ts: str = "datetime", value: str = "nitrate_con") -> DataFrame:
    """Raw readings with next_max, exceeds and eta_seconds: the largest value within `period` days after each reading,
    whether it is above the threshold (null if nothing follows) and the seconds to the first such reading."""
    at = "_at"
    measures = {"next_max": F.max(value), "_first": F.min(F.when(F.col(value) > threshold, F.col(at)))}
    found = over_next_period(readings.withColumn(at, _seconds(F.col(ts))), measures, key, at, period * 86400)
    return found.withColumn("exceeds", F.col("next_max") > threshold).withColumn("eta_seconds", F.col("_first") - F.col(at)).drop(at, "_first")


def exceedance_label(days: DataFrame, threshold: float = 10.0, period: int = 30, key: str = "site_uid", date: str = "date", value: str = "nitrate_con") -> DataFrame:
    """days with next_max, exceeds (null if nothing follows) and eta_days to the first day above the threshold."""
    at = "_at"
    measures = {"next_max": F.max(value), "_first": F.min(F.when(F.col(value) > threshold, F.col(at)))}
    found = over_next_period(days.withColumn(at, _days(date)), measures, key, at, period)
    return found.withColumn("exceeds", F.col("next_max") > threshold).withColumn("eta_days", (F.col("_first") - F.col(at)).cast("int")).drop(at, "_first")


def join_discharge(readings: DataFrame, gauge: DataFrame, site_map: DataFrame) -> DataFrame:
    """Daily readings (site_uid, date) with the same day's discharge of the gauge that site_map gives."""
    return readings.join(site_map.select("site_uid", "monitoring_location_id"), "site_uid").join(gauge.select("monitoring_location_id", "date", "discharge"), ["monitoring_location_id", "date"])


def without_private(readings: DataFrame, params: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings as rows (keys, parameter, value), without the parameters that are marked private."""
    values = [c for c in readings.columns if c not in keys]
    long = readings.unpivot(list(keys), values, "parameter", "value")
    return long.join(params.where("private = 'f'").select(F.col("uid").alias("parameter")), "parameter", "left_semi")
