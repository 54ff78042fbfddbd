"""Resampling of unbounded readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitraflow.operators.timeseries import AGGREGATES


def resample_stream(stream: DataFrame, ts: str, values: Sequence[str], interval: str = "1 day", agg: str = "mean", keys: Sequence[str] = (), late: str = "2 days") -> DataFrame:
    """Aggregates per key and bin of a streaming frame; rows later than `late` are dropped and a bin is
    final once the watermark passes it. Bins count from 1970; empty bins aren't filled."""
    fn = AGGREGATES[agg]
    binned = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, interval)).agg(*[fn(F.col(v)).alias(v) for v in values])
    return binned.select(*keys, F.col("window.start").alias("bin"), *values)
