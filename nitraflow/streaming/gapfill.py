"""Resampling of unbounded readings with empty bins filled."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitraflow.operators.timeseries import EMPTY

#: What a bin of (sum, count, least, largest) says, by aggregate.
_VALUE: dict[str, Callable[[list], float | None]] = {
    "sum": lambda b: b[0], "count": lambda b: b[1], "mean": lambda b: b[0] / b[1] if b[1] else None, "min": lambda b: b[2], "max": lambda b: b[3],
}


def _merged(a: list | None, b: list) -> list:
    if a is None:
        return b
    pick = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    return [a[0] + b[0], a[1] + b[1], pick(min, a[2], b[2]), pick(max, a[3], b[3])]


def resample_stream_filled(stream: DataFrame, ts: str, values: Sequence[str], step: int, agg: str = "mean", keys: Sequence[str] = (), late: str = "2 days") -> DataFrame:
    """Aggregates (sum, count, mean, min, max) of each value per key and bin of `step` seconds, counted from 1970, of a
    streaming frame, in append mode. A bin is final once the watermark, `late` behind the newest reading, passes its
    end; with it come the empty bins since the one before it: sum and count 0, others null. So what has come
    out is, for each key, what `resample` gives from its first bin to its last final one. Rows later than the watermark are
    dropped, and so are those without time or key. The state of a key is its open bins and where the filled ones end."""
    if agg not in _VALUE:
        raise ValueError(f"no such aggregate of a stream: {agg}")
    whole = "_all"
    rows = stream.where(F.col(ts).isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    rows = rows.select(*keys, F.col(ts).cast("timestamp").alias(ts), *[F.col(v).cast("double").alias(v) for v in values]).withWatermark(ts, late)
    rows = rows.withColumn("_bin", F.floor(F.unix_seconds(ts) / step) * step)
    by = list(keys)
    if not by:
        by, rows = [whole], rows.withColumn(whole, F.lit(0))
    kinds = {f.name: f for f in rows.schema.fields}
    out = T.StructType([*[kinds[k] for k in by], T.StructField("bin", T.TimestampType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    empty = float(EMPTY[agg]) if agg in EMPTY else None

    def advanced(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, next_bin = state.get if state.exists else ("{}", None)
        bins: dict[int, list[list]] = {int(b): v for b, v in json.loads(held).items()}
        for frame in frames:
            for b, part in frame.groupby("_bin"):
                if next_bin is None or b >= next_bin:
                    made = [[float(c.sum()), int(c.count()), *(None if pd.isna(x) else float(x) for x in (c.min(), c.max()))] for c in (part[v] for v in values)]
                    bins[int(b)] = [_merged(a, m) for a, m in zip(bins.get(int(b)) or [None] * len(values), made, strict=True)]
        passed = state.getCurrentWatermarkMs() / 1000
        told = []
        for b in sorted(b for b in bins if b + step <= passed):
            for gap in range(next_bin if next_bin is not None else b, b, step):
                told.append((*key, pd.Timestamp(gap, unit="s"), *[empty] * len(values)))
            told.append((*key, pd.Timestamp(b, unit="s"), *[_VALUE[agg](v) for v in bins.pop(b)]))
            next_bin = b + step
        state.update((json.dumps(bins), next_bin))
        if bins:
            state.setTimeoutTimestamp(max((min(bins) + step) * 1000, int(passed * 1000) + 1))
        if told:
            yield pd.DataFrame(told, columns=out.names)

    filled = rows.groupBy(*by).applyInPandasWithState(advanced, out, "bins string, next_bin long", "append", "EventTimeTimeout")
    return filled.select(*keys, "bin", *values)
