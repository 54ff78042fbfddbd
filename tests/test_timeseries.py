import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nitraflow.operators import timeseries
from nitraflow.streaming.resample import resample_stream


@pytest.fixture(scope="module")
def readings(spark):
    rng = np.random.default_rng(1)
    rows = []
    for site in range(6):
        at = pd.Timestamp("2024-01-02 05:00") + pd.Timedelta(hours=site * 9)
        for _ in range(40):
            at += pd.Timedelta(minutes=int(rng.integers(5, 900)))
            rows.append((f"s{site}", at.to_pydatetime(), None if rng.random() < 0.2 or site == 5 else float(rng.integers(0, 100))))
    rows.append(("one", dt.datetime(2024, 1, 3, 12), 4.0))
    return spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double"), pd.DataFrame(rows, columns=["site", "ts", "v"])


@pytest.mark.parametrize("interval", ["1D", "2D", "7h", "15min", "W"])
@pytest.mark.parametrize("agg", ["mean", "sum", "count", "min", "max"])
def test_bins_equal_pandas(readings, interval, agg):
    df, frame = readings
    want = []
    for site, part in frame.groupby("site"):
        r = part.set_index("ts").v.astype(float).resample(interval, origin="start_day").agg(agg)
        want += [(site, t.to_pydatetime(), None if pd.isna(v) else float(v)) for t, v in r.items()]
    found = [(r.site, r.bin, None if r.v is None else float(r.v)) for r in timeseries.resample(df, "ts", ["v"], interval, agg, ["site"]).collect()]
    assert [(a, b, None if c is None else round(c, 9)) for a, b, c in sorted(found, key=str)] == [(a, b, None if c is None else round(c, 9)) for a, b, c in sorted(want, key=str)]


def test_without_keys_and_without_fill(readings):
    df, frame = readings
    out = timeseries.resample(df, "ts", ["v"], "2D", "max").collect()
    assert sorted((r.bin, r.v) for r in out)[0][0] == dt.datetime(2024, 1, 2)
    assert timeseries.resample(df, "ts", ["v"], "1h", "max", ["site"], fill=False).count() < timeseries.resample(df, "ts", ["v"], "1h", "max", ["site"]).count()
    assert timeseries.resample(df.limit(0), "ts", ["v"], "1D", "sum", ["site"]).count() == 0
    with pytest.raises(ValueError):
        timeseries.resample(df, "ts", ["v"], "3W")


def test_callable_and_epoch_origin(spark):
    df = spark.createDataFrame([("a", dt.datetime(1970, 1, 6), 1.0), ("a", dt.datetime(1970, 1, 7), 3.0)], "k string, ts timestamp_ntz, v double")
    out = timeseries.resample(df, "ts", ["v"], "5D", lambda c: F.max(c) - F.min(c), ["k"], origin="epoch").collect()
    assert [(r.bin, r.v) for r in out] == [(dt.datetime(1970, 1, 6), 2.0)]


def test_exceedance(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 5.0), (2, 12.0), (5, 9.0), (6, 11.0))] + [("b", dt.date(2024, 1, 1), 50.0)], "site_uid string, date date, nitrate_con double")
    out = sorted((r.site_uid, r.date.day, r.next_max, r.exceeds, r.eta_days) for r in timeseries.exceedance_label(days, period=3).collect())
    assert out == [("a", 1, 12.0, True, 1), ("a", 2, 9.0, False, None), ("a", 5, 11.0, True, 1), ("a", 6, None, None, None), ("b", 1, None, None, None)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = resample_stream(stream, "ts", ["value"], "1 day", "sum", ["user_id"])
    run = out.writeStream.outputMode("complete").format("memory").queryName("daily_sums").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = timeseries.resample(events, "ts", ["value"], "1D", "sum", ["user_id"], fill=False).collect()
    assert {(r.user_id, r.bin, round(r.value, 6)) for r in spark.table("daily_sums").collect()} == {(r.user_id, r.bin, round(r.value, 6)) for r in want}


def test_steps_beside_the_day_join_no_raw_rows(readings):
    """Only the partial bins meet the first days; of a median, which has no parts, the rows do."""
    df, _ = readings

    def joined_rows(agg):
        plan = timeseries.resample(df, "ts", ["v"], "7h", agg, ["site"], fill=False)._jdf.queryExecution().optimizedPlan().toString().split("\n")
        join = next(i for i, line in enumerate(plan) if "Join Inner" in line)
        return not any("Aggregate" in line for line in plan[join + 1 : join + 4])

    assert [joined_rows(a) for a in ("sum", "count", "mean", "min", "max", "first", "median")] == [False] * 6 + [True]


def test_median_and_functions_with_steps_beside_the_day(readings):
    df, frame = readings
    for agg, plain in (("median", "median"), (lambda c: F.max(c) - F.min(c), lambda x: x.max() - x.min())):
        want = {(site, t.to_pydatetime()): None if pd.isna(v) else float(v) for site, part in frame.groupby("site") for t, v in part.set_index("ts").v.astype(float).resample("7h", origin="start_day").agg(plain).items()}
        assert {(r.site, r.bin): r.v for r in timeseries.resample(df, "ts", ["v"], "7h", agg, ["site"]).collect()} == want


def test_next_period_of_raw_readings(readings, spark):
    df, frame = readings
    rows = timeseries.next_period_of_readings(df.withColumn("id", F.monotonically_increasing_id()).unionByName(df.limit(3).withColumn("id", F.lit(-1).cast("long"))), 60.0, 2, "site", "ts", "v").collect()
    assert len(rows) == len(frame) + 3
    table = pd.DataFrame([(r.site, r.ts, r.v) for r in rows], columns=["site", "ts", "v"])
    for r in rows:
        later = table[(table.site == r.site) & (table.ts > r.ts) & (table.ts <= r.ts + pd.Timedelta(days=2))]
        high = later[later.v > 60]
        best = later.v.max()
        assert (r.next_max, r.eta_seconds) == (None if pd.isna(best) else best, int((high.ts.min() - r.ts).total_seconds()) if len(high) else None)
        assert r.exceeds == (None if pd.isna(best) else best > 60)


def test_a_hot_site_is_spread_over_tasks(spark):
    """One site with all readings: its windows run in as many groups as it has periods."""
    df = spark.range(20_000).select(F.lit("hot").alias("site_uid"), F.timestamp_seconds(F.col("id") * 3600).alias("datetime"), (F.col("id") % 97).cast("double").alias("nitrate_con"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    out = timeseries.next_period_of_readings(df, 95.0, 10)
    held = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(held) >= 6 and max(held) < 8000 and sum(held) == 20_000
    assert out.where("next_max is null").count() == 1


def test_rows_without_key_or_value(spark):
    days = spark.createDataFrame([(None, dt.date(2024, 1, 1), 1.0), (None, dt.date(2024, 1, 2), 50.0), ("a", None, 3.0), ("a", dt.date(2024, 1, 2), None), ("a", dt.date(2024, 1, 1), 20.0)], "site_uid string, date date, nitrate_con double")
    assert sorted(((r.site_uid, r.nitrate_con, r.next_max, r.exceeds) for r in timeseries.exceedance_label(days).collect()), key=str) == [("a", 20.0, None, None), ("a", 3.0, None, None), ("a", None, None, None), (None, 1.0, None, None), (None, 50.0, None, None)]
