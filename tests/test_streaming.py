import datetime as dt

import pytest
from pyspark.sql import functions as F

from nitraflow.operators import timeseries
from nitraflow.streaming.gapfill import resample_stream_filled


def run(spark, tmp_path, parts, name, **how):
    """Each part as a file that the stream takes in a batch of its own."""
    folder = tmp_path / name
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(folder / f"p={i}"))
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    out = resample_stream_filled(stream, "ts", ["v"], **how)
    out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start().awaitTermination(200)
    return spark.table(name)


@pytest.mark.parametrize("agg", ["sum", "mean", "max"])
def test_stream_equals_batch_with_gaps(spark, tmp_path, agg):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 5).alias("k"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 6 > 0, F.col("value")).alias("v"))
    lo, hi = (r.timestamp() for r in events.agg(F.min("ts"), F.max("ts")).first())
    cut = [lo + (hi - lo) * i / 3 for i in range(4)]
    parts = [events.where((F.unix_timestamp("ts") >= int(a)) & (F.unix_timestamp("ts") < (int(b) if b < hi else int(b) + 9))) for a, b in zip(cut, cut[1:])]
    # a reading a year on makes every bin before it final
    parts.append(spark.createDataFrame([(99, dt.datetime.fromtimestamp(hi, dt.UTC) + dt.timedelta(days=365), 1.0)], events.schema))
    got = run(spark, tmp_path, parts, f"filled_{agg}", step=7200, agg=agg, keys=["k"], late="1 hour").where("k < 99").collect()
    want = timeseries.resample(events, "ts", ["v"], "2h", agg, ["k"], origin="epoch").collect()
    plain = lambda rows: sorted((r.k, r.bin, None if r.v is None else round(r.v, 6)) for r in rows)
    assert plain(got) == plain(want) and any(r.v in (None, 0.0) for r in got)


def test_late_rows_keys_and_names(spark, tmp_path):
    row = lambda k, day, hour, v: (k, dt.datetime(2024, 1, day, hour, tzinfo=dt.UTC), v)
    first = spark.createDataFrame([row("a", 1, 0, 1.0), row("a", 1, 5, None), row(None, 1, 1, 5.0), ("a", None, 2.0)], "k string, ts timestamp, v double")
    parts = [first, spark.createDataFrame([row("a", 3, 0, 4.0)], first.schema), spark.createDataFrame([row("a", 4, 0, 8.0)], first.schema), spark.createDataFrame([row("a", 1, 0, 100.0), row("a", 9, 0, 1.0)], first.schema)]
    got = run(spark, tmp_path, parts, "late_rows", step=86400, agg="count", keys=["k"], late="6 hours").orderBy("bin").collect()
    assert [(r.bin.day, r.v) for r in got] == [(1, 1.0), (2, 0.0), (3, 1.0), (4, 1.0)]
    alone = run(spark, tmp_path, [p.where("k is not null") for p in parts], "no_keys", step=86400, agg="sum", late="6 hours").orderBy("bin").collect()
    assert [(r.bin.day, r.v) for r in alone] == [(1, 1.0), (2, 0.0), (3, 4.0), (4, 8.0)]
    with pytest.raises(ValueError, match="median"):
        resample_stream_filled(spark.readStream.format("rate").load(), "timestamp", ["value"], 60, "median")
