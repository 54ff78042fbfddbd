import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from nitraflow.functions import scalars, weather
from nitraflow.operators import catalog, county, geo, quality, raster, soil
from nitraflow.plans import forecast


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_hargreaves(spark):
    f = lambda *v: one(spark, weather.hargreaves_et0(*[F.lit(x).cast("double") for x in v]))
    assert abs(f(20, 25, 16, 10) - 0.0023 * 37.8 * 3 * 10 / 0.408) < 1e-12
    assert f(20, 25, 15, 0) == 0.0 and f(20, 15, 25, 10) == 0.0 and f(None, 25, 15, 10) is None and f(20, 25, 15, None) is None


def test_penman_monteith_published_example(spark):
    # 6 July, 50.8 N, 100 m: Tmax 21.5, Tmin 12.3, wind 2.078, radiation 22.07, vapour pressure 1.409 kPa
    saturated = (0.6108 * 2.718281828 ** (17.27 * 21.5 / 258.8) + 0.6108 * 2.718281828 ** (17.27 * 12.3 / 249.6)) / 2
    v = [16.9, 21.5, 12.3, 1.409 / saturated * 100, 2.078, 22.07, 100.0, 50.8]
    assert abs(one(spark, weather.penman_monteith_et0(*[F.lit(x) for x in v], F.lit(187))) - 3.9) < 0.1


def test_scalars(spark):
    assert one(spark, scalars.value_number(F.lit("1,234.5"))) == 1234.5 and one(spark, scalars.value_number(F.lit("(D)"))) is None
    assert one(spark, scalars.size_kb(F.lit(1280 + 64))) == 1.3 and one(spark, scalars.fips_text(F.lit(1001))) == "01001"
    assert one(spark, scalars.year_in(F.lit("a-kg-1987-2"))) == 1987 and abs(one(spark, scalars.pollutant_load(F.lit(2.0), F.lit(3.0))) - 32.36262) < 1e-9
    assert one(spark, scalars.exceeds(F.lit(10.0))) is False and one(spark, scalars.log1p_or_null(F.lit(-2.0))) is None
    assert one(spark, scalars.comma_list(F.lit("a"), F.lit("b"))) == "a,b" and one(spark, scalars.pollutant_yield(F.lit(1.0), F.lit(0.0))) is None


def test_fertilizer_alignment(spark):
    total = spark.createDataFrame([(1,), (2,), (3,)], "`fips-int` int")
    farm = spark.createDataFrame([(1, 10.0), (2, 5.0)], "`fips-int` int, `farmfertN-kg-1987` double")
    other = spark.createDataFrame([(1, 2.0), (3, 1.0)], "`fips-int` int, `nonffertN-kg-1987` double")
    out = county.combine_fertilizer(total, farm, other, [1987])
    assert sorted(map(tuple, out.collect())) == [(1, 12.0), (2, None), (3, None)]
    assert [r[0] for r in county.common_keys(farm, other, "fips-int").collect()] == [1]
    wide = spark.createDataFrame([("01001", "n", 100.0, 5.0)], "STCOFIPS string, CountyName string, `farmfertN-kg-1987` double, extra double")
    land = spark.createDataFrame([("01001", 0.0)], "STCOFIPS string, area_land_km2 double")
    long = county.intensity_long(county.intensity(wide, land, [1987]), ["STCOFIPS"])
    assert [tuple(r) for r in long.collect()] == [("01001", 1987, None)]
    assert county.leading_columns(wide, "STCOFIPS", 2).columns == ["STCOFIPS", "CountyName", "farmfertN-kg-1987"]


def test_exclude_keeps_null_keys(spark):
    df = spark.createDataFrame([("02",), ("19",), (None,)], "k string")
    assert {r.k for r in county.exclude(df, "k", county.NON_CONUS).collect()} == {"19", None}


def test_soil(spark):
    crops = spark.createDataFrame([("c1", "Corn", "bu", "12.5", None), ("c1", "Corn", None, "x", "3"), ("c2", None, "bu", "1", "1")], "cokey string, cropname string, yldunits string, nonirryield_r string, irryield_r string")
    assert [tuple(r) for r in soil.crop_yield_summary(crops).collect()] == [("Corn", "bu", 12.5, 3.0)]
    horizons = spark.createDataFrame([("c1", 0, 10, 1.0, None), ("c1", 10, 30, 4.0, 8.0), ("c1", 30, 200, 9.0, 9.0)], "cokey string, hzdept_r int, hzdepb_r int, a double, b double")
    assert tuple(soil.depth_weighted(horizons, ["a", "b"], 0, 30).first()) == ("c1", 3.0, 8.0)
    component = spark.createDataFrame([("m", "c1", 60.0, 1.0), ("m", "c2", 40.0, None), ("n", "c3", 5.0, 2.0)], "mukey string, cokey string, comppct_r double, a double")
    assert sorted(map(tuple, soil.rollup_to_map_unit(component, ["a"]).collect())) == [("m", 1.0), ("n", 2.0)]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "point_id int, x double, y double")
    edges = spark.createDataFrame([(z, 1.0, 0.0, 1.0, 1.0) for z in ("n", "m")] + [(z, 0.0, 1.0, 0.0, 0.0) for z in ("n", "m")], "zone string, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r.point_id, r.mukey) for r in soil.map_unit_of_points(points, edges).collect()) == [(1, "m"), (2, None)]
    found = soil.soil_profile(points, edges, component, crops, horizons, crops.limit(0))
    assert [t.count() for t in found] == [3, 3, 0]


def test_class_coverage_ties_and_unknown_codes(spark):
    pixels = spark.createDataFrame([(c,) for c in [0, 0, 1, 1, 999, 999, 5]], "code int")
    rows = raster.class_coverage(pixels, "code", raster.crop_labels(spark), 3).collect()
    assert [(r.code, r.label, r.n) for r in rows] == [(0, "Background", 2), (1, "Corn", 2), (999, "Code 999", 2)]
    assert abs(rows[0].percent - 200 / 7) < 1e-9


def test_codes_samples_and_picks(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, c string")
    assert sorted((r.i, r.code) for r in catalog.category_codes(df, "c").collect()) == [(1, 1), (2, 0), (3, -1), (4, 1)]
    assert catalog.sample_rows(df, "i", 2, 5).collect() == catalog.sample_rows(df.repartition(3), "i", 2, 5).collect()
    head, rest = catalog.head_with_rest(df, ["i"], 3)
    assert [r.i for r in head.collect()] == [1, 2, 3] and rest.first().n_more == 1
    assert {(r.c, r.i) for r in catalog.first_per_group(df, "c", ["i"], last=True).collect()} == {("b", 4), ("a", 2), (None, 3)}
    assert catalog.record_filter(df, c=["a", "b"], i=None).count() == 3


@pytest.mark.parametrize(("spec", "days"), [("2024-01-02/2024-01-03", [2, 3]), ("2024-01-03/..", [3, 4]), ("../2024-01-02", [1, 2]), ("P2D", [2, 3, 4])])
def test_time_filters(spark, spec, days):
    df = spark.createDataFrame([(d, dt.datetime(2024, 1, d)) for d in (1, 2, 3, 4)], "d int, ts timestamp_ntz")
    assert sorted(r.d for r in catalog.iso_time_filter(df, "ts", spec, "2024-01-04").collect()) == days


def test_diffs(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, None, "x"), (3, 3.0, "y"), (None, 1.0, "z")], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (4, 3.0, "y"), (None, 1.0, "z")], "k int, v double, s string")
    assert sorted((r.k, r.side, r["columns"]) for r in quality.table_diff(a, b, ["k"]).collect()) == [(2, "both", ["v"]), (3, "left_only", []), (4, "right_only", [])]
    assert quality.table_diff(a, a, ["k"]).count() == 0
    assert tuple(quality.diff_summary(a, b, ["k"], "k").first()) == (True, True, 3, 2, 4, True)
    assert {(r.column, r.n_distinct) for r in quality.distinct_counts(a).collect()} == {("k", 4), ("v", 3), ("s", 4)}
    assert {(r.column, r.n_rows, r.n_values) for r in quality.profile(a).collect()} == {("k", 4, 3), ("v", 4, 3), ("s", 4, 3)}


def test_forecast(spark):
    days = spark.createDataFrame([(f"s{s}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(20 if s % 2 else 1) + d % 3) for s in range(6) for d in range(20)], "site_uid string, date date, nitrate_con double")
    rain = days.select("site_uid", "date", (F.col("nitrate_con") / 2).alias("rain"))
    features = forecast.feature_table(days, rain, period=5)
    model = forecast.fit_exceedance(features, ["nitrate_con", "rain"], 5)
    out = {r.site_uid: r.exceeds_threshold for r in forecast.forecast_exceedance(features, model, days.where("site_uid <> 's0'").select("site_uid")).collect()}
    assert out == {f"s{s}": bool(s % 2) for s in range(1, 6)}


def test_forecast_on_sites_it_has_not_seen(spark):
    """Sites whose nitrate climbs at a rate that `rain` sets: the forecast is better than the base rate, and its days nearer than a constant's."""
    rng = np.random.default_rng(7)
    rows = []
    for site in range(120):
        rain, level = float(rng.integers(0, 10)), float(rng.uniform(2, 9))
        for day in range(40):
            level = min(level + rng.normal(0.05 + 0.04 * rain, 0.15), 30) if level < 12 else 2.0
            rows.append((f"s{site}", dt.date(2024, 1, 1) + dt.timedelta(days=day), float(level), rain))
    days = spark.createDataFrame(rows, "site_uid string, date date, nitrate_con double, rain double")
    labelled = forecast.feature_table(days.select("site_uid", "date", "nitrate_con"), days.select("site_uid", "date", "rain"), period=20)
    train = labelled.where(F.substring("site_uid", 2, 3).cast("int") % 3 != 0)
    model = forecast.fit_exceedance(train, ["nitrate_con", "rain"], 20)
    # the day that is forecast from is the 20th: what follows is known
    other = labelled.where((F.substring("site_uid", 2, 3).cast("int") % 3 == 0) & (F.col("date") <= dt.date(2024, 1, 20)))
    told = {r.site_uid: r for r in forecast.forecast_exceedance(other, model).collect()}
    truth = {r.site_uid: r for r in other.where(F.col("date") == dt.date(2024, 1, 20)).collect()}
    assert len(told) == len(truth) == 40
    y = np.array([bool(truth[s].exceeds) for s in told])
    p = np.array([told[s].probability for s in told])
    base = y.mean()
    loss = lambda q: -np.mean(np.where(y, np.log(q), np.log(1 - q)))
    assert loss(np.clip(p, 1e-4, 1 - 1e-4)) < 0.7 * loss(np.full(len(y), base))
    assert all((r.eta_days is not None) == r.exceeds_threshold == (r.probability >= 0.5) for r in told.values())
    both = [(told[s].eta_days, truth[s].eta_days) for s in told if told[s].eta_days and truth[s].eta_days]
    middle = np.median([b for _, b in both])
    assert len(both) > 8 and np.mean([abs(a - b) for a, b in both]) < 0.8 * np.mean([abs(middle - b) for _, b in both])


def test_days_at_risk(spark):
    days = spark.createDataFrame([("a", dt.date(2024, 1, d), v) for d, v in ((1, 1.0), (3, 12.0), (4, 2.0), (9, 3.0))], "site_uid string, date date, nitrate_con double")
    rows = sorted((r.date.day, r.day, r.event) for r in forecast.days_at_risk(forecast.feature_table(days, period=4), 4).collect())
    assert rows == [(1, 1, 0.0), (1, 2, 1.0), *[(3, k, 0.0) for k in (1, 2, 3, 4)], *[(4, k, 0.0) for k in (1, 2, 3, 4)]]


def test_sites_in_a_region(spark):
    region = geo.wkt_to_vertices(spark.createDataFrame([("r", "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))")], "zone string, wkt string"))
    sites = spark.createDataFrame([("in", 1.0, 1.0), ("out", 9.0, 1.0), ("none", None, 1.0)], "site_uid string, longitude double, latitude double")
    assert [r.site_uid for r in forecast.sites_in_region(sites, region).collect()] == ["in"]
