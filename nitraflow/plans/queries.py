"""The registered queries of the library, and their SQL. Each works on whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitraflow.functions import geo as geo_functions
from nitraflow.functions import scalars, weather
from nitraflow.functions.tables import materialised
from nitraflow.operators import catalog, county, geo, positions, profiles, quality, raster, soil, timeseries
from nitraflow.plans import forecast, panel
from nitraflow.sources import files, responses, schemas, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({c: scalars.rounded(F.col(c), digits) if types[c] == "double" else F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- time series


@query("""
WITH b AS (SELECT user_id, event_type, date_trunc('day', ts) AS bin, avg(value) AS value FROM events GROUP BY ALL),
s AS (SELECT user_id, event_type, unnest(generate_series(min(bin)::TIMESTAMP, max(bin)::TIMESTAMP, INTERVAL 1 DAY)) AS bin FROM b GROUP BY user_id, event_type)
SELECT user_id, event_type, s.bin AS bin, round(b.value, 8) AS value FROM s LEFT JOIN b USING (user_id, event_type, bin)""")
def daily_mean_gapfill(spark, sf_dir):
    return _rounded(timeseries.resample(_read(spark, sf_dir, "events"), "ts", ["value"], "1D", "mean", ["user_id", "event_type"]), "value")


@query("""
WITH d AS (SELECT user_id, date_trunc('day', min(ts))::TIMESTAMP AS day0 FROM events GROUP BY 1),
b AS (SELECT user_id, day0 + to_days((2 * floor(epoch(ts - day0) / 172800))::INT) AS bin, sum(value) AS value FROM events JOIN d USING (user_id) GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(bin), max(bin), INTERVAL 2 DAY)) AS bin FROM b GROUP BY 1)
SELECT user_id, s.bin AS bin, round(coalesce(b.value, 0), 8) AS value FROM s LEFT JOIN b USING (user_id, bin)""")
def resample_2d_start_day(spark, sf_dir):
    return _rounded(timeseries.resample(_read(spark, sf_dir, "events"), "ts", ["value"], "2D", "sum", ["user_id"]), "value")


@query("""
WITH d AS (SELECT event_type, date_trunc('day', min(ts))::TIMESTAMP AS day0 FROM events GROUP BY 1),
b AS (SELECT event_type, day0 + to_hours((7 * floor(epoch(ts - day0) / 25200))::INT) AS bin, max(value) AS value FROM events JOIN d USING (event_type) GROUP BY ALL),
s AS (SELECT event_type, unnest(generate_series(min(bin), max(bin), INTERVAL 7 HOUR)) AS bin FROM b GROUP BY 1)
SELECT event_type, s.bin AS bin, b.value AS value FROM s LEFT JOIN b USING (event_type, bin)""")
def resample_7h_max(spark, sf_dir):
    return timeseries.resample(_read(spark, sf_dir, "events"), "ts", ["value"], "7h", "max", ["event_type"])


@query("""
WITH b AS (SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS w, avg(value) AS value FROM events GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS w FROM b GROUP BY 1)
SELECT user_id, s.w + INTERVAL 6 DAY AS bin, round(b.value, 8) AS value FROM s LEFT JOIN b USING (user_id, w)""")
def resample_weekly(spark, sf_dir):
    return _rounded(timeseries.resample(_read(spark, sf_dir, "events"), "ts", ["value"], "W", "mean", ["user_id"]), "value")


@query("""
WITH b AS (SELECT o_orderpriority, date_trunc('month', o_orderdate)::TIMESTAMP AS bin, sum(o_totalprice) AS o_totalprice FROM orders GROUP BY ALL),
s AS (SELECT o_orderpriority, unnest(generate_series(min(bin), max(bin), INTERVAL 1 MONTH)) AS bin FROM b GROUP BY 1)
SELECT o_orderpriority, s.bin AS bin, round(coalesce(b.o_totalprice, 0), 2) AS o_totalprice FROM s LEFT JOIN b USING (o_orderpriority, bin)""")
def resample_monthly(spark, sf_dir):
    out = timeseries.resample(_read(spark, sf_dir, "orders"), "o_orderdate", ["o_totalprice"], "M", "sum", ["o_orderpriority"])
    return _rounded(out, "o_totalprice", digits=2)


@query("""
WITH b AS (SELECT l_returnflag, l_linestatus, date_trunc('day', l_shipdate)::TIMESTAMP AS bin, avg(l_quantity) AS l_quantity, avg(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL),
s AS (SELECT l_returnflag, l_linestatus, unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY)) AS bin FROM b GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, s.bin AS bin, round(b.l_quantity, 8) AS l_quantity, round(b.l_extendedprice, 6) AS l_extendedprice FROM s LEFT JOIN b USING (l_returnflag, l_linestatus, bin)""")
def resample_multi_col(spark, sf_dir):
    out = timeseries.resample(_read(spark, sf_dir, "lineitem"), "l_shipdate", ["l_quantity", "l_extendedprice"], "1D", "mean", ["l_returnflag", "l_linestatus"])
    return _rounded(_rounded(out, "l_quantity"), "l_extendedprice", digits=6)


def _daily_events(spark, sf_dir) -> DataFrame:
    return timeseries.daily(_read(spark, sf_dir, "events"), "user_id", "ts", "value")


_DAYS = "days AS (SELECT user_id, ts::DATE AS date, max(value) AS value FROM events GROUP BY ALL)"


@query(f"""
WITH {_DAYS}
SELECT a.user_id, a.date, a.value, max(b.value) AS next_max, max(b.value) > 150 AS exceeds, (min(b.date) FILTER (b.value > 150) - a.date)::INT AS eta_days
FROM days a LEFT JOIN days b ON a.user_id = b.user_id AND b.date > a.date AND b.date <= a.date + 10 GROUP BY a.user_id, a.date, a.value""")
def exceedance_label(spark, sf_dir):
    return timeseries.exceedance_label(_daily_events(spark, sf_dir), 150.0, 10, "user_id", "date", "value")


@query(f"""
WITH {_DAYS}, g AS (SELECT 'gauge' || (user_id % 20) AS monitoring_location_id, ts::DATE AS date, round(avg(value), 8) AS discharge FROM events WHERE event_type = 'click' GROUP BY ALL)
SELECT days.user_id AS site_uid, g.monitoring_location_id, days.date, days.value, g.discharge, round(days.value * g.discharge * 5.39377, 3) AS load_lb_day
FROM days JOIN g ON g.monitoring_location_id = 'gauge' || (days.user_id % 20) AND g.date = days.date""")
def discharge_load(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    name = F.concat(F.lit("gauge"), (F.col("user_id") % 20).cast("string"))
    gauge = events.where("event_type = 'click'").groupBy(name.alias("monitoring_location_id"), F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 8).alias("discharge"))
    sites = events.select(F.col("user_id").alias("site_uid"), name.alias("monitoring_location_id")).distinct()
    joined = timeseries.join_discharge(_daily_events(spark, sf_dir).withColumnRenamed("user_id", "site_uid"), gauge, sites)
    load = F.round(scalars.pollutant_load(F.col("value"), F.col("discharge")), 3)
    return joined.select("site_uid", "monitoring_location_id", "date", "value", "discharge", load.alias("load_lb_day"))


@query("""
SELECT event_id, 'v' || (event_id % 4) AS parameter, value FROM events WHERE event_id % 4 NOT IN (1, 3)
""")
def private_parameters(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    wide = events.select("event_id", *[F.when(F.col("event_id") % 4 == i, F.col("value")).alias(f"v{i}") for i in range(4)])
    params = events.select((F.col("event_id") % 4).alias("p")).distinct().select(F.concat(F.lit("v"), F.col("p").cast("string")).alias("uid"), F.when(F.col("p") % 2 == 1, "t").otherwise("f").alias("private"))
    return timeseries.without_private(wide, params, ["event_id"]).where("value is not null").select("event_id", "parameter", "value")


# ---------------------------------------------------------------- filters, picks, codes


@query("""
SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_brand LIKE 'Brand#1%' AND NOT starts_with(p_type, 'ECO') AND p_name LIKE '%t'""")
def site_filter_prefix(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.where(F.col("p_brand").like("Brand#1%") & ~F.col("p_type").startswith("ECO") & F.col("p_name").endswith("t")).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""
SELECT s_suppkey::VARCHAR AS uid, s_name, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5 OR l_suppkey % 3 = 0)""")
def site_semi_join(spark, sf_dir):
    sites = _read(spark, sf_dir, "supplier").select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string"), F.lit("  ")).alias("uid"), "s_name", "s_acctbal")
    readings = _read(spark, sf_dir, "lineitem").where("l_quantity > 49.5 or l_suppkey % 3 = 0").select(F.concat(F.col("l_suppkey").cast("string"), F.lit("   ")).alias("site_uid"))
    return catalog.sites_with_data(sites, readings)


@query("""
SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'""")
def record_filter(spark, sf_dir):
    rows = catalog.record_filter(_read(spark, sf_dir, "orders"), o_orderstatus="F", o_orderpriority=["1-URGENT", "2-HIGH"], o_clerk=None)
    return catalog.iso_time_filter(rows, "o_orderdate", "1997-01-01/1998-06-30", "2002-01-01").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")


@query("""
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '2001-01-01' - INTERVAL 1 YEAR AND TIMESTAMP '2001-01-01'""")
def duration_filter(spark, sf_dir):
    return catalog.iso_time_filter(_read(spark, sf_dir, "orders"), "o_orderdate", "P1Y", "2001-01-01").select("o_orderkey", "o_orderdate")


@query("""
SELECT o_orderkey, o_totalprice, greatest((SELECT count(*) FROM orders) - 25, 0)::BIGINT AS n_more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def head_sample(spark, sf_dir):
    head, rest = catalog.head_with_rest(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)
    return head.crossJoin(F.broadcast(rest))  # one row


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT 100""")
def seeded_sample(spark, sf_dir):
    return catalog.sample_rows(_read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100, seed=7)


@query("""
SELECT c.c_custkey, c.c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS code FROM customer c""")
def category_codes(spark, sf_dir):
    return catalog.category_codes(_read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


# ---------------------------------------------------------------- county tables


@query("""
SELECT n.n_nationkey::VARCHAR AS FIPS, r.r_name, count(*)::BIGINT AS n_suppliers, round(sum(s_acctbal) * 1000 / 1e6, 6) AS area_land_km2,
round(sum(s_acctbal) * 1000 / 1e6 * avg(s_suppkey % 100) / 100, 8) AS farm_area_km2
FROM nation n JOIN region r ON n_regionkey = r_regionkey JOIN supplier s ON s_nationkey = n_nationkey GROUP BY ALL""")
def county_area_derivation(spark, sf_dir):
    supplier, nation = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    geo_table = supplier.groupBy(F.col("s_nationkey").cast("string").alias("FIPS")).agg((F.sum("s_acctbal") * 1000).alias("ALAND"), F.lit(0.0).alias("AWATER"), F.count("*").alias("n_suppliers"))
    farms = supplier.groupBy(F.col("s_nationkey").cast("string").alias("FIPS")).agg(F.avg(F.col("s_suppkey") % 100).alias("farm_acre_as_percent"), F.lit(1.0).alias("crop_acre_as_percent"))
    names = nation.join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("FIPS"), "r_name")
    out = county.county_areas(geo_table, farms, names).select("FIPS", "r_name", "n_suppliers", "area_land_km2", "farm_area_km2")
    return _rounded(_rounded(out, "area_land_km2", digits=6), "farm_area_km2")


@query("""
WITH c AS (SELECT c_nationkey::VARCHAR AS FIPS, count(*)::BIGINT AS people FROM customer GROUP BY 1), s AS (SELECT s_nationkey::VARCHAR AS FIPS, round(avg(s_acctbal), 8) AS income FROM supplier GROUP BY 1),
n AS (SELECT n_nationkey::VARCHAR AS FIPS, n_name FROM nation)
SELECT FIPS, n_name, people, income FROM n JOIN c USING (FIPS) JOIN s USING (FIPS)""")
def county_characteristics(spark, sf_dir):
    people = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("FIPS")).agg(F.count("*").alias("people"))
    income = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("FIPS")).agg(F.round(F.avg("s_acctbal"), 8).alias("income"))
    names = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("FIPS"), "n_name")
    return county.county_characteristics(names, people, income, ["FIPS", "n_name", "people", "income"])


_YEARS = tuple(range(1996, 2001))


def _yearly(spark, sf_dir, prefix: str, where: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").where(where).join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").cast("int").alias("fips-int"), F.year("o_orderdate").alias("year"), "o_totalprice")
    wide = rows.groupBy("fips-int").pivot("year", list(_YEARS)).agg(F.sum("o_totalprice"))
    return wide.withColumnsRenamed({str(y): f"{prefix}{y}" for y in _YEARS})


_YEAR_SUMS = ", ".join(f"sum(o_totalprice) FILTER (year(o_orderdate) = {y}) AS v{y}" for y in _YEARS)


@query(f"""
WITH x AS (SELECT c_nationkey AS k, o_orderstatus, o_totalprice, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT k, {_YEAR_SUMS} FROM x WHERE o_orderstatus = 'F' GROUP BY k), b AS (SELECT k, {_YEAR_SUMS} FROM x WHERE o_orderstatus = 'O' AND k % 5 <> 0 GROUP BY k)
SELECT n_nationkey AS k, n_name, {", ".join(f'round(a.v{y} + b.v{y}, 2) AS "tot-fertN-kg-{y}"' for y in _YEARS)}
FROM nation LEFT JOIN (a JOIN b USING (k)) ON n_nationkey = k""")
def farm_plus_nonfarm_aligned(spark, sf_dir):
    total = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("fips-int"), "n_name")
    farm = _yearly(spark, sf_dir, "farmfertN-kg-", "o_orderstatus = 'F'")
    other = _yearly(spark, sf_dir, "nonffertN-kg-", "o_orderstatus = 'O'").where("`fips-int` % 5 <> 0")
    out = county.combine_fertilizer(total, farm, other, _YEARS)
    return out.select(F.col("fips-int").alias("k"), "n_name", *[F.round(F.col(f"`tot-fertN-kg-{y}`"), 2).alias(f"tot-fertN-kg-{y}") for y in _YEARS])


@query(f"""
WITH x AS (SELECT c_nationkey AS k, {_YEAR_SUMS} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY k),
l AS (SELECT k, y.year AS year, round(y.v / nullif(k % 4, 0), 8) AS intensity FROM x, LATERAL (VALUES {", ".join(f"({y}, v{y})" for y in _YEARS)}) AS y(year, v))
SELECT k, year::INT AS year, intensity, (SELECT min(intensity) FROM l) AS vmin, (SELECT max(intensity) FROM l) AS vmax FROM l""")
def intensity_long(spark, sf_dir):
    farm = _yearly(spark, sf_dir, "farmfertN-kg-", "true").withColumn("STCOFIPS", F.col("fips-int").cast("string"))
    land = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("STCOFIPS"), (F.col("n_nationkey") % 4).cast("double").alias("area_land_km2"))
    long = county.intensity_long(county.intensity(farm, land, _YEARS).withColumnRenamed("fips-int", "k"), ["k"], value="intensity")
    long = materialised(_rounded(long, "intensity"))
    return long.crossJoin(F.broadcast(county.value_range(long, "intensity")))  # one row


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END AS k, r_name AS plain, coalesce(r_name, 'Code ' || (n_nationkey % 7)) AS label
FROM nation LEFT JOIN region ON r_regionkey = n_nationkey % 7 WHERE NOT coalesce(CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey END IN (2, 15), false)""")
def state_lookup_default(spark, sf_dir):
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")).alias("k"), (F.col("n_nationkey") % 7).alias("code"))
    dim = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("plain"))
    out = county.lookup(county.exclude(rows, "k", (2, 15)), dim, "code", "plain")
    out = county.lookup(out, dim.withColumnRenamed("plain", "label"), "code", "label", F.concat(F.lit("Code "), F.col("code").cast("string")))
    return out.select("n_nationkey", "k", "plain", "label")


# ---------------------------------------------------------------- soil hierarchy


@query("""
SELECT DISTINCT p_type FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment LIKE 'BU%'""")
def snowflake_like_distinct(spark, sf_dir):
    legend = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lkey"), F.col("c_mktsegment").alias("areasymbol"))
    mapunit = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mukey"), F.col("o_custkey").alias("lkey"))
    component = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cokey"), F.col("l_orderkey").alias("mukey"))
    names = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("cokey"), F.col("p_type").alias("mrulename"))
    return soil.interpretation_names(names, component, mapunit, legend, "BU%").withColumnRenamed("mrulename", "p_type")


@query("""
SELECT o_orderkey AS mukey, c_mktsegment AS areasymbol, o_orderpriority, s.n_lines, round(s.quantity, 2) AS quantity
FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, count(*)::BIGINT AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey WHERE c_mktsegment LIKE 'MA%'""")
def map_units_by_area(spark, sf_dir):
    legend = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lkey"), F.col("c_mktsegment").alias("areasymbol"))
    mapunit = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mukey"), F.col("o_custkey").alias("lkey"), "o_orderpriority")
    attributes = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mukey")).agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return soil.map_units_by_area(mapunit, attributes, legend, "MA%").select("mukey", "areasymbol", "o_orderpriority", "n_lines", "quantity")


@query("""
SELECT o_orderkey AS cokey, o_custkey AS mukey, l_linenumber, l_quantity, first_value(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS first_part
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def component_children(spark, sf_dir):
    component = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cokey"), F.col("o_custkey").alias("mukey"))
    lines = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cokey"), "l_linenumber", "l_partkey", "l_quantity")
    keys = _read(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("mukey"))
    first = catalog.first_per_group(lines, "cokey", ["l_linenumber", "l_partkey"]).select("cokey", F.col("l_partkey").alias("first_part"))
    return soil.children(keys, component, lines).join(first, "cokey").select("cokey", "mukey", "l_linenumber", "l_quantity", "first_part")


@query("""
SELECT p_type AS cropname, min(p_brand) AS yldunits, round(coalesce(sum(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END), 0), 2) AS nonirryield_r,
round(coalesce(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END), 0), 2) AS irryield_r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def yield_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    crops = rows.select(
        F.col("p_type").alias("cropname"), F.col("p_brand").alias("yldunits"), F.when(F.col("l_linenumber") == 3, "(D)").otherwise(F.col("l_quantity").cast("string")).alias("nonirryield_r"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast("string")).alias("irryield_r"),
    )
    return _rounded(soil.crop_yield_summary(crops), "nonirryield_r", "irryield_r", digits=2)


@query("""
WITH h AS (SELECT l_orderkey AS cokey, greatest((l_linenumber - 1) * 10, 5) AS t, least(l_linenumber * 10, 45) AS b, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS q, l_tax AS x FROM lineitem)
SELECT cokey, round(sum(q * (b - t)) / nullif(sum(CASE WHEN q IS NOT NULL THEN b - t END), 0), 8) AS q, round(sum(x * (b - t)) / sum(b - t), 8) AS x FROM h WHERE b > t GROUP BY 1""")
def depth_weighted(spark, sf_dir):
    n = F.col("l_linenumber")
    horizons = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cokey"), ((n - 1) * 10).alias("hzdept_r"), (n * 10).alias("hzdepb_r"), F.when(n != 2, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("x"))
    return _rounded(soil.depth_weighted(horizons, ["q", "x"], 5, 45), "q", "x")


@query("""
WITH m AS (SELECT o_orderkey AS mukey, o_custkey, sum(l_discount * l_quantity) / sum(l_quantity) AS d FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT c_nationkey::VARCHAR AS FIPS, round(sum(d * c_acctbal) / nullif(sum(CASE WHEN d IS NOT NULL THEN c_acctbal END), 0), 8) AS d FROM m JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1""")
def area_weighted(spark, sf_dir):
    component = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mukey"), F.col("l_quantity").alias("comppct_r"), F.col("l_discount").alias("d"))
    overlap = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("mukey"), F.col("c_nationkey").cast("string").alias("FIPS"), F.col("c_acctbal").alias("area"))
    return _rounded(soil.rollup_to_county(soil.rollup_to_map_unit(component, ["d"]), overlap, "area", ["d"]), "d")


# ---------------------------------------------------------------- comparing and profiling


def _perturbed(lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_quantity", "l_returnflag").groupBy("k").agg(F.min("l_quantity").alias("l_quantity"), F.min("l_returnflag").alias("l_returnflag"))
    k = F.col("k")
    other = rows.where(k % 101 != 0).withColumn("l_quantity", F.when(k % 97 == 0, None).otherwise(F.col("l_quantity"))).withColumn("l_returnflag", F.when(k % 89 == 0, F.lit("?")).otherwise(F.col("l_returnflag")))
    return rows.where(k % 103 != 0), other


_PERTURBED = """
r AS (SELECT l_orderkey * 10 + l_linenumber AS k, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY 1), a AS (SELECT * FROM r WHERE k % 103 <> 0),
b AS (SELECT k, CASE WHEN k % 97 = 0 THEN NULL ELSE q END AS q, CASE WHEN k % 89 = 0 THEN '?' ELSE f END AS f FROM r WHERE k % 101 <> 0),
d AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side,
CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.q IS DISTINCT FROM b.q THEN 'l_quantity' END, CASE WHEN a.f IS DISTINCT FROM b.f THEN 'l_returnflag' END) END AS columns FROM a FULL JOIN b ON a.k = b.k),
bad AS (SELECT * FROM d WHERE side <> 'both' OR columns <> '')"""


@query(f"WITH {_PERTURBED} SELECT * FROM bad")
def table_diff(spark, sf_dir):
    a, b = _perturbed(_read(spark, sf_dir, "lineitem"))
    return quality.table_diff(a, b, ["k"]).withColumn("columns", F.array_join("columns", ","))


@query(f"""WITH {_PERTURBED} SELECT (SELECT count(*) FROM a) = (SELECT count(*) FROM b) AS same_rows, true AS same_columns, count(*)::BIGINT AS n_bad, min(k) AS first_bad, max(k) AS last_bad,
max(k) - min(k) = count(*) - 1 AS contiguous FROM bad""")
def diff_summary(spark, sf_dir):
    a, b = _perturbed(_read(spark, sf_dir, "lineitem"))
    return quality.diff_summary(a, b, ["k"], "k")


_EVENT_COLUMNS = (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count(*)::BIGINT AS n_rows, count(v)::BIGINT AS n_values, (count(DISTINCT v) + max((v IS NULL)::INT))::BIGINT AS n_distinct FROM (SELECT {'CASE WHEN value >= 5 THEN value END' if c == 'value' else c} AS v FROM events)" for c, t in _EVENT_COLUMNS))
def column_profile(spark, sf_dir):
    events = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") >= 5, F.col("value")).alias("value"))
    return quality.profile(events).join(quality.distinct_counts(events), "column")


@query("""
SELECT k::INT AS ord, least(5000, n - 5000 * k)::BIGINT AS rows_found, true AS ok FROM (SELECT n, unnest(generate_series(0, (n - 1) // 5000)) AS k FROM (SELECT count(*) AS n FROM orders))""")
def chunk_audit(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    path = _new_path(spark, "chunks")
    sinks.write_chunks(orders, path, "orders.csv", 5000, scan=True)
    manifest = files.read_manifest(spark, f"{path}/manifest")
    scan = spark.read.schema(orders.schema).option("header", True).csv(f"{path}/chunks")
    return quality.chunk_audit(scan, manifest).join(manifest.select("filename", "ord"), "filename").select("ord", "rows_found", "ok")


_CHANGED = "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END"
_ORDERED = f"""r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey, o_totalprice AS p, {_CHANGED} AS q, count(*) OVER () AS n FROM orders),
bad AS (SELECT row_no, n, CASE WHEN row_no >= n - 7 THEN 'left_only' ELSE 'both' END AS side, CASE WHEN row_no >= n - 7 THEN '' ELSE 'o_totalprice' END AS columns FROM r WHERE row_no >= n - 7 OR p IS DISTINCT FROM q)"""


def _two_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The orders as CSV in order, and another export of them: some values differ and the last seven rows are missing."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    last = positions.numbered(orders, ["o_orderkey"])
    kept = last.where(F.col("row_no") < orders.count() - 7).drop("row_no").withColumn("o_totalprice", F.expr(_CHANGED))
    paths = [_csv(df.orderBy("o_orderkey"), label) for df, label in ((orders, "left"), (kept, "right"))]
    left, right = (spark.read.schema(orders.schema).option("header", True).csv(p) for p in paths)
    return left, right


@query(f"WITH {_ORDERED} SELECT row_no, side, columns FROM bad")
def positional_diff(spark, sf_dir):
    return positions.diff_by_position(*_two_files(spark, sf_dir)).withColumn("columns", F.array_join("columns", ","))


@query(f"""WITH {_ORDERED}, b AS (SELECT row_no // 400 AS batch, count(*) AS n_bad, min(row_no) AS first_bad, max(row_no) AS last_bad FROM bad GROUP BY 1)
SELECT row_no // 400 AS batch, count(*) AS rows_a, count(*) FILTER (row_no < n - 7) AS rows_b, coalesce(any_value(n_bad), 0) AS n_bad, any_value(first_bad) AS first_bad, any_value(last_bad) AS last_bad,
any_value(last_bad - first_bad = n_bad - 1) AS contiguous FROM r LEFT JOIN b ON batch = row_no // 400 GROUP BY 1""")
def diff_batches(spark, sf_dir):
    left, right = _two_files(spark, sf_dir)
    return positions.diff_batches(positions.line_numbers(left), positions.line_numbers(right), 400)


# ---------------------------------------------------------------- space

#: Per label: a rectangle over the middle of its points with a hole, and a triangle beside it.
_ZONES = """
z AS (SELECT label AS zone, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM p GROUP BY 1)"""


def _embedding_points(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), "label", scalars.rounded(F.col("embedding")[0].cast("double"), 6).alias("x"), scalars.rounded(F.col("embedding")[1].cast("double"), 6).alias("y"))


def _embedding_zones(points: DataFrame) -> DataFrame:
    box = points.groupBy(F.col("label").alias("zone")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))

    def ring(*corners: tuple[float, float]):
        along = lambda axis, u: F.format_string("%.6f", scalars.rounded(F.col(f"{axis}1") + (F.col(f"{axis}2") - F.col(f"{axis}1")) * u, 6))
        at = [F.concat_ws(" ", along("x", u), along("y", v)) for u, v in (*corners, corners[0])]
        return F.concat(F.lit("("), F.concat_ws(", ", *at), F.lit(")"))

    outer, hole = ring((0.1, 0.1), (0.6, 0.1), (0.6, 0.7), (0.1, 0.7)), ring((0.3, 0.3), (0.4, 0.3), (0.4, 0.5), (0.3, 0.5))
    return box.select("zone", F.concat(F.lit("MULTIPOLYGON (("), outer, F.lit(", "), hole, F.lit("), ("), ring((0.7, 0.1), (0.95, 0.1), (0.7, 0.9)), F.lit("))")).alias("wkt"))


_AT = lambda axis, u: f"round({axis}1 + ({axis}2 - {axis}1) * {u}, 6)"
_INSIDE = f"""((x >= {_AT("x", 0.1)} AND x < {_AT("x", 0.6)} AND y >= {_AT("y", 0.1)} AND y < {_AT("y", 0.7)})
AND NOT (x >= {_AT("x", 0.3)} AND x < {_AT("x", 0.4)} AND y >= {_AT("y", 0.3)} AND y < {_AT("y", 0.5)}))
OR (x >= {_AT("x", 0.7)} AND y >= {_AT("y", 0.1)} AND y < {_AT("y", 0.9)} AND x < {_AT("x", 0.95)} + (y - {_AT("y", 0.1)}) * ({_AT("x", 0.7)} - {_AT("x", 0.95)}) / ({_AT("y", 0.9)} - {_AT("y", 0.1)}))"""
_POINTS = "p AS (SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings)"


_CORNERS = ((0, 0, 0.1, 0.1), (0, 0, 0.6, 0.1), (0, 0, 0.6, 0.7), (0, 0, 0.1, 0.7), (0, 1, 0.3, 0.3), (0, 1, 0.4, 0.3), (0, 1, 0.4, 0.5), (0, 1, 0.3, 0.5), (1, 0, 0.7, 0.1), (1, 0, 0.95, 0.1), (1, 0, 0.7, 0.9))
_RING_ENDS = [c for c in _CORNERS if [d[:2] for d in _CORNERS].index(c[:2]) == _CORNERS.index(c)]
_VERTICES = f"""va AS (SELECT zone, part, ring, row_number() OVER (PARTITION BY zone, part, ring ORDER BY k) - 1 AS ord, round(x1 + (x2 - x1) * u, 6) AS x, round(y1 + (y2 - y1) * v, 6) AS y
  FROM z, (VALUES {", ".join(str((k, *c)) for k, c in enumerate((*_CORNERS, *_RING_ENDS)))}) c(k, part, ring, u, v))"""


@query(f"WITH {_POINTS}, {_ZONES} SELECT vec_id AS point_id, zone FROM p, z WHERE {_INSIDE}")
def point_in_zone(spark, sf_dir):
    points = _embedding_points(spark, sf_dir)
    return geo.point_in_zone(points, geo.wkt_to_edges(_embedding_zones(points)))


_EDGES = "SELECT zone, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {} WINDOW w AS (PARTITION BY zone, part, ring ORDER BY ord) QUALIFY x2 IS NOT NULL"
_SIDE = lambda s, p, k: f"sign(({s}.x2 - {s}.x1) * ({p}.y{k} - {s}.y1) - ({s}.y2 - {s}.y1) * ({p}.x{k} - {s}.x1))"
_WITHIN = lambda v, e: f"SELECT v.zone AS own, e.zone AS other FROM (SELECT * FROM {v} WHERE ord = 0) v JOIN {e} e ON v.y >= least(e.y1, e.y2) AND v.y < greatest(e.y1, e.y2) WHERE e.x1 + (v.y - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > v.x GROUP BY v.zone, v.part, v.ring, e.zone HAVING count(*) % 2 = 1"


@query(f"""
WITH {_POINTS}, {_ZONES},
{_VERTICES},
vb AS (SELECT vec_id AS zone, 0 AS part, 0 AS ring, ord, round(x + dx, 6) AS x, round(y + dy, 6) AS y FROM p, (VALUES (0, -0.02, -0.01), (1, 0.02, -0.01), (2, 0.02, 0.01), (3, -0.02, 0.01), (4, -0.02, -0.01)) c(ord, dx, dy)),
ea AS ({_EDGES.format("va")}), eb AS ({_EDGES.format("vb")}),
crossed AS (SELECT ea.zone AS a, eb.zone AS b FROM ea JOIN eb ON least(ea.x1, ea.x2) <= greatest(eb.x1, eb.x2) AND least(eb.x1, eb.x2) <= greatest(ea.x1, ea.x2) AND least(ea.y1, ea.y2) <= greatest(eb.y1, eb.y2)
  AND least(eb.y1, eb.y2) <= greatest(ea.y1, ea.y2) WHERE {_SIDE("ea", "eb", 1)} * {_SIDE("ea", "eb", 2)} <= 0 AND {_SIDE("eb", "ea", 1)} * {_SIDE("eb", "ea", 2)} <= 0)
SELECT a AS region, b AS zone FROM crossed UNION SELECT own, other FROM ({_WITHIN("va", "eb")}) UNION SELECT other, own FROM ({_WITHIN("vb", "ea")})""")
def areas_that_meet(spark, sf_dir):
    points = _embedding_points(spark, sf_dir)
    corners = F.array(*[F.struct(F.lit(i).alias("ord"), scalars.rounded(F.col("x") + dx, 6).alias("x"), scalars.rounded(F.col("y") + dy, 6).alias("y")) for i, (dx, dy) in enumerate(((-0.02, -0.01), (0.02, -0.01), (0.02, 0.01), (-0.02, 0.01), (-0.02, -0.01)))])
    units = points.select(F.col("point_id").alias("zone"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.inline(corners))
    return geo.area_map_units(units, geo.wkt_to_vertices(_embedding_zones(points)))


_PIXELS = "px AS (SELECT 2020 + vec_id % 3 AS year, round(x, 1) AS y, x AS value, round(y, 2) AS x FROM p)"


@query(f"""
WITH {_POINTS}, {_ZONES}, {_PIXELS}, i AS (SELECT zone, year, avg(value) AS mean, sum(value) AS sum, count(*) AS count FROM px, z WHERE {_INSIDE} GROUP BY ALL)
SELECT z.zone, y.year::INT AS year, round(mean, 8) AS mean_surplus_kgha, round(sum, 8) AS raw_sum, round(sum * 6.25, 8) AS total_kg_N, coalesce(count, 0)::BIGINT AS pixel_count
FROM z CROSS JOIN (SELECT DISTINCT year FROM px) y LEFT JOIN i ON i.zone = z.zone AND i.year = y.year""")
def zonal_stats(spark, sf_dir):
    points = _embedding_points(spark, sf_dir)
    zones = _embedding_zones(points)
    pixels = points.select((2020 + F.col("point_id") % 3).cast("int").alias("year"), scalars.rounded(F.col("x"), 1).alias("py"), F.col("x").alias("value"), scalars.rounded(F.col("y"), 2).alias("px")).select("year", F.col("px").alias("x"), F.col("py").alias("y"), "value")
    stats = geo.zonal_stats(pixels, geo.wkt_to_edges(zones), zones.select("zone"))
    out = stats.select("zone", "year", F.col("mean").alias("mean_surplus_kgha"), F.col("sum").alias("raw_sum"), (F.col("sum") * raster.PIXEL_HECTARES).alias("total_kg_N"), F.col("count").alias("pixel_count"))
    return _rounded(out, "mean_surplus_kgha", "raw_sum", "total_kg_N")


@query(f"""
WITH {_POINTS}, {_ZONES}, {_PIXELS}, i AS (SELECT zone, year, avg(value) AS mean, sum(value) AS sum, count(*) AS count FROM px, z WHERE {_INSIDE} GROUP BY ALL),
s(code, state) AS (VALUES ('01', 'AL'), ('04', 'AZ'), ('05', 'AR'), ('06', 'CA'), ('08', 'CO'), ('09', 'CT'), ('10', 'DE'), ('11', 'DC'), ('12', 'FL'), ('13', 'GA'), ('16', 'ID'), ('17', 'IL'), ('18', 'IN'), ('19', 'IA'), ('20', 'KS')),
c AS (SELECT zone, lpad((zone % 60 + 1)::VARCHAR, 2, '0') AS code FROM z)
SELECT y.year::INT AS year, c.zone AS "GEOID", c.code AS "STATEFP", s.state AS "STATE", 'COUNTYFP ' || c.zone AS "COUNTYFP", 'NAME ' || c.zone AS "NAME", 'NAMELSAD ' || c.zone AS "NAMELSAD",
round(mean, 8) AS mean_surplus_kgha, round(sum, 8) AS raw_sum, round(sum * 6.25, 8) AS "total_kg_N", coalesce(count, 0)::BIGINT AS pixel_count
FROM c CROSS JOIN (SELECT DISTINCT year FROM px) y LEFT JOIN i ON i.zone = c.zone AND i.year = y.year LEFT JOIN s ON s.code = c.code WHERE c.code NOT IN ('02', '15', '60')""")
def surplus_panel(spark, sf_dir):
    points = _embedding_points(spark, sf_dir)
    code = F.lpad((F.col("label") % 60 + 1).cast("string"), 2, "0")
    counties = points.select("label").distinct().select(F.col("label").alias("GEOID"), code.alias("STATEFP"), *[F.concat(F.lit(f"{n} "), F.col("label").cast("string")).alias(n) for n in ("COUNTYFP", "NAME", "NAMELSAD")])
    pixels = points.select((2020 + F.col("point_id") % 3).cast("int").alias("year"), scalars.rounded(F.col("y"), 2).alias("x"), scalars.rounded(F.col("x"), 1).alias("y"), F.col("x").alias("value"))
    return _rounded(panel.surplus_panel(pixels, geo.wkt_to_edges(_embedding_zones(points)), counties, county.state_table(spark)), "mean_surplus_kgha", "raw_sum", "total_kg_N")


@query("""
SELECT n_nationkey AS county, y.year, n.n AS n_customers, round(o.total, 4) AS total, s.n AS n_suppliers
FROM nation CROSS JOIN (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders) y
LEFT JOIN (SELECT c_nationkey AS k, year(o_orderdate) AS year, count(DISTINCT c_custkey)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL) n ON n.k = n_nationkey AND n.year = y.year
LEFT JOIN (SELECT c_nationkey AS k, year(o_orderdate) AS year, sum(o_totalprice) AS total FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY ALL) o ON o.k = n_nationkey AND o.year = y.year
LEFT JOIN (SELECT s_nationkey AS k, 1995 AS year, count(*)::BIGINT AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey AND s.year = y.year""")
def county_year_panel(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate")).withColumn("county", F.col("c_nationkey"))
    base = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("county")).crossJoin(F.broadcast(_read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()))
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy("county", "year").agg(F.count_distinct("c_custkey").alias("n_customers"))
    rich = orders.where("c_acctbal > 5000").groupBy("county", "year").agg(F.round(F.sum("o_totalprice"), 4).alias("total"))
    sellers = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("county")).agg(F.count("*").alias("n_suppliers")).withColumn("year", F.lit(1995))
    return panel.county_year_panel(base, urgent, rich, sellers)


@query(f"WITH {_POINTS}, {_ZONES}, {_VERTICES} SELECT zone::VARCHAR AS zone, part::INT AS part, ring::INT AS ring, ord::INT AS ord, x, y FROM va")
def geojson_features(spark, sf_dir):
    path = _new_path(spark, "features")
    geo.to_geojson(geo.wkt_to_vertices(_embedding_zones(_embedding_points(spark, sf_dir)))).select("feature").write.text(path)
    return geo.from_geojson(spark.read.text(path), "value")


@query("""
WITH f AS (SELECT s_suppkey AS zone, '{"type":"Feature","properties":{"zone":"' || s_suppkey || '"},"geometry":{"type":"MultiPolygon","coordinates":[[[[' || s_suppkey || '.0,0.5],[' || (s_suppkey + 1) || '.0,0.5],[' || (s_suppkey + 1) || '.0,2.5],[' || s_suppkey || '.0,0.5]]]]}}' AS feature FROM supplier)
SELECT zone // 50 AS sheet, '{"type":"FeatureCollection","features":[' || string_agg(feature, ',' ORDER BY zone) || ']}' AS collection FROM f GROUP BY 1""")
def geojson_collection(spark, sf_dir):
    k = lambda n: (F.col("s_suppkey") + n).cast("string")
    wkt = F.concat(F.lit("POLYGON(("), k(0), F.lit(" 0.5,"), k(1), F.lit(" 0.5,"), k(1), F.lit(" 2.5,"), k(0), F.lit(" 0.5))"))
    zones = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("zone"), wkt.alias("wkt"))
    features = geo.to_geojson(geo.wkt_to_vertices(zones)).withColumn("sheet", F.floor(F.col("zone") / 50))
    return geo.feature_collection(features, "sheet")


@query(f"""
WITH {_POINTS}, v AS (SELECT vec_id, k, round(x + 0.01 * cos(2 * pi() * (k % 64) / 64), 9) AS vx, round(y + 0.01 * sin(2 * pi() * (k % 64) / 64), 9) AS vy FROM p, range(65) r(k)),
e AS (SELECT vec_id, vx AS x1, vy AS y1, lead(vx) OVER (PARTITION BY vec_id ORDER BY k) AS x2, lead(vy) OVER (PARTITION BY vec_id ORDER BY k) AS y2 FROM v)
SELECT vec_id AS point_id, count(*)::BIGINT AS n_vertices, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 7) AS area FROM e GROUP BY 1""")
def buffer_point(spark, sf_dir):
    disks = geo.buffer_point(_embedding_points(spark, sf_dir), "x", "y")
    v = geo.wkt_to_edges(disks, "point_id", "region")
    area = F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2
    levels = geo.wkt_to_vertices(disks, "point_id", "region").groupBy("zone").agg(F.count("*").alias("n_vertices"))
    return v.groupBy("zone").agg(F.round(area, 7).alias("area")).join(levels, "zone").select(F.col("zone").alias("point_id"), "n_vertices", F.col("area"))


#: EPSG:5070 written out in SQL: the ellipsoid by its inverse flattening, parallels 29.5 and 45.5, origin 23 N 96 W.
_ALBERS = """e AS (SELECT 2 / 298.257222101 - 1 / 298.257222101 / 298.257222101 AS e2),
h AS (SELECT id, lon, lat, e2, sqrt(e2) AS e, sin(radians(lat)) AS s FROM l CROSS JOIN e),
q AS (SELECT id, lon, cos(radians(lat)) / sqrt(1 - e2 * s * s) AS m, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q FROM h),
k AS (SELECT (a.m * a.m - b.m * b.m) / (b.q - a.q) AS n, a.m * a.m + (a.m * a.m - b.m * b.m) / (b.q - a.q) * a.q AS c, o.q AS q0 FROM q a, q b, q o WHERE a.id = -1 AND b.id = -2 AND o.id = -3),
t AS (SELECT id, 6378137.0 * sqrt(c - n * q) / n AS rho, n * radians(lon + 96.0) AS theta, 6378137.0 * sqrt(c - n * q0) / n AS rho0 FROM q CROSS JOIN k),
xy AS (SELECT id, rho * sin(theta) AS x, rho0 - rho * cos(theta) AS y FROM t)"""
_LONLAT = "l(id, lon, lat) AS (SELECT event_id, -120 + (user_id % 50), 25 + (event_id % 25) FROM events UNION ALL VALUES (-1, 0, 29.5), (-2, 0, 45.5), (-3, 0, 23), (-4, -110.5, 30.5), (-5, -85.5, 43.5))"


@query(f"WITH {_LONLAT}, {_ALBERS} SELECT id AS event_id, round(x, 3) AS x, round(y, 3) AS y FROM xy WHERE id >= 0")
def albers_xy(spark, sf_dir):
    x, y = geo_functions.albers((F.col("user_id") % 50 - 120).cast("double"), (F.col("event_id") % 25 + 25).cast("double"))
    return _read(spark, sf_dir, "events").select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""
WITH {_LONLAT}, {_ALBERS}
SELECT p.id AS event_id FROM xy p, xy sw, xy ne WHERE sw.id = -4 AND ne.id = -5 AND p.id >= 0 AND p.x BETWEEN sw.x AND ne.x AND p.y BETWEEN sw.y AND ne.y""")
def bbox_filter(spark, sf_dir):
    x, y = geo_functions.albers((F.col("user_id") % 50 - 120).cast("double"), (F.col("event_id") % 25 + 25).cast("double"))
    projected = _read(spark, sf_dir, "events").select("event_id", x.alias("x"), y.alias("y"))
    return geo_functions.bbox_filter(projected, "x", "y", (-110.5, 30.5, -85.5, 43.5)).select("event_id")


@query("""
WITH RECURSIVE d(start, node) AS (SELECT c_custkey, c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT start, node // 2 FROM d WHERE node > 0)
SELECT start AS region, s_name AS site_uid FROM d JOIN supplier ON s_suppkey = node""")
def downstream_closure(spark, sf_dir):
    customer = _read(spark, sf_dir, "customer")
    regions = customer.where("c_acctbal > 9000").select(F.col("c_custkey").alias("region"), F.col("c_custkey").alias("node"))
    flows = customer.where("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"))
    return geo.downstream_sites(regions, flows, _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("site_uid")))


@query("""
SELECT p_size AS code, CASE p_size WHEN 1 THEN 'Corn' WHEN 2 THEN 'Cotton' WHEN 3 THEN 'Rice' WHEN 4 THEN 'Sorghum' WHEN 5 THEN 'Soybeans' WHEN 6 THEN 'Sunflower' WHEN 21 THEN 'Barley' WHEN 22 THEN 'Durum Wheat'
WHEN 23 THEN 'Spring Wheat' WHEN 24 THEN 'Winter Wheat' WHEN 36 THEN 'Alfalfa' WHEN 37 THEN 'Other Hay/Non Alfalfa' ELSE 'Code ' || p_size END AS label, count(*)::BIGINT AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS percent
FROM part GROUP BY p_size ORDER BY n DESC, code LIMIT 8""")
def class_coverage_topk(spark, sf_dir):
    pixels = _read(spark, sf_dir, "part").select(F.col("p_size").alias("code"))
    return _rounded(raster.class_coverage(pixels, "code", raster.crop_labels(spark), 8), "percent", digits=6)


# ---------------------------------------------------------------- weather, landed responses


@query("""
WITH d AS (SELECT user_id, ts::DATE AS date, avg(value) / 10 AS m, max(value) / 10 AS hi, min(value) / 10 AS lo, CASE WHEN min(event_id) % 5 = 0 THEN 0 ELSE (count(*) % 9)::DOUBLE END AS solar FROM events GROUP BY ALL)
SELECT user_id, date, round(CASE WHEN solar / 0.408 <= 0 THEN 0 ELSE 0.0023 * (m + 17.8) * sqrt(greatest(hi - lo, 0)) * solar / 0.408 END, 8) AS et0 FROM d""")
def et0_hargreaves(spark, sf_dir):
    days = _read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(
        (F.avg("value") / 10).alias("m"), (F.max("value") / 10).alias("hi"), (F.min("value") / 10).alias("lo"), F.when(F.min("event_id") % 5 == 0, 0.0).otherwise((F.count("*") % 9).cast("double")).alias("solar")
    )
    return days.select("user_id", "date", F.round(weather.hargreaves_et0(F.col("m"), F.col("hi"), F.col("lo"), F.col("solar")), 8).alias("et0"))


@query("""
WITH d AS (SELECT user_id, ts::DATE AS date, avg(value) / 10 + 5 AS m, max(value) / 10 + 8 AS hi, min(value) / 10 AS lo FROM events GROUP BY ALL),
v AS (SELECT *, 0.6108 * exp(17.27 * m / (m + 237.3)) AS em, 0.6108 * exp(17.27 * hi / (hi + 237.3)) AS eh, 0.6108 * exp(17.27 * lo / (lo + 237.3)) AS el, radians(42.0) AS phi, 2 * pi() / 365 * dayofyear(date) AS turn FROM d),
w AS (SELECT *, (eh + el) / 2 AS es, (eh + el) / 2 * 65.0 / 100 AS ea, 4098 * em / pow(m + 237.3, 2) AS slope, 0.000665 * 101.3 * pow((293 - 0.0065 * 300.0) / 293, 5.26) AS gamma, 0.409 * sin(turn - 1.39) AS tilt FROM v),
x AS (SELECT *, acos(greatest(least(-tan(phi) * tan(tilt), 1.0), -1.0)) AS sunset FROM w),
y AS (SELECT *, 24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(turn)) * (sunset * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(sunset)) AS ra FROM x),
n AS (SELECT *, 0.77 * 14.0 - 4.903e-9 * (pow(hi + 273.16, 4) + pow(lo + 273.16, 4)) / 2 * (0.34 - 0.14 * sqrt(ea)) * (1.35 * least(14.0 / ((0.75 + 2e-5 * 300.0) * ra), 1.0) - 0.35) AS net FROM y)
SELECT user_id, date, round((0.408 * slope * net + gamma * 900 / (m + 273) * 2.0 * (es - ea)) / (slope + gamma * (1 + 0.34 * 2.0)), 8) AS et0 FROM n""")
def et0_penman_monteith(spark, sf_dir):
    days = _read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg((F.avg("value") / 10 + 5).alias("m"), (F.max("value") / 10 + 8).alias("hi"), (F.min("value") / 10).alias("lo"))
    et0 = weather.penman_monteith_et0(F.col("m"), F.col("hi"), F.col("lo"), F.lit(65.0), F.lit(2.0), F.lit(14.0), F.lit(300.0), F.lit(42.0), F.dayofyear("date"))
    return days.select("user_id", "date", F.round(et0, 8).alias("et0"))


@query("""
SELECT user_id AS point, ts::DATE AS date, round(avg((props->>'k')::DOUBLE), 8) AS T2M, round(max((props->>'k')::DOUBLE), 8) AS T2M_MAX FROM events GROUP BY ALL""")
def json_long_wide(spark, sf_dir):
    k = F.from_json("props", "k double")["k"]
    days = _read(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyyMMdd").alias("day"), k.alias("k")).groupBy("user_id", "day").agg(F.round(F.avg("k"), 8).alias("avg"), F.round(F.max("k"), 8).alias("max"))
    by_day = lambda c: F.map_from_entries(F.collect_list(F.struct("day", c)))
    landed = days.groupBy(F.col("user_id").alias("point")).agg(F.to_json(F.struct(F.struct(F.struct(by_day("avg").alias("T2M"), by_day("max").alias("T2M_MAX")).alias("parameter")).alias("properties"))).alias("json"))
    return responses.weather_from_json(landed).select("point", "date", "T2M", "T2M_MAX")


@query("""
SELECT n_name AS county_name, CASE WHEN n_nationkey % 3 = 0 THEN '(D)' ELSE format('{:,}', n_nationkey * 1234) END AS "Value", CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE (n_nationkey * 1234)::DOUBLE END AS value_num,
CASE WHEN n_nationkey % 2 = 0 THEN 'BU' ELSE '' END AS unit_desc FROM nation""")
def crop_records(spark, sf_dir):
    k = F.col("n_nationkey")
    record = F.struct(F.col("n_name").alias("county_name"), F.when(k % 3 == 0, "(D)").otherwise(F.format_number(k * 1234, 0)).alias("Value"), F.when(k % 2 == 0, "BU").alias("unit_desc"))
    landed = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(record).alias("data"))).alias("json"))
    out = responses.crop_stats_from_json(landed)
    return out.select("county_name", "Value", scalars.value_number(F.col("Value")).alias("value_num"), "unit_desc")


@query("""
SELECT n_name AS title, n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'd' || n_nationkey ELSE '' END AS doi, '' AS url FROM nation""")
def catalog_records(spark, sf_dir):
    k = F.col("n_nationkey")
    record = F.struct(F.col("n_name").alias("title"), k.cast("long").alias("id"), F.when(k % 2 == 0, F.concat(F.lit("d"), k.cast("string"))).alias("doi"))
    return responses.catalog_from_json(_read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(record)).alias("json")))


@query("""
SELECT c_custkey::VARCHAR AS mukey, c_name AS muname, round(c_acctbal, 2)::VARCHAR AS aws FROM customer""")
def response_rows(spark, sf_dir):
    cells = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_acctbal").cast("string"))
    rows = _read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_list(cells).alias("r"))
    header = F.array(F.array(F.lit("mukey"), F.lit("muname"), F.lit("aws")))
    return responses.table_from_rows(rows.select(F.to_json(F.struct(F.concat(header, "r").alias("Table"))).alias("json")), ["mukey", "muname", "aws"])


# ---------------------------------------------------------------- files written and read back


def _new_path(spark: SparkSession, label: str) -> str:
    """A new folder's name below the session's checkpoint folder, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        materialised(spark.range(1))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, label: str, **options) -> str:
    path = _new_path(df.sparkSession, label)
    df.write.options(header=True, **options).csv(path)
    return path


def _raw_readings(spark, sf_dir) -> DataFrame:
    """Readings as text: padded sites, two offsets, some NaN."""
    value = F.when(F.col("event_id") % 7 == 0, "NaN").otherwise(F.col("value").cast("string"))
    when = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "-05").otherwise("-06"))
    columns = [F.concat(F.col("user_id").cast("string"), F.lit("  ")).alias("site_uid"), when.alias("datetime"), value.alias("nitrate_con")]
    return _read(spark, sf_dir, "events").select(*columns, *[F.lit(None).cast("string").alias(c) for c in schemas.MEASURES[1:]])


_READINGS = """r AS (SELECT user_id::VARCHAR AS site_uid, date_trunc('second', ts) + CASE WHEN event_id % 2 = 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 6 HOUR END AS datetime, CASE WHEN event_id % 7 <> 0 THEN value END AS nitrate_con FROM events)"""


@query(f"WITH {_READINGS} SELECT site_uid, count(*)::BIGINT AS n, count(nitrate_con)::BIGINT AS n_values, round(avg(nitrate_con), 8) AS mean, strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS first FROM r GROUP BY 1")
def readings_from_csv(spark, sf_dir):
    read = files.read_readings(spark, _csv(_raw_readings(spark, sf_dir), "readings", ignoreTrailingWhiteSpace=False))
    return read.groupBy("site_uid").agg(F.count("*").alias("n"), F.count("nitrate_con").alias("n_values"), F.round(F.avg("nitrate_con"), 8).alias("mean"), F.date_format(F.min("datetime"), "yyyy-MM-dd HH:mm:ss").alias("first"))


@query(f"WITH {_READINGS} SELECT nitrate_con, count(*)::BIGINT AS n FROM r WHERE site_uid = '7' GROUP BY ALL")
def site_partition(spark, sf_dir):
    path = _new_path(spark, "by-site")
    sinks.write_by_site(files.cleaned_readings(_raw_readings(spark, sf_dir).withColumn("nitrate_con", F.col("nitrate_con").cast("double"))), path)
    return files.read_site(spark, path, "7 ").groupBy("nitrate_con").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS uid, s_acctbal AS latitude, s_nationkey::DOUBLE AS longitude FROM supplier WHERE s_suppkey % 10 <> 3")
def tolerant_sites(spark, sf_dir):
    latitude = F.when(F.col("s_suppkey") % 10 == 3, "north").otherwise(F.col("s_acctbal").cast("string"))
    rows = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("uid"), latitude.alias("latitude"), F.col("s_nationkey").alias("longitude"))
    return files.read_sites(spark, _csv(rows, "sites"))[0]


@query("""
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 700)::INT AS ord, 'orders.csv' AS original_filename FROM orders""")
def chunks_appended(spark, sf_dir):
    path, rows = _new_path(spark, "chunks"), _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sinks.write_chunks(rows, path, "orders.csv", 700, by=["o_orderkey"])
    manifest = files.read_manifest(spark, f"{path}/manifest")
    return files.read_chunks(spark, f"{path}/chunks", manifest, rows.schema).join(F.broadcast(manifest.select("ord", "original_filename")), "ord")


@query("SELECT c_custkey::VARCHAR AS FIPS, c_acctbal AS value FROM customer")
def keyed_csv(spark, sf_dir):
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("FIPS"), F.col("c_acctbal").alias("value"))
    return files.read_keyed_csv(spark, _csv(rows, "keyed", sep=";"), rows.schema, ";")


@query("SELECT event_type AS parameter_code, user_id::VARCHAR AS monitoring_location_id, count(*)::BIGINT AS n, round(avg(value), 8) AS mean FROM events GROUP BY ALL")
def gauge_series(spark, sf_dir):
    path = _new_path(spark, "gauge")
    _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("monitoring_location_id"), F.col("event_type").alias("parameter_code"), F.col("ts").cast("timestamp").alias("time"), "value").write.parquet(path)
    return files.read_gauge(spark, path, "continuous").groupBy("parameter_code", "monitoring_location_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"))


@query(f"WITH {_POINTS}, {_ZONES} SELECT zone::VARCHAR AS GEOID, 'zone ' || zone AS NAME, 14::BIGINT AS n_vertices, round({_AT('x', 0.1)}, 6) AS west FROM z")
def zones_from_text(spark, sf_dir):
    zones = _embedding_zones(_embedding_points(spark, sf_dir))
    rows = zones.select(F.col("zone").cast("string").alias("GEOID"), F.concat(F.lit("zone "), F.col("zone").cast("string")).alias("NAME"), "wkt")
    read = files.read_zones(spark, _csv(rows, "zones", sep="\t"), "NAME")
    vertices = geo.wkt_to_vertices(read, "GEOID").groupBy(F.col("zone").alias("GEOID")).agg(F.count("*").alias("n_vertices"), F.round(F.min("x"), 6).alias("west"))
    return read.select("GEOID", "NAME").join(vertices, "GEOID")


@query(f"WITH {_POINTS}, {_ZONES} SELECT zone::VARCHAR AS zone FROM z WHERE zone = 3")
def region_by_name(spark, sf_dir):
    zones = _embedding_zones(_embedding_points(spark, sf_dir)).withColumn("NAME", F.concat(F.lit("zone "), F.col("zone").cast("string")))
    return geo.select_region(zones, "zone 3").select(F.col("zone").cast("string").alias("zone"))


@query(f"WITH {_LONLAT}, {_ALBERS} SELECT id AS zone, round(x, 3) AS x, round(y, 3) AS y FROM xy WHERE id >= 0")
def zones_projected(spark, sf_dir):
    at = [(F.col("user_id") % 50 - 120).cast("double").alias("x"), (F.col("event_id") % 25 + 25).cast("double").alias("y")]
    return _rounded(geo.projected_vertices(_read(spark, sf_dir, "events").select(F.col("event_id").alias("zone"), *at)), "x", "y", digits=3)


@query("SELECT p_size AS code, count(*)::BIGINT AS n FROM part GROUP BY 1")
def class_raster(spark, sf_dir):
    path = _new_path(spark, "classes")
    cells = [F.lit(0).alias("row"), F.col("p_partkey").cast("int").alias("col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("p_size").cast("double").alias("value")]
    _read(spark, sf_dir, "part").select(*cells).write.parquet(path)
    return files.read_pixels(spark, path).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT year, count(*)::BIGINT AS n, count(value)::BIGINT AS n_values, round(sum(value), 6) AS total FROM (SELECT 2020 + l_linenumber % 2 AS year, CASE WHEN l_quantity <> 7 THEN l_quantity END AS value FROM lineitem) GROUP BY 1")
def yearly_rasters(spark, sf_dir):
    path, rows = _new_path(spark, "rasters"), _read(spark, sf_dir, "lineitem")
    for year in (2020, 2021):
        cells = [F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("l_quantity").alias("value")]
        rows.where(F.col("l_linenumber") % 2 == year - 2020).select(*cells).write.parquet(f"{path}/surplus_map_{year}")
    read = files.read_yearly_rasters(spark, f"{path}/surplus_map_*", nodata=7.0)
    return read.groupBy("year").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.sum("value"), 6).alias("total"))


@query("""
SELECT c_custkey::VARCHAR AS FIPS, CASE WHEN c_custkey % 5 = 0 THEN c_name || chr(10) || 'second line' WHEN c_custkey % 5 = 1 THEN 'the "' || c_name || '", so called' ELSE c_name END AS name,
CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS value FROM customer""")
def sheet_with_titles(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit('"'), "c_name", F.lit('\nsecond line"'))).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit('"the ""'), "c_name", F.lit('"", so called"'))).otherwise(F.col("c_name"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), name, F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal").cast("string")))
    # sheets of up to 200 rows, a file each
    sheets = _read(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 200).alias("sheet")).agg(F.concat(F.lit("A title, with a comma\n\nFIPS,name,value\n"), F.array_join(F.collect_list(line), "\n")).alias("value"))
    path = _new_path(spark, "sheet")
    sheets.write.partitionBy("sheet").text(path)
    return files.read_sheet(spark, f"{path}/*/*.txt", 2, schemas.both(schemas.strings("FIPS", "name"), schemas.doubles("value")))


@query("SELECT s_suppkey::VARCHAR AS uid FROM supplier WHERE s_suppkey IN (SELECT user_id FROM events)")
def sites_of_interest(spark, sf_dir):
    path, sites = _new_path(spark, "of-interest"), _read(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")).alias("uid"))
    sinks.write_sites_of_interest(sites, _read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("site_uid")), path)
    return files.read_keyed_csv(spark, path, schemas.strings("uid"))


@query("SELECT c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM customer JOIN orders ON o_custkey = c_custkey) WHERE k = 1")
def first_order(spark, sf_dir):
    joined = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_orderdate")
    return catalog.first_per_group(joined, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_no FROM orders")
def sorted_by_date(spark, sf_dir):
    return positions.numbered(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def leading_columns(spark, sf_dir):
    return county.leading_columns(_read(spark, sf_dir, "customer").select("c_name", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), "c_custkey", 2)


@query("""
SELECT p_partkey, round_even(p_size * p_partkey / 1024.0, 1) AS size_kb, CASE WHEN p_retailprice > 999 THEN round(ln(1 + (p_retailprice - 1000)), 8) END AS log_price, p_brand || ',' || p_type AS names FROM part""")
def small_expressions(spark, sf_dir):
    price = F.col("p_retailprice") - 1000
    return _read(spark, sf_dir, "part").select("p_partkey", scalars.size_kb(F.col("p_size") * F.col("p_partkey")).alias("size_kb"), F.round(scalars.log1p_or_null(price), 8).alias("log_price"), scalars.comma_list(F.col("p_brand"), F.col("p_type")).alias("names"))


@query(f"WITH {_POINTS} SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN x END AS lon, CASE WHEN vec_id % 7 <> 0 THEN y END AS lat FROM p")
def points_of_wkt(spark, sf_dir):
    at = lambda c: F.format_string("%.6f", c)
    wkt = F.concat(F.when(F.col("point_id") % 7 == 0, F.lit("LINESTRING (")).otherwise(F.lit(" POINT( ")), at(F.col("x")), F.lit(" "), at(F.col("y")), F.lit(" )"))
    lon, lat = geo_functions.point_xy(wkt)
    return _embedding_points(spark, sf_dir).select(F.col("point_id").alias("vec_id"), lon.alias("lon"), lat.alias("lat"))


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def common_keys(spark, sf_dir):
    return county.common_keys(_read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), _read(spark, sf_dir, "events").select(F.col("user_id").alias("k")), "k")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, ceil(count(*) / 900)::BIGINT AS n_files, count(*)::BIGINT AS n_rows, count({v})::BIGINT AS n_values, true AS near FROM orders" for c, t, v in (("o_orderkey", "bigint", "o_orderkey"), ("o_custkey", "bigint", "CASE WHEN o_custkey % 3 > 0 THEN 1 END"), ("o_totalprice", "double", "o_totalprice"))))
def profile_by_chunk(spark, sf_dir):
    """Chunks are profiled one by one; half of them in a first run, the others when the manifest has grown."""
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("o_custkey"), "o_totalprice")
    path = _new_path(spark, "profiled")
    sinks.write_chunks(orders, path, "orders.csv", 900, by=["o_orderkey"])
    manifest = files.read_manifest(spark, f"{path}/manifest")
    read = lambda paths: spark.read.schema(orders.schema).option("header", True).csv(paths)
    nothing = spark.createDataFrame([], profiles.STATE)
    state = materialised(profiles.refreshed_state(nothing, manifest.where("ord % 2 = 0"), f"{path}/chunks", read))
    merged = profiles.merged_profile(profiles.refreshed_state(state, manifest, f"{path}/chunks", read))
    exact = quality.distinct_counts(orders).withColumnRenamed("n_distinct", "exact")
    return merged.join(exact, "column").select("column", "type", "n_files", "n_rows", "n_values", (F.abs(F.col("n_distinct") / F.col("exact") - 1) < 0.06).alias("near"))


# ---------------------------------------------------------------- forecasts


def _features(spark, sf_dir) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    other = events.where("event_type <> 'click'").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 8).alias("rain"))
    site = events.groupBy("user_id").agg(F.round(F.avg("value"), 8).alias("surplus"))
    return forecast.feature_table(_daily_events(spark, sf_dir), other, site, keys=("user_id", "date"), threshold=150.0, period=10, value="value")


@query(f"""
WITH {_DAYS}, o AS (SELECT user_id, ts::DATE AS date, round(avg(value), 8) AS rain FROM events WHERE event_type <> 'click' GROUP BY ALL), s AS (SELECT user_id, round(avg(value), 8) AS surplus FROM events GROUP BY 1),
l AS (SELECT a.user_id, a.date, a.value, max(b.value) AS next_max, max(b.value) > 150 AS exceeds, (min(b.date) FILTER (b.value > 150) - a.date)::INT AS eta_days
FROM days a LEFT JOIN days b ON a.user_id = b.user_id AND b.date > a.date AND b.date <= a.date + 10 GROUP BY a.user_id, a.date, a.value)
SELECT user_id, date, value, next_max, exceeds, eta_days, rain, surplus FROM l LEFT JOIN o USING (user_id, date) LEFT JOIN s USING (user_id)""")
def feature_table(spark, sf_dir):
    return _features(spark, sf_dir).select("user_id", "date", "value", "next_max", "exceeds", "eta_days", "rain", "surplus")


@query()
def forecast_exceedance(spark, sf_dir):
    features = _features(spark, sf_dir)
    model = forecast.fit_exceedance(features, ["value", "rain", "surplus"], 10, "user_id")
    return forecast.forecast_exceedance(features, model, key="user_id")


@query(f"""
WITH {_DAYS}, l AS (SELECT a.user_id, a.date, (min(b.date) FILTER (b.value > 150) - a.date)::INT AS eta_days FROM days a LEFT JOIN days b ON a.user_id = b.user_id AND b.date > a.date AND b.date <= a.date + 10 GROUP BY a.user_id, a.date),
u AS (SELECT l.*, coalesce(eta_days, least(10, max(date) OVER (PARTITION BY user_id) - date)) AS until FROM l)
SELECT user_id, date, day::INT AS day, CASE WHEN day = eta_days THEN 1.0 ELSE 0.0 END::DOUBLE AS event FROM (SELECT *, unnest(generate_series(1, until)) AS day FROM u)""")
def days_at_risk(spark, sf_dir):
    return forecast.days_at_risk(_features(spark, sf_dir), 10, "user_id").select("user_id", "date", "day", "event")


@query("""
WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)
SELECT a.event_id, max(b.value) AS next_max, max(b.value) > 150 AS exceeds, (min(b.s) FILTER (b.value > 150) - a.s)::BIGINT AS eta_seconds
FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.s > a.s AND b.s <= a.s + 5 * 86400 GROUP BY a.event_id, a.s""")
def next_period_of_readings(spark, sf_dir):
    return timeseries.next_period_of_readings(_read(spark, sf_dir, "events"), 150.0, 5, "user_id", "ts", "value").select("event_id", "next_max", "exceeds", "eta_seconds")
