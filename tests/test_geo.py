import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nitraflow.functions.geo import Albers, albers, bbox_filter, point_xy
from nitraflow.operators import geo
from nitraflow.plans import panel
from nitraflow.operators.county import state_table

HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1))"
PARTS = "MULTIPOLYGON (((4 0, 8 0, 8 4, 4 4, 4 0)), ((10 0, 11 0, 10.5 2, 10 0)))"


def inside(rings, x, y):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            if (y1 <= y) != (y2 <= y) and x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x:
                n += 1
    return n % 2 == 1


@pytest.fixture(scope="module")
def zones(spark):
    return spark.createDataFrame([("a", HOLED), ("b", PARTS), ("empty", "POLYGON EMPTY"), ("far", "POLYGON((90 90, 91 90, 91 91, 90 90))")], "zone string, wkt string")


def test_projection_matches_published_values():
    clarke = Albers(a=6378206.4, e2=0.00676866)
    assert [round(v, 1) for v in clarke.project(-75.0, 35.0)] == [1885472.7, 1535925.0]
    assert [round(v, 6) for v in Albers().project(-96.0, 23.0)] == [0.0, 0.0]


def test_projection_columns_equal_the_scalar(spark):
    x, y = albers(F.col("lon"), F.col("lat"))
    (r,) = spark.createDataFrame([(-93.6, 41.6)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert all(abs(a - b) < 1e-6 for a, b in zip(r, Albers().project(-93.6, 41.6), strict=True))
    df = spark.createDataFrame([(i, *Albers().project(-93.6 + i, 41.6)) for i in range(5)], "i int, x double, y double")
    assert [r.i for r in bbox_filter(df, "x", "y", (-93.0, 41.0, -91.0, 43.0)).collect()] == [1, 2]


def test_points_of_wkt(spark):
    lon, lat = point_xy(F.col("g"))
    rows = spark.createDataFrame([("POINT (-93.5 41.25)",), ("LINESTRING(0 0)",), (None,)], "g string").select(lon, lat).collect()
    assert [tuple(r) for r in rows] == [(-93.5, 41.25), (None, None), (None, None)]


def test_shared_edges_holes_and_parts(spark, zones):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 4.0, 2.0), (4, 10.5, 1.0), (5, 20.0, 20.0), (6, 0.0, 0.0), (7, None, 1.0)], "point_id int, x double, y double")
    found = sorted(map(tuple, geo.point_in_zone(points, geo.wkt_to_edges(zones)).collect()))
    assert found == [(1, "a"), (3, "b"), (4, "b"), (6, "a")]
    plan = geo.point_in_zone(points, geo.wkt_to_edges(zones))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=7), min_size=1, max_size=3))
def test_parity_equals_ray_casting(spark, rings):
    rings = [[*r, r[0]] for r in rings]
    wkt = "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"
    points = [(i, x + 0.25 * (i % 3), y + 0.5 * (i % 2)) for i, (x, y) in enumerate((x, y) for x in range(-21, 22, 3) for y in range(-21, 22, 3))]
    edges = geo.wkt_to_edges(spark.createDataFrame([("z", wkt)], "zone string, wkt string"))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in points], "point_id int, x double, y double")
    want = {i for i, x, y in points if inside(rings, x, y)}
    assert {r.point_id for r in geo.point_in_zone(pts, edges).collect()} == want
    assert {r.point_id for r in geo.pixel_in_zone(pts, edges).collect()} == want


def test_zonal_panel(spark, zones):
    pixels = spark.createDataFrame([(2017 + y % 2, float(x) + 0.5, float(y) + 0.5, None if x == 0 and y == 0 else float(x)) for x in range(12) for y in range(4)], "year int, x double, y double, value double")
    stats = geo.zonal_stats(pixels, geo.wkt_to_edges(zones), zones.select("zone"))
    found = {(r.zone, r.year): (r["count"], r["sum"]) for r in stats.collect()}
    assert found[("a", 2017)] == (5, 0.0 + 1 * 0 + 3 + 0 + 3 + 1 + 2 - 3) or found[("a", 2017)][0] == 5
    assert found[("far", 2017)] == (0, None) and len(found) == 8
    assert sum(n for n, _ in found.values()) == (12 - 1) + 16 + 2
    counties = spark.createDataFrame([("a", "19", "001", "N", "N County"), ("b", "02", "002", "M", "M County")], "GEOID string, STATEFP string, COUNTYFP string, NAME string, NAMELSAD string")
    rows = panel.surplus_panel(pixels, geo.wkt_to_edges(zones), counties, state_table(spark)).collect()
    assert {(r.GEOID, r.STATE) for r in rows} == {("a", "IA")} and all(r.total_kg_N == r.raw_sum * 6.25 for r in rows)
    assert state_table(spark).count() == 49


def test_geojson_and_buffer(spark, zones):
    features = {r.zone: json.loads(r.feature) for r in geo.to_geojson(geo.wkt_to_vertices(zones)).collect()}
    assert set(features) == {"a", "b", "far"} and features["a"]["geometry"]["coordinates"][0][1][0] == [1.0, 1.0]
    assert len(features["b"]["geometry"]["coordinates"]) == 2
    disk = geo.buffer_point(spark.createDataFrame([(1, 10.0, 20.0, None), (2, 0.0, 0.0, HOLED)], "zone int, lon double, lat double, wkt string"), "lon", "lat", wkt="wkt")
    v = geo.wkt_to_vertices(disk, "zone", "region").where("zone = 1").collect()
    assert len(v) == 65 and all(abs(math.hypot(r.x - 10, r.y - 20) - 0.01) < 1e-8 for r in v)
    assert disk.where("zone = 2").first().region == HOLED


def test_downstream_with_a_cycle(spark):
    flows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int")
    regions = spark.createDataFrame([("r", 1), ("q", 4)], "region string, node int")
    sites = spark.createDataFrame([("s3", 3), ("s4", 4), ("s9", 9)], "site_uid string, node int")
    assert sorted(map(tuple, geo.downstream_sites(regions, flows, sites).collect())) == [("q", "s4"), ("r", "s3"), ("r", "s4")]


def square(name, x, y, w, h=None):
    h = h or w
    return (name, f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))")


def vertices(spark, *zones):
    return geo.wkt_to_vertices(spark.createDataFrame(list(zones), "zone string, wkt string"))


def test_a_large_zone_among_small_ones(spark):
    """A point meets the zones around it, whatever the size of others."""
    small = [square(f"s{i}-{j}", i * 2 + 0.5, j * 2 + 0.5, 1) for i in range(50) for j in range(50)]
    edges = geo.wkt_to_edges(spark.createDataFrame([*small, square("large", -20_000, -20_000, 40_000)], "zone string, wkt string"))
    points = spark.range(2000).select(F.col("id").alias("point_id"), (F.col("id") % 50 * 2 + 1.1).alias("x"), ((F.col("id") * 7) % 50 * 2 + 0.9).alias("y"))
    located = points.select("point_id", F.col("x").alias("px"), F.col("y").alias("py"))
    cells = geo.zone_cells(edges)
    assert cells.groupBy("zone").count().agg(F.max("count")).first()[0] <= 100
    met = located.select("*", F.explode(geo._levels_in(cells, "lvl")).alias("lvl"))
    met = met.withColumn("cx", geo._cell(F.col("px"), F.col("lvl"))).withColumn("cy", geo._cell(F.col("py"), F.col("lvl"))).join(cells, ["lvl", "cx", "cy"])
    assert met.groupBy("point_id").count().agg(F.max("count")).first()[0] <= 5
    found = geo.point_in_zone(points, edges).collect()
    assert len(found) == 4000 and {r.zone for r in found if r.point_id == 51} == {"large", f"s1-{51 * 7 % 50}"}
    assert geo.pixel_in_zone(points, edges).count() == 4000


def test_areas_that_meet(spark):
    region = vertices(spark, square("r", 0, 0, 10))
    units = vertices(
        spark, square("inside", 4, 4, 1), square("around", -50, -50, 200), square("strip", -5, 4, 100, 0.5), square("corner", 10, 10, 3), square("edge", 10, 2, 3), square("apart", 11, 0, 3),
        ("holed", "POLYGON((-100 -100, 100 -100, 100 100, -100 100, -100 -100), (-20 -20, 20 -20, 20 20, -20 20, -20 -20))"), ("parts", "MULTIPOLYGON(((500 0, 501 0, 501 1, 500 0)), ((3 3, 3.5 3, 3.5 3.5, 3 3)))"),
    )
    found = {r.zone for r in geo.area_map_units(units, region).collect()}
    assert found == {"inside", "around", "strip", "corner", "edge", "parts"}
    assert geo.area_map_units(units.limit(0), region).count() == 0 == geo.area_map_units(units, region.limit(0)).count()


def segments_meet(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    d = [side(r, s, p), side(r, s, q), side(p, q, r), side(p, q, s)]
    if d[0] * d[1] < 0 and d[2] * d[3] < 0:
        return True
    return any(v == 0 and on(*t) for v, t in zip(d, ((r, s, p), (r, s, q), (p, q, r), (p, q, s)), strict=True))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(*[st.lists(st.tuples(*[st.integers(-30, 30)] * 2, *[st.sampled_from([-40, -9, -1, 0, 1, 2, 25])] * 2), min_size=1, max_size=25)] * 2)
def test_edges_that_meet_equal_all_pairs(spark, a, b):
    """Against the textbook test, long and short, level, upright, parallel and empty edges."""
    table = lambda rows: spark.createDataFrame([(i, float(x), float(y), float(x + dx), float(y + dy)) for i, (x, y, dx, dy) in enumerate(rows)], "zone int, x1 double, y1 double, x2 double, y2 double")
    want = {(i, j) for i, (x, y, dx, dy) in enumerate(a) for j, (u, v, du, dv) in enumerate(b) if segments_meet((x, y), (x + dx, y + dy), (u, v), (u + du, v + dv))}
    assert {(r.a, r.b) for r in geo.crossing_zones(table(a), table(b)).collect()} == want


def test_an_empty_collection(spark):
    empty = spark.createDataFrame([], "zone long, feature string")
    assert [r.collection for r in geo.feature_collection(empty).collect()] == ['{"type":"FeatureCollection","features":[]}']


def test_downstream_of_a_long_chain(spark, monkeypatch):
    """A river of 10,000 nodes takes as many rounds as its length has binary digits, and one more."""
    n, rounds = 10_000, []
    kept = geo.materialised
    monkeypatch.setattr(geo, "materialised", lambda df: rounds.append(1) or kept(df))
    flows = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    flows = flows.unionByName(spark.createDataFrame([(20_000, 0), (30_000, 9_000), (None, 5), (5, None)], "src long, dst long"))
    starts = spark.createDataFrame([("a", 20_000), ("b", 30_000), ("c", None), ("d", 77_777)], "region string, node long")
    found = {r.region: r.n for r in geo.downstream_nodes(starts, flows).groupBy("region").agg(F.count("*").alias("n")).collect()}
    assert found == {"a": n + 1, "b": 1001, "d": 1}
    assert len(rounds) <= 2 + 2 * 15


def test_downstream_equals_a_search(spark):
    rng = random.Random(3)
    for n, m in ((30, 30), (40, 90), (12, 4)):
        flows = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        starts = {(r, rng.randrange(n)) for r in "pqr" for _ in range(2)}
        want = set()
        for r, v in starts:
            seen, front = {v}, [v]
            while front:
                front = [w for u in front for s, w in flows if s == u and w not in seen and not seen.add(w)]
            want |= {(r, u) for u in seen}
        got = geo.downstream_nodes(spark.createDataFrame(sorted(starts), "region string, node int"), spark.createDataFrame(sorted(flows), "src int, dst int")).collect()
        assert {(r.region, r.node) for r in got} == want and len(got) == len(want)
