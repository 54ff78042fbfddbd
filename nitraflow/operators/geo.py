"""Polygons as tables, and joins of points and pixels with zones.

A polygon is a set of edges (zone, x1, y1, x2, y2); a point is inside where it has an odd number of
edges to its right (even-odd rule), so holes and several parts need no special care. Edges are
half-open: a point on an edge that two zones share belongs to one of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nitraflow.functions.tables import materialised


def _rings(df: DataFrame, zone: str, wkt: str) -> DataFrame:
    """(zone, part, ring, points) with points as an array of (x, y)."""
    body = F.regexp_replace(F.upper(wkt), r"^\s*(MULTI)?POLYGON\s*", "")
    parts = df.where(F.col(wkt).isNotNull() & ~F.upper(wkt).contains("EMPTY")).select(F.col(zone).alias("zone"), F.posexplode(F.split(body, r"\)\s*\)\s*,\s*\(\s*\(")).alias("part", "_p"))
    rings = parts.select("zone", "part", F.posexplode(F.split("_p", r"\)\s*,\s*\(")).alias("ring", "_r"))
    number = r"[-+]?[0-9.]+(?:E[-+]?\d+)?"
    found = F.regexp_extract_all("_r", F.lit(rf"({number}\s+{number})"), F.lit(1))
    xy = F.transform(found, lambda p: F.struct(F.split(p, r"\s+")[0].cast("double").alias("x"), F.split(p, r"\s+")[1].cast("double").alias("y")))
    return rings.select("zone", "part", "ring", xy.alias("points"))


def wkt_to_vertices(df: DataFrame, zone: str = "zone", wkt: str = "wkt") -> DataFrame:
    """(zone, part, ring, ord, x, y) of POLYGON and MULTIPOLYGON text."""
    return _rings(df, zone, wkt).select("zone", "part", "ring", F.posexplode("points").alias("ord", "_v")).select("zone", "part", "ring", "ord", "_v.x", "_v.y")


def wkt_to_edges(df: DataFrame, zone: str = "zone", wkt: str = "wkt") -> DataFrame:
    """(zone, x1, y1, x2, y2), without the level edges, which no level ray crosses."""
    pairs = F.arrays_zip(F.slice("points", 1, F.greatest(F.size("points") - 1, F.lit(0))).alias("a"), F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))).alias("b"))
    edges = _rings(df, zone, wkt).select("zone", F.explode(pairs).alias("_e"))
    return edges.select("zone", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2")).where("y1 != y2")


def projected_vertices(vertices: DataFrame) -> DataFrame:
    """Vertices in longitude and latitude as CONUS Albers metres."""
    from nitraflow.functions.geo import albers

    x, y = albers(F.col("x"), F.col("y"))
    return vertices.withColumn("_x", x).withColumn("y", y).withColumn("x", F.col("_x")).drop("_x")


def vertices_to_edges(vertices: DataFrame) -> DataFrame:
    ring = vertices.groupBy("zone", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("v"))
    pairs = ring.select("zone", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v") - 1).alias("b"))).alias("_e"))
    return pairs.select("zone", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2")).where("y1 != y2")


def to_geojson(vertices: DataFrame) -> DataFrame:
    """One row per zone: its MultiPolygon feature as GeoJSON text, vertices in order."""
    rings = vertices.groupBy("zone", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("x", "y").alias("xy")))).alias("v"))
    parts = rings.groupBy("zone", "part").agg(F.array_sort(F.collect_list(F.struct("ring", F.transform("v", lambda p: p["xy"]).alias("c")))).alias("r"))
    shapes = parts.groupBy("zone").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.transform("r", lambda r: r["c"]).alias("c")))), lambda p: p["c"]).alias("coordinates"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("zone").cast("string").alias("zone")).alias("properties"), geometry.alias("geometry"))
    return shapes.select("zone", F.to_json(feature).alias("feature"))


def from_geojson(features: DataFrame, feature: str = "feature") -> DataFrame:
    """(zone, part, ring, ord, x, y) of MultiPolygon features as text: the vertices that to_geojson has written."""
    shape = F.from_json(feature, "properties struct<zone: string>, geometry struct<coordinates: array<array<array<array<double>>>>>")
    parts = features.select(shape.alias("s")).select(F.col("s.properties.zone").alias("zone"), F.posexplode("s.geometry.coordinates").alias("part", "p"))
    rings = parts.select("zone", "part", F.posexplode("p").alias("ring", "r"))
    return rings.select("zone", "part", "ring", F.posexplode("r").alias("ord", "v")).select("zone", "part", "ring", "ord", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def feature_collection(features: DataFrame, by: str | None = None) -> DataFrame:
    """The features of to_geojson as one GeoJSON text, in the order of their zones: one row, or one for each value of the column
    `by`. A map's selection is meant: a text is one value. Without features and `by`, an empty collection."""
    held = F.transform(F.array_sort(F.collect_list(F.struct("zone", "feature"))), lambda f: f["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(held, ","), F.lit("]}")).alias("collection")
    return features.agg(text) if by is None else features.groupBy(by).agg(text)


def buffer_point(df: DataFrame, lon: str, lat: str, deg: float = 0.01, corners: int = 64, wkt: str | None = None) -> DataFrame:
    """df with `region`: a disk around the point as WKT. Rows that already have a polygon in the column
    wkt keep it."""
    angle = lambda k: k * (2 * math.pi / corners)
    corner = lambda k: F.concat_ws(" ", F.round(F.col(lon) + deg * F.cos(angle(k)), 9).cast("string"), F.round(F.col(lat) + deg * F.sin(angle(k)), 9).cast("string"))
    steps = F.concat(F.sequence(F.lit(0), F.lit(corners - 1)), F.array(F.lit(0)))
    disk = F.concat(F.lit("POLYGON(("), F.array_join(F.transform(steps, corner), ","), F.lit("))"))
    return df.withColumn("region", disk if wkt is None else F.coalesce(F.col(wkt), disk))


def select_region(zones: DataFrame, name: str, column: str = "NAME") -> DataFrame:
    return zones.where(F.col(column) == name)


# ---------------------------------------------------------------- points and zones


def _crossing(x1: Column, y1: Column, x2: Column, y2: Column, y: Column) -> Column:
    return x1 + (y - y1) * (x2 - x1) / (y2 - y1)


def _level(size: Column, least: float = 2.0**-30) -> Column:
    """The power of two whose cells are at least as large as `size`; cells of a level cover at most two of them a side."""
    return F.ceil(F.log2(F.greatest(size, F.lit(least)))).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("long")


def _cells(low: Column, high: Column, level: Column) -> Column:
    return F.explode(F.sequence(_cell(low, level), _cell(high, level)))


def _levels_in(df: DataFrame, level: str) -> Column:
    """An array of the levels that occur: a few dozen at most, as they are exponents of two."""
    return F.array(*[F.lit(r[0]) for r in df.select(level).where(F.col(level).isNotNull()).distinct().orderBy(level).collect()]).cast("array<int>")


def zone_cells(edges: DataFrame) -> DataFrame:
    """(zone, its box, lvl, cx, cy, strip): the cells that each zone's box touches, at the level of its own size, so a
    zone has from 16 to 81 cells whatever the size of others; and the level of the strips that its edges are cut
    into, so fine that a strip holds about a dozen edges of a plain outline and so coarse that edges are copied a few times at most."""
    box = edges.groupBy("zone").agg(
        F.min(F.least("x1", "x2")).alias("bx1"), F.max(F.greatest("x1", "x2")).alias("bx2"), F.min(F.least("y1", "y2")).alias("by1"), F.max(F.greatest("y1", "y2")).alias("by2"),
        F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("_dy"),
    )
    size = F.greatest(F.col("bx2") - F.col("bx1"), F.col("by2") - F.col("by1"))
    levels = box.withColumn("lvl", _level(size / 8)).withColumn("strip", _level(4 * F.col("_dy"))).drop("_dy")
    return levels.withColumn("cx", _cells(F.col("bx1"), F.col("bx2"), F.col("lvl"))).withColumn("cy", _cells(F.col("by1"), F.col("by2"), F.col("lvl")))


def zone_candidates(points: DataFrame, cells: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Points (px, py and the columns keep) with each zone whose box holds them: a point is looked up once at every
    level that zones have, so it meets the zones around it and not those that share a coarse cell."""
    located = points.select(*keep, "px", "py", F.explode(_levels_in(cells, "lvl")).alias("lvl"))
    located = located.withColumn("cx", _cell(F.col("px"), F.col("lvl"))).withColumn("cy", _cell(F.col("py"), F.col("lvl")))
    return located.join(cells, ["lvl", "cx", "cy"]).where("px >= bx1 and px <= bx2 and py >= by1 and py <= by2").drop("lvl", "cx", "cy", "bx1", "bx2", "by1", "by2")


def point_in_zone(points: DataFrame, edges: DataFrame, point: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """(point, zone) of every point and each zone that holds it, by equality joins on cells and strips of several
    levels. Points without a coordinate are in no zone."""
    cells = materialised(zone_cells(edges))
    located = points.select(F.col(point), F.col(x).alias("px"), F.col(y).alias("py")).where("px is not null and py is not null")
    near = zone_candidates(located, cells, [point]).withColumn("at", _cell(F.col("py"), F.col("strip")))
    strips = edges.where("y1 != y2").join(cells.select("zone", "strip").distinct(), "zone").withColumn("at", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("strip"))).drop("strip")
    crossed = near.join(strips, ["zone", "at"]).where((F.col("py") >= F.least("y1", "y2")) & (F.col("py") < F.greatest("y1", "y2")))
    crossed = crossed.where(_crossing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("py")) > F.col("px"))
    return crossed.groupBy(point, "zone").agg(F.count("*").alias("n")).where("n % 2 = 1").select(point, "zone")


def raster_spans(levels: DataFrame, edges: DataFrame) -> DataFrame:
    """(zone, y, xa, xb): for each raster row y in levels, the half-open x ranges inside each zone. A row meets the edges
    around it: each edge stands at the level of its own height, in two strips at most."""
    tall = edges.where("y1 != y2").withColumn("lvl", _level(F.abs(F.col("y2") - F.col("y1"))))
    strips = tall.withColumn("at", _cells(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("lvl")))
    rows = levels.select("y").distinct().select("y", F.explode(_levels_in(tall, "lvl")).alias("lvl")).withColumn("at", _cell(F.col("y"), F.col("lvl")))
    crossed = rows.join(strips, ["lvl", "at"]).where((F.col("y") >= F.least("y1", "y2")) & (F.col("y") < F.greatest("y1", "y2")))
    xs = crossed.select("zone", "y", _crossing(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("y")).alias("x")).groupBy("zone", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return xs.select("zone", "y", "xs", F.explode(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2))).alias("i")).select("zone", "y", F.element_at("xs", F.col("i")).alias("xa"), F.element_at("xs", F.col("i") + 1).alias("xb")).where("xa < xb")


def pixel_in_zone(pixels: DataFrame, edges: DataFrame) -> DataFrame:
    """pixels with the zone that holds their centre, one row for each; by raster rows, so spans and not
    edges meet the pixels, each span at the level of its own width."""
    spans = materialised(raster_spans(pixels, edges).withColumn("_lvl", _level(F.col("xb") - F.col("xa"))))
    cells = spans.withColumn("_cx", _cells(F.col("xa"), F.col("xb"), F.col("_lvl")))
    looked = pixels.withColumn("_lvl", F.explode(_levels_in(spans, "_lvl"))).withColumn("_cx", _cell(F.col("x"), F.col("_lvl")))
    return looked.join(cells, ["y", "_lvl", "_cx"]).where("x >= xa and x < xb").drop("_lvl", "_cx", "xa", "xb")


def zonal_stats(pixels: DataFrame, edges: DataFrame, zones: DataFrame, by: Sequence[str] = ("year",), value: str = "value") -> DataFrame:
    """mean, sum and count of the pixels in each zone and group; zones without pixels are kept with
    count 0 in every group. zones has zone and attributes."""
    stats = pixel_in_zone(pixels.where(F.col(value).isNotNull()), edges).groupBy("zone", *by).agg(F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.count(value).alias("count"))
    if not by:
        return zones.join(stats, "zone", "left").fillna(0, ["count"])
    every = zones.crossJoin(pixels.select(*by).distinct())  # the result has a row for each zone and group
    return every.join(stats, ["zone", *by], "left").fillna(0, ["count"])


def _segments(vertices: DataFrame) -> DataFrame:
    """(zone, x1, y1, x2, y2) of every edge, level ones too."""
    ring = vertices.groupBy("zone", "part", "ring").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("v"))
    pairs = ring.select("zone", F.explode(F.arrays_zip(F.slice("v", 1, F.size("v") - 1).alias("a"), F.slice("v", 2, F.size("v") - 1).alias("b"))).alias("_e"))
    return pairs.select("zone", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))


def crossing_zones(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of the zones with edges that meet, ends and touching included; a and b have zone, x1, y1, x2, y2.

    Every edge stands in the cells of its own level, four at most, and looks for edges of its own level and coarser
    ones there, where it touches four cells at most too. So an edge meets those near it, long or short."""
    box = lambda df, p: df.select(F.col("zone").alias(f"{p}zone"), *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")]).withColumn(f"{p}lvl", _level(F.greatest(F.abs(F.col(f"{p}x2") - F.col(f"{p}x1")), F.abs(F.col(f"{p}y2") - F.col(f"{p}y1")))))
    left, right = materialised(box(a, "a")), materialised(box(b, "b"))

    def placed(df: DataFrame, p: str, level: Column) -> DataFrame:
        at = lambda axis: _cells(F.least(f"{p}{axis}1", f"{p}{axis}2"), F.greatest(f"{p}{axis}1", f"{p}{axis}2"), F.col("lvl"))
        return df.withColumn("lvl", level).withColumn("cx", at("x")).withColumn("cy", at("y"))

    def coarser(own: str, other: DataFrame, level: str, equal: bool) -> Column:
        return F.explode(F.filter(_levels_in(other, level), lambda v: v >= F.col(own) if equal else v > F.col(own)))

    met = placed(left, "a", coarser("alvl", right, "blvl", True)).join(placed(right, "b", F.col("blvl")), ["lvl", "cx", "cy"])
    met = met.unionByName(placed(left, "a", F.col("alvl")).join(placed(right, "b", coarser("blvl", left, "alvl", False)), ["lvl", "cx", "cy"]))
    over = lambda axis: (F.least(f"a{axis}1", f"a{axis}2") <= F.greatest(f"b{axis}1", f"b{axis}2")) & (F.least(f"b{axis}1", f"b{axis}2") <= F.greatest(f"a{axis}1", f"a{axis}2"))
    side = lambda s, p, k: F.signum((F.col(f"{s}x2") - F.col(f"{s}x1")) * (F.col(f"{p}y{k}") - F.col(f"{s}y1")) - (F.col(f"{s}y2") - F.col(f"{s}y1")) * (F.col(f"{p}x{k}") - F.col(f"{s}x1")))
    straddle = (side("a", "b", 1) * side("a", "b", 2) <= 0) & (side("b", "a", 1) * side("b", "a", 2) <= 0)
    return met.where(over("x") & over("y") & straddle).select(F.col("azone").alias("a"), F.col("bzone").alias("b")).distinct()


def areas_that_meet(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b) of the zones of two vertex tables that share a point: their edges meet, or a part of one lies in the
    other, which its first vertex tells. A zone in a hole of another doesn't meet it."""
    sides = [materialised(_segments(v)) for v in (a, b)]
    pairs = crossing_zones(*sides)

    def inside(vertices: DataFrame, edges: DataFrame, own: str, other: str) -> DataFrame:
        first = vertices.groupBy("zone", "part", "ring").agg(F.min_by(F.struct("x", "y"), "ord").alias("p")).select(F.struct("zone", "part", "ring").alias("point_id"), "p.x", "p.y")
        return point_in_zone(first, edges.where("y1 != y2")).select(F.col("point_id.zone").alias(own), F.col("zone").alias(other))

    within = inside(a, sides[1], "a", "b").unionByName(inside(b, sides[0], "b", "a"))
    return pairs.unionByName(within).distinct()


def area_map_units(vertices: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, zone): the map units that each region meets, also those that hold the whole region, lie within it or are crossed
    by a part of it without corners there. Both are vertex tables."""
    return areas_that_meet(regions, vertices).select(F.col("a").alias("region"), F.col("b").alias("zone"))


def downstream_nodes(starts: DataFrame, flow_edges: DataFrame) -> DataFrame:
    """(region, node): all nodes that water from a region's nodes reaches, these included. starts has region and node,
    flow_edges has src and dst.

    By path doubling: `jumps` leads from a node to those 2^i steps on, and is joined with itself to double. A round adds
    to the nodes fewer than 2^i steps away those that a jump leads to from there. When a round adds none, none are left, as
    a shortest path to a farther node would pass one at each distance. Rounds follow the logarithm of the longest path, and
    cycles end like anything else. Only nodes with 2^i steps ahead of them stay in `jumps`."""
    edges = flow_edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    reached = materialised(starts.where("node is not null").select("region", "node").distinct())
    jumps, size = materialised(edges), reached.count()
    while True:
        ahead = reached.join(jumps, F.col("node") == F.col("src")).select("region", F.col("dst").alias("node"))
        reached = materialised(reached.unionByName(ahead).distinct())
        found = reached.count()
        if found == size:
            return reached
        size = found
        on = jumps.select(F.col("src").alias("_mid"), F.col("dst").alias("_far"))
        jumps = materialised(jumps.join(on, F.col("dst") == F.col("_mid")).select("src", F.col("_far").alias("dst")).distinct())


def downstream_sites(regions: DataFrame, flow_edges: DataFrame, sites: DataFrame) -> DataFrame:
    """(region, site_uid): the sites that water from a region's nodes reaches. regions has region and
    node, flow_edges has src and dst, sites has site_uid and node. Cycles are fine."""
    return downstream_nodes(regions, flow_edges).join(sites, "node").select("region", "site_uid").distinct()
