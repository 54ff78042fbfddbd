"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of edges with the smallest node that it reaches.

    Each round is two joins on aggregated minima; the minima are written tables, so that the joins can
    split the edges of a hub. Each round is a written table too, which replaces the one before it, so the
    lineage stays short. Before a round, nodes with one edge only, to a smaller node, are set aside: they go where that node goes, so
    a round works on what is still open, most of which is gone after the first. The number of rounds grows with the
    logarithm of the longest chain; it ends once all edges lead to roots.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
    aside = []
    while not (open_ := (low := _minima(now)).where("below > 1 or below = 1 and above")).isEmpty():
        aside.append(low)
        core = now.join(open_.select("u"), "u", "left_semi")
        to = low.where("above").select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = core.join(to, "v").select("u", F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # after the large stars a node has few neighbours below it, so its rows need no splitting
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        then = written(small.where("u > v").distinct(), "edges")
        discard(now)
        now = then
    discard(low)
    for low in reversed(aside):
        ends = low.where("below = 1 and not above").select("u", F.col("m").alias("v")).join(now.select(F.col("u").alias("v"), F.col("v").alias("to")), "v", "left")
        then = written(now.unionByName(ends.select("u", F.coalesce("to", "v").alias("v"))), "edges")
        discard(now, low)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _minima(edges: DataFrame) -> DataFrame:
    """For each node u its smallest neighbour m, the number of edges to smaller nodes and whether there are larger ones."""
    both = edges.select("u", "v", F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
    return written(both.groupBy("u").agg(F.min("v").alias("m"), F.sum("down").alias("below"), (F.min("down") == 0).alias("above")), "minima")
