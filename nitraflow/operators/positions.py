"""Row positions: the number of every row in file order, or in a given order, found by Spark in two passes.

The first pass counts the rows of each split of the scan; their cumulated counts, a row for each split,
are where the splits begin. The second numbers the rows of a split from there. No row is moved: the
numbers come from the scan itself, and the table of splits is broadcast while it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nitraflow.functions.tables import materialised, stored
from nitraflow.operators.quality import table_diff

#: Splits whose starts are broadcast; with more of them the rows are joined by a shuffle.
MOST_SPLITS = 200_000


def line_numbers(scan: DataFrame, order: DataFrame | None = None, out: str = "row_no") -> DataFrame:
    """scan with the position of each row, from 0: files by path, or by `ord` of order (filename, ord), and rows as
    they stand in their file. scan is a plain file scan; files that order lacks are left out. Files that hold the same rows
    twice are numbered twice; empty files take no number."""
    name, block, at = "_file", "_block", "_at"
    named = scan.select("*", F.col("_metadata.file_path").alias(name), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(at))
    # within a task the rows of a split follow one another, so its first id tells where it begins
    splits = materialised(named.groupBy(name, "_name", block).agg(F.min(at).alias("_first"), F.count("*").alias("_n")))
    place: Column | str = name
    if order is not None:
        splits = splits.join(order.select(F.col("filename").alias("_name"), F.col("ord").alias("_ord")), "_name")
        place = "_ord"
    per_file = splits.groupBy(name, place).agg(F.sum("_n").alias("_rows")) if place != name else splits.groupBy(name).agg(F.sum("_n").alias("_rows"))
    # a row for each file: one task orders them
    before = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.select(name, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_file_start"))
    earlier = Window.partitionBy(name).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_split_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(per_file, name)
    starts = materialised(starts.select(name, block, "_first", (F.col("_file_start") + F.col("_split_start")).alias("_start")))
    few = starts.count() <= MOST_SPLITS
    joined = named.join(F.broadcast(starts) if few else starts, [name, block])
    return joined.select(*scan.columns, (F.col("_start") + F.col(at) - F.col("_first")).alias(out))


def numbered(df: DataFrame, by: Sequence[str], out: str = "row_no") -> DataFrame:
    """df with the position of each row in the order of the columns `by`, from 0; rows that agree in them stand next
    to each other in the order of their other columns' hash. Range-partitioned and sorted rows are stored
    once, so the numbers don't change when tasks run again."""
    others = [c for c in df.columns if c not in by]
    order = [F.col(c).asc_nulls_first() for c in by] + ([F.xxhash64(*others)] if others else [])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return line_numbers(stored(ranged, "ordered"), out=out)


def diff_by_position(a: DataFrame, b: DataFrame, row_no: str = "row_no") -> DataFrame:
    """The rows of two file scans that differ at the same position: row_no, side and the columns that differ."""
    return table_diff(line_numbers(a, out=row_no), line_numbers(b, out=row_no), [row_no])


def diff_batches(a: DataFrame, b: DataFrame, batch: int = 5_000_000, row_no: str = "row_no") -> DataFrame:
    """A report for each `batch` positions of two numbered tables: rows of a and of b, bad rows, the first and the last
    of them and whether they are contiguous (null without bad rows)."""
    per = (F.col(row_no) / batch).cast("long")
    rows = lambda df, name: df.groupBy(per.alias("batch")).agg(F.count("*").alias(name))
    bad = table_diff(a, b, [row_no]).groupBy(per.alias("batch")).agg(F.count("*").alias("n_bad"), F.min(row_no).alias("first_bad"), F.max(row_no).alias("last_bad"))
    every = rows(a, "rows_a").join(rows(b, "rows_b"), "batch", "full_outer").join(bad, "batch", "left").fillna(0, ["rows_a", "rows_b", "n_bad"])
    return every.withColumn("contiguous", F.col("last_bad") - F.col("first_bad") == F.col("n_bad") - 1)
