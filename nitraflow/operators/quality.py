"""Comparing, profiling and auditing tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that differ, by key: side (left_only, right_only, both) and the columns that differ.
    Keys are unique in each table; null keys match each other, and so do null values."""
    values = [c for c in a.columns if c in b.columns and c not in keys]
    left = a.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(True).alias("_in_a"))
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_in_b"))
    joined = left.join(right, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "full_outer")
    side = F.when(F.col("_in_b").isNull(), "left_only").when(F.col("_in_a").isNull(), "right_only").otherwise("both")
    differs = [F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in values]
    changed = F.when(side == "both", F.array_compact(F.array(*differs) if differs else F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    out = joined.select(*[F.when(F.col("_in_a").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)).alias(k) for k in keys], side.alias("side"), changed.alias("columns"))
    return out.where((F.col("side") != "both") | (F.size("columns") > 0))


def diff_summary(a: DataFrame, b: DataFrame, keys: Sequence[str], row_no: str | None = None) -> DataFrame:
    """One row: shapes and columns equal, bad rows, and the first and last bad row number and whether
    they are contiguous (row_no is one of the keys)."""
    bad = table_diff(a, b, keys)
    at = F.col(row_no) if row_no else F.lit(None).cast("long")
    found = bad.agg(F.count("*").alias("n_bad"), F.min(at).alias("first_bad"), F.max(at).alias("last_bad"))
    # one row each
    joined = found.crossJoin(F.broadcast(a.agg(F.count("*").alias("na")))).crossJoin(F.broadcast(b.agg(F.count("*").alias("nb"))))
    return joined.select(
        (F.col("na") == F.col("nb")).alias("same_rows"), F.lit(a.columns == b.columns).alias("same_columns"), "n_bad", "first_bad", "last_bad",
        ((F.col("last_bad") - F.col("first_bad")) == F.col("n_bad") - 1).alias("contiguous"),
    )


def _per_column(df: DataFrame, measures: dict[str, Column], out: str) -> DataFrame:
    one = df.agg(*[m.alias(c) for c, m in measures.items()])
    return one.unpivot([], list(measures), "column", out) if len(measures) > 1 else one.select(F.lit(next(iter(measures))).alias("column"), F.col(next(iter(measures))).alias(out))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, n_values): all columns in one pass."""
    counts = {"*": F.count(F.lit(1))} | {c: F.count(c) for c in df.columns}
    rows = df.agg(*[m.alias(f"_{i}") for i, m in enumerate(counts.values())])
    table = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_0").alias("n_rows"), F.col(f"_{i}").alias("n_values")) for i, (c, t) in enumerate(df.dtypes, 1)])
    return rows.select(F.explode(table).alias("r")).select("r.*")


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """(column, n_distinct): null counts as a value. All columns in one pass; approx uses sketches."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return _per_column(df, {c: count(c) + F.coalesce(F.max(F.col(c).isNull().cast("long")), F.lit(0)) for c in df.columns}, "n_distinct")


def chunk_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows and bytes of each file against the manifest. files is a file scan; manifest has filename,
    size_bytes and chunk_size."""
    per = files.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("bytes_found")).groupBy("filename", "bytes_found").agg(F.count("*").alias("rows_found"))
    joined = manifest.select("filename", "size_bytes", "chunk_size").join(per, "filename", "full_outer")
    ok = F.coalesce((F.col("bytes_found") == F.col("size_bytes")) & (F.col("rows_found") <= F.col("chunk_size")), F.lit(False))
    return joined.withColumn("ok", ok)
