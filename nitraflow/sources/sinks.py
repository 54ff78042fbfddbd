"""Writers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitraflow.functions.tables import stored
from nitraflow.operators.positions import line_numbers, numbered

from .schemas import MANIFEST


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_site(df: DataFrame, root: str, site: str = "site_uid", salts: int = 1, max_rows: int = 5_000_000) -> None:
    """One folder per trimmed site. One shuffle on the site, salted so that a site with a large share
    of all rows is written by `salts` tasks; files hold at most max_rows rows."""
    rows = df.withColumn(site, F.trim(site))
    keys = [site] if salts <= 1 else [site, F.pmod(F.xxhash64(*[c for c in df.columns if c != site]), F.lit(salts))]
    rows.repartition(*keys).write.mode("overwrite").option("maxRecordsPerFile", max_rows).partitionBy(site).parquet(root)


def write_chunks(df: DataFrame, path: str, name: str, chunk_size: int = 500_000, by: Sequence[str] = (), scan: bool = False) -> DataFrame:
    """CSV files of exactly chunk_size rows each but the last, in order, every one with a header; and the
    manifest as a one-row frame (also written below path/manifest), its chunks in order.

    The order is that of the columns `by`; or, where df is a plain file scan, that of its files and their rows; or else that
    of df's partitions, as an ordered frame has it. A row goes to the task of its chunk by its global position, so the
    chunks are full however many tasks read df. A table without rows gives one file without rows."""
    rows = numbered(df, by, "_row_no") if by else line_numbers(df if scan else stored(df, "ordered"), out="_row_no")
    last = rows.agg(F.max("_row_no")).first()[0]
    n_chunks = 1 if last is None else last // chunk_size + 1
    chunk = F.floor(F.col("_row_no") / chunk_size).cast("int")
    chunks = rows.repartitionById(n_chunks, chunk).sortWithinPartitions("_row_no").drop("_row_no")
    chunks.write.mode("overwrite").option("header", True).csv(f"{path}/chunks")
    files = df.sparkSession.read.schema(df.schema).option("header", True).csv(f"{path}/chunks")
    found = files.select(F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_size").alias("size_bytes")).groupBy("filename", "size_bytes").agg(F.count("*").alias("n"))
    manifest = found.agg(
        F.lit(name).alias("original_filename"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.lit(chunk_size).cast("long").alias("chunk_size"),
        F.count("*").cast("int").alias("num_chunks"), F.array_sort(F.collect_list(F.struct("filename", "size_bytes"))).alias("chunks"),
    )
    manifest.select(*MANIFEST.names).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def write_sites_of_interest(sites: DataFrame, readings: DataFrame, path: str) -> None:
    from nitraflow.operators.catalog import sites_with_data

    write_csv(sites_with_data(sites, readings), path)


def partitions_for(n_bytes: int, target: int = 128 << 20) -> int:
    """How many output partitions of about `target` bytes a table of n_bytes needs."""
    return max(1, math.ceil(n_bytes / target))
