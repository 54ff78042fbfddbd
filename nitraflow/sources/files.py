"""Scans of files that are already landed where Spark can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nitraflow.operators.positions import MOST_SPLITS, line_numbers

from . import schemas


def cleaned_readings(raw: DataFrame) -> DataFrame:
    """Trims the site, parses the timestamp with its offset (UTC session) and maps NaN to null."""
    values = [F.nanvl(c, F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in raw.dtypes if c not in ("site_uid", "datetime")]
    when = F.try_to_timestamp("datetime", F.lit("yyyy-MM-dd HH:mm:ssx"))
    return raw.select(F.trim("site_uid").alias("site_uid"), when.alias("datetime"), *values)


def read_readings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return cleaned_readings(spark.read.schema(schemas.RAW_READINGS).option("header", True).csv(path))


def read_sites(spark: SparkSession, path: str, schema: T.StructType = schemas.SITES) -> tuple[DataFrame, DataFrame]:
    """(good rows, a one-row frame with n_bad and the number of values of each column): a row that doesn't fit the schema is left out and counted."""
    held = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    rows = spark.read.schema(held).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").csv(path)
    return rows.where("_bad is null").drop("_bad"), rows.agg(F.count("_bad").alias("n_bad"), *[F.count(f.name).alias(f"n_{f.name}") for f in schema.fields])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk, in file order."""
    doc = spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)
    return doc.select("original_filename", "total_rows", "chunk_size", "num_chunks", F.posexplode("chunks").alias("ord", "chunk")).select("original_filename", "total_rows", "chunk_size", "num_chunks", "ord", "chunk.filename", "chunk.size_bytes")


def read_chunks(spark: SparkSession, root: str, manifest: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the manifest's files, in one scan of root, each with its chunk's position as `ord` and its own
    position in the whole as `row_no`: chunks in the manifest's order, rows as they stand in their chunk. Files below root that the
    manifest doesn't list aren't part of it."""
    listed = manifest.select("filename", "ord")
    scan = spark.read.schema(schema).options(header=True, recursiveFileLookup=True).csv(root)
    rows = line_numbers(scan.select("*", F.col("_metadata.file_name").alias("filename")), listed)
    return rows.join(F.broadcast(listed) if listed.count() <= MOST_SPLITS else listed, "filename").drop("filename")


def read_site(spark: SparkSession, root: str, uid: str) -> DataFrame:
    """One site of a table partitioned by site; only its folder is listed and read, however many sites there are. A site
    without a folder has no rows."""
    own = f"{root.rstrip('/')}/site_uid={_escaped(uid.strip())}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    there = uid.strip() != "" and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    found = spark.read.option("basePath", root).parquet(own if there else root)
    # the site is text; left to inference, that of a folder read alone could become a number
    schema = T.StructType([*(f for f in found.schema.fields if f.name != "site_uid"), T.StructField("site_uid", T.StringType())])
    rows = spark.read.schema(schema).option("basePath", root).parquet(own if there else root)
    return rows.where(F.col("site_uid") == F.lit(uid.strip()))


def _escaped(value: str) -> str:
    """A partition's value as Hive and Spark write it in a folder's name."""
    return "".join(f"%{ord(c):02X}" if c in "\"#%'*/:=?\\{[]^\x7f" or c < " " else c for c in value)


def read_keyed_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).options(header=True, sep=sep).csv(path)


def read_yearly_rasters(spark: SparkSession, pattern: str, nodata: float | None = None) -> DataFrame:
    """Pixel tables whose file name ends in _<year>, by its last token (null where that isn't a number); nodata and NaN become null."""
    rows = spark.read.schema(schemas.PIXELS).parquet(pattern)
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/part-"), 1), r"(\.\w+)+$", "")
    year = F.element_at(F.split(stem, "_"), -1).try_cast("int")
    value = F.nanvl("value", F.lit(None).cast("double"))
    return rows.withColumn("year", year).withColumn("value", F.when(value != nodata, value) if nodata is not None else value)


def read_gauge(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(schemas.GAUGES[kind]).parquet(path)


def read_zones(spark: SparkSession, path: str, *attributes: str) -> DataFrame:
    """GEOID, attributes and the polygon as WKT text, from a tab-separated table."""
    return spark.read.schema(schemas.strings("GEOID", *attributes, "wkt")).options(header=True, sep="\t").csv(path)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A class raster: row, col, x, y and an integer code."""
    return spark.read.schema(schemas.PIXELS).parquet(path).withColumn("code", F.col("value").cast("int")).drop("value")


def read_sheet(spark: SparkSession, path: str, skip_rows: int, schema: T.StructType) -> DataFrame:
    """Tables whose header stands below skip_rows title lines, one in each file of path. A sheet is a file of bounded
    size; many of them are read side by side. A quoted cell may hold line breaks, commas and doubled quotes; every record after the header
    that isn't blank is a row; cells that a row lacks are null."""
    cells = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), {"mode": "PERMISSIVE", "multiLine": "true", "escape": '"'})
    below = F.regexp_replace("value", rf"^(?:[^\n]*\n){{{skip_rows}}}", "")
    records = F.regexp_extract_all(below, F.lit(r'((?:[^"\n]++|"[^"]*+"?)++)'), F.lit(1))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(records).alias("at", "record"))
    return rows.where((F.col("at") > 0) & (F.trim(F.translate("record", "\r", "")) != "")).withColumn("record", F.regexp_replace("record", "\r$", "")).select(cells.alias("r")).select("r.*")
