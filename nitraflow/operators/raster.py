"""Class rasters as pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Common crop codes and their labels.
CROP_CODES = {
    0: "Background", 1: "Corn", 2: "Cotton", 3: "Rice", 4: "Sorghum", 5: "Soybeans", 6: "Sunflower", 21: "Barley", 22: "Durum Wheat",
    23: "Spring Wheat", 24: "Winter Wheat", 36: "Alfalfa", 37: "Other Hay/Non Alfalfa", 111: "Open Water", 121: "Developed/Open Space",
    141: "Deciduous Forest", 190: "Woody Wetlands", 195: "Herbaceous Wetlands",
}
PIXEL_HECTARES = 250 * 250 / 10000


def crop_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(CROP_CODES.items()), "code int, label string")


def class_coverage(pixels: DataFrame, code: str, labels: DataFrame, top_n: int = 8) -> DataFrame:
    """(code, label, n, percent) of the top_n classes by count, ties by code; percent of all pixels.
    The total is a window over the class counts, of which there are few."""
    counts = pixels.groupBy(code).agg(F.count("*").alias("n"))
    shares = counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    named = shares.join(labels.select(F.col("code").alias(code), "label"), code, "left")
    return named.withColumn("label", F.coalesce("label", F.concat(F.lit("Code "), F.col(code).cast("string")))).orderBy(F.desc("n"), code).limit(top_n)
