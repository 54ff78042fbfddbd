"""Exceedance forecasts: features, fit and prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nitraflow.operators.geo import point_in_zone, vertices_to_edges
from nitraflow.operators.timeseries import exceedance_label


def feature_table(days: DataFrame, *tables: DataFrame, keys: Sequence[str] = ("site_uid", "date"), threshold: float = 10.0, period: int = 30, value: str = "nitrate_con") -> DataFrame:
    """Labelled days with the columns of further tables (surplus, rainfall, evapotranspiration) by key."""
    out = exceedance_label(days, threshold, period, keys[0], keys[1], value)
    for t in tables:
        out = out.join(t, [k for k in keys if k in t.columns], "left")
    return out


def days_at_risk(features: DataFrame, period: int = 30, key: str = "site_uid", date: str = "date") -> DataFrame:
    """A row for each labelled day and each of the `period` days after it on which its site was still below the threshold:
    `day`, and `event` where that day is the first above. Days beyond the site's last reading aren't known and give no row."""
    last = features.groupBy(key).agg(F.max(date).alias("_last"))
    known = features.join(last, key).withColumn("_until", F.coalesce(F.col("eta_days"), F.least(F.lit(period), F.datediff("_last", date))))
    rows = known.where("_until > 0").withColumn("day", F.explode(F.sequence(F.lit(1), F.col("_until"))))
    return rows.withColumn("event", (F.col("day") == F.col("eta_days")).cast("double")).fillna(0.0, ["event"]).drop("_last", "_until")


def _with_time(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_day", F.col("day").cast("double")).withColumn("_log_day", F.log("day"))


@dataclass(frozen=True)
class HazardModel:
    """The fitted stages and the days that they look ahead."""

    stages: PipelineModel
    period: int


def fit_exceedance(features: DataFrame, columns: Sequence[str], period: int = 30, key: str = "site_uid", date: str = "date") -> HazardModel:
    """A hazard of exceedance in discrete time: logistic regression, on every day at risk, of the first day above the
    threshold on the day's distance and the features; missing features take the mean."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import Imputer, VectorAssembler

    rows = _with_time(days_at_risk(features, period, key, date))
    filled = [f"{c}_filled" for c in columns]
    stages = [Imputer(inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=["_day", "_log_day", *filled], outputCol="features"), LogisticRegression(labelCol="event", maxIter=50, regParam=1e-4)]
    return HazardModel(Pipeline(stages=stages).fit(rows.withColumns({c: F.col(c).cast("double") for c in columns})), period)


def forecast_exceedance(features: DataFrame, model: HazardModel, targets: DataFrame | None = None, key: str = "site_uid", date: str = "date") -> DataFrame:
    """(key, exceeds_threshold, probability, eta_days) of the last day of each target, or of each site. The hazards of the days
    ahead give the survival curve: probability is the chance of a crossing within the period, eta_days the first day by which
    it is one half or more (null where it never is, so where no crossing is forecast)."""
    from pyspark.ml.functions import vector_to_array

    rows = features if targets is None else features.join(targets.select(key).distinct(), key, "left_semi")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), date).alias("r")).select(key, "r.*")
    ahead = _with_time(last.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(model.period)))))
    hazard = model.stages.transform(ahead).select(key, "day", vector_to_array("probability")[1].alias("h"))
    curve = hazard.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("day", F.log1p(-F.col("h")).alias("s")))).alias("c"))  # `period` entries
    crossed = F.transform("c", lambda x, i: F.struct(x["day"].alias("day"), (1 - F.exp(F.aggregate(F.slice("c", 1, i + 1), F.lit(0.0), lambda t, y: t + y["s"]))).alias("p")))
    told = curve.select(key, crossed.alias("c")).select(key, F.element_at("c", -1)["p"].alias("probability"), F.filter("c", lambda x: x["p"] >= 0.5).alias("late"))
    return told.select(key, (F.col("probability") >= 0.5).alias("exceeds_threshold"), "probability", F.get("late", F.lit(0))["day"].cast("int").alias("eta_days"))


def sites_in_region(sites: DataFrame, region: DataFrame, key: str = "site_uid") -> DataFrame:
    """The sites (key, longitude, latitude) within a region given as vertices: targets of a forecast."""
    edges = vertices_to_edges(region)
    return point_in_zone(sites.select(F.col(key).alias("point_id"), "longitude", "latitude"), edges, x="longitude", y="latitude").select(F.col("point_id").alias(key)).distinct()
