"""Labels, the localisation metric, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import TOLERANCE, is_correct, midpoint_time, seconds_between


def point_labels(series: DataFrame, catalog: DataFrame) -> DataFrame:
    """Labels of every row from its dataset's interval (series_id, anomaly_start, anomaly_end, category), clamped to the series."""
    sizes = series.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    rows = series.join(catalog.select("series_id", "anomaly_start", "anomaly_end", "category").join(sizes, "series_id"), "series_id")
    inside = F.col("pos").between(F.greatest(F.col("anomaly_start"), F.lit(0)), F.least(F.col("anomaly_end"), F.col("n") - 1))
    flag = inside.cast("int")
    return rows.select("series_id", "pos", "time", flag.alias("is_anomaly"), F.when(inside, F.col("category")).otherwise(F.lit("normal")).alias("anomaly_type"))


def anomaly_bounds(labels: DataFrame) -> DataFrame:
    """(series_id, n_anomaly, anomaly_start, anomaly_end, first_time, last_time) of the labelled rows; null where there are none."""
    at = F.col("is_anomaly") == 1
    return labels.groupBy("series_id").agg(
        F.coalesce(F.sum("is_anomaly"), F.lit(0)).cast("long").alias("n_anomaly"),
        F.min(F.when(at, F.col("pos"))).alias("anomaly_start"),
        F.max(F.when(at, F.col("pos"))).alias("anomaly_end"),
        F.min(F.when(at, F.col("time"))).alias("first_time"),
        F.max(F.when(at, F.col("time"))).alias("last_time"),
    )


def localisation(results: DataFrame, bounds: DataFrame, series: DataFrame | None = None) -> DataFrame:
    """Whether the middle of each series' flagged window lies in its labelled interval, give or take 100 rows.

    ``bounds`` has series_id, anomaly_start, anomaly_end. Seconds are counted from the series' first time if ``series`` is given, else from
    the first window's. A series without a valid score gets nulls and 0.
    """
    start = results.groupBy("series_id").agg(F.min_by("window_start", "window_no").alias("reference")) if series is None else series.groupBy("series_id").agg(F.min("time").alias("reference"))
    best = results.where("predicted_anomaly = 1").select("series_id", "window_start", "window_end", "sigma2")
    rows = bounds.select("series_id", "anomaly_start", "anomaly_end").join(best, "series_id", "left").join(start, "series_id", "left")
    index = seconds_between(F.col("reference"), midpoint_time(F.col("window_start"), F.col("window_end")))
    has = F.col("sigma2").isNotNull()
    return rows.withColumn("_index", F.when(has, index)).select(
        "series_id",
        F.col("_index").cast("long").alias("ucr_prediction_index"),
        F.when(has, F.col("sigma2")).alias("ucr_prediction_score"),
        F.when(has, F.col("anomaly_start") - TOLERANCE).cast("long").alias("ucr_correct_start"),
        F.when(has, F.col("anomaly_end") + TOLERANCE).cast("long").alias("ucr_correct_end"),
        is_correct(F.col("_index"), F.col("anomaly_start"), F.col("anomaly_end")).alias("ucr_correct"),
    )


def _tallied(grouped) -> DataFrame:
    return grouped.agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("ucr_correct").cast("long").alias("n_correct"), F.avg("ucr_correct").alias("ucr_accuracy"))


def category_summary(metrics: DataFrame) -> DataFrame:
    """Datasets, hits and accuracy of each category; a null category is one."""
    return _tallied(metrics.groupBy("category")).orderBy(F.col("category").asc_nulls_last())


def overall_summary(metrics: DataFrame) -> DataFrame:
    """The categories' rows and, last, one of all datasets named ``overall``."""
    found = metrics.rollup("category").agg(F.count(F.lit(1)).alias("n_datasets"), F.sum("ucr_correct").cast("long").alias("n_correct"), F.avg("ucr_correct").alias("ucr_accuracy"), F.grouping("category").alias("_total"))
    named = found.withColumn("category", F.when(F.col("_total") == 1, F.lit("overall")).otherwise(F.col("category")))
    return named.orderBy("_total", F.col("category").asc_nulls_last()).drop("_total")


def prepared_counts(catalog: DataFrame) -> DataFrame:
    """Datasets of each category as it is written in the map."""
    return catalog.groupBy("category").agg(F.count(F.lit(1)).alias("n_datasets")).orderBy("category")


def period_accuracy(settings: DataFrame, periods: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Estimated against curated periods: whether they agree, or one is a multiple of the other, within ``tolerance``.

    ``settings`` has dataset_idx and estimated_period, ``periods`` dataset_idx and period.
    """
    rows = periods.join(settings, "dataset_idx", "left")
    ratio = F.col("estimated_period") / F.col("period")
    multiple = F.greatest(ratio, 1 / ratio)
    near = F.coalesce(F.abs(ratio - 1) <= tolerance, F.lit(False))
    harmonic = F.coalesce(F.abs(multiple - F.round(multiple)) <= tolerance, F.lit(False))
    return rows.select("dataset_idx", "period", "estimated_period", near.cast("int").alias("is_match"), harmonic.cast("int").alias("is_multiple"))
