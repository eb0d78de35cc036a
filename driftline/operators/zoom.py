"""The rows around a labelled interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PADDING = 500


def zoom_bounds(series: DataFrame, bounds: DataFrame, padding: int = PADDING) -> DataFrame:
    """(series_id, zoom_start, zoom_end): times ``padding`` rows before the first and after the last labelled time.

    ``bounds`` has series_id, first_time, last_time; series without labelled rows are left out.
    """
    known = bounds.where("first_time IS NOT NULL").select("series_id", "first_time", "last_time")
    rows = series.join(known, "series_id")
    places = rows.groupBy("series_id").agg(F.count_if(F.col("time") < F.col("first_time")).alias("a"), F.count_if(F.col("time") <= F.col("last_time")).alias("b"), F.count(F.lit(1)).alias("n"))
    places = places.select("series_id", F.greatest(F.lit(0), F.col("a") - padding).alias("a"), F.least(F.col("n") - 1, F.col("b") - 1 + padding).alias("b"))
    picked = series.join(places, "series_id").groupBy("series_id")
    return picked.agg(F.min(F.when(F.col("pos") == F.col("a"), F.col("time"))).alias("zoom_start"), F.min(F.when(F.col("pos") == F.col("b"), F.col("time"))).alias("zoom_end"))


def zoom_rows(rows: DataFrame, zoom: DataFrame, time: str = "time") -> DataFrame:
    """The rows of any table with series_id and a time that lie in the zoom, its ends included."""
    return rows.join(zoom, "series_id").where(F.col(time).between(F.col("zoom_start"), F.col("zoom_end"))).drop("zoom_start", "zoom_end")


def zoom_scores(results: DataFrame, zoom: DataFrame) -> DataFrame:
    """The window results in the zoom, with ``is_best_in_zoom`` for the flagged window if it is one of them."""
    return zoom_rows(results, zoom).withColumn("is_best_in_zoom", F.col("predicted_anomaly"))
