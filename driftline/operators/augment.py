"""Variance bursts put into series, with their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalar import unit_noise


def variance_burst(series: DataFrame, bursts: DataFrame, strength: float = 3.0, seed: int = 0) -> DataFrame:
    """Adds noise of ``strength`` sample deviations to rows start to start + duration - 1 of each series, and labels them.

    ``bursts`` has series_id, start, duration. The noise depends on seed and position only, not on how rows are dealt.
    Returns series_id, pos, time, value, is_anomaly, anomaly_type. A burst that doesn't fit its series is an error.
    """
    known = series.groupBy("series_id").agg(F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n")).join(bursts, "series_id")
    start, duration = F.col("start"), F.col("duration")
    wrong = F.when(start < 0, F.lit("a burst starts before its series")).when(duration <= 0, F.lit("a burst lasts no row")).when(start + duration > F.col("n"), F.lit("a burst goes on after the end of its series"))
    checked = known.withColumn("start", F.when(wrong.isNotNull(), F.raise_error(wrong).cast("long")).otherwise(start))
    inside = F.col("pos").between(F.col("start"), F.col("start") + F.col("duration") - 1)
    noisy = F.col("value") + unit_noise(F.lit(seed), F.col("pos")) * strength * F.col("std")
    return series.join(checked, "series_id").select(
        "series_id", "pos", "time", F.when(inside, noisy).otherwise(F.col("value")).alias("value"), inside.cast("int").alias("is_anomaly"), F.when(inside, F.lit("variance_burst")).otherwise(F.lit("normal")).alias("anomaly_type")
    )
