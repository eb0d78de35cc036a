"""The autocorrelation of series in blocks and runs of blocks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import periods


def values_of(n):
    k = np.arange(n)
    return np.sin(k / 7.3) * 5 + (k * 7919 % 113) / 10


@pytest.mark.parametrize(("block", "run"), [(16, 64), (64, 64), (7, 20), (100, 32), (1024, 32_768)])
def test_blocks_and_runs_lose_no_product(spark, monkeypatch, block, run):
    monkeypatch.setattr(periods, "BLOCK", run)
    sizes = {"a": 333, "b": 256, "c": 130, "d": 16}
    rows = [(s, k, float(v)) for s, n in sizes.items() for k, v in enumerate(values_of(n))]
    series = spark.createDataFrame(rows, "series_id string, pos long, value double").withColumn("value", F.when(F.col("pos") % 17 != 3, F.col("value")))
    found = {(r.series_id, r.lag): r.acf for r in periods.acf(series, block=block).collect()}
    expected = {}
    for s, n in sizes.items():
        x = np.array([v for k, v in enumerate(values_of(n)) if k % 17 != 3])
        x = x - x.mean()
        expected |= {(s, lag): float((x[: len(x) - lag] * x[lag:]).sum() / (x * x).sum()) for lag in range(len(x) // 4 + 1)}
    assert found == pytest.approx(expected, abs=1e-12)


def test_sums_are_worked_out_once_and_points_arrive_packed(spark):
    series = spark.range(4000).select(F.lit("a").alias("series_id"), F.col("id").alias("pos"), F.sin("id").alias("value"))
    plan = periods.acf(series, block=256)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsIn") == 1
    given = plan[plan.index("FlatMapGroupsIn") :]
    assert "collect_list" in given
