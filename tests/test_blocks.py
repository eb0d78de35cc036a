"""Windows, residuals and differences that are worked out in blocks, against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.arima import fit
from driftline.operators import preprocess, scoring, windows

START = dt.datetime(2026, 1, 1)


def series_of(spark, lists, n=3):
    rows = [(name, k, START + dt.timedelta(seconds=k), v) for name, values in lists.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, pos long, time timestamp_ntz, value double").repartition(n)


def settings_of(spark, lists, sizes):
    return spark.createDataFrame([(name, *sizes[name]) for name in lists], "series_id string, window_size int, stride int")


def random_lists(rng, n):
    out = {}
    for k in range(n):
        values = [rng.gauss(0, 5) if rng.random() > 0.1 else None for _ in range(rng.randrange(20, 400))]
        out[f"s{k}"] = values
    return out


SIZES = [(5, 1), (5, 2), (7, 7), (10, 30), (4, 100), (12, 5), (16, 3), (3, 25)]


def plain_windows(values, w, s):
    kept = [(k, v) for k, v in enumerate(values) if v is not None]
    ends = list(range(w - 1, len(kept), s))
    ends += [len(kept) - 1] if ends[-1] != len(kept) - 1 else []
    return [(i, e, kept[e - w + 1 : e + 1]) for i, e in enumerate(ends)]


def test_windows_are_slices_of_blocks(spark):
    lists = random_lists(random.Random(1), len(SIZES))
    sizes = dict(zip(lists, SIZES, strict=True))
    found = windows.trailing_windows(series_of(spark, lists), settings_of(spark, lists, sizes)).collect()
    got = {(r.series_id, r.window_no, r.window_end_pos, tuple((p.pos, p.value) for p in r.points)) for r in found}
    assert len(got) == len(found)
    assert got == {(name, i, e, tuple(points)) for name, values in lists.items() for i, e, points in plain_windows(values, *sizes[name])}
    assert all(r.window_start == START + dt.timedelta(seconds=r.points[0].pos) and r.window_end == START + dt.timedelta(seconds=r.points[-1].pos) for r in found)


def test_few_rows_are_in_two_blocks(spark):
    lists = {"a": [float(k % 13) for k in range(5000)], "b": [1.0] * 64}
    blocks = windows.position_blocks(series_of(spark, lists), settings_of(spark, lists, {"a": (10, 2), "b": (8, 1)}))
    held = blocks.agg(F.sum(F.size("points"))).first()[0]
    assert 5064 <= held <= 5064 * (1 + 1 / windows.LENGTHS)
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of blocks, never of windows


@pytest.mark.parametrize("order", [(0, 1, 0), (0, 0, 0), (1, 0, 0)])
def test_residuals_add_up_over_blocks(spark, order):
    lists = random_lists(random.Random(2), 4)
    sizes = dict(zip(lists, [(12, 3), (20, 7), (9, 40), (15, 15)], strict=True))
    series = series_of(spark, lists)
    fitted = scoring.score_series(series, settings_of(spark, lists, sizes), order)
    got = {(r.series_id, r.pos): r.residual for r in scoring.residual_series(fitted, series).collect()}
    scores = {(r.series_id, r.window_no): (r.sigma2, r.converged) for r in scoring.scores(fitted).collect()}
    assert len(got) == sum(map(len, lists.values()))
    for name, values in lists.items():
        sums, counts = np.zeros(len(values)), np.zeros(len(values))
        for i, _, points in plain_windows(values, *sizes[name]):
            sigma2, left, sure = fit(np.array([[v for _, v in points]]), order)
            assert scores[name, i] == (pytest.approx(sigma2[0], rel=1e-9), sure[0])
            for (pos, _), r in zip(points, left[0], strict=True):
                sums[pos] += r
                counts[pos] += 1
        for pos in range(len(values)):
            assert got[name, pos] == (pytest.approx(sums[pos] / counts[pos], rel=1e-7, abs=1e-7) if counts[pos] else None)


@pytest.mark.parametrize("block", [16, 4096])
def test_differences_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(preprocess, "BLOCK", block)
    lists = random_lists(random.Random(3), 5) | {"one": [4.0], "exact": [float(k) for k in range(32)]}
    period = dict(zip(lists, [1, 3, 24, None, 90, 2, 16], strict=True))
    settings = spark.createDataFrame(list(period.items()), "series_id string, estimated_period int")
    found = preprocess.seasonal_diff(series_of(spark, lists), settings)
    expected = set()
    for name, values in lists.items():
        p = period[name]
        for k, v in enumerate(values):
            before = values[k - p] if p and k >= p else None
            expected.add((name, k, v if p is None else None if v is None or before is None else v - before))
    rows = [(r.series_id, r.pos, r.value) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # with the settings
    with pytest.raises(Exception, match="a gap or twice: series exact"):
        preprocess.seasonal_diff(series_of(spark, {"exact": lists["exact"]}).where("pos != 9"), settings).collect()
