"""Spectra of many tasks against numpy."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from driftline.operators import periods, spectrum


@pytest.mark.parametrize("band", [1, 64, 1000, 1 << 20])
def test_powers_of_any_length(spark, band):
    rng = np.random.default_rng(band)
    lists = {f"s{n}": rng.standard_normal(n) for n in ((8, 97, 1000) if band == 1 else (2, 3, 8, 97, 128, 1000, 4999))}
    rows = [(name, k, len(x), float(v)) for name, x in lists.items() for k, v in enumerate(x)]
    found = spectrum.long_powers(spark.createDataFrame(rows, "series_id string, cpos long, n long, x double").repartition(4), band).collect()
    assert len(found) == sum(len(x) // 2 for x in lists.values())
    for name, x in lists.items():
        own = sorted((r.k, r.period, r.power) for r in found if r.series_id == name)
        expected = np.abs(np.fft.rfft(x)) ** 2
        np.testing.assert_allclose([p for *_, p in own], expected[1 : len(x) // 2 + 1], atol=1e-9 * expected.sum())
        assert [k for k, *_ in own] == list(range(1, len(x) // 2 + 1)) and all(p == pytest.approx(len(x) / k) for k, p, _ in own)


def test_a_long_series_of_many_bands(spark):
    n = 300_007
    x = np.sin(np.arange(n) / 7) + np.random.default_rng(0).standard_normal(n)
    rows = spark.createDataFrame([(x.tolist(),)], "x array<double>").selectExpr("'a' AS series_id", "posexplode(x) AS (cpos, x)").selectExpr("series_id", "cast(cpos AS long) AS cpos", f"cast({n} AS long) AS n", "x")
    found = spectrum.long_powers(rows, 1 << 14).toPandas().sort_values("k")
    expected = np.abs(np.fft.rfft(x)) ** 2
    np.testing.assert_allclose(found["power"], expected[1 : n // 2 + 1], atol=1e-9 * expected.sum())


def test_periodogram_is_the_same_by_either_way(spark):
    start = dt.datetime(2026, 1, 1)
    rows = [(s, k, start + dt.timedelta(seconds=k), float(np.sin(k / 5) + k % 3) if k % 11 else None) for s, n in (("a", 400), ("b", 90), ("c", 5)) for k in range(n)]
    series = spark.createDataFrame(rows, "series_id string, pos long, time timestamp_ntz, value double")
    one, many = (sorted(map(tuple, periods.periodogram(series, longest=size).collect())) for size in (1000, 100))
    assert [r[:3] for r in one] == [r[:3] for r in many] and len(one) > 100
    np.testing.assert_allclose([r[3] for r in one], [r[3] for r in many], atol=1e-7)
