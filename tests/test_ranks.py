"""Medians by narrowing ranges against numpy."""

from __future__ import annotations

import numpy as np
import pytest

from driftline.operators.ranks import medians


@pytest.mark.parametrize("enough", [1, 7, 4096])
def test_medians(spark, enough):
    rng = np.random.default_rng(enough)
    groups = {
        "odd": rng.standard_normal(3001), "even": rng.standard_normal(2000), "tail": np.exp(rng.standard_normal(2500) * 12), "equal": np.full(900, 3.5), "two": np.array([1.0, 4.0]), "one": np.array([-2.0]),
        "halves": np.r_[np.zeros(500), np.ones(500)], "wide": np.r_[-1e308, rng.standard_normal(1000), 1e308], "ties": rng.integers(0, 3, 1000).astype(float),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("none", None)]
    found = {r.g: r["median"] for r in medians(spark.createDataFrame(rows, "g string, p double").repartition(5), "g", "p", enough).collect()}
    assert found == {k: pytest.approx(float(np.median(x)), rel=1e-12, abs=0) for k, x in groups.items()}


def test_no_rows(spark):
    assert medians(spark.createDataFrame([], "g string, p double"), "g", "p").collect() == []
