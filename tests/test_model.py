"""The window model: closed forms, recovery of parameters, and the best of a fine grid."""

from __future__ import annotations

import numpy as np
import pytest

from driftline.functions import arima


def arma(rows, n, phi, theta, seed=0):
    e = np.random.default_rng(seed).standard_normal((rows, n + 100))
    x = np.zeros_like(e)
    for t in range(1, n + 100):
        x[:, t] = phi * x[:, t - 1] + e[:, t] + theta * e[:, t - 1]
    return x[:, 100:]


def test_closed_forms():
    x = arma(20, 60, 0.3, 0.0) * 4 + 9
    np.testing.assert_allclose(arima.fit(x, (0, 0, 0))[0], x.var(1))
    for d in (1, 2):
        sigma2, residuals, _ = arima.fit(x, (0, d, 0))
        np.testing.assert_allclose(sigma2, (np.diff(x, n=d) ** 2).mean(1))
        np.testing.assert_allclose(residuals[:, d:], np.diff(x, n=d))
        np.testing.assert_allclose(residuals[:, :d], x[:, :d])


def test_first_order_autoregression_has_the_root_of_a_cubic():
    x = np.cumsum(arma(40, 50, 0.5, 0.0), axis=1) * 20
    sigma2, _, converged = arima.fit(x, (1, 1, 0))
    assert converged.all()
    for found, z in zip(sigma2, np.diff(x), strict=True):
        m, c, b = len(z), (z * z).sum(), (z[1:] * z[:-1]).sum()
        a = c - z[0] ** 2 - z[-1] ** 2
        phi = sorted(np.roots([a * (m - 1), -b * (m - 2), -(a * m + c), b * m]).real)[1]
        assert found == pytest.approx((c - 2 * b * phi + a * phi * phi) / m, rel=1e-9)


def test_recovers_parameters():
    x = arma(200, 200, 0.6, 0.3)
    scaled = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    free, _, ok = arima._minimise(scaled, np.tile([0.4, -0.4], (200, 1)), 1, True)
    assert ok.mean() > 0.98
    phi, theta, _, _ = arima.first_order(free, 1)
    assert np.median(phi) == pytest.approx(0.6, abs=0.06)
    assert np.median(theta) == pytest.approx(0.3, abs=0.06)
    assert arima.fit(x, (1, 0, 1))[0].mean() == pytest.approx(1.0, abs=0.05)


def test_is_as_good_as_a_fine_grid():
    x = arma(12, 50, 0.5, 0.4, 3)
    scaled = np.diff(x) / np.sqrt((np.diff(x) ** 2).mean(1, keepdims=True))
    grid = np.full(12, np.inf)
    for a in np.linspace(-2.5, 2.5, 31):
        for b in np.linspace(-2.5, 2.5, 31):
            grid = np.minimum(grid, arima._profile(scaled, np.tile([[a, b]], (12, 1)), 1, False)[0])
    free, _ = arima.search(scaled, 1, 2, False)
    assert (arima._profile(scaled, free, 1, False)[0] <= grid + 1e-3).all()


def test_scale_and_shift():
    x = arma(10, 60, 0.5, 0.2, 5)
    for order in ((1, 0, 1), (1, 1, 1), (2, 0, 0)):
        base = arima.fit(x, order)[0]
        np.testing.assert_allclose(arima.fit(x * 7, order)[0], base * 49, rtol=1e-4)
        np.testing.assert_allclose(arima.fit(x + 50, order)[0], base, rtol=1e-4)


def test_windows_that_cannot_be_fitted():
    sigma2, residuals, _ = arima.fit(np.array([[1.0, np.inf, 2, 3, 4, 5], [2.0] * 6]), (0, 1, 0))
    assert np.isnan(sigma2[0]) and np.isnan(residuals[0]).all() and sigma2[1] == 0
    assert np.isnan(arima.fit(np.ones((1, 3)), (2, 1, 2))[0]).all()


@pytest.mark.parametrize("order", [(1, 0), (1, -1, 0), (1, 0, 1, 0)])
def test_order_is_checked(order):
    with pytest.raises(ValueError, match="a model order"):
        arima.checked_order(order)


@pytest.mark.parametrize(("p", "q", "mean"), [(1, 1, False), (1, 1, True), (0, 1, True), (1, 0, False)])
def test_first_order_models_follow_the_general_recursion(p, q, mean):
    rng = np.random.default_rng(p + 2 * q)
    x, free = rng.standard_normal((30, 40)), rng.uniform(-1.4, 1.4, (30, p + q))
    value, var, errors, slopes = arima._first_profile(x, free, p, mean, slopes=True)
    phi, theta, _, _ = arima.first_order(free, p)
    stacked = np.stack([x, np.ones_like(x)], axis=1)
    v, f = arima.innovations(stacked, phi[:, None] if p else np.zeros((30, 0)), theta[:, None] if q else np.zeros((30, 0)))
    own = v[:, 0] - ((v[:, 0] * v[:, 1] / f).sum(1) / (v[:, 1] ** 2 / f).sum(1))[:, None] * v[:, 1] if mean else v[:, 0]
    np.testing.assert_allclose(errors, own, atol=1e-10)
    np.testing.assert_allclose(var, (own * own / f).mean(1), rtol=1e-9)
    np.testing.assert_allclose(value, 40 * np.log(var) + np.log(f).sum(1), rtol=1e-9)
    np.testing.assert_allclose([arima._values_at(x, free[0], p, mean)[k] for k in (0, 7)], [arima._profile(x[[k]], free[[0]], p, mean)[0][0] for k in (0, 7)], rtol=1e-9)
    for j in range(p + q):
        up, down = (arima._profile(x, free + s * 1e-6 * np.eye(p + q)[j], p, mean)[0] for s in (1, -1))
        np.testing.assert_allclose(slopes[:, j], (up - down) / 2e-6, atol=2e-3, rtol=1e-4)


def test_a_moving_average_at_its_bound_is_found_exactly():
    x = np.diff(np.random.default_rng(1).standard_normal((200, 40)))
    free, sure = arima.search(x / np.sqrt((x * x).mean(1))[:, None], 0, 1, False)
    theta = arima.first_order(free, 0)[1]
    assert sure.all() and (np.abs(theta + 1) < 1e-9).mean() > 0.5


@pytest.mark.parametrize("order", [(1, 1, 1), (1, 0, 1)])
def test_few_windows_have_a_better_maximum_than_the_one_found(order, monkeypatch):
    rng = np.random.default_rng(0)
    s = np.cumsum(rng.standard_normal(3000) * 0.2) + rng.exponential(50, 3000)
    x = np.diff(np.lib.stride_tricks.sliding_window_view(s, 50)[::12], n=order[1], axis=1)
    x = (x - x.mean(1, keepdims=True)) / x.std(1, keepdims=True)
    value = arima._profile(x, arima.search(x, 1, 2, order[1] == 0)[0], 1, order[1] == 0)[0]
    monkeypatch.setattr(arima, "GRID", 41)
    monkeypatch.setattr(arima, "KEPT_HOLLOWS", 16)
    best = arima._profile(x, arima.search(x, 1, 2, order[1] == 0)[0], 1, order[1] == 0)[0]
    assert (value > best + 1e-6).mean() < 0.02 and (value - best).max() < 0.3
