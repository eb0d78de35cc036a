"""Exact Gaussian likelihood of ARIMA(p, d, q) for many windows at once.

The windows of a batch have one length, and the recursions run over time only, with all windows (and all parameter
vectors that are tried for them) in one array. The innovation variance is concentrated out of the likelihood; with d = 0
the mean is a generalised least squares estimate. Parameters stay stationary and invertible by way of partial
autocorrelations. See Harvey (1989), Durbin and Koopman (2012), Monahan (1984).
"""

from __future__ import annotations

from itertools import product

import numpy as np

#: Values of each free parameter, before tanh, from which the search may start.
STARTS = (-2.0, -0.8, -0.2, 0.2, 0.8, 2.0)
KEPT_STARTS = 2
ROUNDS = 80
#: Points of the grid along phi where p, q <= 1 (along theta there are twice as many, since maxima stand close to its ends), and hollows of it in which a search begins, at most.
GRID, KEPT_HOLLOWS = 15, 8
STEP = 1e-5
#: The search ends where a step would change the log-likelihood by less.
CLOSE = 1e-9


def checked_order(order: tuple[int, int, int] | list[int]) -> tuple[int, int, int]:
    """Three whole numbers, none negative."""
    if len(order) != 3:
        raise ValueError("a model order is three numbers (p, d, q)")
    if any(int(x) != x or x < 0 for x in order):
        raise ValueError("a model order has whole numbers from 0 on")
    return tuple(int(x) for x in order)


def coefficients(free: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from unbounded parameters (rows)."""
    partial = np.tanh(free)
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        r = partial[:, k : k + 1]
        out[:, :k] = out[:, :k] - r * out[:, :k][:, ::-1]
        out[:, k] = r[:, 0]
    return out


def _stationary(phi: np.ndarray, shock: np.ndarray) -> np.ndarray:
    """The state's covariance before the first observation: P = T P T' + R R'."""
    lanes, r = phi.shape
    move = np.zeros((lanes, r, r))
    move[:, :, 0] = phi
    move[:, np.arange(r - 1), np.arange(1, r)] = 1
    square = np.einsum("lij,lkm->likjm", move, move).reshape(lanes, r * r, r * r)
    noise = np.einsum("li,lj->lij", shock, shock).reshape(lanes, r * r, 1)
    return np.linalg.solve(np.eye(r * r) - square, noise).reshape(lanes, r, r)


def innovations(x: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One-step prediction errors (lanes, columns, time) and their variances (lanes, time), relative to the shocks' variance.

    ``x`` is (lanes, columns, time): the columns of a lane are filtered with the same parameters.
    """
    lanes, columns, n = x.shape
    r = max(phi.shape[1], theta.shape[1] + 1)
    auto = np.zeros((lanes, r))
    auto[:, : phi.shape[1]] = phi
    shock = np.zeros((lanes, r))
    shock[:, 0] = 1
    shock[:, 1 : 1 + theta.shape[1]] = theta
    # lanes come last, so that every step runs over them in a row
    cov = np.ascontiguousarray(_stationary(auto, shock).transpose(1, 2, 0))
    auto, shock = np.ascontiguousarray(auto.T), np.ascontiguousarray(shock.T)
    noise = shock[:, None] * shock[None]
    times = np.ascontiguousarray(x.transpose(2, 1, 0))
    state = np.zeros((r, columns, lanes))
    errors, variances = np.empty_like(times), np.empty((n, lanes))
    steady = False
    for t in range(n):
        if not steady:
            f = cov[0, 0]
            moved = auto[:, None] * cov[0]
            moved[:-1] += cov[1:]
            gain = moved[:, 0] / f
            after = moved[:, :1] * auto[None]
            after[:, :-1] += moved[:, 1:]
            after += noise - gain[:, None] * (gain * f)
            steady = t % 4 == 3 and bool(np.abs(after - cov).max() < 1e-13)
            cov = after
        variances[t] = f
        v = np.subtract(times[t], state[0], out=errors[t])
        moved = state[0] * auto[:, None]
        moved[:-1] += state[1:]
        moved += gain[:, None] * v
        state = moved
    return errors.transpose(2, 1, 0), variances.T


def first_order(free: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """phi and theta of models with p, q <= 1 from their unbounded parameters, and by how much they move with these.

    theta is a sine: many windows have their maximum at -1 or 1 itself, where the likelihood is level, and a sine is there at a finite angle.
    """
    phi = np.tanh(free[:, 0]) if p else np.zeros(len(free))
    angle = free[:, p] if free.shape[1] > p else np.zeros(len(free))
    return phi, -np.sin(angle), 1 - phi * phi, -np.cos(angle)


def first_variances(phi: np.ndarray, theta: np.ndarray, n: int) -> np.ndarray:
    """Variances of the prediction errors of models with p, q <= 1 (time, lanes), by their closed recursion."""
    out = np.empty((n, len(phi)))
    out[0] = (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    square = theta * theta
    for t in range(1, n):
        out[t] = 1 + square - square / out[t - 1]
    return out


def first_errors(times: np.ndarray, phi: np.ndarray, theta: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Prediction errors (time, ..., lanes) of ``times`` of the same shape."""
    out = times.copy()
    out[1:] -= phi * times[:-1]
    gains = theta / variances
    for t in range(1, len(times)):
        out[t] -= gains[t - 1] * out[t - 1]
    return out


def _first_profile(x: np.ndarray, free: np.ndarray, p: int, mean: bool, slopes: bool = False) -> tuple[np.ndarray, ...]:
    """-2 log-likelihood, variance and errors for models with p, q <= 1; with ``slopes`` also the derivatives by the unbounded parameters.

    The derivatives follow the recursion's own, so one pass gives them all. The mean, which is at its best, doesn't add to them.
    """
    n, k = x.shape[1], free.shape[1]
    phi, theta, of_phi, of_theta = first_order(free, p)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        f = first_variances(phi, theta, n)
        times = np.ascontiguousarray(x.T)[:, None]
        if mean:
            times = np.concatenate([times, np.ones_like(times)], axis=1)
        errors = first_errors(times, phi, theta, f)
        v, level = errors[:, 0], 0.0
        if mean:
            one = errors[:, 1]
            level = (v * one / f).sum(0) / (one * one / f).sum(0)
            v = v - level * one
        total = (v * v / f).sum(0)
        value = n * np.log(total / n) + np.log(f).sum(0)
        value = np.where(np.isnan(value), np.inf, value)
        if not slopes:
            return value, total / n, v.T
        # the errors of what is left without the mean, and their derivatives
        z = times[:, 0] - level * times[:, 1] if mean else times[:, 0]
        gain, square = theta / f, theta * theta
        out = np.empty((len(x), k))
        for j in range(k):
            own = j < p
            df, dv = np.empty_like(f), np.zeros_like(v)
            top = 1 + 2 * phi * theta + square
            df[0] = (2 * theta * (1 - phi * phi) + 2 * phi * top) / (1 - phi * phi) ** 2 if own else 2 * (phi + theta) / (1 - phi * phi)
            decay = square / (f * f)
            added = 0.0 if own else 2 * theta * (1 - 1 / f)
            for t in range(1, n):
                df[t] = decay[t - 1] * df[t - 1] + (0.0 if own else added[t - 1])
            dgain = -gain / f * df + (0.0 if own else 1 / f)
            pushed = -dgain[:-1] * v[:-1] - (z[:-1] if own else 0.0)
            for t in range(1, n):
                dv[t] = pushed[t - 1] - gain[t - 1] * dv[t - 1]
            moved = n * (2 * v * dv / f - v * v * df / (f * f)).sum(0) / total + (df / f).sum(0)
            out[:, j] = moved * (of_phi if own else of_theta)
        return value, total / n, v.T, out


def _values_at(x: np.ndarray, free: np.ndarray, p: int, mean: bool) -> np.ndarray:
    """-2 log-likelihood of all windows at the same parameters: one lane, whose columns are the windows."""
    n = x.shape[1]
    rows = np.vstack([x, np.ones((1, n))] if mean else [x])
    if p <= 1 and len(free) - p <= 1:
        phi, theta, _, _ = first_order(free[None], p)
        f = first_variances(phi, theta, n)
        v, f = first_errors(np.ascontiguousarray(rows.T), phi, theta, f).T, f.T
    else:
        phi, theta = coefficients(free[None, :p]), -coefficients(free[None, p:])
        errors, f = innovations(rows[None], phi, theta)
        v = errors[0]
    if mean:
        one = v[-1]
        v = v[:-1] - ((v[:-1] * (one / f[0])).sum(1) / (one * one / f[0]).sum())[:, None] * one
    with np.errstate(divide="ignore", invalid="ignore"):
        value = n * np.log((v * v / f[0]).sum(1) / n) + np.log(f[0]).sum()
    return np.where(np.isnan(value), np.inf, value)


def _profile(x: np.ndarray, free: np.ndarray, p: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """-2 log-likelihood (up to a constant), variance, and errors for each lane."""
    if p <= 1 and free.shape[1] - p <= 1:
        return _first_profile(x, free, p, mean)
    phi, theta = coefficients(free[:, :p]), -coefficients(free[:, p:])
    n = x.shape[1]
    stacked = np.stack([x, np.ones_like(x)], axis=1) if mean else x[:, None, :]
    errors, f = innovations(stacked, phi, theta)
    v = errors[:, 0]
    if mean:
        one = errors[:, 1]
        level = (v * one / f).sum(1) / (one * one / f).sum(1)
        v = v - level[:, None] * one
    var = (v * v / f).sum(1) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        value = n * np.log(var) + np.log(f).sum(1)
    return np.where(np.isnan(value), np.inf, value), var, v


def _gradient(x: np.ndarray, free: np.ndarray, p: int, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    lanes, k = free.shape
    if p <= 1 and k - p <= 1:
        value, _, _, slopes = _first_profile(x, free, p, mean, slopes=True)
        return value, slopes
    moves = np.concatenate([np.zeros((1, k)), STEP * np.eye(k), -STEP * np.eye(k)])
    tried = (free[:, None, :] + moves[None]).reshape(-1, k)
    value = _profile(np.repeat(x, len(moves), axis=0), tried, p, mean)[0].reshape(lanes, -1)
    return value[:, 0], (value[:, 1 : k + 1] - value[:, k + 1 :]) / (2 * STEP)


def _minimise(x: np.ndarray, free: np.ndarray, p: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Batched quasi-Newton search: parameters, value, and whether each lane converged."""
    lanes, k = free.shape
    free = free.copy()
    value, grad = _gradient(x, free, p, mean)
    inverse = np.tile(np.eye(k) / 10, (lanes, 1, 1))
    done = ~np.isfinite(value)
    converged = np.zeros(lanes, bool)
    for _ in range(ROUNDS):
        live = np.flatnonzero(~done)
        if not len(live):
            break
        step = -np.einsum("lij,lj->li", inverse[live], grad[live])
        slope = (step * grad[live]).sum(1)
        uphill = slope > 0
        step[uphill] = -grad[live][uphill] / 10
        slope = (step * grad[live]).sum(1)
        step *= np.minimum(1, 1.5 / np.maximum(1e-12, np.abs(step).max(1)))[:, None]
        flat = -slope < CLOSE
        converged[live[flat]] = done[live[flat]] = True
        live, step = live[~flat], step[~flat]
        if not len(live):
            break
        size = np.ones(len(live))
        new = free[live] + step
        found = _profile(x[live], new, p, mean)[0]
        for _ in range(12):
            worse = np.flatnonzero(~(found <= value[live] + 1e-10))
            if not len(worse):
                break
            size[worse] *= 0.35
            new[worse] = free[live[worse]] + size[worse, None] * step[worse]
            found[worse] = _profile(x[live[worse]], new[worse], p, mean)[0]
        stuck = ~(found <= value[live] + 1e-10)
        done[live[stuck]] = True
        converged[live[stuck]] = np.abs(grad[live[stuck]]).max(1) < 1e-2
        live, new = live[~stuck], new[~stuck]
        if not len(live):
            continue
        new_value, new_grad = _gradient(x[live], new, p, mean)
        s, y = new - free[live], new_grad - grad[live]
        sy = (s * y).sum(1)
        ok = sy > 1e-12
        rho = np.where(ok, 1 / np.where(ok, sy, 1), 0)
        left = np.eye(k) - rho[:, None, None] * s[:, :, None] * y[:, None, :]
        update = left @ inverse[live] @ left.transpose(0, 2, 1) + rho[:, None, None] * s[:, :, None] * s[:, None, :]
        inverse[live] = np.where(ok[:, None, None], update, np.eye(k) / 10)
        free[live], value[live], grad[live] = new, new_value, new_grad
    return free, value, converged


def _polish(x: np.ndarray, free: np.ndarray, p: int, mean: bool) -> np.ndarray:
    """Two Newton steps from where the search ended, by one Hessian; they are left out where it isn't that of a minimum."""
    lanes, k = free.shape
    sides = [[_gradient(x, free + sign * 10 * STEP * np.eye(k)[j], p, mean)[1] for sign in (1, -1)] for j in range(k)]
    hess = np.stack([(up - down) / (20 * STEP) for up, down in sides], axis=2)
    hess = (hess + hess.transpose(0, 2, 1)) / 2
    curved = np.isfinite(hess).all((1, 2))
    curved[curved] = np.linalg.eigvalsh(hess[curved])[:, 0] > 1e-3
    for _ in range(2):
        grad = _gradient(x, free, p, mean)[1]
        ok = curved & np.isfinite(grad).all(1)
        step = np.zeros_like(free)
        step[ok] = np.linalg.solve(hess[ok], grad[ok][:, :, None])[:, :, 0]
        free = np.where((np.abs(step).max(1) < 0.05)[:, None], free - step, free)
    return free


def first_axes(p: int, k: int) -> list[np.ndarray]:
    """The grid's values of each unbounded parameter of models with p, q <= 1: those of theta reach from -1 to 1, both included."""
    of_phi, of_theta = np.arctanh(np.linspace(-0.98, 0.98, GRID)), np.linspace(-np.pi / 2, np.pi / 2, 2 * GRID + 1)
    return [of_phi] * p + [of_theta] * (k - p)


def hollows(tried: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Where a grid's values (windows, then an axis for each parameter) are lower than all around: (windows, flat places) of the lowest, the second lowest, and so on, ``n`` at most."""
    shape = tried.shape[1:]
    around = np.pad(tried, [(0, 0), *[(1, 1)] * len(shape)], constant_values=np.inf)
    low = np.ones_like(tried, bool)
    for move in product((-1, 0, 1), repeat=len(shape)):
        if any(move):
            low &= tried <= around[(slice(None), *(slice(1 + m, 1 + m + size) for m, size in zip(move, shape, strict=True)))]
    flat = np.where(low, tried, np.inf).reshape(len(tried), -1)
    order = np.argsort(flat, axis=1)[:, :n]
    found = []
    for j in range(order.shape[1]):
        rows = np.flatnonzero(np.isfinite(np.take_along_axis(flat, order[:, j : j + 1], axis=1)[:, 0]))
        found.append((rows, order[rows, j]))
    return found


def search(x: np.ndarray, p: int, k: int, mean: bool) -> tuple[np.ndarray, np.ndarray]:
    """The best parameters found for each window, and whether the search for them converged.

    With p, q <= 1 the likelihood is worked out on a grid of all parameters, which all windows share, and a search begins in each of its hollows, ``KEPT_HOLLOWS`` at most: windows of few
    rows often have several maxima. Other models begin at the most likely of fewer starts.
    """
    if p <= 1 and k - p <= 1:
        axes = first_axes(p, k)
        grid = np.array(list(product(*axes)))
        tried = np.stack([_values_at(x, g, p, mean) for g in grid], axis=1)
        found = hollows(tried.reshape(len(x), *map(len, axes)), KEPT_HOLLOWS)
        rows, places = np.concatenate([r for r, _ in found]), np.concatenate([at for _, at in found])
    else:
        grid = np.array(list(product(STARTS, repeat=k))) if k <= 2 else np.random.default_rng(k).uniform(-2, 2, (64, k))
        tried = np.stack([_values_at(x, g, p, mean) for g in grid], axis=1)
        places = np.argsort(tried, axis=1)[:, :KEPT_STARTS]
        rows, places = np.repeat(np.arange(len(x)), places.shape[1]), places.ravel()
    ends, values, ok = _minimise(x[rows], grid[places], p, mean)
    free, sure = np.zeros((len(x), k)), np.zeros(len(x), bool)
    order = np.lexsort((-np.arange(len(rows)), -values))  # the best of a window comes last
    free[rows[order]], sure[rows[order]] = ends[order], ok[order]
    return _polish(x, free, p, mean), sure


def fit(windows: np.ndarray, order: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovation variance, residuals on the level of the values, and convergence, for each row of ``windows``.

    A residual is the value less its one-step prediction. The first d values have no prediction from the past, and
    their residuals are the values themselves. Rows that are too short or not finite get NaN.
    """
    p, d, q = checked_order(order)
    n_rows, length = windows.shape
    variance, residuals = np.full(n_rows, np.nan), np.full((n_rows, length), np.nan)
    converged = np.zeros(n_rows, bool)
    good = np.isfinite(windows).all(axis=1)
    if length - d < p + q + 2 or not good.any():
        return variance, residuals, converged
    levels = windows[good]
    x = np.diff(levels, n=d, axis=1)
    mean, k = d == 0, p + q
    centre = x.mean(1, keepdims=True) if mean else 0.0
    spread = np.sqrt(((x - centre) ** 2).mean(1))
    flat = spread <= 1e-12 * np.maximum(1.0, np.abs(levels).max(1))
    scaled = (x - centre) / np.where(flat, 1.0, spread)[:, None]
    scaled[flat] = 0.0
    free, sure = np.zeros((len(x), k)), np.ones(len(x), bool)
    live = np.flatnonzero(~flat)
    if k and len(live):
        free[live], sure[live] = search(scaled[live], p, k, mean)
    _, var, errors = _profile(scaled, free, p, mean)
    scale = np.where(flat, 0.0, spread)
    variance[good] = var * scale**2
    residuals[np.flatnonzero(good)[:, None], np.arange(d, length)] = errors * scale[:, None]
    residuals[np.flatnonzero(good)[:, None], np.arange(d)] = levels[:, :d]
    converged[good] = sure
    return variance, residuals, converged
