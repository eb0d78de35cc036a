"""Linear models fitted in numpy on bounded, documented samples, for use inside Spark tasks."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sample_key(column: str = "doc_id") -> Column:
    """A pseudo-random order of rows that any engine can repeat: the MD5 of the identifier."""
    return F.md5(F.col(column).cast("string"))


def bounded_sample(rows: DataFrame, size: int, column: str = "doc_id") -> DataFrame:
    """The rows of the ``size`` first identifiers in the order of ``sample_key``: a bound, whatever the table's size."""
    last = rows.where(F.col(column).isNotNull()).select(sample_key(column).alias("k")).distinct().orderBy("k").limit(size).agg(F.max("k")).first()[0]
    return rows.where(sample_key(column) <= F.lit(last)) if last is not None else rows.limit(0)


def within_bytes(rows: DataFrame, size: str, most: int, column: str = "doc_id") -> DataFrame:
    """The rows of a bounded sample, in the order of ``sample_key``, as long as their ``size`` adds up to ``most`` at most."""
    order = W.orderBy(sample_key(column), column).rowsBetween(W.unboundedPreceding, 0)
    fit = rows.select(column, F.sum(size).over(order).alias("_sum")).where(F.col("_sum") <= most).select(column)
    return rows.join(F.broadcast(fit), column, "left_semi")


def fold_of(doc_id: int, n: int) -> int:
    """A row's fold, by its identifier."""
    return zlib.crc32(b"fold:%d" % doc_id) % n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Scaled:
    """A linear model on features brought to mean 0 and deviation 1; its weights apply to raw features."""

    def __init__(self, x: np.ndarray) -> None:
        self.mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        deviation = x.std(axis=0) if len(x) else np.zeros(x.shape[1])
        self.scale = np.where(deviation > 1e-9, 1 / np.maximum(deviation, 1e-9), 0.0)

    def design(self, x: np.ndarray) -> np.ndarray:
        out = np.ones((len(x), x.shape[1] + 1))
        np.subtract(x, self.mean, out=out[:, :-1])
        out[:, :-1] *= self.scale
        return out

    def raw(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        v = w[:-1] * self.scale
        return v, float(w[-1] - v @ self.mean)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with an L2 penalty, by Newton steps.

    With one class only the weights are 0 and the intercept says so.
    """
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0 if not len(y) else (8.0 if y[0] else -8.0)
    weight = np.ones(len(y)) if weight is None else weight
    scaled = Scaled(x)
    a = scaled.design(x)
    penalty = np.full(a.shape[1], float(l2))
    penalty[-1] = 1e-6
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (weight * (p - y)) + penalty * w
        hess = np.diag(penalty)
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        for k in range(0, len(a), 1024):  # no second copy of the whole design
            hess += (a[k : k + 1024] * curve[k : k + 1024, None]).T @ a[k : k + 1024]
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return scaled.raw(w)


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine (squared hinge), by accelerated gradient steps; y is -1 or 1."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), float(y[0]) if len(y) else 0.0
    weight = (np.ones(len(y)) if weight is None else weight) / len(y)
    scaled = Scaled(x)
    a = scaled.design(x)
    v = np.full(a.shape[1], 1 / np.sqrt(a.shape[1]))
    for _ in range(10):  # the largest eigenvalue bounds the step
        v = a.T @ (weight * (a @ v))
        v /= np.linalg.norm(v) or 1.0
    rate = 1 / (2 * float(v @ (a.T @ (weight * (a @ v)))) * 1.1 + l2)
    w, u = np.zeros(a.shape[1]), np.zeros(a.shape[1])
    for k in range(rounds):
        slack = np.maximum(0.0, 1 - y * (a @ u))
        new = u - rate * (l2 * u - 2 * a.T @ (weight * y * slack))
        u = new + k / (k + 3) * (new - w)
        w = new
    return scaled.raw(w)


def fit_platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into calibrated log-odds."""
    w, b = fit_logistic(margin[:, None], y, l2=1e-2)
    return (float(w[0]), b) if len(y) and y.min() != y.max() else (1.0, 0.0)
