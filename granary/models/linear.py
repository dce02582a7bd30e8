"""Linear models solved from sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.gram import Moments, moments


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float
    history: tuple[float, ...] = field(default=())

    def predict(self) -> Column:
        """x . w + b as a column expression."""
        out = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.weights, strict=True):
            out = out + col(f) * F.lit(float(w))
        return out

    def score(self, m: Moments) -> float:
        return r_squared(m.squared_error(self.weights, self.intercept), m.total_squares())

    def coefficients(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(w)) for f, w in zip(self.features, self.weights, strict=True)]
        return spark.createDataFrame([*rows, ("(intercept)", float(self.intercept))], "feature string, weight double")


def r_squared(sse: float, sst: float) -> float:
    """A constant target scores 1 when met exactly, else 0."""
    if sst <= 0:
        return 1.0 if sse <= 1e-12 else 0.0
    return 1.0 - sse / sst


def _parts(m: Moments, fit_intercept: bool):
    if fit_intercept:
        s = m.scatter
    else:
        s = m.scatter + m.n * np.outer(m.mean, m.mean)
    return s[:-1, :-1], s[:-1, -1]


def _model(m: Moments, w: np.ndarray, fit_intercept: bool, history=()) -> LinearModel:
    b = float(m.mean[-1] - m.mean[:-1] @ w) if fit_intercept else 0.0
    return LinearModel(m.names[:-1], w, b, tuple(history))


def ols(m: Moments, fit_intercept: bool = True) -> LinearModel:
    """Least squares; the minimum-norm solution when columns depend on each other."""
    a, c = _parts(m, fit_intercept)
    return _model(m, np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ c, fit_intercept)


def ridge(m: Moments, alpha: float, fit_intercept: bool = True) -> LinearModel:
    """Penalty alpha on the sum of squared residuals; the intercept is free."""
    a, c = _parts(m, fit_intercept)
    return _model(m, np.linalg.solve(a + alpha * np.eye(len(c)), c), fit_intercept)


def _descend(a, c, l1: np.ndarray, l2: float, max_iter: int, tol: float) -> np.ndarray:
    w = np.zeros(len(c))
    for _ in range(max_iter):
        biggest = 0.0
        for j in range(len(c)):
            if a[j, j] <= 0:
                continue
            rho = c[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1[j], 0.0) / (a[j, j] + l2)
            biggest = max(biggest, abs(new - w[j]))
            w[j] = new
        if biggest < tol:
            break
    return w


def lasso(m: Moments, alpha: float, max_iter: int = 1000, tol: float = 1e-8, fit_intercept: bool = True) -> LinearModel:
    """Minimizes squares / (2 n) + alpha |w| by coordinate descent on the cross products."""
    a, c = _parts(m, fit_intercept)
    return _model(m, _descend(a, c, np.full(len(c), alpha * m.n), 0.0, max_iter, tol), fit_intercept)


def elastic_net(
    m: Moments,
    alpha: float,
    l1_ratio: float,
    penalty: str = "textbook",
    abs_deviation: np.ndarray | None = None,
    max_iter: int = 1000,
    tol: float = 1e-8,
) -> LinearModel:
    """Mixed penalty.

    ``textbook``: squares / (2 n) + alpha * (ratio |w| + (1 - ratio) / 2 w^2).
    ``legacy``: the L1 threshold uses the column's summed absolute deviation and
    the L2 part is not multiplied by n.
    """
    a, c = _parts(m, True)
    if penalty == "textbook":
        l1, l2 = np.full(len(c), alpha * l1_ratio * m.n), alpha * (1 - l1_ratio) * m.n
    elif penalty == "legacy":
        if abs_deviation is None:
            raise ValueError("legacy penalty needs abs_deviation")
        l1, l2 = alpha * l1_ratio * np.asarray(abs_deviation), alpha * (1 - l1_ratio)
    else:
        raise ValueError(f"unknown penalty {penalty}")
    return _model(m, _descend(a, c, l1, l2, max_iter, tol), True)


def absolute_deviation(df: DataFrame, m: Moments) -> np.ndarray:
    """Sum of |x - mean| per feature, for the legacy elastic net."""
    names = m.names[:-1]
    row = df.agg(*[F.sum(F.abs(col(f) - F.lit(float(mu)))).alias(f) for f, mu in zip(names, m.mean, strict=False)])
    return np.array(list(row.first()))


def gradient_descent(
    m: Moments, learning_rate: float = 0.01, n_iter: int = 1000, tol: float = 1e-6, start: Sequence[float] | None = None
) -> LinearModel:
    """Batch gradient descent, exact from the cross products.

    Gradient X'(Xw - y) / n, cost squares / (2 n); stops when the cost moves less than tol.
    """
    a, c, yy = _with_bias(m)
    theta = np.zeros(len(c)) if start is None else np.array(start, dtype=float)
    costs: list[float] = []
    for _ in range(n_iter):
        theta = theta - learning_rate * (a @ theta - c)
        costs.append(float(theta @ a @ theta - 2 * theta @ c + yy) / 2)
        if not np.isfinite(costs[-1]):
            break
        if len(costs) > 1 and abs(costs[-2] - costs[-1]) < tol:
            break
    return LinearModel(m.names[:-1], theta[1:], float(theta[0]), tuple(costs))


def _with_bias(m: Moments):
    """Averaged cross products including a column of ones in front."""
    mu = m.mean
    full = m.scatter / m.n + np.outer(mu, mu)
    p = len(mu) - 1
    a = np.empty((p + 1, p + 1))
    a[0, 0], a[0, 1:], a[1:, 0], a[1:, 1:] = 1.0, mu[:-1], mu[:-1], full[:-1, :-1]
    return a, np.append(mu[-1], full[:-1, -1]), float(full[-1, -1])


def learning_rate_finder(m: Moments, rates: Sequence[float], n_iter: int = 50, explode: float = 4.0) -> list[dict]:
    """Final cost per rate on a rising grid; stops once the cost rises or explodes."""
    out: list[dict] = []
    for r in rates:
        cost = gradient_descent(m, r, n_iter, 0.0).history[-1]
        best = min((o["cost"] for o in out), default=np.inf)
        stop = bool(out) and (not np.isfinite(cost) or cost > explode * best or cost > out[-1]["cost"])
        out.append({"rate": float(r), "cost": float(cost), "stopped": stop})
        if stop:
            break
    return out


def regularization_path(m: Moments, kind: str, alphas: Sequence[float], l1_ratio: float = 0.5) -> list[tuple]:
    """(alpha, feature, weight) rows from one set of moments."""
    fit = {"ridge": ridge, "lasso": lasso, "elastic_net": lambda s, a: elastic_net(s, a, l1_ratio)}[kind]
    rows = []
    for a in alphas:
        model = fit(m, a)
        rows += [(float(a), f, float(w)) for f, w in zip(model.features, model.weights, strict=True)]
    return rows


def fit_moments(df: DataFrame, features: Sequence[str], target: str) -> Moments:
    return moments(df, features, target)[None]


def leave_one_out(df: DataFrame, features: Sequence[str], target: str, key: str, alpha: float = 0.0) -> DataFrame:
    """Prediction for each row by the model of all other rows.

    residual / (1 - leverage), the leverage from the inverted cross products:
    one statistics pass and one row-wise expression.
    """
    m = fit_moments(df, features, target)
    model = ridge(m, alpha) if alpha else ols(m)
    a, _ = _parts(m, True)
    inv = np.linalg.pinv(a + alpha * np.eye(len(a)), rcond=1e-12, hermitian=True)
    centred = [col(f) - F.lit(float(mu)) for f, mu in zip(model.features, m.mean, strict=False)]
    leverage = F.lit(1.0 / m.n)
    for i, x in enumerate(centred):
        for j, z in enumerate(centred):
            leverage = leverage + x * z * F.lit(float(inv[i, j]))
    y = col(target)
    residual = y - model.predict()
    held_out = residual / (1 - leverage)
    train_mean = (F.lit(float(m.n * m.mean[-1])) - y) / F.lit(m.n - 1)
    return df.select(
        key,
        (y - held_out).alias("prediction"),
        train_mean.alias("train_mean"),
        (1 - F.try_divide(held_out * held_out, (y - train_mean) * (y - train_mean))).alias("r2"),
    )
