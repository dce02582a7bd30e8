"""Kernel values against a bounded set of landmark vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col


def kernel_matrix(a: np.ndarray, b: np.ndarray, kind: str = "rbf", gamma: float = 1.0, coef0: float = 0.0, degree: int = 3) -> np.ndarray:
    if kind == "linear":
        return a @ b.T
    if kind in ("poly", "polynomial"):
        return (gamma * a @ b.T + coef0) ** degree
    if kind == "sigmoid":
        return np.tanh(gamma * a @ b.T + coef0)
    if kind == "rbf":
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return np.exp(-gamma * np.maximum(d2, 0.0))
    raise ValueError(f"unknown kernel {kind}")


def landmarks(df: DataFrame, vector: str, key: str, n: int) -> np.ndarray:
    """The first n vectors by key; n bounds what every task receives."""
    rows = df.orderBy(key).limit(n).select(col(vector).cast("array<double>").alias("v")).collect()
    return np.array([r.v for r in rows])


def kernel_values(vector: str, points: np.ndarray, kind: str | Callable, **params) -> Column:
    """array<double> with one kernel value per landmark; ``kind`` may be a function of two matrices."""

    @F.pandas_udf("array<double>")
    def values(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(float)
        k = kind(x, points) if callable(kind) else kernel_matrix(x, points, kind, **params)
        return pd.Series(list(k))

    return values(col(vector))


def kernel_decision(vector: str, support: np.ndarray, dual: Sequence[float], bias: float, kind: str, **params) -> Column:
    """sum(alpha y K(x, support)) + bias, the scoring form of a kernel machine."""
    weights = np.asarray(dual, dtype=float)

    @F.pandas_udf("double")
    def decide(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(float)
        return pd.Series(kernel_matrix(x, support, kind, **params) @ weights + bias)

    return decide(col(vector))


def random_features(vector: str, dim: int, n_features: int, gamma: float, seed: int) -> Column:
    """sqrt(2/D) cos(Wx + b): dot products of these approach the rbf kernel."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2 * gamma), (dim, n_features))
    b = rng.uniform(0.0, 2 * np.pi, n_features)

    @F.pandas_udf("array<double>")
    def project(s: pd.Series) -> pd.Series:
        x = np.stack(s.to_numpy()).astype(float)
        return pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(x @ w + b)))

    return project(col(vector))
