"""Stochastic gradient training of linear models.

With fixed batches, one mini-batch step depends on the batch only through its
cross products, so one job over the data serves all steps of all epochs. The
one-row-per-step form runs inside a fixed number of parts and averages their
weights.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.models.linear import LinearModel, _with_bias
from granary.operators.gram import Moments, moments, total
from granary.operators.ranking import key_hash

ROWS_PER_PART = 10_000

# fixed values: learning rate at epoch t of T from start value r and decay d
SCHEDULES: dict[str, Callable[[float, float, float, float], float]] = {
    "constant": lambda r, d, t, T: r,
    "inverse": lambda r, d, t, T: r / (1 + d * t),
    "exponential": lambda r, d, t, T: r * math.exp(-d * t),
    "polynomial": lambda r, d, t, T: r * (1 - d * t) ** 2,
    "cosine": lambda r, d, t, T: r * (1 + math.cos(math.pi * t / T)) / 2,
    "sigmoid": lambda r, d, t, T: r / (1 + math.exp(-d * t)),
    "step": lambda r, d, t, T: r * (1 - d * t),
    "cyclic": lambda r, d, t, T: r * (1 + math.sin(2 * math.pi * t / T)) / 2,
}


def schedule(name: str, rate: float, decay: float, t: float, epochs: float) -> float:
    if name not in SCHEDULES:
        raise ValueError(f"unknown schedule {name}")
    return SCHEDULES[name](rate, decay, t, epochs)


def batch_moments(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], n_batches: int, seed: int
) -> dict[int, Moments]:
    """Cross products of hash-assigned batches; ``n_batches`` bounds what reaches the driver."""
    batch = F.conv(F.substring(key_hash(keys, seed), 1, 7), 16, 10).cast("long") % n_batches
    return moments(df, features, target, batch)


def mini_batch(
    batches: dict[int, Moments],
    rate: float,
    epochs: int,
    seed: int,
    schedule_name: str = "constant",
    decay: float = 0.01,
    validation: Moments | None = None,
    patience: int | None = None,
) -> LinearModel:
    """Mini-batch descent; with ``validation`` the best epoch's weights are kept."""
    systems = {b: _with_bias(m) for b, m in batches.items()}
    whole = total(batches)
    a_all, c_all, yy = _with_bias(whole)
    rng = np.random.default_rng(seed)
    names = whole.names[:-1]
    theta = np.zeros(len(c_all))
    best, best_cost, waited, costs = theta, math.inf, 0, []
    order = np.array(sorted(systems))
    for epoch in range(epochs):
        r = schedule(schedule_name, rate, decay, epoch, epochs)
        for b in rng.permutation(order):
            a, c, _ = systems[b]
            theta = theta - r * (a @ theta - c)
        if validation is None:
            costs.append(float(theta @ a_all @ theta - 2 * theta @ c_all + yy) / 2)
            best = theta
            continue
        costs.append(validation.squared_error(theta[1:], float(theta[0])) / validation.n)
        if costs[-1] < best_cost:
            best, best_cost, waited = theta, costs[-1], 0
        else:
            waited += 1
            if patience is not None and waited >= patience:
                break
    return LinearModel(names, best[1:], float(best[0]), tuple(costs))


def averaged_sgd(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keys: Sequence[str],
    rate: float,
    epochs: int,
    seed: int,
    schedule_name: str = "inverse",
    decay: float = 0.1,
    parts: int | None = None,
) -> LinearModel:
    """One row per step inside each of ``parts`` parts; row-weighted average after every epoch.

    Without ``parts`` their number follows from that of the rows: one for
    ``ROWS_PER_PART``, at least 8 and at most 4096.

    A row's part and its place in it come from the hash of its keys, so the
    weights depend neither on partitions nor on cores. A task steps through all
    of its parts at once, one row of each as one vector step. Rows with a null
    cell are left out; rows of equal keys go by their values.
    """
    names = [*features, target]
    cells = [f"x{i}" for i in range(len(names))]
    rows = df.select(key_hash(keys, seed).alias("_h"), *[col(c).cast("double").alias(x) for c, x in zip(names, cells)]).dropna()
    parts = parts or min(max(8, rows.count() // ROWS_PER_PART), 4096)
    part = (F.conv(F.substring("_h", 1, 7), 16, 10).cast("long") % parts).cast("int")
    rows = rows.withColumn("_p", part).repartition("_p").sortWithinPartitions("_h", *cells)
    rows = rows.select("_p", *cells).persist(StorageLevel.DISK_ONLY)  # sorted once; a lost part is sorted again
    p = len(features)
    theta = np.zeros(p + 1)
    costs = []
    for epoch in range(epochs):
        r = schedule(schedule_name, rate, decay, epoch, epochs)

        def steps(batches, start=theta, r=r):
            w = np.tile(start, (parts, 1))
            n, sse = np.zeros(parts, np.int64), np.zeros(parts)
            for b in batches:
                own = b.column(0).to_numpy(zero_copy_only=False)
                z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]])
                x, y = np.column_stack([np.ones(len(z)), z[:, :p]]), z[:, p]
                for at in _turns(own):
                    lane = own[at]
                    e = np.einsum("ij,ij->i", x[at], w[lane]) - y[at]
                    w[lane] -= r * e[:, None] * x[at]
                    n[lane] += 1
                    sse[lane] += e * e
            met = np.flatnonzero(n)
            lists = pa.array(list(w[met]), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(met), lists, pa.array(n[met]), pa.array(sse[met])], names=["part", "w", "n", "sse"])

        found = rows.mapInArrow(steps, "part long, w array<double>, n long, sse double").orderBy("part").collect()  # parts rows
        if not found:
            break
        n = np.array([f.n for f in found], float)
        theta = (np.array([f.w for f in found]) * n[:, None]).sum(0) / n.sum()
        costs.append(float(sum(f.sse for f in found) / n.sum() / 2))
    rows.unpersist()
    return LinearModel(tuple(features), theta[1:], float(theta[0]), tuple(costs))


def _turns(own: np.ndarray):
    """Row numbers, the first row of every part, then the second of every part, and so on."""
    order = np.argsort(own, kind="stable")
    first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]]) if len(own) else np.zeros(0, int)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    by_turn = order[np.argsort(place, kind="stable")]
    return np.split(by_turn, np.cumsum(np.bincount(place))[:-1]) if len(own) else []
