"""Cross-validation and parameter search from fold statistics, and fold loops for other models."""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.models.linear import LinearModel, elastic_net, lasso, ols, r_squared, ridge
from granary.operators.gram import Moments, moments, total

FITS: dict[str, Callable[..., LinearModel]] = {
    "ols": lambda m: ols(m),
    "ridge": lambda m, alpha: ridge(m, alpha),
    "lasso": lambda m, alpha: lasso(m, alpha),
    "elastic_net": lambda m, alpha, l1_ratio: elastic_net(m, alpha, l1_ratio),
}

SCORERS: dict[str, Callable[[float, float, float], float]] = {
    "r2": lambda sse, sst, n: r_squared(sse, sst),
    "mse": lambda sse, sst, n: sse / n,
    "neg_mse": lambda sse, sst, n: -sse / n,
    "rmse": lambda sse, sst, n: math.sqrt(max(sse, 0.0) / n),
}

#: scores that cross products do not give: loss of every row and model from targets (rows x 1) and predictions (rows x models)
ROW_LOSSES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "mae": lambda y, p: np.abs(y - p),
    "neg_mae": lambda y, p: -np.abs(y - p),
}
LOWER_IS_BETTER = ("mse", "rmse", "mae")


def scorer(name: str):
    if name not in SCORERS:
        raise ValueError(f"unknown scoring {name}; use one of {sorted([*SCORERS, *ROW_LOSSES])}")
    return SCORERS[name]


def fit_scaled(kind: str, m: Moments, params: dict, scale: bool) -> LinearModel:
    """Fit on standardized features, weights given back in the original units."""
    if not scale:
        return FITS[kind](m, **params)
    mean, std = m.mean[:-1], m.std[:-1].copy()
    std[std == 0] = 1.0
    z = FITS[kind](m.rescaled(mean, std), **params)
    w = z.weights / std
    return LinearModel(m.names[:-1], w, z.intercept - float(mean @ w))


def fold_models(folds: dict, kind: str, params: dict, scale: bool = False) -> dict[int, LinearModel]:
    """Model per fold, fitted on the total minus that fold."""
    whole = total(folds)
    return {k: fit_scaled(kind, whole - m, params, scale) for k, m in folds.items()}


def cross_val_score(
    folds: dict, kind: str, params: dict, scoring: str = "r2", scale: bool = False, rows: DataFrame | None = None, fold: str = "fold"
) -> list[dict]:
    """Held-out score per fold; no pass over the data unless ``scoring`` needs the rows (see ``row_scores``)."""
    if scoring in ROW_LOSSES:
        return row_scores(rows, folds, kind, [params], scoring, scale, fold)[0]
    score = scorer(scoring)
    out = []
    whole = total(folds)
    for k, model in sorted(fold_models(folds, kind, params, scale).items()):
        m, train = folds[k], whole - folds[k]
        out.append(
            {
                "fold": int(k),
                "n": int(m.n),
                "score": score(m.squared_error(model.weights, model.intercept), m.total_squares(), m.n),
                "train_score": score(
                    train.squared_error(model.weights, model.intercept), train.total_squares(), train.n
                ),
            }
        )
    return out


def row_scores(
    rows: DataFrame | None, folds: dict, kind: str, candidates: Sequence[dict], scoring: str, scale: bool = False, fold: str = "fold"
) -> list[list[dict]]:
    """``cross_val_score`` of every candidate for a mean loss per row, in one pass over the rows.

    The weights of all candidates and folds are one matrix, so a batch of rows
    is scored by one product; a task sends one row per fold, with the summed
    losses of all models. A model's losses on other folds are its training score.
    Rows with a null or NaN cell or without a fold are left out, as in ``folds``.
    """
    if rows is None:
        raise ValueError(f"scoring {scoring} needs the rows")
    loss, names = ROW_LOSSES[scoring], next(iter(folds.values())).names
    keys = sorted(folds)
    models = [m for params in candidates for _, m in sorted(fold_models(folds, kind, params, scale).items())]
    weights = np.column_stack([np.append(m.weights, m.intercept) for m in models])
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    width = len(keys)

    def run(batches):
        sums, n = np.zeros((width, shared.value.shape[1])), np.zeros(width, np.int64)
        for b in batches:
            z = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).astype(float)
            at = np.searchsorted(keys, b.column(0).to_numpy(zero_copy_only=False))
            for start in range(0, len(z), 4096):
                part, here = z[start : start + 4096], at[start : start + 4096]
                losses = loss(part[:, -1:], part[:, :-1] @ shared.value[:-1] + shared.value[-1])
                np.add.at(sums, here, losses)
                n += np.bincount(here, minlength=width)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(n[met]), pa.array(list(sums[met]), pa.list_(pa.float64()))], names=["fold", "n", "losses"]
        )

    cells = rows.select(col(fold).cast("long").alias("_fold"), *[col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    cells = cells.dropna().where(F.col("_fold").isin([int(k) for k in keys]))
    parts = cells.mapInArrow(run, "fold long, n long, losses array<double>")
    # one row per task and fold, added up per fold and model
    parts = parts.select("fold", "n", F.posexplode("losses").alias("model", "loss")).groupBy("fold", "model").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    sums, n = np.zeros((width, len(models))), np.zeros(width)
    for r in parts.collect():
        sums[r.fold, r.model], n[r.fold] = r.loss, r.n
    out = []
    for c in range(len(candidates)):
        own = []
        for i, k in enumerate(keys):
            losses, others = sums[:, c * width + i], np.arange(width) != i
            train = float(losses[others].sum() / n[others].sum()) if n[others].any() else 0.0
            own.append({"fold": int(k), "n": int(n[i]), "score": float(losses[i] / n[i]), "train_score": train})
        out.append(own)
    return out


def cross_val_predict(df: DataFrame, models: dict[int, LinearModel], fold: str, out: str = "prediction") -> DataFrame:
    """Each row is predicted by the model that did not see its fold."""
    expr = F.lit(None).cast("double")
    for k, model in models.items():
        expr = F.when(col(fold) == k, model.predict()).otherwise(expr)
    return df.withColumn(out, expr)


def parameter_grid(grid: dict[str, Sequence]) -> list[dict]:
    names = list(grid)
    return [dict(zip(names, values, strict=True)) for values in itertools.product(*grid.values())]


def sample_parameters(distributions: dict[str, object], n_iter: int, seed: int) -> list[dict]:
    """Seeded draws: a list is sampled uniformly, a (low, high, 'log') tuple log-uniformly."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_iter):
        p = {}
        for name, d in distributions.items():
            if isinstance(d, tuple) and len(d) == 3 and d[2] == "log":
                p[name] = float(np.exp(rng.uniform(math.log(d[0]), math.log(d[1]))))
            elif isinstance(d, tuple):
                p[name] = float(rng.uniform(d[0], d[1]))
            else:
                p[name] = d[int(rng.integers(len(d)))]
        out.append(p)
    return out


def search(
    folds: dict,
    kind: str,
    candidates: Sequence[dict],
    scoring: str = "r2",
    scale: bool = False,
    data: DataFrame | None = None,
    fold: str = "fold",
) -> list[dict]:
    """Every candidate on every fold; rank 1 is the best, the first one on a tie.

    Losses of single rows (``ROW_LOSSES``) need ``data``; one job scores all candidates.
    """
    sign = -1.0 if scoring in LOWER_IS_BETTER else 1.0
    rows = []
    known = row_scores(data, folds, kind, candidates, scoring, scale, fold) if scoring in ROW_LOSSES else None
    for i, params in enumerate(candidates):
        t0 = time.perf_counter()
        scores = known[i] if known else cross_val_score(folds, kind, params, scoring, scale)
        test = np.array([s["score"] for s in scores])
        train = np.array([s["train_score"] for s in scores])
        rows.append(
            {
                "candidate": i,
                "params": params,
                "mean_score": float(test.mean()),
                "std_score": float(test.std()),
                "mean_train_score": float(train.mean()),
                "fit_seconds": time.perf_counter() - t0,
            }
        )
    order = sorted(rows, key=lambda r: (-sign * r["mean_score"], r["candidate"]))
    for rank, r in enumerate(order, 1):
        r["rank"] = rank
    return rows


def best_model(folds: dict, kind: str, results: list[dict], scale: bool = False) -> LinearModel:
    """Refit of the first-ranked candidate on all rows."""
    best = min(results, key=lambda r: r["rank"])
    return fit_scaled(kind, total(folds), best["params"], scale)


def learning_curve(
    df: DataFrame, features: Sequence[str], target: str, fold: str, hash_unit: str, sizes: Sequence[float], kind: str, params: dict
) -> list[dict]:
    """Train and held-out RMSE per training share and fold from one job.

    ``hash_unit`` is a column in [0, 1): rows below a share form that training prefix.
    """
    cell = F.lit(len(sizes))
    for i, s in reversed(list(enumerate(sizes))):
        cell = F.when(col(hash_unit) < s, i).otherwise(cell)
    width = len(sizes) + 1
    cells = moments(df, features, target, (col(fold) * width + cell).cast("long"))
    folds = sorted({int(k) // width for k in cells})
    held = {f: total({k: m for k, m in cells.items() if int(k) // width == f}) for f in folds}
    out = []
    for i, s in enumerate(sizes):
        for f in folds:
            seen = [m for k, m in cells.items() if int(k) // width != f and int(k) % width <= i]
            train = seen[0]
            for m in seen[1:]:
                train = train + m
            model = FITS[kind](train, **params)
            rmse = scorer("rmse")
            out.append(
                {
                    "share": float(s),
                    "fold": f,
                    "n_train": int(train.n),
                    "train_rmse": rmse(train.squared_error(model.weights, model.intercept), 0, train.n),
                    "test_rmse": rmse(held[f].squared_error(model.weights, model.intercept), 0, held[f].n),
                }
            )
    return out
