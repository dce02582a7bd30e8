"""Retraining on newer rows from stored statistics.

Every version keeps the cross products it was fitted from. New rows are added
and outdated ones subtracted, so a refit reads neither the rows that stay nor
those of earlier versions. A refit is published if it predicts the validation
rows better than the published version; every attempt is logged.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.models.linear import LinearModel
from granary.models.search import fit_scaled
from granary.operators import evaluate as E
from granary.operators.gram import Moments, moments
from granary.operators.scoring import price_from_log

REGISTRY = "version long, published boolean, n_rows long, rmse double, previous_rmse double, record string"


def registry(spark: SparkSession, root: str) -> DataFrame:
    """All attempts, published or not, with the statistics and weights in ``record``."""
    return spark.read.schema(REGISTRY).json(f"{root}/registry")


def stored(row) -> tuple[Moments, LinearModel]:
    """Statistics and model of a registry row."""
    r = json.loads(row.record)
    names = tuple(r["names"])
    m = Moments(names, float(r["n"]), np.array(r["mean"]), np.array(r["scatter"]))
    return m, LinearModel(names[:-1], np.array(r["weights"]), float(r["intercept"]))


def price_rmse(model: LinearModel, valid: DataFrame, target: str) -> float:
    """Root of the mean squared error in price space, of a model of the log price."""
    scored = valid.select(F.expm1(target).alias("y"), price_from_log(model.predict(), 0.0).alias("p"))
    return float(scored.agg(E.rmse("y", "p").alias("rmse")).first().rmse)


def retrain(
    root: str,
    added: DataFrame,
    valid: DataFrame,
    features: Sequence[str],
    target: str,
    removed: DataFrame | None = None,
    alpha: float = 0.0,
) -> bool:
    """One attempt on the stored statistics plus ``added`` minus ``removed`` rows; whether it was published.

    Statistics go on from the last attempt, published or not, so that no rows
    are lost. Ridge on scaled features with penalty ``alpha``; 0 is least
    squares. Rows with a null cell are left out. Without any row nothing is
    logged.
    """
    spark = added.sparkSession
    try:
        tried = registry(spark, root).orderBy(F.desc("version")).limit(1).collect()
        best = registry(spark, root).where("published").orderBy(F.desc("version")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        tried, best = [], []
    whole = stored(tried[0])[0] if tried else None
    new = moments(added, features, target).get(None)
    if new is not None:
        whole = new if whole is None else whole + new
    old = moments(removed, features, target).get(None) if removed is not None else None
    if old is not None and whole is not None:
        whole = whole - old
    if whole is None or whole.n <= 0:
        return False
    model = fit_scaled("ridge" if alpha else "ols", whole, {"alpha": alpha} if alpha else {}, True)
    rmse = price_rmse(model, valid, target)
    previous = price_rmse(stored(best[0])[1], valid, target) if best else None
    published = previous is None or rmse < previous
    record = {
        "names": list(whole.names),
        "n": whole.n,
        "mean": whole.mean.tolist(),
        "scatter": whole.scatter.tolist(),
        "weights": [float(w) for w in model.weights],
        "intercept": float(model.intercept),
    }
    row = (tried[0].version + 1 if tried else 1, published, int(whole.n), rmse, previous, json.dumps(record))
    spark.createDataFrame([row], REGISTRY).coalesce(1).write.mode("append").json(f"{root}/registry")
    return published
