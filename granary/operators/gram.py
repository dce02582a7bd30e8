"""Sufficient statistics of linear models: counts, means and central cross products per group.

One pass over the data serves every fold, penalty and scaling. Few columns are
summed inside the JVM (map-side combine); many columns go through Arrow batches
that emit one partial matrix per task and group. Both keep every group, the
null one and those named by strings too, and give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from granary.functions.scalars import col

#: more columns would need so many aggregation buffers that Spark stops compiling the plan
JVM_COLUMNS = 6
#: a group's partial matrices meet in this many parts before they meet as one
MERGE_PARTS = 256


@dataclass(frozen=True)
class Moments:
    """Count, means and cross products around them; the last column is the target."""

    names: tuple[str, ...]
    n: float
    mean: np.ndarray
    scatter: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        between = np.outer(d, d) * (self.n * other.n / n)
        return Moments(self.names, n, self.mean + d * (other.n / n), self.scatter + other.scatter + between)

    def __sub__(self, other: Moments) -> Moments:
        n = self.n - other.n
        if not n:
            return Moments(self.names, 0.0, np.zeros_like(self.mean), np.zeros_like(self.scatter))
        mean = self.mean - (other.mean - self.mean) * (other.n / n)
        d = other.mean - mean
        return Moments(self.names, n, mean, self.scatter - other.scatter - np.outer(d, d) * (other.n * n / self.n))

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.scatter) / self.n, 0.0))

    def keep(self, features: Sequence[str]) -> Moments:
        idx = [self.names.index(f) for f in features] + [len(self.names) - 1]
        return Moments(tuple(self.names[i] for i in idx), self.n, self.mean[idx], self.scatter[np.ix_(idx, idx)])

    def rescaled(self, mean: np.ndarray, std: np.ndarray) -> Moments:
        """Moments of (x - mean) / std for the features; the target stays."""
        m = np.append(mean, 0.0)
        s = np.append(std, 1.0)
        return Moments(self.names, self.n, (self.mean - m) / s, self.scatter / np.outer(s, s))

    def squared_error(self, weights: np.ndarray, intercept: float) -> float:
        """Sum of squared residuals of a linear predictor, without the rows."""
        a = np.append(-weights, 1.0)
        offset = float(a @ self.mean) - intercept
        return float(a @ self.scatter @ a) + self.n * offset * offset

    def total_squares(self, around: float | None = None) -> float:
        d = 0.0 if around is None else self.mean[-1] - around
        return float(self.scatter[-1, -1]) + self.n * d * d


def moments(df: DataFrame, features: Sequence[str], target: str, by: str | Column | None = None) -> dict:
    """{group: Moments}; rows with a null or NaN cell are left out. Without ``by`` the key is None.

    Groups are folds, batches or sizes, of any type: a number of them that the
    caller chose. Rows whose group is null are the group None.
    """
    names = tuple([*features, target])
    xs = [col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]
    group = (col(by) if by is not None else F.lit(None).cast("long")).alias("g")
    rows = df.select(group, *xs).dropna(subset=[f"x{i}" for i in range(len(names))])
    return (_in_expressions if len(names) <= JVM_COLUMNS else _in_batches)(rows, names)


def _in_expressions(rows: DataFrame, names: tuple[str, ...]) -> dict:
    p = len(names)
    aggs = [F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]]
    aggs += [F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    out = {}
    for r in rows.groupBy("g").agg(*aggs).collect():
        c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        out[r.g] = Moments(names, float(r.n), np.array([r[f"m{i}"] for i in range(p)]), c * r.n)
    return out


def _in_batches(rows: DataFrame, names: tuple[str, ...]) -> dict:
    p = len(names)
    cols = [f"x{i}" for i in range(p)]

    def table(found: dict, kind: pa.DataType) -> dict:
        ms = list(found.values())
        lists = pa.list_(pa.float64())
        return {
            "g": pa.array(list(found), kind),
            "n": pa.array([m.n for m in ms], pa.float64()),
            "mean": pa.array([m.mean for m in ms], lists),
            "scatter": pa.array([m.scatter.ravel() for m in ms], lists),
        }

    def partial(batches):
        found: dict = {}
        kind = None
        for b in batches:
            kind = b.schema.field("g").type
            keys = b.column("g").dictionary_encode(null_encoding="encode")
            index = keys.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(index, kind="stable")
            z = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols])[order]
            ends = np.cumsum(np.bincount(index, minlength=len(keys.dictionary)))
            for g, part in zip(keys.dictionary.to_pylist(), np.split(z, ends[:-1])):
                mean = part.mean(axis=0)
                m = Moments(names, float(len(part)), mean, (part - mean).T @ (part - mean))
                found[g] = found[g] + m if g in found else m
        if found:
            yield pa.RecordBatch.from_pydict(table(found, kind))

    def merged(part: pa.Table) -> pa.Table:
        ms = (
            Moments(names, n, np.array(m), np.array(s).reshape(p, p))
            for n, m, s in zip(part["n"].to_pylist(), part["mean"].to_pylist(), part["scatter"].to_pylist())
        )
        return pa.table(table({part["g"][0].as_py(): reduce(lambda a, b: a + b, ms)}, part.schema.field("g").type))

    schema = StructType([rows.schema["g"]]).add("n", DoubleType())
    schema = schema.add("mean", ArrayType(DoubleType())).add("scatter", ArrayType(DoubleType()))
    parts = rows.mapInArrow(partial, schema)
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)))
    parts = salted.groupBy("g", "salt").applyInArrow(merged, schema)
    whole = parts.groupBy("g").applyInArrow(merged, schema)
    return {r.g: Moments(names, r.n, np.array(r.mean), np.array(r.scatter).reshape(p, p)) for r in whole.collect()}


def total(groups: dict) -> Moments:
    return reduce(lambda a, b: a + b, groups.values())
