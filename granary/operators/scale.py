"""Scalers: parameters from one aggregation, applied as expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col


@dataclass(frozen=True)
class StandardScaler:
    """Population deviation; a constant column is only centred."""

    mean: dict[str, float]
    std: dict[str, float]
    with_mean: bool = True

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], with_mean: bool = True, guard_zero: bool = True):
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
        ).first()
        std = {c: row[f"s_{c}"] for c in cols}
        if guard_zero:
            std = {c: s or 1.0 for c, s in std.items()}
        return cls({c: row[f"m_{c}"] for c in cols}, std, with_mean)

    def transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        shift = lambda c: F.lit(self.mean[c]) if self.with_mean else F.lit(0.0)
        return df.withColumns({c: (col(c) - shift(c)) / F.lit(self.std[c]) for c in self.mean})

    def inverse(self, df: DataFrame) -> DataFrame:
        self._check(df)
        shift = lambda c: F.lit(self.mean[c]) if self.with_mean else F.lit(0.0)
        return df.withColumns({c: col(c) * F.lit(self.std[c]) + shift(c) for c in self.mean})

    def _check(self, df: DataFrame) -> None:
        absent = [c for c in self.mean if c not in df.columns]
        if absent:
            raise ValueError(f"scaler was fitted with columns {absent}")


@dataclass(frozen=True)
class MinMaxScaler:
    """Maps the fitted range to ``feature_range``; values outside are not clipped."""

    low: dict[str, float]
    high: dict[str, float]
    feature_range: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], feature_range=(0.0, 1.0)):
        if feature_range[0] >= feature_range[1]:
            raise ValueError("feature_range must increase")
        row = df.agg(
            *[F.min(c).cast("double").alias(f"l_{c}") for c in cols],
            *[F.max(c).cast("double").alias(f"h_{c}") for c in cols],
        ).first()
        return cls({c: row[f"l_{c}"] for c in cols}, {c: row[f"h_{c}"] for c in cols}, feature_range)

    def _span(self, c: str) -> float:
        return (self.high[c] - self.low[c]) or 1.0

    def transform(self, df: DataFrame) -> DataFrame:
        a, b = self.feature_range
        return df.withColumns(
            {c: (col(c) - self.low[c]) / self._span(c) * (b - a) + a for c in self.low}
        )

    def inverse(self, df: DataFrame) -> DataFrame:
        a, b = self.feature_range
        return df.withColumns(
            {c: (col(c) - a) / (b - a) * self._span(c) + self.low[c] for c in self.low}
        )
