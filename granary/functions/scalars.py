"""Scalar column expressions used by several operators."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of a missing value in text files
FILE_NA_TOKENS = ("", "NA", "N/A", "nan", "NaN", ".")
# fixed values: spellings of a missing value inside string columns, any case
TEXT_NA_TOKENS = ("nan", "none", "")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    return F.nanvl(col(c), F.lit(None).cast("double"))


def text_na_to_null(c) -> Column:
    c = col(c)
    return F.when(~F.lower(F.trim(c)).isin(*TEXT_NA_TOKENS), c)


def safe_ratio(num, den, default=0.0) -> Column:
    """num / den where den > 0, else ``default``."""
    return F.when(col(den) > 0, col(num) / col(den)).otherwise(
        default if isinstance(default, Column) else F.lit(default)
    )


def clip(c, low=None, high=None) -> Column:
    """Null stays null (least and greatest skip nulls)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.when(c < low, low).otherwise(out)
    if high is not None:
        out = F.when(c > high, high).otherwise(out)
    return F.when(c.isNotNull(), out)


def log1p_clipped(c) -> Column:
    return F.log1p(clip(c, low=F.lit(0.0)))


def hour_of(seconds, period: int = 24) -> Column:
    return F.pmod(F.floor(col(seconds) / 3600), F.lit(period))


def cyclic(position, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(position) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def floor_bucket(c, width: float) -> Column:
    return F.floor(col(c) / width) * width


def cut(c, edges: Sequence[float], labels: Sequence) -> Column:
    """Right-closed intervals (edges[i], edges[i+1]] -> labels[i]; outside is null."""
    c = col(c)
    out = F.when(c <= edges[0], None)
    for upper, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= upper, label) if not math.isinf(upper) else out.when(c.isNotNull(), label)
    return out


def null_safe_sum(*cols) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(col(c), F.lit(0)) for c in cols])


def sigmoid(c, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-col(c) * scale))


def log_odds(p) -> Column:
    return F.log(col(p) / (1 - col(p) + 1e-10))


def season(month) -> Column:
    m = col(month)
    return (
        F.when(m.between(3, 5), "spring")
        .when(m.between(6, 8), "summer")
        .when(m.between(9, 11), "fall")
        .otherwise("winter")
    )


def equal_width_bin(c, low, high, bins: int) -> Column:
    """1-based bin over [low, high]; the last bin is closed; outside is null."""
    c = col(c)
    raw = F.floor((c - low) / (high - low) * bins).cast("int") + 1
    return F.when((c >= low) & (c <= high), F.least(F.lit(bins), raw))


def elapsed_seconds(ts, origin) -> Column:
    """Seconds between two zone-less timestamps, fraction kept."""
    span = lambda c: F.unix_micros(col(c).cast("timestamp"))
    return (span(ts) - span(origin)) / 1e6


def band(c, limits: Sequence[float], names: Sequence[str]) -> Column:
    """names[i] for limits[i-1] <= c < limits[i]."""
    out = F.when(col(c) < limits[0], names[0])
    for limit, name in zip(limits[1:], names[1:-1], strict=True):
        out = out.when(col(c) < limit, name)
    return out.when(col(c).isNotNull(), names[-1])
