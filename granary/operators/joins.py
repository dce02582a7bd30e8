"""Joins in which a null key meets a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Like ``left.join(right, keys, how)``, but rows of null groups find their group."""
    keys = list(keys)
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_key_{k}"]) for k in keys])
    return left.join(named, match, how).drop(*[f"_key_{k}" for k in keys])
