"""Filters with reported effect, faceted search and per-group heads."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col


def faceted_filter(
    df: DataFrame,
    equals: dict[str, object] | None = None,
    ranges: dict[str, tuple] | None = None,
    search: str | None = None,
    search_columns: Sequence[str] = (),
) -> DataFrame:
    """AND of the facets that are set; None, '' and 0 count as not set."""
    for c, v in (equals or {}).items():
        if v:
            df = df.where(col(c) == v)
    for c, (low, high) in (ranges or {}).items():
        if low:
            df = df.where(col(c) >= low)
        if high:
            df = df.where(col(c) <= high)
    present = [c for c in search_columns if c in df.columns]
    if search and present:
        needle = search.lower()
        df = df.where(reduce(lambda a, b: a | b, [F.lower(c).contains(needle) for c in present]))
    return df


Rule = tuple[str, Sequence[str], Column]


def _usable(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if all(c in df.columns for c in r[1])]


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Keep rows for which every rule (name, needed columns, keep) is true."""
    for _, _, keep in _usable(df, rules):
        df = df.where(F.coalesce(keep, F.lit(False)))
    return df


def rule_effects(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows each rule removes among those the earlier rules kept; absent columns skip a rule."""
    usable = _usable(df, rules)
    kept = F.lit(True)
    aggs, rows = [F.count("*").alias("_n")], []
    for i, (name, _, keep) in enumerate(usable):
        keep = F.coalesce(keep, F.lit(False))
        aggs.append(F.count_if(kept & ~keep).alias(f"_r{i}"))
        kept = kept & keep
        rows.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("rule"), F.col(f"_r{i}").alias("removed")))
    aggs.append(F.count_if(kept).alias("_kept"))
    rows += [
        F.struct(F.lit(len(usable)).alias("step"), F.lit("kept").alias("rule"), (F.col("_n") - F.col("_kept")).alias("removed"))
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def head_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """First k rows of each group.

    Spark keeps only k rows per group and task before the shuffle
    (window group limit), so a hot group does not gather in one task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
