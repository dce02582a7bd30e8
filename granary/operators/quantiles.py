"""Exact interpolated quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a group in one hash map. Here a
bounded sketch first brackets each wanted rank; a second pass counts, with
map-side combining, whole gaps between brackets as one row each and only the
few values inside the brackets one by one. A running count then finds the exact
order statistics.

A bracket is a share of the rows, so on large inputs it is narrowed first: every
round counts the rows below, at and inside the brackets (one row per group
leaves a task) and sketches what is inside, until no bracket holds more than a
fixed number of rows. No window partition grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.joins import join_groups
from granary.session import fill_cores, sized

SKETCH_ACCURACY = 10_000
BRACKET_ROWS = 50_000  # rows strictly inside a bracket that one task may rank
_BRACKET_SHARE = 10.0 / SKETCH_ACCURACY  # of all rows: the width of a bracket and an error bound on each side
_GRID = 1_000  # parts into which a bracket is sketched to narrow it


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by.., feature, v) rows of the numeric columns; null and NaN are left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]
    )
    return (
        df.select(*by, F.inline(pairs))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .withColumn("v", F.col("v") + F.lit(0.0))
    )


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "value",
) -> DataFrame:
    """Rows (by.., feature, prob, value): linear interpolation between order statistics."""
    df = fill_cores(df.select(*by, *[c for c in cols if c not in by]), *cols)
    sketch = None if by else _wide_sketch(df, cols, probs)
    return _quantiles_long(long_values(df, cols, by), probs, list(by), name, sketch=sketch)


def _marks(probs: Sequence[float]) -> list[float]:
    """Sketch positions around each probability, four error bounds away."""
    eps = 4.0 / SKETCH_ACCURACY
    return [m for p in probs for m in (max(0.0, p - eps), min(1.0, p + eps))]


def _wide_sketch(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(feature, _m, _c) from one aggregation over the columns side by side."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    marks = lambda c: F.percentile_approx(value(c), _marks(probs), SKETCH_ACCURACY)
    row = df.agg(*[F.struct(marks(c).alias("_m"), F.count(value(c)).alias("_c")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["_m"].alias("_m"), F.col(c)["_c"].alias("_c")) for c in cols])
    return row.select(F.inline(pairs)).where("_m IS NOT NULL")


def _positions(total: Column, probs: Sequence[float], ranks: Sequence[int] | None) -> list[Column]:
    """Wanted 0-based positions, possibly between two ranks."""
    if ranks is None:
        return [(total - 1) * F.lit(float(p)) for p in probs]
    return [F.lit(float(r)) for r in ranks]


def narrowed(
    values: DataFrame, sketch: DataFrame, keys: Sequence[str], probs: Sequence[float], ranks=None, most: int = BRACKET_ROWS
) -> DataFrame:
    """(keys.., _m, _c) with no more than ``most`` rows strictly inside any bracket.

    ``_m`` holds the two ends of the bracket of every probability. A round
    counts, per group, the rows below and at both ends and inside, and sketches
    the inside on a grid; the next ends are the grid values around the wanted
    ranks. An end is a value of the column, so a value repeated without bound
    is an end sooner or later and no longer inside. Only the largest count
    reaches the driver.
    """
    grid = [g / _GRID for g in range(_GRID + 1)]
    v, n = F.col("v"), len(probs)
    while True:
        aggs = []
        for i in range(n):
            lo, hi = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
            inside = (v > lo) & (v < hi)
            aggs += [F.count_if(v < lo), F.count_if(v == lo), F.count_if(inside)]
            aggs.append(F.percentile_approx(F.when(inside, v), grid, SKETCH_ACCURACY))
        named = [a.alias(f"{c}{i // 4}") for i, (a, c) in enumerate(zip(aggs, ["_below", "_at", "_in", "_grid"] * n))]
        state = join_groups(values, sketch, keys).groupBy(*keys).agg(F.first("_m").alias("_m"), F.count("*").alias("_c"), *named)
        state = sized(state, "brackets")
        largest = state.agg(F.max(F.greatest(F.lit(0), *[F.col(f"_in{i}") for i in range(n)]))).first()[0]
        if (largest or 0) <= most:
            return state.select(*keys, "_m", "_c")
        ends = []
        for i, at in enumerate(_positions(F.col("_c"), probs, ranks)):
            lo, hi, size, values_in = F.col("_m")[2 * i], F.col("_m")[2 * i + 1], F.col(f"_in{i}"), F.col(f"_grid{i}")
            skipped = F.col(f"_below{i}") + F.col(f"_at{i}")
            first, last = F.floor(at) - skipped, F.ceil(at) - skipped  # ranks among the rows inside
            low = (F.floor(first * _GRID / size) - 2).cast("int")
            high = (F.ceil((last + 1) * _GRID / size) + 2).cast("int")
            to_low = F.when(first >= size, hi).when(low > 0, F.get(values_in, low)).otherwise(lo)
            to_high = F.when(last < 0, lo).when(high < _GRID, F.get(values_in, high)).otherwise(hi)
            ends += [F.when(size > most, to_low).otherwise(lo), F.when(size > most, to_high).otherwise(hi)]
        sketch = state.select(*keys, F.array(*ends).alias("_m"), "_c")


def values_at_ranks(df: DataFrame, col: str, ranks: Sequence[int], n: int) -> list[float]:
    """Order statistics of one column at 0-based ranks, given its number of values."""
    probs = [r / max(n - 1, 1) for r in ranks]
    rows = _quantiles_long(long_values(df, [col]), probs, [], "value", ranks)
    # the sketch positions repeat when ranks repeat, so match by position
    got = {round(r.prob, 15): r.value for r in rows.collect()}
    return [got[round(p, 15)] for p in probs]


def _quantiles_long(values: DataFrame, probs, by: list[str], name: str, ranks=None, sketch=None) -> DataFrame:
    keys = [*by, "feature"]
    marks = _marks(probs)
    if sketch is None:
        sketch = values.groupBy(*keys).agg(
            F.percentile_approx("v", marks, SKETCH_ACCURACY).alias("_m"), F.count("*").alias("_c")
        )
    if by:
        sketch = sized(sketch, "sketch")
    else:
        # one row per column name: bounded by the width of the table
        sketch = F.broadcast(values.sparkSession.createDataFrame(sketch.collect(), sketch.schema))
    wide = F.col("_c") * (_BRACKET_SHARE * len(probs)) > BRACKET_ROWS
    if not sketch.where(wide).isEmpty():
        large = narrowed(values, sketch.where(wide), keys, probs, ranks, BRACKET_ROWS)
        sketch = sized(sketch.where(~wide).unionByName(large), "sketch")
    m = [F.col("_m").getItem(i) for i in range(len(marks))]
    v = F.col("v")
    inside = reduce(
        lambda a, b: a | b, [v.between(m[2 * i], m[2 * i + 1]) for i in range(len(probs))]
    )
    passed = reduce(
        lambda a, b: a + b,
        [(v > m[2 * i + 1]).cast("int") + (v >= m[2 * i]).cast("int") for i in range(len(probs))],
    )
    runs = (
        join_groups(values, sketch, keys)
        .select(*keys, "v", passed.alias("_gap"), F.when(inside, v).alias("_exact"))
        .groupBy(*keys, "_gap", "_exact")
        .agg(F.count("*").alias("_n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
    ranked = runs.select(
        *keys,
        "_n",
        "_lo",
        "_hi",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        F.sum("_n").over(group).alias("_total"),
    )

    def at(rank: Column) -> Column:
        start, end = F.col("_start"), F.col("_start") + F.col("_n") - 1
        value = (
            F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
            .when(rank == start, F.col("_lo"))
            .when(rank == end, F.col("_hi"))
            .otherwise(F.raise_error(F.lit("quantile rank left its bracket")).cast("double"))
        )
        return F.max(F.when((rank >= start) & (rank <= end), value))

    aggs = []
    for i, position in enumerate(_positions(F.col("_total"), probs, ranks)):
        aggs += [
            at(F.floor(position)).alias(f"_a{i}"),
            at(F.ceil(position)).alias(f"_b{i}"),
            F.max(position - F.floor(position)).alias(f"_f{i}"),
        ]
    stats = ranked.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("prob"),
                (
                    F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")
                ).alias(name),
            )
            for i, p in enumerate(probs)
        ]
    )
    return stats.select(*keys, F.inline(rows))


def quantile_row(
    df: DataFrame, wanted: dict[str, tuple[str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """One row (per group): output name -> quantile ``(column, prob)``."""
    cols = sorted({c for c, _ in wanted.values()})
    probs = sorted({p for _, p in wanted.values()})
    q = exact_quantiles(df, cols, probs, by)
    return q.groupBy(*by).agg(
        *[
            F.max(F.when((F.col("feature") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(out)
            for out, (c, p) in wanted.items()
        ]
    )


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """Driver-side ``{(column, prob): value}``; as many values as columns x probs."""
    return {(r.feature, r.prob): r.value for r in exact_quantiles(df, cols, probs).collect()}


def split_points(df: DataFrame, col: str, buckets: int) -> list[float]:
    """At most ``2 * buckets`` increasing cut values that spread rows evenly.

    A value that is heavy enough to fill a bucket gets a bucket of its own.
    """
    probs = [i / buckets for i in range(1, buckets)]
    if not probs:
        return []
    row = df.agg(
        F.percentile_approx(F.col(col).cast("double"), probs, SKETCH_ACCURACY).alias("q")
    ).first()
    points: list[float] = []
    for i, q in enumerate(row.q or []):
        if points and q <= points[-1]:
            continue
        points.append(q)
        if i + 1 < len(row.q) and row.q[i + 1] == q:
            points.append(math.nextafter(q, math.inf))
    return points
