"""Drift and performance monitoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col, equal_width_bin
from granary.operators import evaluate as E
from granary.operators.joins import join_groups
from granary.operators.quantiles import exact_quantiles, long_values
from granary.operators.ranking import global_row_number, order_buckets
from granary.session import sized

# fixed values: smallest share, drift limit, rows needed
MIN_SHARE = 1e-4
PSI_LIMIT = 0.2
MIN_ROWS = 100


def last_n(df: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The latest n rows; each task keeps n rows at most before they are merged."""
    return df.orderBy(F.desc(ts), F.desc(key)).limit(n)


def reference_bins(reference: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """(feature, lo, hi, bin, expected) with every bin present; columns x bins rows."""
    v = long_values(reference, cols)
    ends = v.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    counts = (
        v.join(F.broadcast(ends), "feature")
        .groupBy("feature", equal_width_bin("v", F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return grid.join(counts, ["feature", "bin"], "left").select(
        "feature", "lo", "hi", "bin", F.greatest(share, F.lit(MIN_SHARE)).alias("expected")
    )


def psi_table(reference: DataFrame, current: DataFrame, cols: Sequence[str], by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by.., feature, n, psi) of equal-width reference bins; outside values are dropped."""
    return psi_from_bins(reference_bins(reference, cols, bins), current, cols, by, bins)


def psi_from_bins(ref: DataFrame, current: DataFrame, cols: Sequence[str], by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """PSI against bins that were computed (and perhaps stored) before; columns x bins rows."""
    by = list(by)
    ends = ref.select("feature", "lo", "hi").distinct()
    v = long_values(current, cols, by).join(F.broadcast(ends), "feature")
    counts = v.groupBy(*by, "feature", equal_width_bin("v", F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("n"))
    groups = counts.groupBy(*by, "feature").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("inside")
    )
    grid = groups.join(F.broadcast(ref), "feature")
    full = grid.join(counts, [*by, "feature", "bin"], "left")
    actual = F.greatest(F.try_divide(F.coalesce(F.col("n"), F.lit(0)), F.col("inside")), F.lit(MIN_SHARE))
    term = (actual - F.col("expected")) * F.log(actual / F.col("expected"))
    return full.groupBy(*by, "feature").agg(F.max("rows").alias("n"), F.sum(term).alias("psi"))


def drift_report(reference: DataFrame, current: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per group: drift flag, mean and largest PSI, number of drifted features, largest mean shift."""
    by = list(by)
    psi = psi_table(reference, current, cols, by)
    ref = long_values(reference, cols).groupBy("feature").agg(F.avg("v").alias("rm"), F.stddev_pop("v").alias("rs"))
    cur = long_values(current, cols, by).groupBy(*by, "feature").agg(F.avg("v").alias("cm"))
    shift = cur.join(F.broadcast(ref), "feature").select(
        *by, "feature", ((F.col("cm") - F.col("rm")) / (F.col("rs") + 1e-10)).alias("shift")
    )
    rows = psi.join(shift, [*by, "feature"])
    enough = F.max("n") >= MIN_ROWS
    return rows.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.when(enough, "ok").otherwise("insufficient").alias("status"),
        F.when(enough, F.max((F.col("psi") >= PSI_LIMIT).cast("int"))).otherwise(0).alias("drift"),
        F.when(enough, F.avg("psi")).alias("mean_psi"),
        F.when(enough, F.max("psi")).alias("max_psi"),
        F.when(enough, F.count_if(F.col("psi") >= PSI_LIMIT)).otherwise(0).alias("n_drifted"),
        F.when(enough, F.max(F.abs("shift"))).alias("max_shift"),
    )


def quantile_edges(reference: DataFrame, score: str, bins: int = 10) -> list[float]:
    """Distinct quantile edges of the reference scores (bins + 1 numbers at most)."""
    rows = exact_quantiles(reference, [score], [i / bins for i in range(bins + 1)]).collect()
    return sorted({r.value for r in rows})


def edge_bin(c, edges: Sequence[float]) -> Column:
    """0-based bin of sorted edges, left-closed, the last one closed; outside is null."""
    x = col(c)
    inside = (x >= edges[0]) & (x <= edges[-1])
    place = sum(((x >= e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.when(inside, place)


def score_psi(reference: DataFrame, current: DataFrame, score: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """(by.., n, psi) over reference quantile bins, add-one smoothing; small windows give 0."""
    by = list(by)
    edges = quantile_edges(reference, score, bins)
    k = len(edges) - 1
    ref = reference.groupBy(edge_bin(score, edges).alias("bin")).agg(F.count("*").alias("r")).where("bin IS NOT NULL")
    total = ref.agg(F.sum("r").alias("rt"))
    bin_rows = reference.sparkSession.range(k).select(F.col("id").cast("int").alias("bin"))
    ref = bin_rows.join(F.broadcast(ref), "bin", "left").join(F.broadcast(total)).select(
        "bin", ((F.coalesce("r", F.lit(0)) + 1) / (F.col("rt") + k)).alias("expected")
    )
    counts = current.groupBy(*by, edge_bin(score, edges).alias("bin")).agg(F.count("*").alias("c"))
    sizes = counts.groupBy(*by).agg(
        F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("c"))), F.lit(0)).alias("inside")
    )
    full = sizes.join(F.broadcast(ref)).join(counts, [*by, "bin"], "left")
    actual = (F.coalesce("c", F.lit(0)) + 1) / (F.col("inside") + k)
    term = (actual - F.col("expected")) * F.log(actual / F.col("expected") + 1e-10)
    return full.groupBy(*by).agg(
        F.max("n").alias("n"), F.when(F.max("n") < MIN_ROWS, 0.0).otherwise(F.sum(term)).alias("psi")
    )


def mean_shift(reference: DataFrame, recent: DataFrame, c: str, limit: float = 2.0) -> DataFrame:
    """z of the recent mean against the reference."""
    ref = reference.agg(F.avg(c).alias("ref_mean"), F.stddev_pop(c).alias("ref_std"))
    now = recent.agg(F.count("*").alias("n"), F.avg(c).alias("recent_mean"), F.stddev_pop(c).alias("recent_std"))
    z = (F.col("recent_mean") - F.col("ref_mean")) / (F.col("ref_std") + 1e-10)
    return now.join(F.broadcast(ref)).withColumn("z", z).withColumn("alert", (F.abs("z") > limit).cast("int"))


def recent_performance(recent: DataFrame, y: str, p: str, threshold: float = 0.85) -> DataFrame:
    """Metrics of the latest rows, with an alert on low R2; fewer than 10 rows are not judged."""
    d = col(y) - col(p)
    sst = F.var_pop(y) * F.count(y)
    fit = F.when(sst > 0, 1 - F.try_divide(F.sum(d * d), sst)).otherwise(0.0)
    out = recent.agg(
        F.count("*").alias("n"), fit.alias("r2"), E.rmse(y, p).alias("rmse"), E.mae(y, p).alias("mae"), E.mape(y, p, "count").alias("mape")
    )
    enough = F.col("n") >= 10
    kept = {c: F.when(enough, F.col(c)) for c in ("r2", "rmse", "mae", "mape")}
    return out.withColumns(kept).withColumn(
        "status", F.when(~enough, "insufficient").when(F.col("r2") < threshold, "alert").otherwise("normal")
    )


def rolling_fit(df: DataFrame, order: str, tie: str, y: str, p: str, window: int) -> DataFrame:
    """R2 of half-overlapping count windows in arrival order: (end_index, n, r2).

    Each row goes to the (two or three) windows that contain it, so the windows
    are an ordinary grouped aggregation.
    """
    step = window // 2
    numbered = global_row_number(df, order, tie, "_rn")
    total = df.agg(F.count("*").alias("_total"))
    i = F.col("_rn") - 1
    first = F.greatest(F.lit(0), F.floor((i - window) / step) + 1)
    last = F.least(F.floor(i / step), F.floor((F.col("_total") - 1 - window) / step))
    placed = (
        numbered.join(F.broadcast(total))
        .where(last >= first)
        .select(y, p, F.explode(F.sequence(first, last)).alias("_k"))
        .withColumn("end_index", F.col("_k") * step + window)
    )
    d = col(y) - col(p)
    sst = F.var_pop(y) * F.count(y)
    return placed.groupBy("end_index").agg(
        F.count("*").alias("n"), F.when(sst > 0, 1 - F.try_divide(F.sum(d * d), sst)).otherwise(0.0).alias("r2")
    )


def trend_direction(windows: DataFrame) -> DataFrame:
    """Last against previous window."""
    two = windows.orderBy(F.desc("end_index")).limit(2)
    prev = F.lag("r2").over(Window.partitionBy(F.lit(0)).orderBy("end_index"))  # two rows
    return two.select("end_index", "r2", prev.alias("previous")).orderBy(F.desc("end_index")).limit(1).withColumn(
        "trend", F.when(F.col("r2") < F.col("previous"), "declining").otherwise("stable")
    )


def rolling_per_entity(
    df: DataFrame,
    entity: str,
    order: str,
    tie: str,
    back: int,
    aggs: dict[str, Column],
    buckets: int | None = None,
    slice_rows: int | None = None,
) -> DataFrame:
    """Aggregates over each row and the ``back`` rows before it of the same entity.

    An entity of more than ``slice_rows`` rows (100 x ``back``) is cut along its
    own order into slices of about that many, which also get the ``back`` rows
    before them: at most one row in a hundred travels twice, and slices are
    independent tasks. Other entities are one slice, and so is a null one.
    """
    width = slice_rows or 100 * max(back, 1)
    sizes = df.groupBy(entity).agg(F.count("*").alias("_n")).where(F.col("_n") > width)
    busy = sized(sizes.select(entity), "busy")  # at most one entity per ``width`` rows
    frame = Window.partitionBy(entity, "_s").orderBy(order, tie).rowsBetween(-back, 0)
    whole = F.lit(0).cast("long").alias("_s")
    if busy.isEmpty():
        rows = df.select("*", whole, F.lit(1).alias("_own"))
    else:
        rest = join_groups(df, busy, [entity], "left_anti").select(*df.columns, whole, F.lit(1).alias("_own"))
        rows = rest.unionByName(_sliced(join_groups(df, busy, [entity], "left_semi"), entity, order, tie, back, width, buckets))
    out = rows.select(*df.columns, "_own", *[a.over(frame).alias(n) for n, a in aggs.items()])
    return out.where("_own = 1").drop("_own")


def _sliced(df: DataFrame, entity: str, order: str, tie: str, back: int, width: int, buckets: int | None) -> DataFrame:
    """Rows with their slice ``_s``; rows carried into a later slice once more, with ``_own`` 0.

    Cells are the ranges of the global order; those of an entity that begin
    within the same ``width`` rows of it form a slice.
    """
    placed = order_buckets(df, order, tie, buckets)
    cell = [entity, "_b", "_t"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(entity).orderBy("_b", "_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_from", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    cells = sized(counts.withColumn("_s", F.floor(F.col("_from") / width)), "cells")
    slices = cells.groupBy(entity, "_s").agg(F.sum("_c").alias("_c"), F.min("_from").alias("_start"))
    listed = sized(slices.groupBy(entity).agg(F.collect_list(F.struct("_s", "_start")).alias("_slices")), "slices")
    own = join_groups(placed, cells.select(*cell, "_s"), cell).select(*df.columns, "_s", F.lit(1).alias("_own"))
    # the last rows of a slice are limited per task before the shuffle
    end = Window.partitionBy(entity, "_s").orderBy(F.desc(order), F.desc(tie))
    tails = own.withColumn("_rd", F.row_number().over(end)).where(F.col("_rd") <= back)
    tails = join_groups(tails, slices, [entity, "_s"])
    position = F.col("_start") + F.col("_c") - F.col("_rd") + 1
    needed = F.filter("_slices", lambda s: (s["_start"] >= position) & (s["_start"] < position + back))
    carried = join_groups(tails.drop("_s"), listed, [entity]).select(*df.columns, F.explode(needed).alias("_to"))
    return own.unionByName(carried.select(*df.columns, F.col("_to._s").alias("_s"), F.lit(0).alias("_own")))


def retraining_decision(
    days, metric, psi, strategy: str = "hybrid", interval_days: int = 30, metric_limit: float = 0.85, psi_limit: float = 0.2
) -> dict[str, Column]:
    """Flag and joined reasons from a status row."""
    use = lambda s: F.lit(strategy in (s, "hybrid"))
    parts = [
        F.when(use("scheduled") & (col(days) >= interval_days), F.concat(F.lit("Scheduled: "), col(days).cast("string"), F.lit(" days since last retrain"))),
        F.when(use("performance") & (col(metric) < metric_limit), F.concat(F.lit("Performance: "), F.format_string("%.3f", col(metric)), F.lit(f" < {metric_limit}"))),
        F.when(use("drift") & (col(psi) > psi_limit), F.concat(F.lit("Drift: PSI "), F.format_string("%.3f", col(psi)), F.lit(f" > {psi_limit}"))),
    ]
    text = F.concat_ws("; ", *parts)
    return {"retrain": (text != "").cast("int"), "reason": F.when(text == "", "No retraining needed").otherwise(text)}
