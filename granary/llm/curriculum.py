"""Mixing sources to target weights under weight schedules that change over training.

Every source has a schedule, a piecewise-linear weight over training time 0..1.
Its integral, scaled to the source's target, is the cumulative demand for the
source's words. The words of a source, laid out copy after copy in hash order,
meet that demand at the time found by inverting it: the position of each copy.
Documents are then range-sorted by position.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize, word_count
from granary.operators.ranking import sorted_positions

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: (time, weight) knots, repeating over the sources like the weights: level, rising, falling
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
ROWS_PER_BUCKET = 4096


def time_of_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integral of a schedule reaches a share of its whole."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, before, out = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        if area <= 0:
            continue
        need = share * total - before
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = need, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2 * slope), F.lit(0.0)))
        time = F.lit(t0) + need * 2 / F.greatest(F.lit(w0) + root, F.lit(1e-300))
        time = F.least(F.greatest(time, F.lit(t0)), F.lit(t1))
        out = time if out is None else F.when(share * total <= before, out).otherwise(time)
        before += area
    return out


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> adds position, weight, target.

    Sources in code point order (null last) get the weights in turn; each
    target is a share of all sizes by weight, stops at ``most`` times its
    source's size, and the excess goes to the others by weight until none is
    above. Every round is one aggregate over the sources.
    """
    placed = sorted_positions(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"])
    table = F.array(*[F.lit(float(w)) for w in weights])
    placed = materialize(
        placed.drop("_last").withColumn(
            "weight", F.element_at(table, (F.col("position") % len(weights) + 1).cast("int"))
        ),
        "sources",
    )
    cap = F.col("source_size") * float(most)
    row = placed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    total, unit, capped = float(row.n or 0), 0.0, -1
    free, used = row.w, 0.0
    while free:
        unit = (total - used) / free
        over = F.col("weight") * unit > cap
        row = placed.agg(
            F.count(F.when(over, 1)).alias("k"),
            F.sum(F.when(over, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if row.k == capped:
            break
        capped, used, free = row.k, row.used, row.free
    return placed.withColumn("target", F.least(cap, F.col("weight") * unit))


def training_plan(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    most: int = MOST_COPIES,
    seed: int = 17,
) -> DataFrame:
    """One row per document: doc_id, row_hash, source, size, source_size, target, copies, positions.

    A source's target is filled with whole passes over its documents and a last
    partial pass in hash order, so taken words differ from the target by less
    than one document. Running sums use (source, hash range) buckets: bucket
    totals are combined before the shuffle, and a hot source is spread over as
    many buckets as its rows need.

    Null texts count 0 words and may be taken for free; a null source is a
    source of its own, last in order. Repeated rows are separate documents.
    An empty table gives no rows. Further columns are ignored.
    """
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            word_count("text").alias("size"),
            F.xxhash64("doc_id", "source", "text", F.lit(seed)).alias("row_hash"),
        ),
        "sizes",
    )
    rows = sized.count()
    bits = max(0, math.ceil(math.log2(max(rows, 1) / ROWS_PER_BUCKET)))
    bucket = F.shiftright("row_hash", 64 - bits) if bits else F.lit(0).cast("long")
    sized = sized.withColumn("_b", bucket)
    totals = sized.groupBy("source", "_b").agg(F.sum("size").alias("_n"))
    totals = materialize(totals, "buckets")
    targets = source_targets(totals.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, most)
    targets = materialize(targets, "targets")
    before = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    starts = materialize(starts.select("s.source", "_b", "_start", "source_size", "target", "position"), "starts")
    inside = (
        Window.partitionBy("source", "_b")
        .orderBy("row_hash", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = sized.withColumn("_upto", F.sum("size").over(inside)).alias("d")
    joined = ranked.join(
        starts.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._b") == F.col("s._b"))
    )
    size, whole = F.col("size"), F.col("source_size")
    middle = F.col("_start") + F.col("_upto") - size / 2
    passes = F.when(whole > 0, F.floor(F.col("target") / whole)).otherwise(0)
    rest = F.col("target") - passes * whole
    copies = (passes + F.when(middle < rest, 1).otherwise(0)).cast("int")
    joined = joined.select(
        "doc_id", "row_hash", "d.source", "size", "source_size", "target", "position", copies.alias("copies"), middle.alias("_mid")
    )

    def position(k: Column) -> Column:
        share = F.least((k * whole + F.col("_mid")) / F.greatest("target", F.lit(1e-300)), F.lit(1.0))
        out = time_of_demand(share, schedules[0])
        for i, knots in enumerate(schedules[1:], 1):
            out = F.when(F.col("position") % len(schedules) == i, time_of_demand(share, knots)).otherwise(out)
        return out

    numbers = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return joined.withColumn("positions", F.transform(numbers, position)).drop("position", "_mid")


def mixed(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The documents in training order, once per copy; columns as in ``docs``.

    Equal rows have equal plans up to order, so repeated rows are numbered on
    both sides before they are joined. All columns travel as one struct, so
    their names cannot clash.
    """
    key = F.xxhash64("doc_id", "source", "text", F.lit(seed)).alias("_h")
    twin = Window.partitionBy("_h", "_d").orderBy(F.lit(0))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    left = docs.select(whole, key, F.col("doc_id").alias("_d")).withColumn("_k", F.row_number().over(twin))
    right = plan.select(F.col("row_hash").alias("_h"), F.col("doc_id").alias("_d"), "positions")
    right = right.withColumn("_k", F.row_number().over(twin))
    left, right = left.alias("l"), right.alias("r")
    match = (
        (F.col("l._h") == F.col("r._h")) & (F.col("l._k") == F.col("r._k")) & F.col("l._d").eqNullSafe(F.col("r._d"))
    )
    rows = left.join(right, match).select("l._doc", F.explode("r.positions").alias("_at"))
    return rows.orderBy("_at", F.col("_doc.doc_id")).select("_doc.*")
