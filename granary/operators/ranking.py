"""Global order on a cluster: hash cuts, exact ranks and running totals.

A window without ``partitionBy`` moves every row into one task. Both tools here
split the order into many buckets first, add up bucket totals (one small row per
bucket) and rank only inside buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.joins import join_groups
from granary.operators.quantiles import split_points
from granary.session import materialize, sized

HASH_DIGITS = 3  # 4096 buckets of equal expected size at a time
BUCKET_ROWS = 20_000  # rows of a bucket that one task may rank
FEW_BUCKETS = 50_000  # so many bucket names may be broadcast


def key_hash(keys: Sequence[str | Column], seed: int) -> Column:
    """Stable pseudo-random order of rows: md5 of the key columns and the seed."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat(F.concat_ws("|", *[c.cast("string") for c in cols]), F.lit(f":{seed}")))


def hash_cuts(
    df: DataFrame,
    hash_col: str,
    ranks: Sequence[Column],
    by: Sequence[str] = (),
    digits: int = HASH_DIGITS,
    most: int = BUCKET_ROWS,
) -> DataFrame:
    """Per group the hash of the row at each wanted rank (columns n, c0, c1, ..).

    ``ranks`` are expressions over ``n`` (rows in the group). Rank 0 gives ''.
    Rows are counted by the first digits of their hash, added up in each task;
    the bucket that holds a rank is counted by its next digits, and so on until
    it has at most ``most`` rows, or only one hash. Only rows of those last
    buckets leave their task. Counts are written tables; whether a bucket is
    still too large is all that reaches the driver.
    """
    by = list(by)
    rows = df.select(*by, F.col(hash_col).alias("_h"))
    known = materialize(_prefix_counts(rows, by, digits), "hash-counts")
    sizes = known.groupBy(*by).agg(F.sum("_c").alias("n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("_i"), r.cast("long").alias("_r")) for i, r in enumerate(ranks)])
    found = _located(known, sizes.select(*by, F.inline(wanted)).where("_r > 0"), by)
    cuts, length = [], digits
    while True:
        found = materialize(found, "buckets")
        # a bucket of one hash needs no ranking, however many rows it has
        cuts.append(found.where("_lo = _hi").select(*by, "_i", F.col("_lo").alias("_h")))
        found = found.where("_lo < _hi")
        left = found.agg(F.count("*").alias("n"), F.max("_c").alias("largest")).first()
        touched = found.select(*by, "_b").distinct()
        touched = F.broadcast(touched) if left.n <= FEW_BUCKETS else sized(touched, "touched")
        inside = join_groups(rows.withColumn("_b", F.substring("_h", 1, length)), touched, [*by, "_b"], "left_semi")
        if (left.largest or 0) <= most:
            break
        length += digits
        known = _prefix_counts(inside, [*by, "_b"], length, "_next")
        found = _located(known, found.select(*by, "_b", "_i", "_r"), [*by, "_b"], "_next")
        found = found.drop("_b").withColumnRenamed("_next", "_b")
    within = Window.partitionBy(*by, "_b").orderBy("_h")
    last = found.select(*by, "_b", "_i", F.col("_r").alias("_rn"))
    ranked = join_groups(inside.withColumn("_rn", F.row_number().over(within)), last, [*by, "_b", "_rn"])
    every = reduce(DataFrame.unionByName, [*cuts, ranked.select(*by, "_i", "_h")])
    every = every.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_h"))).alias(f"c{i}") for i in range(len(ranks))])
    full = join_groups(sizes, every, by, "left") if by else sizes.join(F.broadcast(every))
    return full.select(*by, "n", *[F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(len(ranks))])


def _prefix_counts(rows: DataFrame, by: Sequence[str], length: int, name: str = "_b") -> DataFrame:
    """Rows, least and greatest hash per group and hash prefix."""
    prefix = F.substring("_h", 1, length).alias(name)
    return rows.groupBy(*by, prefix).agg(F.count("*").alias("_c"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))


def _located(counts: DataFrame, targets: DataFrame, by: Sequence[str], name: str = "_b") -> DataFrame:
    """The bucket of every wanted rank, and the rank inside it; a group has at most 16 ** digits buckets."""
    upto = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    running = F.sum("_c").over(upto.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select("*", (running - F.col("_c")).alias("_before"))
    both = join_groups(placed, targets, by) if by else placed.join(F.broadcast(targets))
    hit = both.where((F.col("_r") > F.col("_before")) & (F.col("_r") <= F.col("_before") + F.col("_c")))
    return hit.withColumn("_r", F.col("_r") - F.col("_before")).drop("_before")


def default_buckets(df: DataFrame) -> int:
    return max(8, min(2048, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def order_buckets(
    df: DataFrame,
    order: str,
    tie: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds ``_b`` and ``_t``: sorting by (_b, _t, order, tie) is sorting by (order, tie).

    Buckets come from sketched cut values collected to the driver (a few
    thousand numbers at most), so every executor sees the same ones. A value
    that fills a bucket alone is cut further by ``tie``.
    """
    k = buckets or default_buckets(df)
    points = split_points(df, order, k)
    splits = [-math.inf, *points, math.inf]
    out = df.withColumn("_key", F.col(order).cast("double"))
    if len(splits) >= 3:
        out = Bucketizer(
            splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep"
        ).transform(out)
    else:
        out = out.withColumn("_b", F.lit(0.0))
    singles = [
        float(i + 1)
        for i, p in enumerate(points[:-1])
        if points[i + 1] == math.nextafter(p, math.inf)
    ]
    out = out.drop("_key")
    if not tie or not singles:
        return out.withColumn("_t", F.lit(0.0))
    # heavy values share k further cuts, so all buckets together stay near 2 k
    ties = split_points(df, tie, -(-k // len(singles)) + 1)
    tie_splits = [-math.inf, *ties, math.inf]
    if len(tie_splits) < 3:
        return out.withColumn("_t", F.lit(0.0))
    out = out.withColumn("_tk", F.col(tie).cast("double"))
    out = Bucketizer(
        splits=tie_splits, inputCol="_tk", outputCol="_t", handleInvalid="keep"
    ).transform(out)
    return out.withColumn("_t", F.when(F.col("_b").isin(singles), F.col("_t")).otherwise(0.0)).drop(
        "_tk"
    )


def running_totals(
    df: DataFrame,
    order: str,
    sums: dict[str, str | Column],
    tie: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Adds inclusive running sums in ascending (order, tie); ``sums``: new name -> column."""
    placed = order_buckets(df, order, tie, buckets)
    exprs = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    totals = placed.groupBy("_b", "_t").agg(*[F.sum(e).alias(f"_s_{k}") for k, e in exprs.items()])
    # one row per bucket, so this window is small whatever the table size
    before = (
        Window.partitionBy(F.lit(0)).orderBy("_b", "_t").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        F.col("_b").alias("_ob"),
        F.col("_t").alias("_ot"),
        *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in exprs],
    )
    keys = [order, tie] if tie else [order]
    inside = (
        Window.partitionBy("_b", "_t").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = placed.select("*", *[F.sum(e).over(inside).alias(f"_l_{k}") for k, e in exprs.items()])
    joined = local.join(
        F.broadcast(offsets), (F.col("_b") == F.col("_ob")) & (F.col("_t") == F.col("_ot"))
    )
    return joined.select(
        *df.columns, *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(k) for k in exprs]
    )


def global_row_number(
    df: DataFrame, order: str, tie: str, name: str = "rn", buckets: int | None = None
) -> DataFrame:
    """Exact 1-based position of every row in ascending (order, tie)."""
    return running_totals(df, order, {name: F.lit(1)}, tie, buckets)


def sorted_positions(df: DataFrame, cols: Sequence[str], name: str = "position") -> DataFrame:
    """0-based position of every row in ascending order of ``cols`` (any sortable types).

    Range partitions are written once with their partition number, so the row
    count of each partition can be added to the rows after it.
    """
    n = default_buckets(df)
    placed = (
        df.repartitionByRange(n, *cols)
        .sortWithinPartitions(*cols)
        .select(*df.columns, F.monotonically_increasing_id().alias("_id"))
    )
    stored = materialize(placed, "sorted").select(
        *df.columns,
        F.shiftright("_id", 33).alias("_p"),
        F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    starts = stored.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = starts.select("_p", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_start"))
    return stored.join(F.broadcast(starts), "_p").select(
        *df.columns, (F.col("_start") + F.col("_i")).alias(name)
    )
