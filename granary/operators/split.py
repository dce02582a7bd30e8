"""Splits, folds and samples decided by a keyed hash: stable under repartitioning.

Exact sizes come from hash cuts (see ``ranking.hash_cuts``), so a split is a
filter on the hash and moves no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from granary.functions.scalars import col
from granary.operators.joins import join_groups
from granary.operators.quantiles import values_at_ranks
from granary.operators.ranking import hash_cuts, key_hash
from granary.session import sized


def hash_fold(keys: Sequence, k: int, seed: int) -> Column:
    """Fold 0..k-1 of about equal size from 28 bits of the key hash."""
    return (F.conv(F.substring(key_hash(keys, seed), 1, 7), 16, 10).cast("long") % k).cast("int")


def hash_below(keys: Sequence, fraction: float, seed: int) -> Column:
    """True for about ``fraction`` of the keys."""
    return F.conv(F.substring(key_hash(keys, seed), 1, 7), 16, 10).cast("long") < int(fraction * (1 << 28))


def _with_cuts(df, keys, seed, ranks: Sequence[Column], by: Sequence[str]) -> DataFrame:
    hashed = df.withColumn("_hash", key_hash(keys, seed))
    cuts = hash_cuts(hashed, "_hash", ranks, by)
    if not by:
        return hashed.join(F.broadcast(cuts))
    return join_groups(hashed, sized(cuts, "cuts"), by)


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float, seed: int, by: Sequence[str] = ()
) -> DataFrame:
    """Adds is_test for exactly floor(n * test_size) rows (of each group)."""
    rank = F.floor(F.col("n") * F.lit(test_size))
    cut = _with_cuts(df, keys, seed, [rank], by)
    return cut.select(*df.columns, (F.col("_hash") <= F.col("c0")).cast("int").alias("is_test"))


def kfold(df: DataFrame, keys: Sequence[str], k: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Adds fold 0..k-1; the first n mod k folds hold one row more (per group)."""
    n = F.col("n")
    ranks = [F.floor(n / k) * i + F.least(F.lit(i), n % k) for i in range(1, k)]
    cut = _with_cuts(df, keys, seed, ranks, by)
    fold = reduce(lambda a, b: a + b, [(F.col("_hash") > F.col(f"c{i}")).cast("int") for i in range(k - 1)])
    return cut.select(*df.columns, fold.alias("fold"))


def repeated_kfold(df: DataFrame, keys: Sequence[str], k: int, repeats: int, seed: int) -> DataFrame:
    """k folds for each repeat, in rows (repeat, fold)."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return kfold(many, ["repeat", *keys], k, seed, ["repeat"])


def repeated_stratified_split(
    df: DataFrame, keys: Sequence[str], test_size: float, repeats: int, seed: int, by: str
) -> DataFrame:
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return train_test_split(many, ["repeat", *keys], test_size, seed, ["repeat", by])


def sample_majority(
    df: DataFrame, keys: Sequence[str], label: str, minority: int, n_majority: int, seed: int
) -> DataFrame:
    """All minority rows and exactly ``n_majority`` of the others."""
    common = df.where(col(label) != minority)
    rank = F.least(F.col("n"), F.lit(n_majority))
    cut = _with_cuts(common, keys, seed, [rank], ())
    sampled = cut.where(F.col("_hash") <= F.col("c0")).select(*df.columns)
    return df.where(col(label) == minority).unionByName(sampled)


def first_rows(df: DataFrame, order: Sequence[str], n_first: int, n_rows: int) -> Column:
    """Predicate for the first ``n_first`` rows in ascending (order[0], order[1], ..), numbers of any size."""
    longs = [c for c in order if isinstance(df.schema[c].dataType, LongType)]
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in longs for n, f in (("a", F.min), ("b", F.max))]).first() if longs else ()
    exact = all(v is None or abs(v) <= 1 << 53 for v in ends)
    parts = []
    for c in order:
        if exact or c not in longs:
            parts.append(col(c).cast("double"))
        else:  # a double does not hold them: upper half, then lower half
            parts += [F.shiftright(c, 32).cast("double"), col(c).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")]
    return _first(df, parts, n_first, n_rows)


def _first(df: DataFrame, order: Sequence[Column], n_first: int, n_rows: int) -> Column:
    if n_first <= 0:
        return F.lit(False)
    if n_first >= n_rows:
        return F.lit(True)
    here, rest = order[0], order[1:]
    cut = values_at_ranks(df.select(here.alias("_here")), "_here", [n_first - 1], n_rows)[0]
    if not rest:
        return here <= cut
    row = df.agg(F.count_if(here < cut).alias("below"), F.count_if(here == cut).alias("ties")).first()
    ties = df.where(here == cut)
    return (here < cut) | ((here == cut) & _first(ties, rest, n_first - row.below, row.ties))


def temporal_split(df: DataFrame, ts: str, key: str, test_size: float) -> DataFrame:
    """Adds is_test; the oldest floor(n * (1 - test_size)) rows train."""
    timed = df.withColumn("_us", F.unix_micros(col(ts).cast("timestamp")))
    n = df.count()
    train = first_rows(timed, ["_us", key], int(n * (1 - test_size)), n)
    return timed.withColumn("is_test", F.when(train, 0).otherwise(1)).drop("_us")


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """weight = n / (classes * class size)."""
    counts = sized(df.groupBy(label).agg(F.count("*").alias("_c")))
    totals = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return (
        join_groups(df, counts, [label])
        .join(F.broadcast(totals))
        .withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c")))
        .drop("_c", "_n", "_k")
    )
