"""Profiling: one aggregation pass per report, long results."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import col, equal_width_bin
from granary.operators.quantiles import exact_quantiles, quantile_row


def one_window():
    """A window over everything; only for results as small as a column or class list."""
    return Window.partitionBy(F.lit(0))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def melt_aggregates(df: DataFrame, per_col: dict[str, dict[str, Column]], key: str = "feature") -> DataFrame:
    """One global aggregation, returned as one row per column.

    ``per_col``: column -> {output name: aggregate expression}.
    """
    aggs, structs = [], []
    for c, outs in per_col.items():
        fields = [F.lit(c).alias(key)]
        for out, expr in outs.items():
            aggs.append(expr.alias(f"{c}__{out}"))
            fields.append(F.col(f"{c}__{out}").alias(out))
        structs.append(F.struct(*fields))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def describe(df: DataFrame, cols: Sequence[str], std: str = "population") -> DataFrame:
    sd = F.stddev_pop if std == "population" else F.stddev
    stats = melt_aggregates(
        df,
        {
            c: {
                "n": F.count(c),
                "mean": F.avg(c),
                "std": sd(c),
                "min": F.min(col(c).cast("double")),
                "max": F.max(col(c).cast("double")),
            }
            for c in cols
        },
    )
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    wide = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    )
    return stats.join(F.broadcast(wide), "feature", "left")


def inferred_types(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """unknown / int64 / float64 / object from the values themselves."""

    def kind(c: str) -> Column:
        text = col(c).cast("string")
        number = text.try_cast("double")
        filled = F.count(c)
        numeric = F.count(number)
        whole = F.count(F.when(number == F.floor(number), 1))
        return (
            F.when(filled == 0, "unknown")
            .when((numeric == filled) & (whole == filled), "int64")
            .when(numeric == filled, "float64")
            .otherwise("object")
        )

    return melt_aggregates(df, {c: {"dtype": kind(c), "non_null": F.count(c)} for c in cols})


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt_aggregates(
        df, {c: {"nulls": F.count_if(col(c).isNull()), "n": F.count("*")} for c in cols}
    )


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    return (
        null_counts(df, cols)
        .where("nulls > 0")
        .select("feature", "nulls", F.round(F.lit(100.0) * F.col("nulls") / F.col("n"), 2).alias("pct"))
        .orderBy(F.desc("nulls"), "feature")
    )


def missing_strategy(df: DataFrame, absent_means_none: str, absent_means_zero: str) -> DataFrame:
    """Fill strategy per column with nulls; name patterns are regular expressions."""
    text = string_columns(df)
    name = F.col("feature")
    return missing_report(df).withColumn(
        "strategy",
        F.when(F.col("pct") > 80, "drop")
        .when(name.rlike(absent_means_none), "fill_none")
        .when(name.rlike(absent_means_zero), "fill_zero")
        .when(name.isin(text), "mode")
        .otherwise("median"),
    )


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return (
        df.where(col(c).isNotNull())
        .groupBy(col(c).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def class_shares(df: DataFrame, c: str) -> DataFrame:
    """Count, share and majority ratio per class."""
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    return counts.select(
        c,
        "n",
        (F.col("n") / F.sum("n").over(one_window())).alias("share"),
        (F.max("n").over(one_window()) / F.col("n")).alias("imbalance"),
    )


def cardinalities(df: DataFrame, cols: Sequence[str], limit: int = 10) -> DataFrame:
    """Exact distinct counts: one shuffle on (column, value) for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("v")) for c in cols])
    return (
        df.select(F.inline(pairs))
        .where("v IS NOT NULL")
        .groupBy("feature", "v")
        .agg(F.lit(1).alias("one"))
        .groupBy("feature")
        .agg(F.count("*").alias("n_unique"))
        .withColumn("kind", F.when(F.col("n_unique") > limit, "high").otherwise("low"))
    )


def adjusted_skew(c) -> Column:
    """Bias-adjusted sample skewness."""
    n = F.count(c).cast("double")
    return F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)


def skewed_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    return (
        melt_aggregates(df, {c: {"skew": adjusted_skew(c)} for c in cols})
        .where(F.abs("skew") > threshold)
        .orderBy(F.desc(F.abs("skew")), "feature")
    )


def histogram(df: DataFrame, c: str, bins: int) -> DataFrame:
    bounds = df.agg(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    return (
        df.select(col(c).cast("double").alias("x"))
        .where("x IS NOT NULL")
        .join(F.broadcast(bounds))
        .groupBy(equal_width_bin("x", F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    )


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Upper triangle of the Pearson matrix from one aggregation."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
                    for i, (a, b) in enumerate(pairs)
                ]
            )
        )
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full matrix in long form; mirrored from the triangle."""
    upper = correlation_pairs(df, cols)
    both = upper.select(
        F.inline(
            F.array(
                F.struct(F.col("a"), F.col("b"), F.col("r")),
                F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("r")),
            )
        )
    )
    ones = melt_aggregates(df, {c: {"r": F.when(F.stddev_pop(c) > 0, 1.0)} for c in cols}, "a")
    return both.unionByName(ones.select("a", F.col("a").alias("b"), "r"))


def target_correlation(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    return melt_aggregates(df, {c: {"r": F.corr(c, target)} for c in cols})


def class_separation(df: DataFrame, cols: Sequence[str], positive: Column, minimum: float = 0.5) -> DataFrame:
    """|mean difference| in units of the negative class's deviation."""
    per_col = {}
    for c in cols:
        pos, neg = F.when(positive, col(c)), F.when(~positive, col(c))
        per_col[c] = {
            "mean_pos": F.avg(pos),
            "mean_neg": F.avg(neg),
            "std_pos": F.stddev(pos),
            "std_neg": F.stddev(neg),
        }
    out = melt_aggregates(df, per_col).withColumn(
        "separation", F.abs(F.col("mean_pos") - F.col("mean_neg")) / (F.col("std_neg") + 1e-10)
    )
    return out.where(F.col("separation") > minimum).orderBy(F.desc("separation"), "feature")


def iqr_outliers(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> DataFrame:
    wanted = {f"{c}__{n}": (c, p) for c in cols for n, p in (("q1", 0.25), ("q3", 0.75))}
    bounds = quantile_row(df, wanted)
    per_col = {}
    for c in cols:
        spread = (F.col(f"{c}__q3") - F.col(f"{c}__q1")) * factor
        outside = (col(c) < F.col(f"{c}__q1") - spread) | (col(c) > F.col(f"{c}__q3") + spread)
        per_col[c] = {"n_out": F.count_if(outside), "n": F.count("*")}
    return melt_aggregates(df.join(F.broadcast(bounds)), per_col).select(
        "feature", "n_out", (F.lit(100.0) * F.col("n_out") / F.col("n")).alias("pct")
    )


def finite_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls, NaN and infinities per column."""
    return melt_aggregates(
        df,
        {
            c: {
                "nulls": F.count_if(col(c).isNull()),
                "nans": F.count_if(F.isnan(c)),
                "infinite": F.count_if(F.abs(col(c)) == float("inf")),
            }
            for c in cols
        },
    )


def reference_statistics(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return describe(df, cols)


def sample_percentiles(df: DataFrame, c: str, probs: Sequence[float]) -> DataFrame:
    return exact_quantiles(df, [c], probs).select("prob", "value")


