"""Model evaluation as aggregations.

Ranking metrics work on one row per distinct score, written once; running
totals over it are distributed (see ``ranking.running_totals``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.profile import one_window
from granary.operators.ranking import running_totals
from granary.session import materialize


def normal_quantile(p) -> Column:
    """Inverse of the standard normal distribution, evaluated in Arrow batches."""

    @F.pandas_udf("double")
    def inverse(s: pd.Series) -> pd.Series:
        from statistics import NormalDist

        nd = NormalDist()
        return s.map(lambda x: nd.inv_cdf(x) if x is not None and 0.0 < x < 1.0 else None).astype("float64")

    return inverse(p)


# ------------------------------------------------------------ regression


def r2(y, p) -> Column:
    """1 - SSE / SST; a constant target gives 1 when met exactly, else 0."""
    sse = F.sum((col(y) - col(p)) * (col(y) - col(p)))
    sst = F.var_pop(col(y)) * F.count(col(y))
    return F.when(sst > 0, 1 - F.try_divide(sse, sst)).otherwise(F.when(sse == 0, 1.0).otherwise(0.0))


def mse(y, p) -> Column:
    return F.avg((col(y) - col(p)) * (col(y) - col(p)))


def rmse(y, p) -> Column:
    return F.sqrt(mse(y, p))


def mae(y, p) -> Column:
    return F.avg(F.abs(col(y) - col(p)))


def mape(y, p, zeros: str = "skip") -> Column:
    """Percent; zero targets are left out, or count as no error."""
    rate = F.when(col(y) != 0, F.abs((col(y) - col(p)) / F.when(col(y) != 0, col(y))))
    return 100 * F.avg(rate if zeros == "skip" else F.coalesce(rate, F.lit(0.0)))


def rmsle(y, p) -> Column:
    d = F.log1p(F.greatest(col(p), F.lit(0.0))) - F.log1p(col(y))
    return F.sqrt(F.avg(d * d))


METRICS: dict[str, Callable[..., Column]] = {"r2": r2, "rmse": rmse, "mae": mae, "mape": mape, "rmsle": rmsle}


def regression_report(df: DataFrame, y: str, p: str, prefix: str = "", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[m(y, p).alias(f"{prefix}{name}") for name, m in METRICS.items()])


def t_interval(values: DataFrame, c: str, confidence: float = 0.95) -> DataFrame:
    """Interval for the root of a mean (of squared errors), Student quantile by expansion."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    stats = values.agg(F.avg(c).alias("m"), F.stddev(c).alias("s"), F.count(c).alias("n"))
    df = F.col("n") - 1
    t = (
        F.lit(z)
        + F.lit((z**3 + z) / 4) / df
        + F.lit((5 * z**5 + 16 * z**3 + 3 * z) / 96) / (df * df)
    )
    half = t * F.col("s") / F.sqrt("n")
    return stats.select(
        F.sqrt(F.greatest(F.col("m") - half, F.lit(0.0))).alias("low"), F.sqrt(F.col("m") + half).alias("high")
    )


# ------------------------------------------------------------ classification


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts with shares of the true class, of the predicted class and of all errors."""
    cells = df.groupBy(truth, pred).agg(F.count("*").alias("n"))
    wrong = F.when(F.col(truth) != F.col(pred), F.col("n")).otherwise(0)
    return cells.select(
        truth,
        pred,
        "n",
        (F.col("n") / F.sum("n").over(Window.partitionBy(truth))).alias("row_share"),
        (F.col("n") / F.sum("n").over(Window.partitionBy(pred))).alias("col_share"),
        F.try_divide(wrong, F.sum(wrong).over(one_window())).alias("error_share"),
    )


def binary_report(df: DataFrame, truth, pred, by: Sequence[str] = ()) -> DataFrame:
    t, p = col(truth) == 1, col(pred) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy, specificity from tp, fp, fn, tn."""
    e = 1e-10
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = tp / (tp + fp + e), tp / (tp + fn + e)
    return counts.withColumns(
        {
            "precision": precision,
            "recall": recall,
            "f1": 2 * precision * recall / (precision + recall + e),
            "accuracy": (tp + tn) / (tp + fp + fn + tn + e),
            "specificity": tn / (tn + fp + e),
        }
    )


def net_value(tp, fp, fn, gain: float = 122.0, loss: float = 122.0, cost: float = 2.0) -> Column:
    """Money saved by caught cases minus missed cases minus false alarms."""
    return col(tp) * gain - col(fn) * loss - col(fp) * cost


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, pos, neg) per distinct score; -0.0 and 0.0 are one score. Written once."""
    counts = (
        df.where(col(score).isNotNull())
        .groupBy((col(score) + F.lit(0.0)).alias("score"))
        .agg(F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) != 1).alias("neg"))
    )
    return materialize(counts, "scores")


def score_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """Counts and cumulative tp, fp at each distinct threshold, with the totals p and n."""
    counts = score_counts(df, score, label)
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ordered = counts.withColumn("_down", -F.col("score"))
    run = running_totals(ordered, "_down", {"tp": "pos", "fp": "neg"}).drop("_down")
    return run.join(F.broadcast(totals))


def roc_pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    return score_curve(df, score, label).select(
        "score",
        "tp",
        "fp",
        F.try_divide("tp", "p").alias("recall"),
        F.try_divide("fp", "n").alias("fpr"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )


def mid_ranks(df: DataFrame, score: str, label: str) -> DataFrame:
    """Ascending average rank per distinct score."""
    c = score_curve(df, score, label)
    size = F.col("pos") + F.col("neg")
    above = F.col("tp") + F.col("fp") - size
    return c.select(
        "score", size.alias("n_ties"), (F.col("p") + F.col("n") - above - size + (size + 1) / 2).alias("rank")
    )


def auc_roc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs ordered rightly, ties half; 0.5 if a class is empty."""
    c = score_curve(df, score, label)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = F.max(F.col("p").cast("double") * F.col("n"))
    return c.agg(F.when(pairs > 0, F.try_divide(wins, pairs)).otherwise(0.5).alias("auc_roc"))


def auc_pr(df: DataFrame, score: str, label: str) -> DataFrame:
    """Trapezoids over recall, from (recall 0, precision 1)."""
    c = score_curve(df, score, label)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp0 + fp0 > 0, F.try_divide(tp0, tp0 + fp0)).otherwise(1.0)
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.sum(F.try_divide("pos", "p") * (here + before) / 2)
    return c.agg(F.coalesce(area, F.lit(0.0)).alias("auc_pr"))


def threshold_sweep(df: DataFrame, score: str, label: str, points: int = 30) -> DataFrame:
    """Metrics at evenly spaced thresholds from the highest to the lowest score.

    Scores fall into threshold cells once; a running sum over the cells gives
    every threshold.
    """
    counts = score_counts(df, score, label)
    ends = counts.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if ends.hi is None:
        raise ValueError("no scores")
    cuts = [ends.hi - (ends.hi - ends.lo) * i / (points - 1) for i in range(points)]
    rising = sorted(set(cuts))
    splits = [float("-inf"), *rising, float("inf")]
    cells = (
        Bucketizer(splits=splits, inputCol="score", outputCol="_b", handleInvalid="keep")
        .transform(counts)
        .groupBy("_b")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    spark = df.sparkSession
    table = spark.createDataFrame(
        [(i, c, float(rising.index(c) + 1)) for i, c in enumerate(cuts)], "step int, threshold double, cell double"
    )
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("cell")).rangeBetween(Window.unboundedPreceding, 0)
    joined = table.join(cells, F.col("cell") == F.col("_b"), "left")
    joined = joined.select(
        "step",
        "threshold",
        F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("neg").over(down), F.lit(0)).alias("fp"),
    )
    totals = counts.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    full = joined.join(F.broadcast(totals)).select(
        "step", "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")
    )
    return with_rates(full)


def operating_point(df: DataFrame, score: str, label: str, metric: str, target: float) -> DataFrame:
    """The strictest threshold whose recall (or precision) reaches the target; nulls if none."""
    curve = roc_pr_curve(df, score, label)
    hit = curve.where(F.col(metric) >= target)
    best = F.max(F.struct("score", "tp", "fp", "precision", "recall"))
    return hit.agg(best.alias("b")).select("b.*")
