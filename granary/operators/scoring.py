"""Bulk scoring: validation, repair, guarded predictions, explanations, similar rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import clip, col, sigmoid
from granary.operators.profile import melt_aggregates
from granary.operators.quantiles import exact_quantiles, quantile_values
from granary.operators.similar import nearest_by_common

# fixed values: log prices above this are not believed, and no price is above the cap
LOG_LIMIT = 15.0
PRICE_CAP = 2_000_000.0


def confidence_band(score, threshold: float) -> Column:
    """high beyond 5 from the threshold, medium beyond 2, else low."""
    d = F.abs(col(score) - threshold)
    return F.when(d > 5, "high").when(d > 2, "medium").otherwise("low")


def repair(df: DataFrame, cols: Sequence[str], bound: float = 1e10) -> DataFrame:
    """Null and NaN -> 0, values clipped to a finite range; absent columns are an error."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"expected features {absent}")

    def fix(c: str) -> Column:
        x = F.coalesce(F.nanvl(col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
        return clip(x, F.lit(-bound), F.lit(bound))

    return df.withColumns({c: fix(c) for c in cols})


def repair_warnings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return melt_aggregates(
        df,
        {
            c: {
                "filled": F.count_if(col(c).isNull() | F.isnan(c)),
                "clipped": F.count_if(F.abs(col(c)) == float("inf")),
            }
            for c in cols
        },
    )


def price_from_log(log_price, fallback: float) -> Column:
    """expm1 within [0, cap]; a log price beyond belief gives the fallback, row by row."""
    x = col(log_price)
    return F.when(x > LOG_LIMIT, F.lit(fallback)).otherwise(clip(F.expm1(x), F.lit(0.0), F.lit(PRICE_CAP)))


def interval(prediction, deviation: float = 20000.0, z: float = 1.96) -> tuple[Column, Column]:
    p = col(prediction)
    low, high = F.lit(0.0), F.lit(PRICE_CAP)
    return clip(p - z * deviation, low, high), clip(p + z * deviation, low, high)


def risk_columns(score, threshold: float) -> dict[str, Column]:
    return {
        "flagged": (col(score) >= threshold).cast("int"),
        "risk_norm": sigmoid(score, 0.1),
        "confidence": confidence_band(score, threshold),
    }


def explain(amount, hour, amount_to_median, signals: Sequence[tuple[Column, Column]]) -> Column:
    """Reasons joined by '; ', with a fallback text."""
    a = col(amount)
    money = F.format_string("%.2f", a)
    amount_reason = (
        F.when(a < 1.0, F.concat(F.lit("micro-transaction ("), money, F.lit(")")))
        .when(a > 1000, F.concat(F.lit("large amount ("), money, F.lit(")")))
        .when(col(amount_to_median) > 10, F.concat(F.lit("large relative to median ("), money, F.lit(")")))
    )
    # fixed values: hours with most fraud
    hour_reason = F.when(
        col(hour).isin(2, 3, 4), F.concat(F.lit("off-hours (hour "), F.format_string("%02d", col(hour)), F.lit(")"))
    )
    parts = [amount_reason, hour_reason, *[F.when(test, text) for test, text in signals]]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "combination of behavioral features").otherwise(text)


def anomaly_signals(v17, v14, v12) -> list[tuple[Column, Column]]:
    """Tests and texts of the three strongest components, for ``explain``."""
    shown = lambda name, c, text: F.concat(F.lit(f"{name} anomaly ("), F.format_string("%.2f", col(c).cast("double")), F.lit(text))
    # fixed values: limits and texts
    return [
        (col(v17) < -2.0, shown("V17", v17, ") \u2014 strong fraud signal")),
        (col(v14) < -5.0, shown("V14", v14, ") \u2014 strong fraud signal")),
        (F.abs(col(v12)) > 3.0, shown("V12", v12, ")")),
    ]


def verdict(score, threshold: float, reasons: Column) -> Column:
    """Verdict, score against threshold, and the reasons, in one line."""
    # fixed values: texts
    said = F.when(col(score) >= threshold, "FLAGGED AS FRAUD").otherwise("Approved")
    against = F.concat(F.lit("risk score "), F.format_string("%.2f", col(score).cast("double")), F.lit(f" vs threshold {threshold:.2f}"))
    return F.concat_ws(" | ", said, against, F.concat(F.lit("Signals: "), reasons))


def similar_rows(df: DataFrame, key: str, key_value, cols: Sequence[str], n: int) -> DataFrame:
    """n rows nearest to one row: sum of |difference| / range over non-null columns.

    The one row and the ranges become literals; top-n needs no full sort.
    """
    cols = [c for c in cols if c in df.columns]
    row = df.where(col(key) == key_value).select(*cols).first()
    if row is None or not cols:
        return df.orderBy(key).limit(n).withColumn("distance", F.lit(None).cast("double"))
    span = df.agg(*[(F.max(c) - F.min(c)).cast("double").alias(c) for c in cols]).first()
    parts = [
        F.coalesce(F.abs(F.lit(float(row[c])) - col(c)) / F.lit(span[c]), F.lit(0.0))
        for c in cols
        if row[c] is not None and span[c]
    ]
    distance = F.round(reduce(lambda a, b: a + b, parts, F.lit(0.0)), 9)
    others = df.where(col(key) != key_value).withColumn("distance", distance)
    return others.orderBy("distance", key).limit(n)


def column_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Default value per column; a column without values gets 0."""
    found = exact_quantiles(df, cols, [0.5]).select("feature", "value")
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(F.broadcast(found), "feature", "left").select("feature", F.coalesce("value", F.lit(0.0)).alias("median"))


def typical_row(df: DataFrame, c: str, key: str) -> DataFrame:
    """The row closest to the median of c; the first by key on a tie."""
    m = quantile_values(df, [c], [0.5])[c, 0.5]
    return df.orderBy(F.round(F.abs(col(c) - m), 9), key).limit(1)


def default_chain(*sources) -> Column:
    return F.coalesce(*[col(s) for s in sources], F.lit(0.0))


def fill_from_similar(
    asked: DataFrame,
    table: DataFrame,
    key: str,
    given: dict[str, float],
    fill: Sequence[str],
    n: int = 10,
    extreme: float = 100_000.0,
) -> DataFrame:
    """Fill the columns ``fill`` of many rows from their n most similar rows.

    ``given``: feature -> weight, see ``similar.nearest_by_common``. A missing value
    becomes the median of the similar rows' values; a value beyond ``extreme``
    the median of those within three deviations of the column's median. Without
    such values the column's median takes their place, and 0 if it has none.
    Last, every value of these columns is limited to their 5 % - 95 % range.
    """
    wanted = reduce(lambda a, b: a | b, [col(c).isNull() | (F.abs(col(c)) > extreme) for c in fill])
    near = nearest_by_common(asked.where(wanted), table, key, given, n)
    q = quantile_values(table, list(fill), [0.05, 0.5, 0.95])
    dev = table.agg(*[F.stddev(c).alias(c) for c in fill]).first()
    values = table.select(col(key).cast("long").alias("neighbor"), *[col(c).cast("double").alias(f"_{c}") for c in fill])
    usual = {
        c: F.abs(F.col(f"_{c}") - F.lit(q.get((c, 0.5)))) < F.lit(3.0 * dev[c]) if dev[c] else F.lit(True) for c in fill
    }
    # at most n values per key
    filled = near.join(values, "neighbor").groupBy(key).agg(
        *[F.median(f"_{c}").alias(f"_fill_{c}") for c in fill],
        *[F.median(F.when(usual[c], F.col(f"_{c}"))).alias(f"_usual_{c}") for c in fill],
    )
    out = asked.join(filled, key, "left")
    for c in fill:
        middle = F.lit(q.get((c, 0.5), 0.0))
        value = (
            F.when(col(c).isNull(), F.coalesce(f"_fill_{c}", middle))
            .when(F.abs(col(c)) > extreme, F.coalesce(f"_usual_{c}", middle))
            .otherwise(col(c).cast("double"))
        )
        if (c, 0.5) in q:
            value = clip(value, F.lit(q[c, 0.05]), F.lit(q[c, 0.95]))
        out = out.withColumn(c, value)
    return out.drop(*[f"_{kind}_{c}" for c in fill for kind in ("fill", "usual")])
