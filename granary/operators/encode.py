"""Categorical encoders: mappings are small tables joined or inlined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.ranking import sorted_positions
from granary.operators.joins import join_groups
from granary.session import sized

WIDE_LIMIT = 1000


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """(category, code): distinct non-null values in ascending order from 0."""
    values = df.select(col(c).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    return sized(sorted_positions(values, ["category"], "code"), "codes")


def label_encode(df: DataFrame, c: str, codes: DataFrame, out: str, strict: bool = True) -> DataFrame:
    """Code column; an unseen category is an error, or null when not strict."""
    m = codes.select(F.col("category").alias("_cat"), F.col("code").alias(out))
    joined = df.join(m, col(c).cast("string") == F.col("_cat"), "left").drop("_cat")
    if not strict:
        return joined
    message = F.concat(F.lit(f"unseen category in {c}: "), col(c).cast("string"))
    return joined.withColumn(
        out, F.when(col(c).isNotNull() & F.col(out).isNull(), F.raise_error(message).cast("long")).otherwise(F.col(out))
    )


def label_decode(df: DataFrame, code: str, codes: DataFrame, out: str) -> DataFrame:
    m = codes.select(F.col("category").alias(out), F.col("code").alias("_code"))
    return df.join(m, col(code) == F.col("_code"), "left").drop("_code")


def ordinal(c, order: Sequence[str], unknown: int = -1) -> Column:
    """Position of the value in ``order``; null counts as 'None'."""
    value = F.coalesce(col(c), F.lit("None"))
    out = F.lit(unknown)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(value == name, i).otherwise(out)
    return out


def categories_of(df: DataFrame, c: str) -> list[str]:
    """Sorted categories for a wide encoding (its columns are part of the schema)."""
    rows = df.select(col(c).cast("string").alias("v")).where("v IS NOT NULL").distinct().limit(WIDE_LIMIT + 1).collect()
    if len(rows) > WIDE_LIMIT:
        raise ValueError(f"{c} has more than {WIDE_LIMIT} categories; use label_codes and one_hot_vectors")
    return sorted(r.v for r in rows)


def one_hot(c: str, categories: Sequence[str], prefix: str | None = None, drop_first: bool = True) -> list[Column]:
    """0/1 columns named prefix_category; unknown values give zeros."""
    kept = list(categories)[1:] if drop_first else list(categories)
    return [F.when(col(c) == v, 1.0).otherwise(0.0).alias(f"{prefix or c}_{v}") for v in kept]


def one_hot_vectors(df: DataFrame, c: str, codes: DataFrame, out: str, drop_first: bool = True) -> DataFrame:
    """0/1 sparse vector of any width, in the order of ``codes`` (see ``label_codes``); unknown values and nulls give zeros."""
    width = codes.count() - int(drop_first)
    place = F.col("_code") - int(drop_first)
    # the place after the last is dropped: for unknown values and the first category
    place = F.when(F.col("_code").isNull() | (place < 0), width).otherwise(place).cast("double")
    encoder = OneHotEncoder(inputCols=["_place"], outputCols=[out], dropLast=True)
    model = encoder.fit(df.sparkSession.range(max(width, 1) + 1).select(F.col("id").cast("double").alias("_place")))
    return model.transform(label_encode(df, c, codes, "_code", strict=False).withColumn("_place", place)).drop("_code", "_place")


@dataclass(frozen=True)
class TargetEncoding:
    """Smoothed target mean per category and the global mean, both as tables."""

    column: str
    mapping: DataFrame
    overall: DataFrame

    @classmethod
    def fit(cls, df: DataFrame, c: str, target: str, smoothing: float = 1.0, min_samples: int = 1):
        sums = df.groupBy(c).agg(F.count(target).alias("n"), F.sum(target).alias("s"))
        overall = df.agg(F.avg(target).alias("global_mean"))
        mapping = sums.join(F.broadcast(overall)).select(
            c, "n", smoothed("n", "s", "global_mean", smoothing, min_samples).alias("encoding")
        )
        return cls(c, sized(mapping, "encoding"), overall)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        m = self.mapping.select(F.col(self.column), F.col("encoding").alias(out))
        return (
            df.join(m, self.column, "left")
            .join(F.broadcast(self.overall))
            .withColumn(out, F.coalesce(out, "global_mean"))
            .drop("global_mean")
        )


def smoothed(n, s, overall, smoothing: float, min_samples: int) -> Column:
    n, s, overall = col(n), col(s), col(overall)
    return F.when(n >= min_samples, (s + F.lit(smoothing) * overall) / (n + F.lit(smoothing))).otherwise(overall)


def out_of_fold_target(
    df: DataFrame, c: str, target: str, fold: str, out: str, smoothing: float = 1.0, min_samples: int = 1
) -> DataFrame:
    """Each row is encoded by the rows of the other folds only.

    One (category, fold) table gives every needed sum: total minus own fold.
    """
    cells = df.groupBy(c, fold).agg(F.count(target).alias("cn"), F.sum(target).alias("cs"))
    per_cat = cells.groupBy(c).agg(F.sum("cn").alias("tn"), F.sum("cs").alias("tsum"))
    per_fold = cells.groupBy(fold).agg(F.sum("cn").alias("fn"), F.sum("cs").alias("fs"))
    total = cells.agg(F.sum("cn").alias("an"), F.sum("cs").alias("asum"))
    outside = (F.col("asum") - F.col("fs")) / (F.col("an") - F.col("fn"))
    table = (
        join_groups(join_groups(cells, per_cat, [c]), F.broadcast(per_fold), [fold])
        .join(F.broadcast(total))
        .select(
            c,
            fold,
            smoothed(
                F.col("tn") - F.col("cn"), F.col("tsum") - F.col("cs"), outside, smoothing, min_samples
            ).alias(out),
        )
    )
    return join_groups(df, sized(table, "encoding"), [c, fold])


def encode_columns(df: DataFrame, plan: dict[str, tuple[str, dict]]) -> DataFrame:
    """Per-column encoders: label, ordinal, onehot (replaces the column) or target."""
    out = df
    for c, (kind, params) in plan.items():
        if kind == "label":
            out = label_encode(out, c, label_codes(df, c), f"{c}_code")
        elif kind == "ordinal":
            out = out.withColumn(f"{c}_code", ordinal(c, **params))
        elif kind == "onehot":
            out = out.select("*", *one_hot(c, categories_of(df, c), **params)).drop(c)
        elif kind == "target":
            out = TargetEncoding.fit(df, c, **params).transform(out, f"{c}_mean")
        else:
            raise ValueError(f"unknown encoder {kind}")
    return out


def recover_mapping(raw: DataFrame, encoded: DataFrame, key: str, category: str, code: str) -> DataFrame:
    """Category -> code from a raw and an encoded table; the first row of a category wins."""
    return raw.join(encoded, key).groupBy(category).agg(F.min_by(code, key).alias(code))
