"""Imputation, outlier handling and configured table cleaning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.scalars import clip, col, text_na_to_null
from granary.operators.filters import Rule, apply_rules, rule_effects
from granary.operators.profile import melt_aggregates, null_counts
from granary.operators.quantiles import exact_quantiles, quantile_values
from granary.session import sized


def _is_text(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.StringType)


def known_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """String spellings of missing become null."""
    return df.withColumns({c: text_na_to_null(c) for c in cols if _is_text(df, c)})


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on a tie; counted by value, not in one task."""
    out: dict[str, object] = {}
    for text in (True, False):
        group = [c for c in cols if _is_text(df, c) == text]
        if not group:
            continue
        kind = "string" if text else "double"
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast(kind).alias("v")) for c in group])
        counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n"))
        best = counts.groupBy("feature").agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("b"))
        out.update({r.feature: r.b["v"] for r in best.collect()})
    return out


@dataclass(frozen=True)
class Imputer:
    """One fill value per column."""

    values: dict[str, object]

    @classmethod
    def fit(cls, df: DataFrame, strategies: dict[str, tuple[str, object]]):
        """``strategies``: column -> (mean | median | most_frequent | constant, fill value).

        A column without any value gets its fill value, or 0.
        """
        usable = {c: s for c, s in strategies.items() if c in df.columns}
        unknown = {s for s, _ in usable.values()} - {"mean", "median", "most_frequent", "constant"}
        if unknown:
            raise ValueError(f"unknown strategies {sorted(unknown)}")
        known = known_text(df, list(usable))
        pick = lambda name: [c for c, (s, _) in usable.items() if s == name]
        found: dict[str, object] = {}
        if pick("mean"):
            found.update(known.agg(*[F.avg(c).alias(c) for c in pick("mean")]).first().asDict())
        if pick("median"):
            found.update({c: v for (c, _), v in quantile_values(known, pick("median"), [0.5]).items()})
        if pick("most_frequent"):
            found.update(modes(known, pick("most_frequent")))
        values = {}
        for c, (strategy, fill) in usable.items():
            v = fill if strategy == "constant" else found.get(c)
            if v is None:
                v = fill if fill is not None else 0
            values[c] = v
        return cls(values)

    def transform(self, df: DataFrame) -> DataFrame:
        df = known_text(df, list(self.values))
        out = {}
        for c, v in self.values.items():
            kind = df.schema[c].dataType
            if isinstance(v, float) and isinstance(kind, T.IntegralType):
                kind = T.DoubleType()
            out[c] = F.coalesce(col(c).cast(kind), F.lit(v).cast(kind))
        return df.withColumns(out)


def group_median_fill(df: DataFrame, c: str, by: str) -> DataFrame:
    """Null -> median of the row's group, else the global median."""
    med = sized(exact_quantiles(df, [c], [0.5], [by], "_g").select(by, "_g"))
    overall = exact_quantiles(df, [c], [0.5], (), "_all").select("_all")
    return (
        df.join(med, by, "left")
        .join(F.broadcast(overall), how="left")
        .withColumn(c, F.coalesce(col(c).cast("double"), "_g", "_all"))
        .drop("_g", "_all")
    )


@dataclass(frozen=True)
class OutlierHandler:
    """Bounds per column and what to do outside them."""

    bounds: dict[str, tuple[float, float]]
    strategy: str = "clip"

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold=1.5, strategy: str = "clip"):
        if strategy not in ("clip", "nan", "remove"):
            raise ValueError(f"unknown strategy {strategy}")
        if method == "zscore":
            row = df.agg(
                *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
            ).first()
            bounds = {
                c: (row[f"m_{c}"] - threshold * row[f"s_{c}"], row[f"m_{c}"] + threshold * row[f"s_{c}"]) for c in cols
            }
        elif method == "iqr":
            q = quantile_values(df, cols, [0.25, 0.75])
            bounds = {}
            for c in cols:
                spread = threshold * (q[c, 0.75] - q[c, 0.25])
                bounds[c] = (q[c, 0.25] - spread, q[c, 0.75] + spread)
        elif method == "percentile":
            low, high = threshold
            q = quantile_values(df, cols, [low, high])
            bounds = {c: (q[c, low], q[c, high]) for c in cols}
        else:
            raise ValueError(f"unknown method {method}")
        return cls(bounds, strategy)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.strategy == "clip":
            return df.withColumns({c: clip(c, F.lit(a), F.lit(b)) for c, (a, b) in self.bounds.items()})
        out = {c: (col(c) < a) | (col(c) > b) for c, (a, b) in self.bounds.items()}
        if self.strategy == "nan":
            return df.withColumns({c: F.when(F.coalesce(o, F.lit(False)), None).otherwise(col(c)) for c, o in out.items()})
        for o in out.values():
            df = df.where(~F.coalesce(o, F.lit(False)))
        return df


@dataclass
class CleaningSteps:
    """Named steps, each fitted and applied in turn.

    ``fit_on="raw"`` fits every step on the incoming table, ``"sequential"``
    on the output of the steps before it.
    """

    fit_on: str = "sequential"
    steps: list[tuple[str, Callable[[DataFrame], object]]] = field(default_factory=list)
    fitted: list[tuple[str, object]] = field(default_factory=list)
    log: list[str] = field(default_factory=list)

    def add(self, name: str, fit: Callable[[DataFrame], object]) -> CleaningSteps:
        if name in [n for n, _ in self.steps]:
            raise ValueError(f"step {name} exists")
        self.steps.append((name, fit))
        return self

    def fit(self, df: DataFrame) -> CleaningSteps:
        current, self.fitted = df, []
        for name, fit in self.steps:
            model = fit(df if self.fit_on == "raw" else current)
            self.fitted.append((name, model))
            self.log.append(f"fitted {name}")
            current = model.transform(current)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        for _, model in self.fitted:
            df = model.transform(df)
        return df


@dataclass(frozen=True)
class CleaningConfig:
    drop: Sequence[str] = ()
    rules: Sequence[Rule] = ()
    none_columns: Sequence[str] = ()
    zero_columns: Sequence[str] = ()
    median_columns: Sequence[str] = ()
    mode_columns: Sequence[str] = ()


def fill_absent(df: DataFrame, none_columns: Sequence[str], zero_columns: Sequence[str]) -> DataFrame:
    """A null that means 'there is none': 'None' for text, 0 for numbers."""
    fills: dict[str, object] = {c: "None" for c in none_columns if c in df.columns}
    fills.update({c: 0 for c in zero_columns if c in df.columns})
    return df.fillna(fills) if fills else df


def clean_table(df: DataFrame, config: CleaningConfig) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and report rows (section, name, n)."""
    kept = df.drop(*config.drop)
    effects = rule_effects(kept, config.rules)
    out = fill_absent(apply_rules(kept, config.rules), config.none_columns, config.zero_columns)
    strategies = {c: ("median", None) for c in config.median_columns if c in out.columns}
    strategies.update({c: ("most_frequent", None) for c in config.mode_columns if c in out.columns})
    if strategies:
        out = Imputer.fit(out, strategies).transform(out)
    left = null_counts(out, out.columns)
    report = effects.select(F.lit("removed").alias("section"), F.col("rule").alias("name"), F.col("removed").alias("n")).unionByName(
        left.select(F.lit("nulls").alias("section"), F.col("feature").alias("name"), F.col("nulls").alias("n"))
    )
    return out, report


def expectations(df: DataFrame, checks: dict[str, object]) -> DataFrame:
    """Rows (check, violations) from one pass; a check is a boolean column every row must satisfy."""
    per = {name: {"violations": F.count_if(~F.coalesce(ok, F.lit(False)))} for name, ok in checks.items()}
    return melt_aggregates(df, per, "check")
