"""Spark ML estimators in the shapes the queries need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.clean import Imputer
from granary.operators.scale import StandardScaler


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "columns to work on", TypeConverters.toListString)


class Log1pTransformer(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """log1p of each column, in place."""

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.log1p(F.greatest(col(c), F.lit(0.0))) for c in self.getOrDefault("columns")})


class MedianScale(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation, then population scaling."""

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._set(columns=list(columns))

    def _fit(self, df: DataFrame) -> MedianScaleModel:
        cols = self.getOrDefault("columns")
        fills = Imputer.fit(df, {c: ("median", None) for c in cols})
        s = StandardScaler.fit(fills.transform(df), cols)
        return MedianScaleModel(
            cols, [float(fills.values[c]) for c in cols], [s.mean[c] for c in cols], [s.std[c] for c in cols]
        )


class MedianScaleModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "fill values", TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "means", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "deviations", TypeConverters.toListFloat)

    def __init__(self, columns=(), fills=(), means=(), stds=()):
        super().__init__()
        self._set(columns=list(columns), fills=list(fills), means=list(means), stds=list(stds))

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = zip(*[self.getOrDefault(n) for n in ("columns", "fills", "means", "stds")], strict=True)
        return df.withColumns({c: (F.coalesce(col(c).cast("double"), F.lit(f)) - m) / s for c, f, m, s in parts})


def column_transformer(
    median_scaled: Sequence[str] = (),
    log_scaled: Sequence[str] = (),
    one_hot: Sequence[str] = (),
    remainder: Sequence[str] = (),
) -> Pipeline:
    """Different preparation per column group, assembled into ``features``.

    The alphabetically first category of a one-hot column is dropped.
    """
    stages = []
    if log_scaled:
        stages.append(Log1pTransformer(log_scaled))
    scaled = [*median_scaled, *log_scaled]
    if scaled:
        stages.append(MedianScale(scaled))
    for c in one_hot:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetDesc", handleInvalid="keep"))
    if one_hot:
        stages.append(
            OneHotEncoder(inputCols=[f"{c}_idx" for c in one_hot], outputCols=[f"{c}_hot" for c in one_hot], dropLast=True)
        )
    stages.append(
        VectorAssembler(inputCols=[*scaled, *[f"{c}_hot" for c in one_hot], *remainder], outputCol="features")
    )
    return Pipeline(stages=stages)


def weighted_kmeans(df: DataFrame, vector: str, k: int, seed: int, weight: str | None = None) -> list[list[float]]:
    """Centres, ordered, of a (weighted) k-means fit; k x width numbers."""
    km = KMeans(k=k, seed=seed, featuresCol="_v")
    if weight:
        km = km.setWeightCol(weight)
    model = km.fit(df.withColumn("_v", array_to_vector(col(vector).cast("array<double>"))))
    return sorted([[float(x) for x in c] for c in model.clusterCenters()])


def linear_svm(c: float, n: int, weight: str | None = None, **params) -> LinearSVC:
    """Hinge loss with C on the sum of the losses."""
    svc = LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=params.pop("maxIter", 100), **params)
    return svc.setWeightCol(weight) if weight else svc


def with_vector(df: DataFrame, array: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(col(array).cast("array<double>")))


def margin_count(scored: DataFrame, label: str, raw: str = "rawPrediction") -> DataFrame:
    """Rows on or inside the margin: y f(x) <= 1 + 1e-4 with y in -1, 1."""
    from pyspark.ml.functions import vector_to_array

    f = F.get(vector_to_array(raw), F.lit(1))
    y = F.when(col(label) == 1, 1.0).otherwise(-1.0)
    return scored.agg(F.count("*").alias("n"), F.count_if(y * f <= 1 + 1e-4).alias("n_margin"))


def one_vs_rest(c: float, n: int, label: str) -> OneVsRest:
    return OneVsRest(classifier=linear_svm(c, n, maxIter=20), labelCol=label, featuresCol="features", parallelism=4)


def logistic(label: str, reg: float = 0.0, weight: str | None = None) -> LogisticRegression:
    lr = LogisticRegression(labelCol=label, featuresCol="features", regParam=reg, maxIter=100)
    return lr.setWeightCol(weight) if weight else lr
