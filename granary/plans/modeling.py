"""Model fitting, evaluation, cross-validation and tuning queries."""

import numpy as np
from pyspark.sql import functions as F

from granary.models import linear, search, sgd
from granary.operators import evaluate as E
from granary.operators import kernels, neighbors
from granary.operators.features import polynomial
from granary.operators.gram import moments
from granary.operators.profile import histogram
from granary.operators.quantiles import quantile_row
from granary.operators.scale import StandardScaler
from granary.operators.split import hash_fold, with_class_weights
from granary.plans.common import LINE_KEY, LINE_NULLS_SQL, SCORED_SQL, line_nulls, scored_events
from granary.plans.registry import query
from granary.session import materialize

KEYS = ", ".join(LINE_KEY)
FOLD_SQL = f"CAST(('0x' || substr(md5(concat_ws('|', {KEYS}) || ':42'), 1, 7)) AS BIGINT) % 5"
UNIT_SQL = f"CAST(('0x' || substr(md5(concat_ws('|', {KEYS}) || ':7'), 1, 7)) AS BIGINT) / 268435456.0::DOUBLE"


def regression_rows(t):
    """Two features, a target that depends on them, a simple prediction p and a fold."""
    c = F.col
    return t.lineitem.select(
        *LINE_KEY,
        "l_returnflag",
        c("l_quantity").alias("x1"),
        (c("l_discount") * 100).alias("x2"),
        (c("l_extendedprice") * 0.1 + c("l_quantity") * 500 - c("l_discount") * 3000).alias("y"),
        (c("l_quantity") * 500 + 5000).alias("p"),
        hash_fold(LINE_KEY, 5, 42).alias("fold"),
        (F.conv(F.substring(F.md5(F.concat(F.concat_ws("|", *LINE_KEY), F.lit(":7"))), 1, 7), 16, 10).cast("long") / 268435456.0).alias("u"),
    )


REG = f"""(SELECT {KEYS}, l_returnflag, l_quantity AS x1, l_discount * 100 AS x2,
  l_extendedprice * 0.1 + l_quantity * 500 - l_discount * 3000 AS y, l_quantity * 500 + 5000 AS p, {FOLD_SQL} AS fold, {UNIT_SQL} AS u FROM lineitem)"""

S_SQL = """count(*)::DOUBLE AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) * count(*) AS s11, var_pop(x2) * count(*) AS s22,
  covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS s1y, covar_pop(x2, y) * count(*) AS s2y"""


def coefficient_sql(w1: str, w2: str, source: str) -> str:
    return f"""WITH w AS (SELECT *, {w1} AS w1, {w2} AS w2 FROM ({source}))
      SELECT 'x1' AS feature, round(w1, 6) AS weight FROM w UNION ALL SELECT 'x2', round(w2, 6) FROM w
      UNION ALL SELECT '(intercept)', round(my - w1 * m1 - w2 * m2, 5) FROM w"""


def coefficient_rows(t, model):
    d = model.coefficients(t.spark)
    digits = F.when(F.col("feature") == "(intercept)", F.round("weight", 5)).otherwise(F.round("weight", 6))
    return d.select("feature", digits.alias("weight"))


# ---------------------------------------------------------------- E5, M linear models


@query(
    "e5_sufficient_statistics",
    f"""SELECT fold, count(*) AS n, round(avg(x1), 6) AS m1, round(avg(x2), 6) AS m2, round(avg(y), 5) AS my, round(var_pop(x1), 5) AS v11, round(covar_pop(x1, x2), 5) AS v12,
        round(covar_pop(x1, y), 3) AS v1y, round(covar_pop(x2, y), 3) AS v2y, round(var_pop(y) / 1000, 3) AS vyy FROM {REG} GROUP BY fold""",
)
def _(t):
    rows = []
    for k, m in moments(regression_rows(t), ["x1", "x2"], "y", "fold").items():
        v = m.scatter / m.n
        rows.append((int(k), int(m.n), *map(float, m.mean), *map(float, (v[0, 0], v[0, 1], v[0, 2], v[1, 2], v[2, 2] / 1000))))
    d = t.spark.createDataFrame(rows, "fold int, n long, m1 double, m2 double, my double, v11 double, v12 double, v1y double, v2y double, vyy double")
    digits = {"m1": 6, "m2": 6, "my": 5, "v11": 5, "v12": 5, "v1y": 3, "v2y": 3, "vyy": 3}
    return d.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "e5_wide_statistics",
    """SELECT label, i AS cell, count(*) AS n, round(avg(embedding[i]::DOUBLE), 6) AS mean,
        round(var_pop(embedding[i]::DOUBLE), 6) AS variance, round(covar_pop(embedding[i]::DOUBLE, embedding[64]::DOUBLE), 6) AS with_last
      FROM embeddings, range(1, 64) AS cells(i) GROUP BY label, i""",
)
def _(t):
    """63 embedding cells against the last one, per label."""
    cells = [f"e{i}" for i in range(1, 65)]
    df = t.embeddings.select("label", *[F.get("embedding", F.lit(i)).alias(c) for i, c in enumerate(cells)])
    rows = []
    for label, m in moments(df, cells[:-1], cells[-1], "label").items():
        v = m.scatter / m.n
        rows += [(label, i + 1, int(m.n), float(m.mean[i]), float(v[i, i]), float(v[i, -1])) for i in range(63)]
    kind = t.embeddings.schema["label"].dataType.simpleString()
    d = t.spark.createDataFrame(rows, f"label {kind}, cell long, n long, mean double, variance double, with_last double")
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "variance", "with_last")})


@query(
    "m1_linear_regression",
    coefficient_sql("(s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)", "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12)", f"SELECT {S_SQL} FROM {REG}"),
)
def _(t):
    return coefficient_rows(t, linear.ols(linear.fit_moments(regression_rows(t), ["x1", "x2"], "y")))


@query(
    "m2_batch_gradient_descent",
    f"""SELECT 'z' AS feature, round(covar_pop(x1, y) / stddev_pop(x1), 3) AS weight FROM {REG} UNION ALL SELECT '(intercept)', round(avg(y), 3) FROM {REG}""",
)
def _(t):
    df = regression_rows(t).select("x1", "y")
    z = StandardScaler.fit(df, ["x1"]).transform(df).withColumnRenamed("x1", "z")
    model = linear.gradient_descent(linear.fit_moments(z, ["z"], "y"), 0.5, 200, 0.0)
    return model.coefficients(t.spark).withColumn("weight", F.round("weight", 3))


def scaled_rows(t):
    df = regression_rows(t)
    s = StandardScaler.fit(df, ["x1", "x2", "y"])
    return s.transform(df)


def history_rows(t, models):
    rows = [(name, i, float(c)) for name, m in models.items() for i, c in enumerate(m.history)]
    return t.spark.createDataFrame(rows, "model string, epoch int, cost double")


@query("m3_stochastic_gradient_descent")
def _(t):
    model = sgd.averaged_sgd(scaled_rows(t), ["x1", "x2"], "y", LINE_KEY, 0.05, 5, 42)
    return model.coefficients(t.spark)


@query("m4_mini_batch_gradient_descent")
def _(t):
    batches = sgd.batch_moments(scaled_rows(t), ["x1", "x2"], "y", LINE_KEY, 64, 42)
    return history_rows(t, {"mini_batch": sgd.mini_batch(batches, 0.05, 10, 42)})


@query("m5_schedules")
def _(t):
    batches = sgd.batch_moments(scaled_rows(t), ["x1", "x2"], "y", LINE_KEY, 32, 42)
    models = {name: sgd.mini_batch(batches, 0.05, 10, 42, name, 0.05) for name in sgd.SCHEDULES}
    costs = history_rows(t, models)
    rates = [(name, e, float(sgd.schedule(name, 0.05, 0.05, e, 10))) for name in sgd.SCHEDULES for e in range(10)]
    return costs.join(t.spark.createDataFrame(rates, "model string, epoch int, rate double"), ["model", "epoch"])


DET = "((s11 + 1000) * (s22 + 1000) - s12 * s12)"


@query(
    "m6_ridge_regression",
    coefficient_sql(f"((s22 + 1000) * s1y - s12 * s2y) / {DET}", f"((s11 + 1000) * s2y - s12 * s1y) / {DET}", f"SELECT {S_SQL} FROM {REG}"),
)
def _(t):
    return coefficient_rows(t, linear.ridge(linear.fit_moments(regression_rows(t), ["x1", "x2"], "y"), 1000.0))


ALPHAS = [0.0, 10.0, 1000.0, 50000.0, 200000.0]
ALPHA_SQL = "(SELECT unnest([0.0, 10.0, 1000.0, 50000.0, 200000.0]::DOUBLE[]) AS alpha)"


@query(
    "m7_lasso_regression",
    f"""SELECT alpha, round(sign(s1y) * greatest(abs(s1y) - alpha * n, 0) / s11, 6) AS weight FROM (SELECT {S_SQL} FROM {REG}), {ALPHA_SQL}""",
)
def _(t):
    m = linear.fit_moments(regression_rows(t), ["x1"], "y")
    rows = [(a, float(linear.lasso(m, a).weights[0])) for a in ALPHAS]
    return t.spark.createDataFrame(rows, "alpha double, weight double").withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    "m8_elastic_net",
    f"""WITH s AS (SELECT {S_SQL} FROM {REG}), d AS (SELECT sum(abs(x1 - m1)) AS dev FROM {REG}, s)
       SELECT alpha, 'textbook' AS penalty, round(sign(s1y) * greatest(abs(s1y) - alpha * 0.5 * n, 0) / (s11 + alpha * 0.5 * n), 6) AS weight FROM s, {ALPHA_SQL}
       UNION ALL SELECT alpha, 'legacy', round(sign(s1y) * greatest(abs(s1y) - alpha * 0.5 * dev, 0) / (s11 + alpha * 0.5), 6) FROM s, d, {ALPHA_SQL}""",
)
def _(t):
    df = regression_rows(t)
    m = linear.fit_moments(df, ["x1"], "y")
    dev = linear.absolute_deviation(df, m)
    rows = []
    for a in ALPHAS:
        rows.append((a, "textbook", float(linear.elastic_net(m, a, 0.5).weights[0])))
        rows.append((a, "legacy", float(linear.elastic_net(m, a, 0.5, "legacy", dev).weights[0])))
    d = t.spark.createDataFrame(rows, "alpha double, penalty string, weight double")
    return d.withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    "m9_regularization_path",
    f"""WITH s AS (SELECT {S_SQL} FROM {REG}), a AS (SELECT i, pow(10, -2 + 8.0::DOUBLE * i / 49) AS alpha FROM (SELECT unnest(range(50)) AS i))
       SELECT i AS step, 'x1' AS feature, round(((s22 + alpha) * s1y - s12 * s2y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12), 5) AS weight FROM s, a
       UNION ALL SELECT i, 'x2', round(((s11 + alpha) * s2y - s12 * s1y) / ((s11 + alpha) * (s22 + alpha) - s12 * s12), 5) FROM s, a""",
)
def _(t):
    m = linear.fit_moments(regression_rows(t), ["x1", "x2"], "y")
    alphas = [10 ** (-2 + 8.0 * i / 49) for i in range(50)]
    path = linear.regularization_path(m, "ridge", alphas)
    rows = [(i // 2, f, w) for i, (_, f, w) in enumerate(path)]
    return t.spark.createDataFrame(rows, "step int, feature string, weight double").withColumn("weight", F.round("weight", 5))


@query(
    "m10_predict_and_score",
    f"""WITH w AS (SELECT regr_slope(y, x1) AS a, regr_intercept(y, x1) AS b FROM {REG})
       SELECT l_returnflag, count(*) AS n, round(avg(a * x1 + b), 4) AS mean_prediction, round(1 - sum((y - a * x1 - b) * (y - a * x1 - b)) / (var_pop(y) * count(*)), 8) AS r2
       FROM {REG}, w GROUP BY 1""",
)
def _(t):
    df = regression_rows(t)
    model = linear.ols(linear.fit_moments(df, ["x1"], "y"))
    scored = df.withColumn("prediction", model.predict())
    return scored.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg("prediction"), 4).alias("mean_prediction"), F.round(E.r2("y", "prediction"), 8).alias("r2")
    )


@query(
    "m11_polynomial_regression",
    f"""WITH s AS (SELECT {S_SQL} FROM (SELECT x1, x1 * x1 AS x2, y FROM {REG})),
        w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS w2 FROM s)
       SELECT round(w1, 4) AS w1, round(w2, 5) AS w2, round(my - w1 * m1 - w2 * m2, 3) AS intercept FROM w""",
)
def _(t):
    df = regression_rows(t)
    cubic = df.select(*polynomial(["x1"], 2), "y")
    m = linear.ols(linear.fit_moments(cubic, ["x1", "x1*x1"], "y"))
    row = (round(float(m.weights[0]), 4), round(float(m.weights[1]), 5), round(m.intercept, 3))
    return t.spark.createDataFrame([row], "w1 double, w2 double, intercept double")


@query("m12_early_stopping")
def _(t):
    z = scaled_rows(t).withColumn("part", F.when(F.col("fold") == 0, -1).otherwise(F.floor(F.col("u") * 32)).cast("long"))
    cells = moments(z, ["x1", "x2"], "y", "part")
    valid = cells.pop(-1)
    model = sgd.mini_batch(cells, 0.05, 50, 42, validation=valid, patience=5)
    return history_rows(t, {"early_stopping": model})


@query("m13_learning_rate_finder")
def _(t):
    m = linear.fit_moments(scaled_rows(t), ["x1", "x2"], "y")
    found = linear.learning_rate_finder(m, list(np.geomspace(1e-4, 10, 30)))
    return t.spark.createDataFrame([(r["rate"], r["cost"], r["stopped"]) for r in found], "rate double, cost double, stopped boolean")


@query(
    "m20_baselines",
    f"""WITH b AS (SELECT avg(y) AS mean, median(y) AS median FROM {REG})
       SELECT 'mean' AS baseline, round(sqrt(avg((y - mean) * (y - mean))), 4) AS rmse FROM {REG}, b
       UNION ALL SELECT 'median', round(sqrt(avg((y - median) * (y - median))), 4) FROM {REG}, b
       UNION ALL SELECT 'constant', round(sqrt(avg((y - 17500) * (y - 17500))), 4) FROM {REG}
       UNION ALL SELECT 'majority', (SELECT round(max(n)::DOUBLE / sum(n), 9) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""",
)
def _(t):
    df = regression_rows(t)
    med = quantile_row(df, {"median": ("y", 0.5)})
    b = df.agg(F.avg("y").alias("mean")).join(F.broadcast(med))
    r = df.join(F.broadcast(b)).agg(
        F.round(E.rmse("y", "mean"), 4).alias("mean"),
        F.round(E.rmse("y", "median"), 4).alias("median"),
        F.round(E.rmse("y", F.lit(17500.0)), 4).alias("constant"),
    )
    counts = t.labels.groupBy("quality").agg(F.count("*").alias("n"))
    major = counts.agg(F.lit("majority").alias("baseline"), F.round(F.max("n") / F.sum("n"), 9).alias("rmse"))
    return r.unpivot([], ["mean", "median", "constant"], "baseline", "rmse").unionByName(major)


@query(
    "l8_leave_one_out",
    """WITH s AS (SELECT count(*)::DOUBLE AS n, avg(c_nationkey) AS mx, var_pop(c_nationkey) * count(*) AS sxx, regr_slope(c_acctbal, c_nationkey) AS w,
          regr_intercept(c_acctbal, c_nationkey) AS b, sum(c_acctbal) AS sy FROM customer),
        r AS (SELECT c_custkey, c_acctbal AS y, (c_acctbal - w * c_nationkey - b) / (1 - 1 / n - (c_nationkey - mx) * (c_nationkey - mx) / sxx) AS e, (sy - c_acctbal) / (n - 1) AS m FROM customer, s)
       SELECT c_custkey, round(y - e, 4) AS prediction, round(m, 4) AS train_mean FROM r""",
)
def _(t):
    d = linear.leave_one_out(t.customer, ["c_nationkey"], "c_acctbal", "c_custkey")
    return d.select("c_custkey", F.round("prediction", 4).alias("prediction"), F.round("train_mean", 4).alias("train_mean"))


@query("m26_feature_selection")
def _(t):
    m = linear.fit_moments(scaled_rows(t), ["x1", "x2"], "y")
    coefs = linear.lasso(m, 0.05).coefficients(t.spark)
    return coefs.where((F.col("feature") != "(intercept)") & (F.abs("weight") > 1e-10))


@query(
    "g2_top_weights",
    f"""WITH s AS (SELECT count(*)::DOUBLE AS n, corr(x1, x2) AS r, corr(x1, y) AS a, corr(x2, y) AS b FROM {REG}),
        w AS (SELECT ((n + 1) * n * a - n * r * n * b) / ((n + 1) * (n + 1) - n * r * n * r) AS w1, ((n + 1) * n * b - n * r * n * a) / ((n + 1) * (n + 1) - n * r * n * r) AS w2 FROM s),
        l AS (SELECT 'x1' AS feature, w1 AS weight FROM w UNION ALL SELECT 'x2', w2 FROM w)
       SELECT feature, round(weight, 8) AS weight, round(abs(weight), 8) AS size, CASE WHEN weight >= 0 THEN '+' ELSE '-' END AS direction FROM l""",
)
def _(t):
    coefs = linear.ridge(linear.fit_moments(scaled_rows(t), ["x1", "x2"], "y"), 1.0).coefficients(t.spark)
    size = F.abs("weight")
    return (
        coefs.where("feature <> '(intercept)'")
        .select("feature", F.round("weight", 8).alias("weight"), F.round(size, 8).alias("size"), F.when(F.col("weight") >= 0, "+").otherwise("-").alias("direction"))
        .orderBy(F.desc("size"), "feature")
        .limit(10)
    )


# ---------------------------------------------------------------- N regression metrics

METRIC_SQL = """round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS {0}r2, round(sqrt(avg((y - p) * (y - p))), 5) AS {0}rmse,
  round(avg(abs(y - p)), 5) AS {0}mae, round(100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS {0}mape,
  round(sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2))), 8) AS {0}rmsle"""
DIGITS = {"r2": 8, "rmse": 5, "mae": 5, "mape": 6, "rmsle": 8}


def rounded(df, prefix=""):
    return df.withColumns({f"{prefix}{c}": F.round(f"{prefix}{c}", n) for c, n in DIGITS.items()})


def positive(df):
    return df.withColumn("y", F.abs("y"))


POS = f"(SELECT * REPLACE (abs(y) AS y) FROM {REG})"


@query("n1_r2", f"SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 8) AS r2 FROM {REG} GROUP BY 1")
def _(t):
    return regression_rows(t).groupBy("l_returnflag").agg(F.round(E.r2("y", "p"), 8).alias("r2"))


@query("n2_mse_rmse_mae", f"SELECT round(avg((y - p) * (y - p)) / 1000, 4) AS mse_k, round(sqrt(avg((y - p) * (y - p))), 5) AS rmse, round(avg(abs(y - p)), 5) AS mae FROM {REG}")
def _(t):
    return regression_rows(t).agg(
        F.round(E.mse("y", "p") / 1000, 4).alias("mse_k"), F.round(E.rmse("y", "p"), 5).alias("rmse"), F.round(E.mae("y", "p"), 5).alias("mae")
    )


@query(
    "n3_mape",
    """SELECT round(100 * avg(CASE WHEN l_discount <> 0 THEN abs((l_discount - l_tax) / l_discount) END), 6) AS skip_zeros,
       round(100 * avg(CASE WHEN l_discount <> 0 THEN abs((l_discount - l_tax) / l_discount) ELSE 0 END), 6) AS count_zeros FROM lineitem""",
)
def _(t):
    return t.lineitem.agg(
        F.round(E.mape("l_discount", "l_tax"), 6).alias("skip_zeros"), F.round(E.mape("l_discount", "l_tax", "count"), 6).alias("count_zeros")
    )


@query("n4_rmsle", f"SELECT round(sqrt(avg(pow(ln(1 + greatest(p - 20000, 0)) - ln(1 + y), 2))), 8) AS rmsle FROM {POS}")
def _(t):
    df = positive(regression_rows(t)).withColumn("p", F.col("p") - 20000)
    return df.agg(F.round(E.rmsle("y", "p"), 8).alias("rmsle"))


@query("n5_regression_report", f"SELECT l_returnflag, {METRIC_SQL.format('test_')} FROM {POS} GROUP BY 1")
def _(t):
    return rounded(E.regression_report(positive(regression_rows(t)), "y", "p", "test_", ["l_returnflag"]), "test_")


@query(
    "n14_residual_statistics",
    f"""WITH r AS (SELECT y - p AS e FROM {REG}), b AS (SELECT min(e) AS lo, max(e) AS hi, avg(e) AS m, stddev_pop(e) AS s FROM r)
       SELECT least(CAST(floor((e - lo) / (hi - lo) * 30) AS INT) + 1, 30) AS bin, count(*) AS n, round(any_value(m), 5) AS mean, round(any_value(s), 5) AS std,
        round(any_value(lo), 5) AS min, round(any_value(hi), 5) AS max FROM r, b GROUP BY 1""",
)
def _(t):
    r = regression_rows(t).select((F.col("y") - F.col("p")).alias("e"))
    stats = r.agg(
        F.round(F.avg("e"), 5).alias("mean"), F.round(F.stddev_pop("e"), 5).alias("std"), F.round(F.min("e"), 5).alias("min"), F.round(F.max("e"), 5).alias("max")
    )
    return histogram(r, "e", 30).select("bin", "n").join(F.broadcast(stats))


@query(
    "n15_rmse_interval",
    f"""WITH s AS (SELECT avg((y - p) * (y - p)) AS m, stddev((y - p) * (y - p)) AS s, count(*)::DOUBLE AS n FROM {REG}), z AS (SELECT 1.959963984540054::DOUBLE AS z),
        t AS (SELECT *, z + (z * z * z + z) / 4 / (n - 1) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / ((n - 1) * (n - 1)) AS t FROM s, z)
       SELECT round(sqrt(m - t * s / sqrt(n)), 4) AS low, round(sqrt(m + t * s / sqrt(n)), 4) AS high FROM t""",
)
def _(t):
    sq = regression_rows(t).select(((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("e2"))
    return E.t_interval(sq, "e2").select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


CV_SQL = f"""SELECT fold, count(*) AS n, 1 - sum((y - w * x1 - b) * (y - w * x1 - b)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - w * x1 - b) * (y - w * x1 - b))) AS rmse,
  avg(abs(y - w * x1 - b)) AS mae FROM {REG} r JOIN (SELECT k, regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k) m ON r.fold = m.k GROUP BY fold"""


def cv_rows(t, kind="ols", params=None, scoring="r2", scale=False, features=("x1",)):
    folds = moments(regression_rows(t), list(features), "y", "fold")
    rows = search.cross_val_score(folds, kind, params or {}, scoring, scale)
    return t.spark.createDataFrame([(r["fold"], r["n"], r["score"]) for r in rows], f"fold int, n long, {scoring} double")


@query("n16_score_interval", f"SELECT round(avg(r2) - 1.96 * stddev_pop(r2) / sqrt(count(*)), 8) AS low, round(avg(r2) + 1.96 * stddev_pop(r2) / sqrt(count(*)), 8) AS high FROM ({CV_SQL})")
def _(t):
    half = 1.96 * F.stddev_pop("r2") / F.sqrt(F.count("*"))
    return cv_rows(t).agg(F.round(F.avg("r2") - half, 8).alias("low"), F.round(F.avg("r2") + half, 8).alias("high"))


@query("n17_improvement", f"SELECT round(1 - sqrt(avg((y - p) * (y - p))) / stddev_pop(y), 8) AS improvement FROM {REG}")
def _(t):
    return regression_rows(t).agg(F.round(1 - E.rmse("y", "p") / F.stddev_pop("y"), 8).alias("improvement"))


@query(
    "n18_model_comparison",
    f"""WITH w AS (SELECT regr_slope(y, x1) AS a, regr_intercept(y, x1) AS b, avg(y) AS m FROM {REG}),
        r AS (SELECT 'mean' AS model, sqrt(avg((y - m) * (y - m))) AS rmse FROM {REG}, w UNION ALL SELECT 'rule', sqrt(avg((y - p) * (y - p))) FROM {REG}
          UNION ALL SELECT 'linear', sqrt(avg((y - a * x1 - b) * (y - a * x1 - b))) FROM {REG}, w)
       SELECT model, round(rmse, 4) AS rmse, row_number() OVER (ORDER BY rmse) AS rank FROM r""",
)
def _(t):
    df = regression_rows(t)
    m = linear.fit_moments(df, ["x1"], "y")
    model = linear.ols(m)
    wide = df.agg(
        E.rmse("y", F.lit(float(m.mean[-1]))).alias("mean"), E.rmse("y", "p").alias("rule"), E.rmse("y", model.predict()).alias("linear")
    )
    table = wide.unpivot([], ["mean", "rule", "linear"], "model", "rmse")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse"))  # one row per model
    return table.select("model", F.round("rmse", 4).alias("rmse"), rank.alias("rank"))


# ---------------------------------------------------------------- N classification metrics

PRED_SQL = "(SELECT vec_id, label, embedding, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings)"


def class_rows(t):
    head = F.slice("embedding", 1, 10)
    return t.embeddings.select("vec_id", "label", "embedding", (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("pred"))


@query(
    "n6_confusion_matrix",
    f"""SELECT label, pred, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY label), 9) AS row_share, round(n::DOUBLE / sum(n) OVER (PARTITION BY pred), 9) AS col_share,
        round(CASE WHEN label <> pred THEN n ELSE 0 END::DOUBLE / sum(CASE WHEN label <> pred THEN n ELSE 0 END) OVER (), 9) AS error_share
       FROM (SELECT label, pred::INT AS pred, count(*) AS n FROM {PRED_SQL} GROUP BY 1, 2)""",
)
def _(t):
    d = E.confusion(class_rows(t), "label", "pred")
    return d.withColumns({c: F.round(c, 9) for c in ("row_share", "col_share", "error_share")})


RATES_SQL = """SELECT {keys}, tp, fp, fn, tn, round(precision, 8) AS precision, round(recall, 8) AS recall, round(2 * precision * recall / (precision + recall + 1e-10), 8) AS f1,
  round((tp + tn) / (tp + fp + fn + tn + 1e-10), 8) AS accuracy, round(tn / (tn + fp + 1e-10), 8) AS specificity
  FROM (SELECT *, tp / (tp + fp + 1e-10) AS precision, tp / (tp + fn + 1e-10) AS recall FROM ({inner}))"""
RATES = ("precision", "recall", "f1", "accuracy", "specificity")


@query(
    "n7_binary_report",
    RATES_SQL.format(
        keys="hour",
        inner=f"""SELECT hour(ts) AS hour, count(*) FILTER (label = 1 AND score >= 2) AS tp, count(*) FILTER (label = 0 AND score >= 2) AS fp,
          count(*) FILTER (label = 1 AND NOT score >= 2) AS fn, count(*) FILTER (label = 0 AND NOT score >= 2) AS tn FROM {SCORED_SQL} GROUP BY 1""",
    ),
)
def _(t):
    s = scored_events(t).select(F.hour("ts").alias("hour"), "label", (F.col("score") >= 2).cast("int").alias("pred"))
    return E.binary_report(s, "label", "pred", ["hour"]).withColumns({c: F.round(c, 8) for c in RATES})


CURVE_SQL = f"""c AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM {SCORED_SQL} GROUP BY 1),
  k AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c)"""


@query("n8_auc_roc", f"WITH {CURVE_SQL} SELECT round(sum(neg * (tp - pos / 2))::DOUBLE / (max(p)::DOUBLE * max(n)), 9) AS auc_roc FROM k")
def _(t):
    return E.auc_roc(scored_events(t), "score", "label").withColumn("auc_roc", F.round("auc_roc", 9))


@query(
    "n9_auc_pr",
    f"""WITH {CURVE_SQL} SELECT round(sum(pos::DOUBLE / p * (tp::DOUBLE / (tp + fp) + CASE WHEN tp + fp - pos - neg > 0 THEN (tp - pos)::DOUBLE / (tp + fp - pos - neg) ELSE 1 END) / 2), 9) AS auc_pr FROM k""",
)
def _(t):
    return E.auc_pr(scored_events(t), "score", "label").withColumn("auc_pr", F.round("auc_pr", 9))


@query(
    "n10_curves",
    f"""WITH {CURVE_SQL} SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / p, 9) AS recall, round(fp::DOUBLE / n, 9) AS fpr, round(tp::DOUBLE / (tp + fp), 9) AS precision FROM k""",
)
def _(t):
    d = E.roc_pr_curve(scored_events(t), "score", "label")
    return d.withColumns({c: F.round(c, 9) for c in ("recall", "fpr", "precision")})


@query(
    "f1_mid_ranks",
    f"SELECT score, count(*) AS n_ties, any_value(r) AS rank FROM (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2::DOUBLE AS r FROM {SCORED_SQL}) GROUP BY 1",
)
def _(t):
    return E.mid_ranks(scored_events(t), "score", "label")


@query("f2_cumulative_counts", f"WITH {CURVE_SQL} SELECT score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM k")
def _(t):
    return E.score_curve(scored_events(t), "score", "label").select("score", "pos", "neg", "tp", "fp")


SWEEP_SQL = f"""SELECT step, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp,
  count(*) FILTER (label = 1 AND NOT score >= threshold) AS fn, count(*) FILTER (label = 0 AND NOT score >= threshold) AS tn
  FROM {SCORED_SQL}, (SELECT i AS step, hi - (hi - lo) * i / 29 AS threshold FROM (SELECT min(score) AS lo, max(score) AS hi FROM {SCORED_SQL}), (SELECT unnest(range(30)) AS i)) GROUP BY 1, 2"""


@query("n11_threshold_sweep", RATES_SQL.format(keys="step, round(threshold, 9) AS threshold", inner=SWEEP_SQL))
def _(t):
    d = E.threshold_sweep(scored_events(t), "score", "label", 30)
    return d.withColumns({c: F.round(c, 8) for c in RATES}).withColumn("threshold", F.round("threshold", 9))


@query(
    "n12_operating_points",
    f"""WITH {CURVE_SQL}, r AS (SELECT score, tp::BIGINT AS tp, fp::BIGINT AS fp, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / p AS recall FROM k)
       (SELECT 'recall' AS target, score, tp, fp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM r WHERE recall >= 0.8 ORDER BY score DESC LIMIT 1)
       UNION ALL (SELECT 'precision', score, tp, fp, round(precision, 9), round(recall, 9) FROM r WHERE precision >= 0.2 ORDER BY score DESC LIMIT 1)""",
)
def _(t):
    s = scored_events(t)
    a = E.operating_point(s, "score", "label", "recall", 0.8).withColumn("target", F.lit("recall"))
    b = E.operating_point(s, "score", "label", "precision", 0.2).withColumn("target", F.lit("precision"))
    return a.unionByName(b).withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query("n13_net_value", f"SELECT step, 122.0::DOUBLE * tp - 122.0::DOUBLE * fn - 2.0::DOUBLE * fp AS value FROM ({SWEEP_SQL})")
def _(t):
    d = E.threshold_sweep(scored_events(t), "score", "label", 30)
    return d.select("step", E.net_value("tp", "fp", "fn").alias("value"))


@query("n19_agreement", "SELECT label, round(avg(((embedding[1] >= 0) = (embedding[2] >= 0))::INT), 9) AS agreement FROM embeddings GROUP BY 1")
def _(t):
    a, b = F.get("embedding", F.lit(0)) >= 0, F.get("embedding", F.lit(1)) >= 0
    return t.embeddings.groupBy("label").agg(F.round(F.avg((a == b).cast("int")), 9).alias("agreement"))


# ---------------------------------------------------------------- O cross-validation and tuning


@query("o1_cross_val_score", f"SELECT fold, n, round(r2, 8) AS r2, round(mae, 4) AS mae FROM ({CV_SQL})")
def _(t):
    df = regression_rows(t)
    folds = moments(df, ["x1"], "y", "fold")
    r2 = search.cross_val_score(folds, "ols", {}, "r2")
    mae = search.cross_val_score(folds, "ols", {}, "mae", rows=df)
    rows = [(a["fold"], a["n"], round(a["score"], 8), round(b["score"], 4)) for a, b in zip(r2, mae, strict=True)]
    return t.spark.createDataFrame(rows, "fold int, n long, r2 double, mae double")


@query(
    "o2_cross_val_predict",
    f"""SELECT {KEYS}, fold, round(w * x1 + b, 4) AS prediction FROM {REG} r JOIN
        (SELECT k, regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k) m ON r.fold = m.k""",
)
def _(t):
    df = regression_rows(t)
    models = search.fold_models(moments(df, ["x1"], "y", "fold"), "ols", {})
    return search.cross_val_predict(df, models, "fold").select(*LINE_KEY, "fold", F.round("prediction", 4).alias("prediction"))


SCALED_SQL = f"""(SELECT k, avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, covar_pop(x1, y) * count(*) / stddev_pop(x1) / (count(*) + {{alpha}}) AS wz
  FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k)"""


@query(
    "o3_scaled_cross_validation",
    f"""SELECT fold, count(*) AS n, {METRIC_SQL.format('')} FROM (SELECT fold, abs(y) AS y, my + wz * (x1 - mx) / sx AS p FROM (SELECT * EXCLUDE (p) FROM {REG}) r
         JOIN {SCALED_SQL.format(alpha='500.0')} m ON r.fold = m.k) GROUP BY fold""",
)
def _(t):
    """Ridge on features scaled inside each training fold; held-out rows scored once."""
    df = regression_rows(t)
    models = search.fold_models(moments(df, ["x1"], "y", "fold"), "ridge", {"alpha": 500.0}, scale=True)
    scored = positive(search.cross_val_predict(df.drop("p"), models, "fold", "p"))
    counts = scored.groupBy("fold").agg(F.count("*").alias("n"), *[m("y", "p").alias(k) for k, m in E.METRICS.items()])
    return rounded(counts)


GRID_SQL = f"""WITH tr AS (SELECT k, avg(x1) AS mx, avg(y) AS my, var_pop(x1) * count(*) AS sxx, covar_pop(x1, y) * count(*) AS sxy FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k),
  te AS (SELECT fold AS k, count(*)::DOUBLE AS n, avg(x1) AS tx, avg(y) AS ty, var_pop(x1) * count(*) AS txx, covar_pop(x1, y) * count(*) AS txy, var_pop(y) * count(*) AS tyy FROM {REG} GROUP BY 1),
  g AS (SELECT unnest([0.1, 10.0, 1000.0, 100000.0, 1000000.0]::DOUBLE[]) AS alpha),
  s AS (SELECT alpha, k, 1 - (tyy - 2 * w * txy + w * w * txx + n * pow((ty - w * tx) - (my - w * mx), 2)) / tyy AS r2 FROM (SELECT *, sxy / (sxx + alpha) AS w FROM tr JOIN te USING (k), g))"""


@query(
    "o4_grid_search",
    GRID_SQL
    + """SELECT alpha, round(avg(r2), 8) AS mean_score, round(stddev_pop(r2), 8) AS std_score, row_number() OVER (ORDER BY avg(r2) DESC, alpha) AS rank FROM s GROUP BY alpha""",
)
def _(t):
    return grid_rows(t).select("alpha", F.round("mean_score", 8).alias("mean_score"), F.round("std_score", 8).alias("std_score"), "rank")


def grid_rows(t):
    folds = moments(regression_rows(t), ["x1"], "y", "fold")
    rows = search.search(folds, "ridge", search.parameter_grid({"alpha": [0.1, 10.0, 1000.0, 100000.0, 1000000.0]}))
    return t.spark.createDataFrame(
        [(r["params"]["alpha"], r["mean_score"], r["std_score"], r["rank"]) for r in rows],
        "alpha double, mean_score double, std_score double, rank int",
    )


@query(
    "o4_grid_search_mae",
    f"""WITH tr AS (SELECT k, avg(x1) AS mx, avg(y) AS my, var_pop(x1) * count(*) AS sxx, covar_pop(x1, y) * count(*) AS sxy FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k),
      w AS (SELECT alpha, k, mx, my, sxy / (sxx + alpha) AS w FROM tr, (SELECT unnest([0.1, 10.0, 1000.0, 100000.0, 1000000.0]::DOUBLE[]) AS alpha)),
      s AS (SELECT alpha, k, avg(abs(y - my - w * (x1 - mx))) FILTER (fold = k) AS test, avg(abs(y - my - w * (x1 - mx))) FILTER (fold <> k) AS train FROM {REG}, w GROUP BY ALL)
    SELECT alpha, round(avg(test), 4) AS mean_score, round(avg(train), 4) AS mean_train_score, row_number() OVER (ORDER BY avg(test), alpha) AS rank FROM s GROUP BY alpha""",
)
def _(t):
    df = regression_rows(t)
    grid = search.parameter_grid({"alpha": [0.1, 10.0, 1000.0, 100000.0, 1000000.0]})
    rows = search.search(moments(df, ["x1"], "y", "fold"), "ridge", grid, "mae", data=df)
    return t.spark.createDataFrame(
        [(r["params"]["alpha"], round(r["mean_score"], 4), round(r["mean_train_score"], 4), r["rank"]) for r in rows],
        "alpha double, mean_score double, mean_train_score double, rank int",
    )


@query("f6_grid_ranks", GRID_SQL + "SELECT alpha, row_number() OVER (ORDER BY avg(r2) DESC, alpha) AS rank FROM s GROUP BY alpha")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("mean_score"), "alpha")  # one row per candidate
    return grid_rows(t).select("alpha", F.row_number().over(w).alias("rank"))


@query("o5_randomized_search")
def _(t):
    folds = moments(regression_rows(t), ["x1", "x2"], "y", "fold")
    draws = search.sample_parameters({"alpha": (1e-2, 1e5, "log"), "l1_ratio": (0.0, 1.0)}, 25, 42)
    rows = search.search(folds, "elastic_net", draws, "rmse")
    return t.spark.createDataFrame(
        [(r["params"]["alpha"], r["params"]["l1_ratio"], r["mean_score"], r["rank"]) for r in rows],
        "alpha double, l1_ratio double, rmse double, rank int",
    )


@query(
    "o6_learning_curve",
    f"""WITH g AS (SELECT * FROM (SELECT unnest(range(5)) AS k), (SELECT unnest([0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS s)),
        m AS (SELECT k, s, count(*) AS n_train, regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b, sqrt(var_pop(y) - regr_slope(y, x1) * covar_pop(x1, y)) AS train_rmse
          FROM {REG} f JOIN g ON f.fold <> k AND f.u < s GROUP BY k, s)
       SELECT s AS share, k AS fold, any_value(n_train) AS n_train, round(any_value(train_rmse), 4) AS train_rmse, round(sqrt(avg((y - w * x1 - b) * (y - w * x1 - b))), 4) AS test_rmse
       FROM {REG} r JOIN m ON r.fold = m.k GROUP BY 1, 2""",
)
def _(t):
    rows = search.learning_curve(regression_rows(t), ["x1"], "y", "fold", "u", [0.2, 0.4, 0.6, 0.8, 1.0], "ols", {})
    d = t.spark.createDataFrame(
        [(r["share"], r["fold"], r["n_train"], r["train_rmse"], r["test_rmse"]) for r in rows],
        "share double, fold int, n_train long, train_rmse double, test_rmse double",
    )
    return d.withColumns({c: F.round(c, 4) for c in ("train_rmse", "test_rmse")})


@query("o7_classifier_search")
def _(t):
    """C grid by folds for a linear classifier, ranked by average precision."""
    from granary.models.spark_ml import linear_svm, with_vector

    df = with_vector(class_rows(t).withColumn("y", (F.col("label") >= 5).cast("int")), "embedding")
    df = materialize(df.withColumn("fold", hash_fold(["vec_id"], 3, 42)).select("vec_id", "y", "fold", "features"), "digits")
    n = df.count()
    out = None
    for c in (0.01, 1.0):
        for k in range(3):
            model = linear_svm(c, n, labelCol="y", maxIter=20).fit(df.where(F.col("fold") != k))
            scored = with_score(model.transform(df.where(F.col("fold") == k)))
            row = E.auc_pr(scored, "score", "y").select(F.lit(c).alias("c"), F.lit(k).alias("fold"), "auc_pr")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("c").agg(F.avg("auc_pr").alias("mean_auc_pr"), F.stddev_pop("auc_pr").alias("std_auc_pr"))


def with_score(df):
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("score", F.get(vector_to_array("rawPrediction"), F.lit(1)))


@query(
    "o8_grid_heat_map",
    f"""WITH tr AS (SELECT k, count(*)::DOUBLE AS n, avg(x1) AS mx, avg(y) AS my, var_pop(x1) * count(*) AS sxx, covar_pop(x1, y) * count(*) AS sxy FROM {REG} f JOIN (SELECT unnest(range(5)) AS k) ON f.fold <> k GROUP BY k),
        te AS (SELECT fold AS k, count(*)::DOUBLE AS tn, avg(x1) AS tx, avg(y) AS ty, var_pop(x1) * count(*) AS txx, covar_pop(x1, y) * count(*) AS txy, var_pop(y) * count(*) AS tyy FROM {REG} GROUP BY 1),
        g AS (SELECT * FROM (SELECT unnest([0.1, 10.0, 1000.0]::DOUBLE[]) AS alpha), (SELECT unnest([0.2, 0.8]::DOUBLE[]) AS ratio)),
        s AS (SELECT alpha, ratio, avg(1 - (tyy - 2 * w * txy + w * w * txx + tn * pow((ty - w * tx) - (my - w * mx), 2)) / tyy) AS r2 FROM
          (SELECT *, sign(sxy) * greatest(abs(sxy) - alpha * ratio * n, 0) / (sxx + alpha * (1 - ratio) * n) AS w FROM tr JOIN te USING (k), g) GROUP BY 1, 2)
       SELECT alpha, round(max(r2) FILTER (ratio = 0.2), 8) AS "0.2", round(max(r2) FILTER (ratio = 0.8), 8) AS "0.8" FROM s GROUP BY 1""",
)
def _(t):
    folds = moments(regression_rows(t), ["x1"], "y", "fold")
    grid = search.parameter_grid({"alpha": [0.1, 10.0, 1000.0], "l1_ratio": [0.2, 0.8]})
    rows = [(r["params"]["alpha"], str(r["params"]["l1_ratio"]), r["mean_score"]) for r in search.search(folds, "elastic_net", grid)]
    d = t.spark.createDataFrame(rows, "alpha double, l1_ratio string, r2 double")
    return d.groupBy("alpha").pivot("l1_ratio", ["0.2", "0.8"]).agg(F.round(F.max("r2"), 8))


# ---------------------------------------------------------------- M kernels, neighbours, classifiers

LAND = "(SELECT vec_id AS landmark, embedding AS l FROM embeddings ORDER BY vec_id LIMIT 5)"
DOT = "list_sum(list_transform(list_zip(embedding, l), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
DIST = "list_sum(list_transform(list_zip(embedding, l), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))"
KERNELS = {
    "linear": (DOT, {}),
    "poly": (f"pow(0.5 * {DOT} + 1, 3)", {"gamma": 0.5, "coef0": 1.0, "degree": 3}),
    "rbf": (f"exp(-0.5 * {DIST})", {"gamma": 0.5}),
    "sigmoid": (f"tanh(0.5 * {DOT} + 1)", {"gamma": 0.5, "coef0": 1.0}),
}


@query(
    "m16_kernels",
    " UNION ALL ".join(
        f"SELECT vec_id, landmark, '{k}' AS kernel, round({sql}, 7) + 0 AS value FROM embeddings, {LAND}" for k, (sql, _) in KERNELS.items()
    ),
)
def _(t):
    points = kernels.landmarks(t.embeddings, "embedding", "vec_id", 5)
    keys = [r.vec_id for r in t.embeddings.orderBy("vec_id").limit(5).select("vec_id").collect()]
    out = t.embeddings.select(
        "vec_id", *[kernels.kernel_values("embedding", points, k, **p).alias(k) for k, (_, p) in KERNELS.items()]
    )
    long = out.select("vec_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kernel"), F.col(k).alias("v")) for k in KERNELS])))
    names = F.array(*[F.lit(k) for k in keys])
    return long.select("vec_id", "kernel", F.posexplode("v").alias("i", "value")).select(
        "vec_id", "kernel", F.get(names, F.col("i")).alias("landmark"), (F.round("value", 7) + 0).alias("value")
    )


@query("u5_callable_kernel", f"SELECT vec_id, landmark, round(1 / (1 + {DIST}), 7) AS value FROM embeddings, {LAND}")
def _(t):
    points = kernels.landmarks(t.embeddings, "embedding", "vec_id", 5)
    keys = F.array(*[F.lit(r.vec_id) for r in t.embeddings.orderBy("vec_id").limit(5).select("vec_id").collect()])

    def cauchy(a, b):
        d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
        return 1 / (1 + np.maximum(d2, 0.0))

    out = t.embeddings.select("vec_id", F.posexplode(kernels.kernel_values("embedding", points, cauchy)).alias("i", "value"))
    return out.select("vec_id", F.get(keys, F.col("i")).alias("landmark"), F.round("value", 7).alias("value"))


@query(
    "m25_kernel_decision",
    f"""SELECT vec_id, round(d, 6) AS decision, (d >= 0)::INT AS prediction FROM (SELECT vec_id, sum(CASE WHEN landmark_rank % 2 = 1 THEN 1 ELSE -1 END * 0.25 * landmark_rank * exp(-0.5 * {DIST})) + 0.1 AS d
       FROM embeddings, (SELECT row_number() OVER (ORDER BY vec_id) AS landmark_rank, embedding AS l FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 5)) GROUP BY vec_id)""",
)
def _(t):
    support = kernels.landmarks(t.embeddings, "embedding", "vec_id", 5)
    dual = [0.25, -0.5, 0.75, -1.0, 1.25]
    d = kernels.kernel_decision("embedding", support, dual, 0.1, "rbf", gamma=0.5)
    out = t.embeddings.select("vec_id", d.alias("d"))
    return out.select("vec_id", F.round("d", 6).alias("decision"), (F.col("d") >= 0).cast("int").alias("prediction"))


KNN_SQL = """n AS (SELECT q, id, y, sqrt(d2) AS d, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(d2), 9), id) AS r FROM (SELECT a.vec_id AS q, b.vec_id AS id, b.label AS y,
  list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2))) AS d2 FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) QUALIFY r <= 5)"""


@query("d6_nearest_neighbors", f"WITH {KNN_SQL} SELECT q AS vec_id, r AS rank, id AS neighbor, round(round(d, 9), 6) AS distance FROM n")
def _(t):
    e = t.embeddings
    near = neighbors.nearest(e, e, "vec_id", "vec_id", "embedding", 5, exclude_self=True)
    return near.select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))


@query(
    "m18_knn_classifier",
    f"""WITH {KNN_SQL}, u AS (SELECT q, y, count(*) AS w FROM n GROUP BY 1, 2), v AS (SELECT q, y, round(sum(1 / greatest(d, 1e-12)), 9) AS w FROM n GROUP BY 1, 2)
       SELECT vec_id, label, a.y AS uniform, b.y AS weighted FROM embeddings JOIN (SELECT q, y FROM u QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, y) = 1) a ON a.q = vec_id
       JOIN (SELECT q, y FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY w DESC, y) = 1) b ON b.q = vec_id""",
)
def _(t):
    e = t.embeddings
    near = materialize(neighbors.nearest(e, e, "vec_id", "vec_id", "embedding", 5, payload="label", exclude_self=True), "knn")
    u = neighbors.vote(near, "vec_id", "uniform", "uniform")
    w = neighbors.vote(near, "vec_id", "distance", "weighted")
    return e.select("vec_id", "label").join(u, "vec_id").join(w, "vec_id")


def svm_rows(t):
    from granary.models.spark_ml import with_vector

    return with_vector(t.embeddings.withColumn("y", (F.col("label") >= 5).cast("int")), "embedding")


def written(df, rows_per_task=50_000):
    """Training rows written once, in as few partitions as hold them: every step of a fit is a job over them."""
    df = materialize(df, "training")
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def apart(df, key, folds=5):
    """Training rows and held-out rows (one fold)."""
    df = written(df.withColumn("fold", hash_fold([key], folds, 42)))
    return df.where("fold <> 0"), df.where("fold = 0")


@query("m14_linear_svm")
def _(t):
    """Support vectors of a margin classifier: training rows on or inside the margin."""
    from granary.models.spark_ml import linear_svm, margin_count

    df = written(svm_rows(t).select("y", "features"))
    model = linear_svm(1.0, df.count(), labelCol="y").fit(df)
    return margin_count(model.transform(df), "y")


@query("m15_balanced_svm")
def _(t):
    """Balanced classifier of toxic documents from simple text measures, reported on held-out rows."""
    from pyspark.ml.feature import VectorAssembler

    from granary.models.spark_ml import linear_svm

    d = t.documents.join(t.labels, "doc_id").select(
        "doc_id",
        "toxic",
        F.log1p("n_chars").alias("a"),
        F.log1p(F.regexp_count("text", F.lit("[0-9]"))).alias("b"),
        F.log1p(F.regexp_count("text", F.lit(r"\S+"))).alias("c"),
    )
    names = ["a", "b", "c"]
    train, held = apart(d, "doc_id")  # texts are read once; scaling and fitting see three numbers
    scaler = StandardScaler.fit(train, names)
    vector = VectorAssembler(inputCols=names, outputCol="features")
    ready = lambda rows: vector.transform(scaler.transform(rows))
    fit_rows = written(ready(with_class_weights(train, "toxic")).select("toxic", "weight", "features"))
    model = linear_svm(1.0, fit_rows.count(), "weight", labelCol="toxic", maxIter=50).fit(fit_rows)
    return E.binary_report(model.transform(ready(held)), "toxic", "prediction")


@query("m17_random_kernel_features")
def _(t):
    """Random kernel features, made once, and a linear classifier on them, reported on held-out rows."""
    from granary.models.spark_ml import linear_svm, with_vector

    df = t.embeddings.withColumn("y", (F.col("label") >= 5).cast("int"))
    df = with_vector(df.withColumn("z", kernels.random_features("embedding", 64, 512, 1.0, 42)), "z")
    train, held = apart(df.select("vec_id", "y", "features"), "vec_id")
    model = linear_svm(10.0, train.count(), labelCol="y", maxIter=50).fit(train)
    return E.auc_roc(with_score(model.transform(held)), "score", "y")


@query("m19_linear_classifier")
def _(t):
    """Scores of held-out rows."""
    from granary.models.spark_ml import linear_svm

    train, held = apart(svm_rows(t).select("vec_id", "y", "features"), "vec_id")
    model = linear_svm(0.1, train.count(), labelCol="y", maxIter=20).fit(train)
    return with_score(model.transform(held)).select("vec_id", "y", "score", "prediction")


@query("m22_trees")
def _(t):
    """Decision tree and forest on prices, forest on vectors, with importances."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor

    names = ["x1", "x2"]
    df = VectorAssembler(inputCols=names, outputCol="features").transform(regression_rows(t))
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=5, seed=42).fit(df)
    forest = RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=5, seed=42).fit(df)
    digits = svm_rows(t)
    classes = RandomForestClassifier(labelCol="label", numTrees=10, maxDepth=5, seed=42).fit(digits)
    rows = [(m, n, float(v)) for m, model in (("tree", tree), ("forest", forest)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)]
    rows += [("digits", f"cell_{i}", float(v)) for i, v in enumerate(classes.featureImportances.toArray())]
    return t.spark.createDataFrame(rows, "model string, feature string, importance double")


@query("m23_one_vs_rest")
def _(t):
    """Confusion of held-out rows."""
    from granary.models.spark_ml import one_vs_rest

    train, held = apart(svm_rows(t).select("vec_id", "label", "features"), "vec_id")
    model = one_vs_rest(1.0, train.count(), "label").fit(train)
    return E.confusion(model.transform(held).withColumn("prediction", F.col("prediction").cast("int")), "label", "prediction")


@query("m24_kmeans")
def _(t):
    from granary.models.spark_ml import weighted_kmeans

    centres = weighted_kmeans(t.embeddings.withColumn("w", F.col("label") + 1.0), "embedding", 10, 42, "w")
    d = t.spark.createDataFrame(list(enumerate(centres)), "cluster int, centre array<double>")
    return d.select("cluster", F.posexplode("centre").alias("cell", "value")).withColumn("value", F.round("value", 6))


# ---------------------------------------------------------------- U composition


STAGE_SQL = """SELECT '{name}' AS variant, round(corr(x, y) * corr(x, y), 6) AS r2, round(sqrt(var_pop(y) - pow(covar_pop(x, y), 2) / var_pop(x)), 2) AS rmse,
  round(avg({shown}), 6) AS mean_input FROM (SELECT {x} AS x, l_extendedprice::DOUBLE AS y FROM {src})"""


@query(
    "u1_stage_composition",
    " UNION ALL ".join(
        STAGE_SQL.format(name=name, x=x, shown=shown, src="(SELECT *, median(l_discount::DOUBLE) OVER () AS med FROM " + LINE_NULLS_SQL + ")")
        for name, x, shown in (
            ("scaled", "coalesce(l_discount, med)::DOUBLE", "0::DOUBLE"),
            ("logged", "ln(1 + greatest(coalesce(l_discount, 0), 0)::DOUBLE)", "x"),
        )
    ),
)
def _(t):
    """Named stages: fitted in order, one replaced, parameters set, the fitted front part used alone."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from granary.models.spark_ml import Log1pTransformer, MedianScale
    from granary.models.stages import Stages

    stages = Stages(
        [
            ("prepare", MedianScale(["l_discount"])),
            ("assemble", VectorAssembler(inputCols=["l_discount"], outputCol="features")),
            ("model", LinearRegression(labelCol="l_extendedprice", regParam=10.0)),
        ]
    ).set_params(model__regParam=0.0)
    df = line_nulls(t).withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    known = df.withColumn("l_discount", F.coalesce("l_discount", F.lit(0.0)))
    out = None
    for name, rows, kind in (("scaled", df, stages), ("logged", known, stages.replace("prepare", Log1pTransformer(["l_discount"])))):
        fitted = kind.fit(rows)
        report = E.regression_report(fitted.transform(rows), "l_extendedprice", "prediction").select(F.round("r2", 6).alias("r2"), F.round("rmse", 2).alias("rmse"))
        shown = fitted[:"prepare"].transform(rows).agg((F.round(F.avg("l_discount"), 6) + 0.0).alias("mean_input"))
        row = report.join(F.broadcast(shown)).select(F.lit(name).alias("variant"), "r2", "rmse", "mean_input")
        out = row if out is None else out.unionByName(row)
    return out


@query("u6_custom_scorer", f"SELECT fold, round(quantile_cont(abs(y - p), 0.5), 5) AS median_error, round(max(abs(y - p)), 5) AS worst, round(avg((abs(y - p) <= 2000)::INT), 9) AS near FROM {REG} GROUP BY fold")
def _(t):
    scorers = {
        "worst": lambda y, p: F.max(F.abs(F.col(y) - F.col(p))),
        "near": lambda y, p: F.avg((F.abs(F.col(y) - F.col(p)) <= 2000).cast("int")),
    }
    df = regression_rows(t)
    agg = df.groupBy("fold").agg(*[f("y", "p").alias(n) for n, f in scorers.items()])
    med = quantile_row(df.select("fold", F.abs(F.col("y") - F.col("p")).alias("e")), {"median_error": ("e", 0.5)}, ["fold"])
    return agg.join(med, "fold").select("fold", F.round("median_error", 5).alias("median_error"), F.round("worst", 5).alias("worst"), F.round("near", 9).alias("near"))


