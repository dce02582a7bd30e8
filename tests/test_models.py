"""Models against closed forms; neighbours and ranking metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.models import linear, search, sgd
from granary.operators import evaluate as E
from granary.operators import kernels, neighbors
from granary.operators.gram import moments, total


def frame(spark, x, y, **extra):
    cols = [f"x{j}" for j in range(x.shape[1])]
    names = ["id", *cols, "y", *extra]
    rows = [(i, *map(float, x[i]), float(y[i]), *[int(v[i]) for v in extra.values()]) for i in range(len(y))]
    schema = "id long, " + ", ".join(f"{c} double" for c in [*cols, "y"]) + "".join(f", {k} long" for k in extra)
    return spark.createDataFrame(rows, schema).select(*names), cols


def sparse_problem(seed=42, n=200, p=10, noise=2.0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p))
    w = np.array([3, -1, 2, 0.5, -0.5] + [0] * (p - 5))
    return x, x @ w + 4 + noise * rng.standard_normal(n)


def ridge_closed(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - x.mean(0) @ w


@pytest.mark.parametrize("width", [3, 14, 40])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_moments_inside_jvm_and_in_batches(spark, width, kind):
    x, y = sparse_problem(p=40)
    x, y = x + 1e6, y  # far from zero: sums of squares would lose digits
    df, cols = frame(spark, x, y, fold=np.arange(len(y)) % 4)
    cols = cols[:width]
    # the last fold is the null group
    fold = F.when(F.col("fold") < 3, F.col("fold").cast(kind))
    groups = moments(df.repartition(4), cols, "y", fold)
    assert set(groups) == {*([0, 1, 2] if kind == "long" else ["0", "1", "2"]), None}
    z = np.column_stack([x[:, :width], y])
    for k, m in groups.items():
        part = z[np.arange(len(y)) % 4 == (3 if k is None else int(k))]
        assert m.n == len(part)
        np.testing.assert_allclose(m.mean, part.mean(0), rtol=1e-12)
        c = part - part.mean(0)
        np.testing.assert_allclose(m.scatter, c.T @ c, atol=1e-6)
    whole = total(groups)
    c = z - z.mean(0)
    np.testing.assert_allclose(whole.mean, z.mean(0), rtol=1e-12)
    np.testing.assert_allclose(whole.scatter, c.T @ c, atol=1e-6)
    rest = whole - groups[None]
    part = z[np.arange(len(y)) % 4 < 3]
    c = part - part.mean(0)
    np.testing.assert_allclose(rest.scatter, c.T @ c, atol=1e-5)
    assert moments(df.limit(0), cols, "y", fold) == {}


def test_linear_and_ridge_equal_closed_form(spark):
    x, y = sparse_problem()
    df, cols = frame(spark, x, y)
    m = linear.fit_moments(df, cols, "y")
    for alpha in (0.0, 1.0, 100.0):
        model = linear.ridge(m, alpha) if alpha else linear.ols(m)
        w, b = ridge_closed(x, y, alpha)
        np.testing.assert_allclose(model.weights, w, atol=1e-8)
        assert model.intercept == pytest.approx(b)
    pred = np.array([r.p for r in df.select("id", linear.ols(m).predict().alias("p")).orderBy("id").collect()])
    assert m.squared_error(linear.ols(m).weights, linear.ols(m).intercept) == pytest.approx(((y - pred) ** 2).sum())


def test_rank_deficient_gives_minimum_norm(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(5, 10))
    y = rng.uniform(size=5)
    df, cols = frame(spark, x, y)
    m = linear.ols(linear.fit_moments(df, cols, "y"))
    want = np.linalg.pinv(x - x.mean(0)) @ (y - y.mean())
    np.testing.assert_allclose(m.weights, want, atol=1e-5)


def test_lasso_optimality_and_zeros(spark):
    x, y = sparse_problem()
    df, cols = frame(spark, x, y)
    model = linear.lasso(linear.fit_moments(df, cols, "y"), 0.5)
    r = y - y.mean() - (x - x.mean(0)) @ model.weights
    grad = (x - x.mean(0)).T @ r / len(y)
    for w, g in zip(model.weights, grad, strict=True):
        assert abs(g - 0.5 * np.sign(w)) < 1e-6 if w else abs(g) <= 0.5 + 1e-6
    assert (model.weights == 0).any()


def test_elastic_net_ends_equal_lasso_and_ridge(spark):
    x, y = sparse_problem()
    df, cols = frame(spark, x, y)
    m = linear.fit_moments(df, cols, "y")
    np.testing.assert_allclose(linear.elastic_net(m, 0.3, 1.0).weights, linear.lasso(m, 0.3).weights, atol=1e-8)
    np.testing.assert_allclose(linear.elastic_net(m, 0.3, 0.0).weights, linear.ridge(m, 0.3 * m.n).weights, atol=1e-6)
    with pytest.raises(ValueError):
        linear.elastic_net(m, 1.0, 0.5, "legacy")


def test_gradient_methods_approach_least_squares(spark):
    x, y = sparse_problem(noise=0.1)
    df, cols = frame(spark, x, y)
    m = linear.fit_moments(df, cols, "y")
    w = linear.ols(m).weights
    gd = linear.gradient_descent(m, 0.3, 500, 0.0)
    np.testing.assert_allclose(gd.weights, w, atol=1e-6)
    assert all(a >= b - 1e-12 for a, b in zip(gd.history, gd.history[1:], strict=False))
    batches = sgd.batch_moments(df, cols, "y", ["id"], 8, 1)
    assert sum(b.n for b in batches.values()) == len(y)
    np.testing.assert_allclose(sgd.mini_batch(batches, 0.1, 60, 1).weights, w, atol=0.1)
    np.testing.assert_allclose(sgd.averaged_sgd(df, cols, "y", ["id"], 0.05, 8, 1).weights, w, atol=0.2)


def test_schedules():
    assert sgd.schedule("inverse", 1.0, 0.5, 2, 10) == pytest.approx(0.5)
    assert sgd.schedule("cosine", 1.0, 0.0, 10, 10) == pytest.approx(0.0)
    with pytest.raises(ValueError):
        sgd.schedule("other", 1, 1, 1, 1)


def test_learning_rate_finder_stops(spark):
    x, y = sparse_problem()
    df, cols = frame(spark, x, y)
    found = linear.learning_rate_finder(linear.fit_moments(df, cols, "y"), list(np.geomspace(1e-3, 100, 20)))
    assert found[-1]["stopped"] and len(found) < 20


def test_leave_one_out_equals_refits(spark):
    x, y = sparse_problem(n=12, p=5)
    x = x[:, :2]
    df, cols = frame(spark, x, y)
    got = {r.id: r.prediction for r in linear.leave_one_out(df, cols, "y", "id").collect()}
    for i in range(12):
        keep = np.arange(12) != i
        w, b = ridge_closed(x[keep], y[keep], 0.0)
        assert got[i] == pytest.approx(x[i] @ w + b)


@pytest.mark.parametrize("scale", [False, True])
def test_fold_scores_equal_refits(spark, scale):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((100, 2)) * [1000, 0.01]
    y = x @ [0.001, 100] + 0.5 * rng.standard_normal(100)
    fold = np.arange(100) % 5
    df, cols = frame(spark, x, y, fold=fold)
    rows = search.cross_val_score(moments(df, cols, "y", "fold"), "ridge", {"alpha": 1.0}, "r2", scale)
    for r in rows:
        tr, te = fold != r["fold"], fold == r["fold"]
        mu, sd = (x[tr].mean(0), x[tr].std(0)) if scale else (0.0, 1.0)
        w, b = ridge_closed((x[tr] - mu) / sd, y[tr], 1.0)
        p = (x[te] - mu) / sd @ w + b
        assert r["score"] == pytest.approx(1 - ((y[te] - p) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum(), abs=1e-8)


def test_search_ranks_and_argument_checks(spark):
    x, y = sparse_problem()
    df, cols = frame(spark, x, y, fold=np.arange(len(y)) % 5)
    folds = moments(df, cols, "y", "fold")
    rows = search.search(folds, "ridge", search.parameter_grid({"alpha": [1.0, 1.0, 1e6]}))
    assert [r["rank"] for r in rows] == [1, 2, 3]
    assert search.best_model(folds, "ridge", rows).weights == pytest.approx(ridge_closed(x, y, 1.0)[0])
    with pytest.raises(ValueError):
        search.cross_val_score(folds, "ridge", {"alpha": 1.0}, "nonsense")
    draws = search.sample_parameters({"alpha": (1e-3, 1e3, "log"), "k": ["a", "b"]}, 5, 0)
    assert draws == search.sample_parameters({"alpha": (1e-3, 1e3, "log"), "k": ["a", "b"]}, 5, 0)
    assert all(1e-3 <= d["alpha"] <= 1e3 for d in draws)


# ------------------------------------------------------------ ranking metrics


def test_auc_against_pairs_with_ties_and_signed_zero(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.standard_normal(400), 1)
    s[:50] = -0.0
    s[50:100] = 0.0
    y = (rng.uniform(size=400) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    p, n = s[y == 1], s[y == 0]
    wins = (p[:, None] > n[None, :]).sum() + 0.5 * (p[:, None] == n[None, :]).sum()
    assert E.auc_roc(df, "s", "y").first()[0] == pytest.approx(wins / len(p) / len(n))
    ranks = {r.score: r.rank for r in E.mid_ranks(df, "s", "y").collect()}
    for v in np.unique(s):
        below, same = (s < v).sum(), (s == v).sum()
        assert ranks[float(v) + 0.0] == pytest.approx(below + (same + 1) / 2)
    one = df.where("y = 1")
    assert E.auc_roc(one, "s", "y").first()[0] == 0.5


def test_threshold_sweep_by_hand(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0), (0.5, 1)], "s double, y int")
    rows = {r.step: r for r in E.threshold_sweep(df, "s", "y", 5).collect()}
    assert (rows[0].tp, rows[0].fp) == (1, 0)
    assert (rows[1].tp, rows[1].fp) == (2, 1)
    assert (rows[4].tp, rows[4].fp, rows[4].fn, rows[4].tn) == (3, 2, 0, 0)
    none = E.operating_point(df.withColumn("y", F.lit(0)), "s", "y", "precision", 0.9).first()
    assert none is None or none.score is None


def test_r2_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0, 2.0)] * 4, "y double, p double, q double")
    row = df.agg(E.r2("y", "p").alias("a"), E.r2("y", "q").alias("b")).first()
    assert (row.a, row.b) == (1.0, 0.0)


# ------------------------------------------------------------ neighbours and kernels


def brute(q, x, ids, k, skip=None, metric="l2"):
    d = np.abs(x - q).sum(1) if metric == "l1" else np.sqrt(((x - q) ** 2).sum(1))
    d = np.round(d, 9)
    order = [i for i in np.lexsort((ids, d)) if ids[i] != skip]
    return [int(ids[i]) for i in order[:k]]


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_neighbors_with_a_third_of_copies(spark, metric, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 40)  # force several blocks per cell
    rng = np.random.default_rng(5)
    x = np.round(rng.standard_normal((300, 6)), 3)
    x[:100] = x[0]
    x[100:180] += 8
    ids = np.arange(300)
    df = spark.createDataFrame([(int(i), x[i].tolist(), int(i % 4)) for i in ids], "id long, v array<double>, y int")
    got = neighbors.nearest(df, df, "id", "id", "v", 5, payload="y", exclude_self=True, metric=metric)
    near = {}
    for r in got.collect():
        near.setdefault(r.id, {})[r["rank"]] = r.neighbor
    for i in ids:
        assert [near[i][k] for k in sorted(near[i])] == brute(x[i], x, ids, 5, i, metric)


def test_neighbors_of_wide_vectors_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 90)
    monkeypatch.setattr(neighbors, "STEP", 32)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 32)).astype(np.float32)
    x[300:340] = np.round(x[300:340])  # some distances are equal
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(500)], "id long, v array<float>")
    near = {}
    for r in neighbors.nearest(df.where("id % 5 = 0"), df, "id", "id", "v", 7).collect():
        near.setdefault(r.id, {})[r["rank"]] = r.neighbor
    assert len(near) == 100
    for i in near:
        assert [near[i][k] for k in sorted(near[i])] == brute(x[i].astype(float), x.astype(float), np.arange(500), 7)


def test_cells_share_blocks_of_bounded_size():
    size = np.array([400] * 250 + [0, 70_000, 5, 32_768, 9])
    first, parts = neighbors._bundled(size, 32_768)
    rows = {}
    for f, p, n in zip(first, parts, size):
        for b in range(f, f + p):
            rows[b] = rows.get(b, 0) + -(-n // p)
    # a query that visits every cell is sent to a few blocks, not to 254 cells
    assert set(rows) == set(range(len(rows))) and len(rows) <= 9
    assert max(rows.values()) <= 32_768 and sum(rows.values()) - size.sum() < 3


def test_neighbors_of_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [5.0])], "id long, v array<double>")
    got = neighbors.nearest(df, df, "id", "id", "v", 10).groupBy("id").count().collect()
    assert all(r["count"] == 3 for r in got)


def test_kernels():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((10, 5)), rng.standard_normal((7, 5))
    for kind in ("linear", "poly", "polynomial", "rbf", "sigmoid"):
        assert kernels.kernel_matrix(a, b, kind).shape == (10, 7)
    np.testing.assert_allclose(np.diag(kernels.kernel_matrix(a, a, "rbf")), 1.0)
    with pytest.raises(ValueError):
        kernels.kernel_matrix(a, b, "other")


def test_random_features_approach_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((30, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(30)], "id long, v array<double>")
    z = np.array([r.z for r in df.select("id", kernels.random_features("v", 4, 4000, 0.3, 7).alias("z")).orderBy("id").collect()])
    np.testing.assert_allclose(z @ z.T, kernels.kernel_matrix(x, x, "rbf", gamma=0.3), atol=0.08)


def test_linear_svm_and_random_features_on_known_shapes(spark):
    from granary.models.spark_ml import linear_svm, with_vector

    rng = np.random.default_rng(42)
    blobs = np.vstack([rng.normal(2, 0.5, (50, 2)), rng.normal(-2, 0.5, (50, 2))])
    xor = rng.standard_normal((200, 2))
    sets = {"blobs": (blobs, np.repeat([1, 0], 50)), "xor": (xor, (xor[:, 0] * xor[:, 1] > 0).astype(int))}

    def accuracy(x, y, expand):
        df = spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(len(y))], "v array<double>, y int")
        if expand:
            df = df.withColumn("v", kernels.random_features("v", 2, 300, 1.0, 1))
        df = with_vector(df, "v")
        model = linear_svm(10.0, len(y), labelCol="y", maxIter=25).fit(df)
        return model.transform(df).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]

    assert accuracy(*sets["blobs"], False) > 0.95
    assert accuracy(*sets["xor"], True) > accuracy(*sets["xor"], False) + 0.1
