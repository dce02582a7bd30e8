"""Quantiles, ranks, running totals, splits: exact on skewed data and after repartitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import split
from granary.operators.drift import rolling_per_entity
from granary.operators.quantiles import exact_quantiles, values_at_ranks
from granary.operators.ranking import global_row_number, running_totals, sorted_positions


def skewed(spark, n=5000, seed=1):
    """A third of all rows share one value and one group."""
    rng = np.random.default_rng(seed)
    v = np.round(rng.lognormal(0, 2, n), 2)
    v[: n // 3] = 1.25
    g = np.where(np.arange(n) % 3 == 0, "hot", rng.integers(0, 20, n).astype(str))
    rng.shuffle(v)
    rows = [(int(i), str(g[i]), float(v[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g string, v double"), v, g


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 12345])
def test_quantiles_equal_numpy(spark, n):
    x = np.round(np.random.default_rng(n).standard_normal(n), 2)
    df = spark.createDataFrame([(float(a),) for a in x], "x double")
    got = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0, 0.05, 0.25, 0.5, 0.9, 1]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(x, 100 * p), abs=1e-12)


def test_grouped_quantiles_with_hot_group_and_nulls(spark):
    df, v, g = skewed(spark)
    df = df.withColumn("v", F.when(F.col("id") % 10 != 0, F.col("v"))).repartition(5)
    ids = np.arange(len(v)) % 10 != 0
    for r in exact_quantiles(df, ["v"], [0.25, 0.5], ["g"]).collect():
        assert r.value == pytest.approx(np.percentile(v[ids & (g == r.g)], 100 * r.prob), abs=1e-12)


def test_values_at_ranks(spark):
    df, v, _ = skewed(spark)
    s = np.sort(v)
    ranks = [0, 17, len(v) // 2, len(v) - 1]
    assert values_at_ranks(df, "v", ranks, len(v)) == [s[r] for r in ranks]


@pytest.mark.parametrize("start", [-(1 << 63), -40, (1 << 53) - 3, (1 << 63) - 30])
def test_first_rows_of_large_keys(spark, start):
    keys = [start + i for i in range(30)]
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k long, g long").repartition(3)
    for order in (["k"], ["g", "k"]):
        want = sorted(keys, key=lambda k: (k % 3, k) if len(order) == 2 else k)[:14]
        assert {r.k for r in df.where(split.first_rows(df, order, 14, 30)).collect()} == set(want)


@pytest.mark.parametrize("buckets", [2, 8, 64])
def test_row_number_with_heavy_value(spark, buckets):
    df, v, _ = skewed(spark)
    got = global_row_number(df.repartition(7), "v", "id", buckets=buckets).select("v", "id", "rn").collect()
    assert [r.rn for r in sorted(got, key=lambda r: (r.v, r.id))] == list(range(1, len(v) + 1))


def test_running_totals(spark):
    df, v, _ = skewed(spark)
    got = running_totals(df, "v", {"s": "id"}, "id", 16).collect()
    total = 0
    for r in sorted(got, key=lambda r: (r.v, r.id)):
        total += r.id
        assert r.s == total


def test_sorted_positions(spark):
    words = [f"w{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = sorted(r.position for r in sorted_positions(df, ["w"]).collect())
    assert got == list(range(1000))
    order = sorted(sorted_positions(df, ["w"]).collect(), key=lambda r: r.position)
    assert [r.w for r in order] == sorted(words)


def test_folds_partition_rows_and_survive_repartition(spark):
    df, v, g = skewed(spark)
    a = split.kfold(df, ["id"], 7, 42)
    sizes = sorted(r["count"] for r in a.groupBy("fold").count().collect())
    assert sum(sizes) == len(v) and max(sizes) - min(sizes) <= 1 and len(sizes) == 7
    b = split.kfold(df.repartition(13).orderBy(F.desc("v")), ["id"], 7, 42)
    assert a.select("id", "fold").exceptAll(b.select("id", "fold")).count() == 0


def test_stratified_split_is_exact_per_class(spark):
    df, v, g = skewed(spark)
    rows = split.train_test_split(df, ["id"], 0.2, 1, ["g"]).groupBy("g").agg(F.sum("is_test").alias("t"), F.count("*").alias("n"))
    for r in rows.collect():
        assert r.t == int(r.n * 0.2 + 1e-9)


def test_temporal_split_with_equal_times(spark):
    df, v, _ = skewed(spark)
    timed = df.withColumn("ts", F.timestamp_micros(F.floor(F.col("v") * 100).cast("long")))
    rows = split.temporal_split(timed, "ts", "id", 0.3).select("ts", "id", "is_test").collect()
    rows.sort(key=lambda r: (r.ts, r.id))
    train = int(len(v) * 0.7)
    assert [r.is_test for r in rows] == [0] * train + [1] * (len(v) - train)


def test_majority_sample(spark):
    df, v, g = skewed(spark)
    y = df.withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    s = split.sample_majority(y, ["id"], "y", 1, 777, 3)
    assert s.where("y = 1").count() == 100 and s.where("y = 0").count() == 777


@pytest.mark.parametrize("back", [1, 10])
def test_rolling_per_entity_cut_into_slices(spark, back):
    df, v, g = skewed(spark, 1500)
    got = rolling_per_entity(df, "g", "v", "id", back, {"s": F.sum("v"), "n": F.count("*")}, buckets=16)
    got = {r.id: (r.s, r.n) for r in got.collect()}
    assert len(got) == 1500
    for name in set(g):
        ids = [i for i in range(1500) if g[i] == name]
        ids.sort(key=lambda i: (v[i], i))
        for pos, i in enumerate(ids):
            frame = ids[max(0, pos - back) : pos + 1]
            assert got[i][1] == len(frame)
            assert got[i][0] == pytest.approx(sum(v[j] for j in frame))
