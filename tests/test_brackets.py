"""Quantiles whose brackets are narrowed before ranking, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]


@pytest.fixture
def narrow(monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 300)
    return 300


def check(spark, df, by=()):
    got = {(*[r[b] for b in by], r.feature, r.prob): r.value for r in quantiles.exact_quantiles(df, ["v"], PROBS, by).collect()}
    data = df.select(*by, "v").toPandas()
    groups = data.groupby(list(by), dropna=False) if by else [((), data)]
    want = {}
    for name, rows in groups:
        name = tuple(None if x is None or x != x else x for x in name)
        v = rows["v"].dropna().to_numpy()
        if len(v):
            want |= {(*name, "v", p): np.quantile(v, p) for p in PROBS}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-12) for k in want)


def test_two_million_distinct_values(spark, narrow):
    df = spark.range(2_000_000).select((F.exp(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / F.lit(1 << 34)) + F.col("id") * 1e-9).alias("v"))
    check(spark, df)


def test_hot_group_hot_value_and_null_group(spark, narrow):
    n = 200_000
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise((F.col("id") % 50).cast("string"))
    v = F.when(F.col("id") % 5 < 2, F.lit(1.5)).when(F.col("id") % 5 < 4, F.col("id") % 2 + 0.0).otherwise(F.col("id") / 7.0)
    df = spark.range(n).select(g.alias("g"), v.alias("v"))
    check(spark, df, ["g"])
    check(spark, df)


def test_no_bracket_stays_wide(spark, narrow):
    values = quantiles.long_values(spark.range(300_000).select((F.col("id") * 1.0).alias("v")), ["v"])
    marks = quantiles._marks(PROBS)
    sketch = values.groupBy("feature").agg(F.percentile_approx("v", marks, quantiles.SKETCH_ACCURACY).alias("_m"), F.count("*").alias("_c"))
    m = quantiles.narrowed(values, sketch, ["feature"], PROBS, None, narrow).first()["_m"]
    for i, p in enumerate(PROBS):
        lo, hi = m[2 * i], m[2 * i + 1]
        assert lo <= p * 299_999 <= hi and hi - lo - 1 <= narrow


def test_ranks(spark, narrow):
    df = spark.range(100_000).select(((F.col("id") * 7919) % 100_003 * 1.0).alias("v"))
    want = np.sort(np.array([(i * 7919) % 100_003 for i in range(100_000)], float))
    ranks = [0, 1, 777, 50_000, 99_999]
    assert quantiles.values_at_ranks(df, "v", ranks, 100_000) == want[ranks].tolist()
