"""Cleaning, encoding, feature, scaling and splitting queries."""

from pyspark.sql import functions as F

from granary.functions.scalars import cut, elapsed_seconds, floor_bucket, safe_ratio, season
from granary.operators import clean, encode, features, profile, split
from granary.operators.scale import MinMaxScaler, StandardScaler
from granary.plans.common import (
    LINE_KEY,
    LINE_NULLS_SQL,
    LINE_NUM,
    PART_NULLS_SQL,
    line_nulls,
    part_nulls,
)
from granary.plans.registry import query

KEYS = ", ".join(LINE_KEY)

# ---------------------------------------------------------------- J cleaning


@query(
    "j1_simple_imputer",
    f"""WITH p AS (SELECT * FROM {PART_NULLS_SQL}),
        m AS (SELECT p_type AS v FROM p WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1)
       SELECT p_partkey, coalesce(p_type, (SELECT v FROM m)) AS p_type,
         coalesce(p_size, (SELECT median(p_size) FROM p)) AS p_size FROM p""",
)
def _(t):
    df = part_nulls(t)
    model = clean.Imputer.fit(df, {"p_type": ("most_frequent", None), "p_size": ("median", None)})
    return model.transform(df).select("p_partkey", "p_type", F.col("p_size").cast("double").alias("p_size"))


@query(
    "j2_column_imputer",
    f"""WITH p AS (SELECT {KEYS}, l_discount, l_tax, l_quantity, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag FROM {LINE_NULLS_SQL})
       SELECT {KEYS}, round(coalesce(l_discount, (SELECT avg(l_discount) FROM p)), 9) AS l_discount,
         coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM p)) AS l_tax, coalesce(flag, 'Z') AS flag FROM p""",
)
def _(t):
    df = line_nulls(t).withColumn("flag", F.when(F.col("l_returnflag") == "R", "NaN").otherwise(F.col("l_returnflag")))
    model = clean.Imputer.fit(
        df,
        {
            "l_discount": ("mean", None),
            "l_tax": ("median", None),
            "flag": ("constant", "Z"),
            "not_there": ("median", None),
        },
    )
    return model.transform(df).select(*LINE_KEY, F.round("l_discount", 9).alias("l_discount"), "l_tax", "flag")


@query(
    "j3_absent_fill",
    f"SELECT p_partkey, coalesce(p_type, 'None') AS p_type, coalesce(p_size, 0) AS p_size FROM {PART_NULLS_SQL}",
)
def _(t):
    return clean.fill_absent(part_nulls(t), ["p_type", "nope"], ["p_size"]).select("p_partkey", "p_type", "p_size")


@query(
    "j4_group_fill",
    f"""WITH p AS (SELECT * FROM {PART_NULLS_SQL}), g AS (SELECT p_brand, median(p_size) AS m FROM p GROUP BY 1)
       SELECT p_partkey, round(coalesce(p_size, m, (SELECT median(p_size) FROM p)), 6) AS p_size FROM p LEFT JOIN g USING (p_brand)""",
)
def _(t):
    return clean.group_median_fill(part_nulls(t), "p_size", "p_brand").select("p_partkey", F.round("p_size", 6).alias("p_size"))


@query(
    "j5_outliers_iqr_clip",
    """WITH b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
       SELECT event_id, round(CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1)
         WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END, 9) AS value FROM events, b""",
)
def _(t):
    model = clean.OutlierHandler.fit(t.events, ["value"])
    return model.transform(t.events).select("event_id", F.round("value", 9).alias("value"))


@query(
    "j5_outliers_zscore_nan",
    f"""WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)
       SELECT {KEYS}, CASE WHEN l_extendedprice BETWEEN m - 1.5 * s AND m + 1.5 * s THEN l_extendedprice END AS l_extendedprice FROM lineitem, b""",
)
def _(t):
    model = clean.OutlierHandler.fit(t.lineitem, ["l_extendedprice"], "zscore", 1.5, "nan")
    return model.transform(t.lineitem).select(*LINE_KEY, "l_extendedprice")


@query(
    "j5_outliers_percentile_remove",
    """WITH b AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)
       SELECT event_id, value FROM events, b WHERE NOT (value < lo OR value > hi)""",
)
def _(t):
    model = clean.OutlierHandler.fit(t.events, ["value"], "percentile", (0.05, 0.95), "remove")
    return model.transform(t.events).select("event_id", "value")


@query(
    "j6_cleaning_steps",
    f"""WITH p AS (SELECT {KEYS}, l_extendedprice, l_discount FROM {LINE_NULLS_SQL}),
        i AS (SELECT {KEYS}, l_extendedprice, coalesce(l_discount, (SELECT median(l_discount) FROM p)) AS d FROM p),
        b AS (SELECT avg(d) AS m, stddev_pop(d) AS s FROM i)
       SELECT {KEYS}, round(CASE WHEN d < m - 1.5 * s THEN m - 1.5 * s WHEN d > m + 1.5 * s THEN m + 1.5 * s ELSE d END, 9) AS l_discount FROM i, b""",
)
def _(t):
    df = line_nulls(t)
    steps = clean.CleaningSteps()
    steps.add("impute", lambda d: clean.Imputer.fit(d, {"l_discount": ("median", None)}))
    steps.add("outliers", lambda d: clean.OutlierHandler.fit(d, ["l_discount"], "zscore", 1.5, "clip"))
    return steps.fit(df).transform(df).select(*LINE_KEY, F.round("l_discount", 9).alias("l_discount"))


def part_config():
    return clean.CleaningConfig(
        drop=["p_name"],
        rules=[("cheap", ["p_retailprice"], F.col("p_retailprice") < 990), ("small", ["p_size"], F.coalesce("p_size", F.lit(0)) < 48)],
        none_columns=["p_comment"],
        median_columns=["p_size"],
        mode_columns=["p_type"],
    )


@query(
    "j7_clean_table",
    f"""WITH p AS (SELECT * FROM {PART_NULLS_SQL} WHERE p_retailprice < 990 AND coalesce(p_size, 0) < 48)
       SELECT p_partkey, p_brand, p_retailprice, coalesce(p_size, (SELECT median(p_size) FROM p)) AS p_size,
         coalesce(p_type, (SELECT p_type FROM p WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS p_type FROM p""",
)
def _(t):
    out, _report = clean.clean_table(part_nulls(t), part_config())
    return out.withColumn("p_size", F.col("p_size").cast("double"))


@query(
    "j7_clean_report",
    f"""WITH p AS (SELECT * FROM {PART_NULLS_SQL})
       SELECT 'removed' AS section, 'cheap' AS name, count(*) FILTER (p_retailprice >= 990) AS n FROM p
       UNION ALL SELECT 'removed', 'small', count(*) FILTER (p_retailprice < 990 AND coalesce(p_size, 0) >= 48) FROM p
       UNION ALL SELECT 'removed', 'kept', count(*) FILTER (NOT (p_retailprice < 990 AND coalesce(p_size, 0) < 48)) FROM p
       UNION ALL SELECT 'nulls', c, 0 FROM (SELECT unnest(['p_partkey', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS c)""",
)
def _(t):
    return clean.clean_table(part_nulls(t), part_config())[1]


@query(
    "j8_expectations",
    """SELECT 'priority_known' AS "check", count(*) FILTER (o_orderpriority IS NULL) AS violations FROM orders
       UNION ALL SELECT 'price_range', count(*) FILTER (NOT o_totalprice BETWEEN 2000 AND 480000) FROM orders
       UNION ALL SELECT 'not_pending', count(*) FILTER (o_orderstatus = 'P') FROM orders""",
)
def _(t):
    return clean.expectations(
        t.orders,
        {
            "priority_known": F.col("o_orderpriority").isNotNull(),
            "price_range": F.col("o_totalprice").between(2000, 480000),
            "not_pending": F.col("o_orderstatus") != "P",
        },
    )


# ---------------------------------------------------------------- J encoding


@query(
    "j9_label_encoder",
    """SELECT p_partkey, p_brand, code, p_brand AS decoded FROM part JOIN
        (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)""",
)
def _(t):
    codes = encode.label_codes(t.part, "p_brand")
    coded = encode.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand", codes, "code")
    return encode.label_decode(coded, "code", codes, "decoded")


PRIORITIES = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]


@query(
    "j10_ordinal_encoder",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE -1 END AS code FROM orders""",
)
def _(t):
    return t.orders.select("o_orderkey", encode.ordinal("o_orderpriority", PRIORITIES).alias("code"))


@query(
    "j11_one_hot",
    "SELECT event_id, "
    + ", ".join(f"(event_type = '{c}')::DOUBLE AS event_type_{c}" for c in ("error", "purchase", "signup", "view"))
    + " FROM events",
)
def _(t):
    cats = encode.categories_of(t.events, "event_type")
    return t.events.select("event_id", *encode.one_hot("event_type", cats))


TARGET_SQL = """WITH g AS (SELECT avg(p_retailprice) AS m FROM part),
  e AS (SELECT p_name, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1)
  SELECT p_partkey, round(CASE WHEN n >= 12 THEN (s + 10 * m) / (n + 10) ELSE m END, 6) AS encoded FROM part JOIN e USING (p_name), g"""


@query("j12_target_encoder", TARGET_SQL)
def _(t):
    enc = encode.TargetEncoding.fit(t.part, "p_name", "p_retailprice", 10.0, 12)
    return enc.transform(t.part.select("p_partkey", "p_name"), "encoded").select("p_partkey", F.round("encoded", 6).alias("encoded"))


@query(
    "j13_out_of_fold_target",
    """WITH f AS (SELECT *, CAST(('0x' || substr(md5(p_partkey || ':42'), 1, 7)) AS BIGINT) % 5 AS fold FROM part)
       SELECT a.p_partkey, a.fold, round((coalesce(sum(b.p_retailprice) FILTER (b.p_brand = a.p_brand), 0) + 10 * avg(b.p_retailprice))
         / (count(*) FILTER (b.p_brand = a.p_brand) + 10), 6) AS encoded
       FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.p_partkey, a.fold, a.p_brand""",
)
def _(t):
    folded = t.part.withColumn("fold", split.hash_fold(["p_partkey"], 5, 42))
    out = encode.out_of_fold_target(folded, "p_brand", "p_retailprice", "fold", "encoded", 10.0, 0)
    return out.select("p_partkey", "fold", F.round("encoded", 6).alias("encoded"))


@query(
    "j14_multi_column_encoder",
    """WITH g AS (SELECT avg(p_retailprice) AS m FROM part), e AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1),
        l AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS c FROM (SELECT DISTINCT p_name FROM part))
       SELECT p_partkey, l.c AS p_name_code, round((s + m) / (n + 1), 6) AS p_brand_mean, """
    + ", ".join(f"(p_type = '{c}')::DOUBLE AS p_type_{c}" for c in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM part JOIN e USING (p_brand) JOIN l USING (p_name), g",
)
def _(t):
    plan = {"p_name": ("label", {}), "p_type": ("onehot", {}), "p_brand": ("target", {"target": "p_retailprice"})}
    out = encode.encode_columns(t.part, plan)
    return out.drop("p_name", "p_brand", "p_size", "p_retailprice").withColumn("p_brand_mean", F.round("p_brand_mean", 6))


# ---------------------------------------------------------------- J features


@query(
    "j15_domain_features",
    f"""SELECT {KEYS}, greatest(0, date_diff('day', o_orderdate, l_shipdate)) AS ship_lag, (year(o_orderdate) = year(l_shipdate))::INT AS same_year,
         l_extendedprice * (1 - l_discount) AS revenue, CASE WHEN l_extendedprice * (1 - l_discount) > 0 THEN l_extendedprice * l_tax / (l_extendedprice * (1 - l_discount)) ELSE 0 END AS tax_share,
         CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity ELSE 0 END AS unit_price, (l_discount > 0)::INT AS has_discount, l_quantity * p_size AS qty_size,
         CASE WHEN month(l_shipdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(l_shipdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(l_shipdate) BETWEEN 9 AND 11 THEN 'fall' ELSE 'winter' END AS season
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    D = features.Derived
    c = F.col
    wanted = [
        D("ship_lag", ("l_shipdate", "o_orderdate"), lambda d: F.greatest(F.lit(0), F.datediff("l_shipdate", "o_orderdate"))),
        D("same_year", ("l_shipdate", "o_orderdate"), lambda d: (F.year("o_orderdate") == F.year("l_shipdate")).cast("int")),
        D("revenue", ("l_extendedprice", "l_discount"), lambda d: c("l_extendedprice") * (1 - c("l_discount"))),
        D("tax_share", ("revenue", "l_tax"), lambda d: safe_ratio(c("l_extendedprice") * c("l_tax"), "revenue")),
        D("unit_price", ("l_extendedprice", "l_quantity"), lambda d: safe_ratio("l_extendedprice", "l_quantity")),
        D("has_discount", ("l_discount",), lambda d: (c("l_discount") > 0).cast("int")),
        D("qty_size", ("l_quantity", "p_size"), lambda d: c("l_quantity") * c("p_size")),
        D("garage", ("l_garage",), lambda d: F.lit(1)),
        D("season", ("l_shipdate",), lambda d: season(F.month("l_shipdate"))),
    ]
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey")).join(
        t.part.select("p_partkey", "p_size"), c("l_partkey") == c("p_partkey")
    )
    made = [f.name for f in wanted if f.name != "garage"]
    return features.derive(j, wanted).select(*LINE_KEY, *made)


@query(
    "j15_house_features",
    """SELECT o_orderkey, greatest(0, 2002 - year(o_orderdate)) AS House_Age, (year(o_orderdate) = 2002)::INT AS Is_New,
        o_totalprice / 100 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 500 END AS Total_SF,
        round(CASE WHEN o_totalprice / 100 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 500 END > 0 THEN (o_totalprice / 100) / (o_totalprice / 100 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 500 END) ELSE 1 END, 9) AS Above_Grade_Ratio,
        (o_orderstatus <> 'P')::INT AS Has_Basement, (month(o_orderdate) BETWEEN 3 AND 5)::INT AS Sold_Spring, (month(o_orderdate) BETWEEN 6 AND 8)::INT AS Sold_Summer,
        (month(o_orderdate) BETWEEN 9 AND 11)::INT AS Sold_Fall, (month(o_orderdate) IN (12, 1, 2))::INT AS Sold_Winter FROM orders""",
)
def _(t):
    o = t.orders.select(
        "o_orderkey",
        F.lit(2002).alias("Yr.Sold"),
        F.year("o_orderdate").alias("Year.Built"),
        F.month("o_orderdate").alias("Mo.Sold"),
        (F.col("o_totalprice") / 100).alias("area"),
        F.when(F.col("o_orderstatus") != "P", 500.0).alias("Total.Bsmt.SF"),
    )
    out = features.derive(o, features.house_features())
    made = "House_Age Is_New Total_SF Has_Basement Sold_Spring Sold_Summer Sold_Fall Sold_Winter".split()
    return out.select("o_orderkey", *made, F.round("Above_Grade_Ratio", 9).alias("Above_Grade_Ratio"))


@query(
    "j16_ratio_features",
    f"""WITH r AS (SELECT {KEYS}, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS a FROM {LINE_NULLS_SQL}),
         i AS (SELECT {KEYS}, coalesce(a, (SELECT median(a) FROM r)) AS a FROM r)
       SELECT {KEYS}, round((a - (SELECT avg(a) FROM i)) / (SELECT stddev_pop(a) FROM i), 6) AS ratio FROM i""",
)
def _(t):
    r = line_nulls(t).select(*LINE_KEY, F.try_divide("l_discount", "l_tax").alias("ratio"))
    filled = clean.Imputer.fit(r, {"ratio": ("median", None)}).transform(r)
    return StandardScaler.fit(filled, ["ratio"]).transform(filled).withColumn("ratio", F.round("ratio", 6))


@query(
    "j17_polynomial_features",
    f"""SELECT {KEYS}, 1.0::DOUBLE AS bias, q AS x, d AS y, q * q AS xx, q * d AS xy, d * d AS yy, q * q * q AS xxx, q * q * d AS xxy, q * d * d AS xyy, d * d * d AS yyy
       FROM (SELECT {KEYS}, l_quantity AS q, l_discount AS d FROM lineitem)""",
)
def _(t):
    df = t.lineitem.select(*LINE_KEY, F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    out = df.select(*LINE_KEY, *features.polynomial(["x", "y"], 3, bias=True))
    return out.toDF(*LINE_KEY, "bias", "x", "y", "xx", "xy", "yy", "xxx", "xxy", "xyy", "yyy")


@query(
    "j18_log_transformer",
    "SELECT event_id, round(ln(1 + value), 9) AS value, round(exp(ln(1 + value)) - 1, 6) AS back, event_id + 0.0::DOUBLE AS kept FROM events",
)
def _(t):
    e = t.events.select("event_id", "value", F.col("event_id").cast("double").alias("kept"))
    model = features.LogTransform.fit(e, None, ["value", "kept"])
    out = model.transform(e).withColumn("logged", F.round("value", 9))
    return model.inverse(out).select("event_id", "kept", F.col("logged").alias("value"), F.round("value", 6).alias("back"))


@query(
    "j19_transaction_features",
    """WITH e AS (SELECT event_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6::DOUBLE AS s FROM events),
         p AS (SELECT median(value) AS m, max(s) AS mx FROM e)
       SELECT event_id, round(ln(1 + value), 9) AS amount_log, CAST(floor(s / 3600) AS BIGINT) % 24 AS hour,
         round(sin(2 * pi() * (CAST(floor(s / 3600) AS BIGINT) % 24) / 24), 9) + 0 AS hour_sin, round(cos(2 * pi() * (CAST(floor(s / 3600) AS BIGINT) % 24) / 24), 9) + 0 AS hour_cos,
         round(value / (m + 1e-9), 9) AS amount_to_median, (value < 1)::INT AS is_micro, round(s / mx, 9) AS time_norm FROM e, p""",
)
def _(t):
    start = t.events.agg(F.min("ts").alias("t0"))
    e = t.events.join(F.broadcast(start)).select("event_id", "value", elapsed_seconds("ts", "t0").alias("seconds"))
    out = features.TransactionFeatures.fit(e, "value", "seconds").transform(e, "value", "seconds")
    r9 = [F.round(c, 9).alias(c) for c in ("amount_log", "amount_to_median", "time_norm")]
    return out.select("event_id", "hour", "is_micro", *r9, *[(F.round(c, 9) + 0).alias(c) for c in ("hour_sin", "hour_cos")])


@query(
    "j20_bucket_and_sum",
    "SELECT c_custkey, CAST(floor(c_acctbal / 15) * 15 AS BIGINT) AS bucket, c_nationkey + length(c_mktsegment) AS relatives FROM customer",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        floor_bucket("c_acctbal", 15).alias("bucket"),
        (F.col("c_nationkey") + F.length("c_mktsegment")).alias("relatives"),
    )


@query(
    "j21_income_category",
    """SELECT cat, count(*) AS n FROM (SELECT CASE WHEN x <= 0 THEN NULL WHEN x <= 1.5 THEN 1 WHEN x <= 3 THEN 2 WHEN x <= 4.5 THEN 3 WHEN x <= 6 THEN 4 ELSE 5 END AS cat
       FROM (SELECT o_totalprice / 80000 AS x FROM orders)) GROUP BY 1""",
)
def _(t):
    cat = cut(F.col("o_totalprice") / 80000, [0, 1.5, 3.0, 4.5, 6.0, float("inf")], [1, 2, 3, 4, 5])
    return t.orders.groupBy(cat.alias("cat")).agg(F.count("*").alias("n"))


@query(
    "j22_shift_augmentation",
    """WITH s AS (SELECT unnest([{dx: 0, dy: 0}, {dx: 1, dy: 0}, {dx: -1, dy: 0}, {dx: 0, dy: 1}, {dx: 0, dy: -1}], recursive := true)),
        c AS (SELECT vec_id, label, dx, dy, i, i % 8 - dx AS x, i // 8 - dy AS y, embedding FROM embeddings, s, (SELECT unnest(range(64)) AS i))
       SELECT vec_id, label, dx, dy, round(sum(CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN CAST(embedding[y * 8 + x + 1] AS DOUBLE) * (i + 1) ELSE 0 END), 6) AS checksum
       FROM c GROUP BY ALL""",
)
@query(
    "h2_augmentation_union",
    """WITH s AS (SELECT unnest([{dx: 0, dy: 0}, {dx: 1, dy: 0}, {dx: -1, dy: 0}, {dx: 0, dy: 1}, {dx: 0, dy: -1}], recursive := true)),
        c AS (SELECT vec_id, label, dx, dy, i, i % 8 - dx AS x, i // 8 - dy AS y, embedding FROM embeddings, s, (SELECT unnest(range(64)) AS i))
       SELECT vec_id, label, dx, dy, round(sum(CASE WHEN x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 THEN CAST(embedding[y * 8 + x + 1] AS DOUBLE) * (i + 1) ELSE 0 END), 6) AS checksum
       FROM c GROUP BY ALL""",
)
def _(t):
    out = features.shift_augment(t.embeddings.select("vec_id", "label", "embedding"), "embedding", 8)
    weighted = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    checksum = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", "label", "dx", "dy", F.round(checksum, 6).alias("checksum"))


@query(
    "u2_custom_stage",
    f"""WITH p AS (SELECT {KEYS}, l_discount FROM {LINE_NULLS_SQL}), i AS (SELECT {KEYS}, coalesce(l_discount, (SELECT median(l_discount) FROM p)) AS d FROM p)
       SELECT {KEYS}, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 7) + 0 AS l_discount FROM i""",
)
def _(t):
    """An estimator of our own is fitted, saved, loaded and applied."""
    from granary.models.spark_ml import MedianScale, MedianScaleModel
    from granary.session import fresh_path

    df = line_nulls(t).select(*LINE_KEY, "l_discount")
    path = fresh_path(t.spark, "stage")
    MedianScale(["l_discount"]).fit(df).write().save(path)
    return MedianScaleModel.load(path).transform(df).withColumn("l_discount", F.round("l_discount", 7) + 0)


@query("j23_noise")
def _(t):
    noisy = features.add_noise(t.embeddings, "embedding", "vec_id", 100, 42, 0.001)
    return noisy.select("vec_id", "label", F.round(F.array_max("embedding"), 6).alias("max"), F.round(F.array_min("embedding"), 6).alias("min"))


@query("j24_cluster_similarity")
def _(t):
    from granary.models.spark_ml import weighted_kmeans

    points = t.customer.select(
        "c_custkey", F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("v"), (F.abs("c_acctbal") + 1).alias("w")
    )
    centres = weighted_kmeans(points, "v", 10, 42, weight="w")
    sims = features.centre_similarity("v", centres, 0.1)
    return points.select("c_custkey", *sims)


@query("j25_column_transformer")
def _(t):
    from granary.models.spark_ml import column_transformer

    df = line_nulls(t)
    model = column_transformer(
        median_scaled=["l_quantity", "l_discount"], log_scaled=["l_extendedprice"], one_hot=["l_returnflag"], remainder=["l_linenumber"]
    ).fit(df)
    out = model.transform(df)
    return out.select(*LINE_KEY, F.col("features").cast("string").alias("features"))


@query(
    "j26_score_from_partial_input",
    """WITH m AS (SELECT median(p_size) AS s, avg(p_retailprice) AS g FROM part),
         e AS (SELECT p_brand, count(*) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1)
       SELECT p_partkey, coalesce(x.p_size, m.s) AS p_size, round(CASE WHEN e.n IS NULL THEN g ELSE (e.s + g) / (e.n + 1) END, 6) AS brand_mean, """
    + ", ".join(f"coalesce(x.p_type = '{c}', false)::INT::DOUBLE AS p_type_{c}" for c in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + f""", round(ln(1 + p_retailprice), 9) AS log_price FROM (SELECT * REPLACE (CASE WHEN p_partkey % 13 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand) FROM {PART_NULLS_SQL}) x LEFT JOIN e USING (p_brand), m""",
)
def _(t):
    """Parameters are fitted on complete rows; inputs may lack values or hold new categories."""
    fitted = t.part
    asked = part_nulls(t).withColumn(
        "p_brand", F.when(F.col("p_partkey") % 13 == 0, "Brand#new").otherwise(F.col("p_brand"))
    )
    defaults = clean.Imputer.fit(fitted, {"p_size": ("median", None)})
    brand = encode.TargetEncoding.fit(fitted, "p_brand", "p_retailprice")
    cats = encode.categories_of(fitted, "p_type")
    log = features.LogTransform(("log_price",))
    rows = brand.transform(defaults.transform(asked), "brand_mean")
    rows = log.transform(rows.withColumn("log_price", F.col("p_retailprice")))
    return rows.select(
        "p_partkey",
        F.col("p_size").cast("double").alias("p_size"),
        F.round("brand_mean", 6).alias("brand_mean"),
        *encode.one_hot("p_type", cats),
        F.round("log_price", 9).alias("log_price"),
    )


@query(
    "j27_encoding_lookup",
    """SELECT p_brand, count(*) AS n, round((sum(p_retailprice) + (SELECT avg(p_retailprice) FROM part)) / (count(*) + 1), 6) AS encoding FROM part GROUP BY 1""",
)
def _(t):
    m = encode.TargetEncoding.fit(t.part, "p_brand", "p_retailprice").mapping
    return m.withColumn("encoding", F.round("encoding", 6))


@query(
    "j28_finite_check",
    f"""SELECT 'l_discount' AS feature, count(*) FILTER (l_discount IS NULL) AS nulls, 0 AS nans, 0 AS infinite FROM {LINE_NULLS_SQL}
       UNION ALL SELECT 'inv_tax', count(*) FILTER (l_tax IS NULL), 0, count(*) FILTER (l_tax = 0) FROM {LINE_NULLS_SQL}
       UNION ALL SELECT 'root', 0, count(*) FILTER (l_quantity < 25), 0 FROM {LINE_NULLS_SQL}""",
)
def _(t):
    inf = F.lit(float("inf"))
    df = line_nulls(t).select(
        "l_discount",
        F.when(F.col("l_tax").isNotNull(), F.coalesce(F.try_divide(F.lit(1.0), "l_tax"), inf)).alias("inv_tax"),
        F.when(F.col("l_quantity") < 25, F.lit(float("nan"))).otherwise(F.sqrt("l_quantity")).alias("root"),
    )
    return profile.finite_report(df, ["l_discount", "inv_tax", "root"])


@query(
    "u3_function_with_inverse",
    f"SELECT {KEYS}, round(ln(l_extendedprice), 9) AS log_l_extendedprice, round(exp(ln(l_extendedprice)), 4) AS l_extendedprice FROM lineitem",
)
@query(
    "j29_function_transformer",
    f"SELECT {KEYS}, round(ln(l_extendedprice), 9) AS log_l_extendedprice, round(exp(ln(l_extendedprice)), 4) AS l_extendedprice FROM lineitem",
)
def _(t):
    ft = features.ColumnTransform(("l_extendedprice",), F.log, F.exp, lambda c: f"log_{c}")
    out = ft.inverse(ft.transform(t.lineitem))
    return out.select(*LINE_KEY, F.round("log_l_extendedprice", 9).alias("log_l_extendedprice"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


# ---------------------------------------------------------------- K scaling

Z_SQL = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 7) + 0 AS {c}" for c in LINE_NUM)


@query("k1_standard_scaler", f"SELECT {KEYS}, {Z_SQL}, round(l_tax, 6) AS restored FROM lineitem")
def _(t):
    df = t.lineitem.select(*LINE_KEY, *LINE_NUM)
    s = StandardScaler.fit(df, LINE_NUM)
    z = s.transform(df)
    back = F.round(F.col("l_tax") * s.std["l_tax"] + s.mean["l_tax"], 6)
    return z.select(*LINE_KEY, *[(F.round(c, 7) + 0).alias(c) for c in LINE_NUM], back.alias("restored"))


@query(
    "k2_scaler_without_mean",
    f"SELECT {KEYS}, round(l_quantity / stddev_pop(l_quantity) OVER (), 8) AS l_quantity FROM lineitem",
)
def _(t):
    df = t.lineitem.select(*LINE_KEY, "l_quantity")
    return StandardScaler.fit(df, ["l_quantity"], with_mean=False, guard_zero=False).transform(df).withColumn("l_quantity", F.round("l_quantity", 8))


@query(
    "k3_min_max_scaler",
    f"""SELECT {KEYS}, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()) * 2 - 1, 9) + 0 AS scaled,
         l_extendedprice FROM lineitem""",
)
def _(t):
    df = t.lineitem.select(*LINE_KEY, F.col("l_extendedprice").alias("x"))
    s = MinMaxScaler.fit(df, ["x"], (-1.0, 1.0))
    z = s.transform(df).withColumn("scaled", F.round("x", 9) + 0)
    return s.inverse(z).select(*LINE_KEY, "scaled", F.round("x", 4).alias("l_extendedprice"))


@query(
    "k4_impute_and_scale",
    f"""WITH p AS (SELECT {KEYS}, l_discount FROM {LINE_NULLS_SQL}), i AS (SELECT {KEYS}, coalesce(l_discount, (SELECT median(l_discount) FROM p)) AS d FROM p)
       SELECT {KEYS}, round((d - avg(d) OVER ()) / stddev_pop(d) OVER (), 7) + 0 AS l_discount FROM i""",
)
def _(t):
    df = line_nulls(t).select(*LINE_KEY, "l_discount")
    filled = clean.Imputer.fit(df, {"l_discount": ("median", None)}).transform(df)
    return StandardScaler.fit(filled, ["l_discount"]).transform(filled).withColumn("l_discount", F.round("l_discount", 7) + 0)


# ---------------------------------------------------------------- L splits


@query(
    "l1_train_test_split",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY md5(o_orderkey || ':42')) <= floor(count(*) OVER () * CAST(0.2 AS DOUBLE)))::INT AS is_test FROM orders""",
)
def _(t):
    return split.train_test_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.2, 42)


@query(
    "l2_temporal_split",
    """SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) > floor(count(*) OVER () * CAST(0.8 AS DOUBLE)))::INT AS is_test FROM orders""",
)
def _(t):
    return split.temporal_split(t.orders, "o_orderdate", "o_orderkey", 0.2).select("o_orderkey", "is_test")


@query(
    "l3_stratified_split",
    """SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42')) <= floor(count(*) OVER (PARTITION BY quality) * CAST(0.2 AS DOUBLE)))::INT AS is_test FROM labels""",
)
def _(t):
    return split.train_test_split(t.labels.select("doc_id", "quality"), ["doc_id"], 0.2, 42, ["quality"])


@query(
    "l4_repeated_stratified_split",
    """SELECT doc_id, quality, repeat, (row_number() OVER (PARTITION BY repeat, quality ORDER BY md5(repeat || '|' || doc_id || ':42'))
         <= floor(count(*) OVER (PARTITION BY repeat, quality) * CAST(0.2 AS DOUBLE)))::INT AS is_test FROM labels, (SELECT unnest(range(10)) AS repeat)""",
)
def _(t):
    return split.repeated_stratified_split(t.labels.select("doc_id", "quality"), ["doc_id"], 0.2, 10, 42, "quality")


@query(
    "l5_minority_plus_sample",
    """SELECT event_id, event_type FROM events WHERE event_type = 'error' UNION ALL
       (SELECT event_id, event_type FROM events WHERE event_type <> 'error' ORDER BY md5(event_id || ':42') LIMIT 4607)""",
)
def _(t):
    e = t.events.select("event_id", "event_type").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return split.sample_majority(e, ["event_id"], "y", 1, 4607, 42).drop("y")


FOLD_SQL = """CASE WHEN r < (n % {k}) * (n // {k} + 1) THEN r // (n // {k} + 1)
  ELSE (n % {k}) + (r - (n % {k}) * (n // {k} + 1)) // (n // {k}) END"""


@query(
    "l6_kfold",
    f"""SELECT o_orderkey, {FOLD_SQL.format(k=7)} AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey || ':42')) - 1 AS r, count(*) OVER () AS n FROM orders)""",
)
def _(t):
    return split.kfold(t.orders.select("o_orderkey"), ["o_orderkey"], 7, 42)


@query(
    "u8_fold_rows",
    f"""SELECT o_orderkey, repeat, {FOLD_SQL.format(k=5)} AS fold FROM (SELECT o_orderkey, repeat, row_number() OVER (PARTITION BY repeat ORDER BY md5(repeat || '|' || o_orderkey || ':42')) - 1 AS r,
         count(*) OVER (PARTITION BY repeat) AS n FROM orders, (SELECT unnest(range(3)) AS repeat))""",
)
@query(
    "l7_repeated_kfold",
    f"""SELECT o_orderkey, repeat, {FOLD_SQL.format(k=5)} AS fold FROM (SELECT o_orderkey, repeat, row_number() OVER (PARTITION BY repeat ORDER BY md5(repeat || '|' || o_orderkey || ':42')) - 1 AS r,
         count(*) OVER (PARTITION BY repeat) AS n FROM orders, (SELECT unnest(range(3)) AS repeat))""",
)
def _(t):
    return split.repeated_kfold(t.orders.select("o_orderkey"), ["o_orderkey"], 5, 3, 42)


STRATIFIED_SQL = f"""SELECT doc_id, toxic, {FOLD_SQL.format(k=5)} AS fold FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id || ':42')) - 1 AS r,
  count(*) OVER (PARTITION BY toxic) AS n FROM labels)"""


@query("l9_stratified_kfold", STRATIFIED_SQL)
def _(t):
    return split.kfold(t.labels.select("doc_id", "toxic"), ["doc_id"], 5, 42, ["toxic"])


@query(
    "l10_stratified_fold_rates",
    f"SELECT fold, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives FROM ({STRATIFIED_SQL}) GROUP BY fold",
)
def _(t):
    folded = split.kfold(t.labels.select("doc_id", "toxic"), ["doc_id"], 5, 42, ["toxic"])
    return folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("toxic").alias("positives"))


@query(
    "l11_positional_split",
    "SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) > floor(count(*) OVER () * 6 / 7.0::DOUBLE))::INT AS is_test FROM embeddings",
)
def _(t):
    df = t.embeddings.select("vec_id", "label")
    n = df.count()
    first = split.first_rows(df, ["vec_id"], int(n * 6 / 7), n)
    return df.withColumn("is_test", F.when(first, 0).otherwise(1))


