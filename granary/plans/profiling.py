"""Profiling queries."""

from pyspark.sql import functions as F

from granary.functions.scalars import elapsed_seconds, hour_of
from granary.operators import profile as P
from granary.operators.quantiles import quantile_row
from granary.operators.ranking import global_row_number
from granary.plans.common import (
    LINE_LONG_SQL,
    LINE_NULLS_SQL,
    LINE_NUM,
    PART_NULLS_SQL,
    line_nulls,
    part_nulls,
)
from granary.plans.registry import query


@query(
    "b1_shape_head_tail",
    """SELECT 'head' AS side, o_orderkey, o_totalprice, n FROM
        (SELECT *, count(*) OVER () AS n FROM orders) ORDER BY o_orderkey LIMIT 5""".join(
        ["SELECT * FROM (", ") UNION ALL SELECT * FROM ("]
    )
    + """SELECT 'tail' AS side, o_orderkey, o_totalprice, n FROM
        (SELECT *, count(*) OVER () AS n FROM orders) ORDER BY o_orderkey DESC LIMIT 5)""",
)
def _(t):
    o = t.orders.select("o_orderkey", "o_totalprice")
    n = t.orders.agg(F.count("*").alias("n"))
    head = o.orderBy("o_orderkey").limit(5).select(F.lit("head").alias("side"), "*")
    tail = o.orderBy(F.desc("o_orderkey")).limit(5).select(F.lit("tail").alias("side"), "*")
    return head.unionByName(tail).join(F.broadcast(n))


@query(
    "b2_infer_types",
    """WITH c AS (SELECT 'event_id' AS feature, CAST(event_id AS VARCHAR) AS v FROM events
        UNION ALL SELECT 'value', CAST(value AS VARCHAR) FROM events
        UNION ALL SELECT 'k', json_extract_string(props, '$.k') FROM events
        UNION ALL SELECT 'event_type', event_type FROM events
        UNION ALL SELECT 'absent', json_extract_string(props, '$.absent') FROM events)
       SELECT feature, count(v) AS non_null, CASE WHEN count(v) = 0 THEN 'unknown'
         WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) AND
              count(*) FILTER (TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))) = count(v) THEN 'int64'
         WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) THEN 'float64' ELSE 'object' END AS dtype
       FROM c GROUP BY feature""",
)
def _(t):
    e = t.events.select(
        "event_id",
        "value",
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.absent").alias("absent"),
    )
    return P.inferred_types(e, ["event_id", "value", "k", "event_type", "absent"])


@query(
    "b3_describe",
    f"""SELECT feature, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 6) AS std,
        min(v) AS min, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
        quantile_cont(v, 0.75) AS q75, max(v) AS max FROM {LINE_LONG_SQL} GROUP BY feature""",
)
def _(t):
    d = P.describe(t.lineitem, LINE_NUM)
    return d.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 6)})


@query(
    "b4_null_counts",
    """WITH j AS (SELECT c.c_custkey, o.o_orderkey, o.o_totalprice, o.o_orderpriority FROM customer c
        LEFT JOIN orders o ON c.c_custkey = o.o_custkey)
       SELECT 'c_custkey' AS feature, count(*) - count(c_custkey) AS nulls, count(*) AS n FROM j
       UNION ALL SELECT 'o_orderkey', count(*) - count(o_orderkey), count(*) FROM j
       UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(*) FROM j
       UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(*) FROM j""",
)
def _(t):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return P.null_counts(j, ["c_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"])


PART_NULL_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
PART_MISSING_SQL = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, "
    f"round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) AS pct FROM {PART_NULLS_SQL}"
    for c in PART_NULL_COLS
) + ") WHERE nulls > 0"


@query("b5_missing_report", PART_MISSING_SQL)
def _(t):
    return P.missing_report(part_nulls(t))


@query(
    "b6_missing_strategy",
    f"""SELECT *, CASE WHEN pct > 80 THEN 'drop' WHEN regexp_matches(feature, 'brand') THEN 'fill_none'
        WHEN regexp_matches(feature, 'price') THEN 'fill_zero' WHEN feature = 'p_type' THEN 'mode'
        ELSE 'median' END AS strategy FROM ({PART_MISSING_SQL})""",
)
def _(t):
    return P.missing_strategy(part_nulls(t), "brand", "price")


@query(
    "b7_value_counts",
    "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1",
)
def _(t):
    return P.value_counts(t.events, "event_type")


@query(
    "b8_class_shares",
    """SELECT quality, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share,
       round(max(n) OVER ()::DOUBLE / n, 9) AS imbalance
       FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)""",
)
def _(t):
    d = P.class_shares(t.labels, "quality")
    return d.withColumns({"share": F.round("share", 9), "imbalance": F.round("imbalance", 9)})


@query(
    "b9_cardinality",
    "SELECT * , CASE WHEN n_unique > 10 THEN 'high' ELSE 'low' END AS kind FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique FROM part"
        for c in ("p_name", "p_brand", "p_type", "p_size")
    )
    + ")",
)
def _(t):
    return P.cardinalities(t.part, ["p_name", "p_brand", "p_type", "p_size"])


@query(
    "b10_skewness",
    """SELECT feature, round(skew, 8) AS skew FROM (
        SELECT 'value' AS feature, skewness(value) AS skew FROM events
        UNION ALL SELECT 'value_sq', skewness(value * value) FROM events
        UNION ALL SELECT 'event_id', skewness(event_id) FROM events) WHERE abs(skew) > 0.5""",
)
def _(t):
    e = t.events.withColumn("value_sq", F.col("value") * F.col("value"))
    d = P.skewed_columns(e, ["value", "value_sq", "event_id"], 0.5)
    return d.withColumn("skew", F.round("skew", 8))


@query(
    "b11_histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
       SELECT least(CAST(floor((o_totalprice - lo) / (hi - lo) * 50) AS INT) + 1, 50) AS bin,
        count(*) AS n, min(o_totalprice) AS min_x, max(o_totalprice) AS max_x
       FROM orders, b GROUP BY 1""",
)
def _(t):
    return P.histogram(t.orders, "o_totalprice", 50)


PAIRS = [(a, b) for i, a in enumerate(LINE_NUM) for b in LINE_NUM[i + 1 :]]
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) + 0.0 AS r FROM lineitem" for a, b in PAIRS
)


@query(
    "b12_correlation_matrix",
    f"""WITH p AS ({PAIRS_SQL}) SELECT a, b, r FROM p UNION ALL SELECT b, a, r FROM p UNION ALL
        SELECT feature, feature, 1.0::DOUBLE FROM {LINE_LONG_SQL} GROUP BY feature""",
)
def _(t):
    d = P.correlation_matrix(t.lineitem, LINE_NUM)
    return d.withColumn("r", F.round("r", 8) + 0.0)


@query(
    "b13_target_correlation",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, l_extendedprice), 8) AS r FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")
    ),
)
def _(t):
    d = P.target_correlation(
        t.lineitem, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice"
    )
    return d.withColumn("r", F.round("r", 8)).orderBy(F.desc("r"), "feature")


#: the columns of a line and two that follow from them
NET = "l_extendedprice * (1 - l_discount)"
MORE_SQL = f"(SELECT *, {NET} AS net, {NET} * (1 + l_tax) AS charge FROM lineitem)"
MORE_NUM = [*LINE_NUM, "net", "charge"]


def priced_lines(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return t.lineitem.withColumns({"net": net, "charge": net * (1 + F.col("l_tax"))})


@query(
    "b14_correlated_pairs",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) + 0.0 AS r FROM {MORE_SQL}" for i, a in enumerate(MORE_NUM) for b in MORE_NUM[i + 1 :]
    )
    + ") WHERE abs(r) > 0.8",
)
def _(t):
    d = P.correlation_pairs(priced_lines(t), MORE_NUM)
    return d.where(F.abs("r") > 0.8).withColumn("r", F.round("r", 8))


@query(
    "b15_class_separation",
    f"""SELECT * FROM (SELECT feature, round(avg(v) FILTER (r), 4) AS mean_pos,
         round(avg(v) FILTER (NOT r), 4) AS mean_neg, round(stddev(v) FILTER (r), 4) AS std_pos,
         round(stddev(v) FILTER (NOT r), 4) AS std_neg,
         round(abs(avg(v) FILTER (r) - avg(v) FILTER (NOT r)) / (stddev(v) FILTER (NOT r) + 1e-10), 6) AS separation
       FROM (SELECT l_extendedprice > 50000 AS r, net, charge, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount FROM {MORE_SQL})
         UNPIVOT (v FOR feature IN (net, charge, l_quantity, l_discount)) GROUP BY feature)
       WHERE separation > 0.5""",
)
def _(t):
    d = P.class_separation(
        priced_lines(t), ["net", "charge", "l_quantity", "l_discount"], F.col("l_extendedprice") > 50000, 0.5
    )
    return d.select(
        "feature",
        *[F.round(c, 4).alias(c) for c in ("mean_pos", "mean_neg", "std_pos", "std_neg")],
        F.round("separation", 6).alias("separation"),
    )


@query(
    "b16_subset_percentiles",
    """SELECT p AS prob, quantile_cont(value, p) AS value FROM events,
       (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p) WHERE event_type = 'error' GROUP BY p""".replace(
        "quantile_cont(value, p)",
        "CASE p " + " ".join(f"WHEN {p} THEN round(quantile_cont(value, {p}), 9)" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " END",
    ).replace("SELECT p AS prob", "SELECT CAST(p AS DOUBLE) AS prob"),
)
def _(t):
    errors = t.events.where("event_type = 'error'")
    out = P.sample_percentiles(errors, "value", [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    return out.withColumn("value", F.round("value", 9))


@query(
    "b17_rate_by_hour",
    """WITH e AS (SELECT CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600) AS BIGINT) % 48 AS hour,
         event_type FROM events)
       SELECT hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS positives,
        round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 9) AS rate
       FROM e GROUP BY hour ORDER BY rate DESC, hour LIMIT 5""",
)
def _(t):
    e = t.events.join(F.broadcast(t.events.agg(F.min("ts").alias("t0"))))
    by_hour = e.groupBy(hour_of(elapsed_seconds("ts", "t0"), 48).alias("hour")).agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("positives")
    )
    return (
        by_hour.withColumn("rate", F.round(F.col("positives") / F.col("n"), 9))
        .orderBy(F.desc("rate"), "hour")
        .limit(5)
    )


@query(
    "b18_group_quartiles",
    """SELECT year(o_orderdate) AS y, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean,
        round(quantile_cont(o_totalprice, 0.25), 6) AS q25, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
        round(quantile_cont(o_totalprice, 0.75), 6) AS q75 FROM orders GROUP BY 1, 2""",
)
def _(t):
    o = t.orders.select(F.year("o_orderdate").alias("y"), "o_orderpriority", "o_totalprice")
    keys = ["y", "o_orderpriority"]
    stats = o.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    c = "o_totalprice"
    q = quantile_row(o, {"q25": (c, 0.25), "median": (c, 0.5), "q75": (c, 0.75)}, keys)
    out = stats.join(q, keys).orderBy("y", "median")
    return out.withColumns({k: F.round(k, 6) for k in ("q25", "median", "q75")})


@query(
    "b19_iqr_outliers",
    """WITH e AS (SELECT feature, v, n FROM (SELECT value AS value, value * value AS value_sq, 1 AS n FROM events)
          UNPIVOT (v FOR feature IN (value, value_sq))),
        b AS (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM e GROUP BY feature)
       SELECT feature, count(*) FILTER (v < q1 - (q3 - q1) * 1.5 OR v > q3 + (q3 - q1) * 1.5) AS n_out,
         round(100.0::DOUBLE * count(*) FILTER (v < q1 - (q3 - q1) * 1.5 OR v > q3 + (q3 - q1) * 1.5) / count(*), 6) AS pct
       FROM e JOIN b USING (feature) GROUP BY feature""",
)
def _(t):
    e = t.events.withColumn("value_sq", F.col("value") * F.col("value"))
    return P.iqr_outliers(e, ["value", "value_sq"]).withColumn("pct", F.round("pct", 6))


@query(
    "b20_trend_line",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
        round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""",
)
def _(t):
    return t.lineitem.agg(
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"),
    )


@query("b21_normal_qq")
def _(t):
    """Order statistics against normal quantiles at the medians of uniform order statistics."""
    from granary.operators.evaluate import normal_quantile

    ranked = global_row_number(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")
    n = t.orders.agg(F.count("*").alias("n"))
    p = (
        F.when(F.col("rn") == 1, 1 - F.pow(F.lit(0.5), 1 / F.col("n")))
        .when(F.col("rn") == F.col("n"), F.pow(F.lit(0.5), 1 / F.col("n")))
        .otherwise((F.col("rn") - 0.3175) / (F.col("n") + 0.365))
    )
    return ranked.join(F.broadcast(n)).select(
        "rn", F.col("o_totalprice").alias("ordered"), normal_quantile(p).alias("theoretical")
    )


@query(
    "b22_eda_summary",
    f"""SELECT count(*) AS n_rows, 11 AS n_columns, count(*) FILTER (l_discount IS NULL OR l_tax IS NULL) AS rows_with_nulls,
        round(avg(l_extendedprice), 4) AS target_mean, min(l_extendedprice) AS target_min,
        max(l_extendedprice) AS target_max,
        CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= abs(corr(l_discount, l_extendedprice))
              AND abs(corr(l_quantity, l_extendedprice)) >= abs(corr(l_tax, l_extendedprice)) THEN 'l_quantity'
             WHEN abs(corr(l_discount, l_extendedprice)) >= abs(corr(l_tax, l_extendedprice)) THEN 'l_discount'
             ELSE 'l_tax' END AS top_feature,
        round(greatest(abs(corr(l_quantity, l_extendedprice)), abs(corr(l_discount, l_extendedprice)),
          abs(corr(l_tax, l_extendedprice))), 8) AS top_corr FROM {LINE_NULLS_SQL}""",
)
def _(t):
    df = line_nulls(t)
    top = [F.struct(F.abs(F.corr(c, "l_extendedprice")).alias("a"), F.lit(c).alias("c")) for c in ("l_quantity", "l_discount", "l_tax")]
    best = F.array_max(F.array(*top))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.count_if(F.col("l_discount").isNull() | F.col("l_tax").isNull()).alias("rows_with_nulls"),
        F.round(F.avg("l_extendedprice"), 4).alias("target_mean"),
        F.min("l_extendedprice").alias("target_min"),
        F.max("l_extendedprice").alias("target_max"),
        best["c"].alias("top_feature"),
        F.round(best["a"], 8).alias("top_corr"),
    )


@query(
    "b23_extreme_rows",
    """SELECT label, count(*) AS n, count(*) FILTER (x) AS n_extreme,
        round(count(*) FILTER (x)::DOUBLE / count(*), 9) AS rate
       FROM (SELECT label, len(list_filter(embedding, lambda v: abs(v) > CAST(0.35 AS FLOAT))) > 0 AS x FROM embeddings) GROUP BY label""",
)
def _(t):
    flagged = t.embeddings.select(
        "label",
        F.exists("embedding", lambda v: F.abs(v) > F.lit(0.35).cast("float")).alias("x"),
    )
    return flagged.groupBy("label").agg(
        F.count("*").alias("n"),
        F.count_if("x").alias("n_extreme"),
        F.round(F.avg(F.col("x").cast("int")), 9).alias("rate"),
    )


@query(
    "b24_table_kpis",
    """SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, min(o_totalprice) AS min_price,
       max(o_totalprice) AS max_price FROM orders""",
)
def _(t):
    return t.orders.agg(
        F.count("*").alias("n"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"),
        F.min("o_totalprice").alias("min_price"),
        F.max("o_totalprice").alias("max_price"),
    )


@query(
    "b25_category_lists",
    f"""SELECT DISTINCT 'p_brand' AS feature, p_brand AS value FROM part WHERE p_brand IS NOT NULL
        UNION ALL SELECT DISTINCT 'p_type', p_type FROM {PART_NULLS_SQL} WHERE p_type IS NOT NULL""",
)
def _(t):
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in ("p_brand", "p_type")])
    return (
        part_nulls(t).select(F.inline(pairs)).where("value IS NOT NULL").distinct().orderBy("feature", "value")
    )


