"""Scoring, window and monitoring queries."""

from pyspark.sql import functions as F

from granary.operators import drift, scoring
from granary.operators.filters import head_per_group
from granary.operators.quantiles import exact_quantiles, quantile_row
from granary.plans.common import LINE_KEY, PART_NULLS_SQL, SCORED_SQL, part_nulls, scored_events
from granary.plans.modeling import REG
from granary.plans.registry import query
from granary.sources import payloads

KEYS = ", ".join(LINE_KEY)

# ---------------------------------------------------------------- P bulk scoring


def dirty_lines(t):
    c = F.col
    return t.lineitem.select(
        *LINE_KEY,
        F.when(c("l_linenumber") == 3, float("nan")).otherwise(c("l_tax")).alias("a"),
        F.when(c("l_quantity") == 50, float("inf")).when(c("l_quantity") == 1, float("-inf")).otherwise(c("l_extendedprice")).alias("b"),
    )


@query(
    "p1_input_repair",
    f"""SELECT {KEYS}, CASE WHEN l_linenumber = 3 THEN 0 ELSE l_tax END AS a, CASE WHEN l_quantity = 50 THEN 1e10 WHEN l_quantity = 1 THEN -1e10 ELSE l_extendedprice END AS b FROM lineitem""",
)
def _(t):
    return scoring.repair(dirty_lines(t), ["a", "b"])


@query(
    "p1_repair_warnings",
    """SELECT 'a' AS feature, count(*) FILTER (l_linenumber = 3) AS filled, 0 AS clipped FROM lineitem UNION ALL SELECT 'b', 0, count(*) FILTER (l_quantity IN (1, 50)) FROM lineitem""",
)
def _(t):
    return scoring.repair_warnings(dirty_lines(t), ["a", "b"])


@query(
    "p2_transaction_validation",
    """WITH e AS (SELECT event_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)
       SELECT event_id, CASE WHEN event_type = 'click' AND value < 10 THEN 'Missing field: V1' WHEN event_type = 'view' AND value < 10 THEN 'Field V1 must be numeric'
         WHEN value - 5 < 0 THEN 'Field Amount must be >= 0' END AS error FROM e""",
)
def _(t):
    v = F.col("value")
    small = v < 10
    fields = F.map_filter(
        F.create_map(
            F.lit("V1"),
            F.when((F.col("event_type") == "click") & small, None).when((F.col("event_type") == "view") & small, "?").otherwise(F.get_json_object("props", "$.k")),
            F.lit("Amount"),
            (v - 5).cast("string"),
            F.lit("Time"),
            F.lit("10"),
        ),
        lambda k, x: x.isNotNull(),
    )
    return t.events.select("event_id", payloads.first_error(fields, {"V1": False, "Amount": True, "Time": True}).alias("error"))


@query(
    "p3_log_price_prediction",
    f"""SELECT {KEYS}, round(CASE WHEN x > 15 THEN 180000 ELSE greatest(0, least(exp(x) - 1, 2000000)) END, 4) AS price FROM
        (SELECT {KEYS}, ln(1 + l_extendedprice) + (l_quantity - 20) * 0.15::DOUBLE AS x FROM lineitem)""",
)
def _(t):
    x = F.log1p("l_extendedprice") + (F.col("l_quantity") - 20) * 0.15
    return t.lineitem.select(*LINE_KEY, F.round(scoring.price_from_log(x, 180000.0), 4).alias("price"))


@query(
    "p4_prediction_interval",
    f"""SELECT {KEYS}, greatest(0, least(2000000, l_extendedprice * 20 - 1.96::DOUBLE * 25000.0)) AS low, greatest(0, least(2000000, l_extendedprice * 20 + 1.96::DOUBLE * 25000.0)) AS high FROM lineitem""",
)
def _(t):
    low, high = scoring.interval(F.col("l_extendedprice") * 20, 25000.0)
    return t.lineitem.select(*LINE_KEY, low.alias("low"), high.alias("high"))


@query(
    "p5_risk_scoring",
    f"""SELECT event_id, (score >= 8.32)::INT AS flagged, round(1 / (1 + exp(-0.1::DOUBLE * score)), 9) AS risk_norm,
        CASE WHEN abs(score - 8.32) > 5 THEN 'high' WHEN abs(score - 8.32) > 2 THEN 'medium' ELSE 'low' END AS confidence FROM {SCORED_SQL}""",
)
def _(t):
    # fixed value: tuned threshold
    out = scored_events(t).select("event_id", *[c.alias(n) for n, c in scoring.risk_columns("score", 8.32).items()])
    return out.withColumn("risk_norm", F.round("risk_norm", 9))


@query(
    "p6_explanations",
    """WITH e AS (SELECT event_id, value * 4 AS amount, hour(ts) AS h, value * 4 / (median(value * 4) OVER () + 1e-9) AS ratio, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
        x AS (SELECT event_id, concat_ws('; ', CASE WHEN amount < 1 THEN 'micro-transaction (' || printf('%.2f', amount) || ')' WHEN amount > 1000 THEN 'large amount (' || printf('%.2f', amount) || ')'
          WHEN ratio > 10 THEN 'large relative to median (' || printf('%.2f', amount) || ')' END, CASE WHEN h IN (2, 3, 4) THEN 'off-hours (hour ' || printf('%02d', h) || ')' END,
          CASE WHEN k < 5 THEN 'low k' END) AS s FROM e)
       SELECT event_id, CASE WHEN s = '' THEN 'combination of behavioral features' ELSE s END AS explanation FROM x""",
)
def _(t):
    e = t.events.withColumn("amount", F.col("value") * 4)
    m = quantile_row(e, {"m": ("amount", 0.5)})
    k = F.get_json_object("props", "$.k").cast("long")
    text = scoring.explain("amount", F.hour("ts"), F.col("amount") / (F.col("m") + 1e-9), [(k < 5, F.lit("low k"))])
    return e.join(F.broadcast(m)).select("event_id", text.alias("explanation"))


@query(
    "p6_verdicts",
    """WITH e AS (SELECT event_id, value * 4 AS amount, hour(ts) AS h, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, floor(value * CAST(0.5 AS DOUBLE) - length(event_type)) / 10 + 0 AS score FROM events),
        v AS (SELECT *, k / 10.0::DOUBLE - 6 AS v17, k % 40 / 4.0::DOUBLE - 8 AS v14, k % 50 / 5.0::DOUBLE - 5 AS v12 FROM e),
        x AS (SELECT event_id, score, concat_ws('; ', CASE WHEN amount < 1 THEN 'micro-transaction (' || printf('%.2f', amount) || ')' WHEN amount > 1000 THEN 'large amount (' || printf('%.2f', amount) || ')' END,
          CASE WHEN h IN (2, 3, 4) THEN 'off-hours (hour ' || printf('%02d', h) || ')' END, CASE WHEN v17 < -2 THEN 'V17 anomaly (' || printf('%.2f', v17) || ') — strong fraud signal' END,
          CASE WHEN v14 < -5 THEN 'V14 anomaly (' || printf('%.2f', v14) || ') — strong fraud signal' END, CASE WHEN abs(v12) > 3 THEN 'V12 anomaly (' || printf('%.2f', v12) || ')' END) AS s FROM v)
       SELECT event_id, CASE WHEN score >= 8.32 THEN 'FLAGGED AS FRAUD' ELSE 'Approved' END || ' | risk score ' || printf('%.2f', score) || ' vs threshold 8.32 | Signals: '
         || CASE WHEN s = '' THEN 'combination of behavioral features' ELSE s END AS verdict FROM x""",
)
def _(t):
    """Verdict lines with the signals of three components, here made from the event's own number."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = scored_events(t).join(t.events.select("event_id", k.alias("k")), "event_id").select(
        "event_id",
        "score",
        (F.col("value") * 4).alias("amount"),
        F.hour("ts").alias("hour"),
        (F.col("k") / 10.0 - 6).alias("v17"),
        (F.col("k") % 40 / 4.0 - 8).alias("v14"),
        (F.col("k") % 50 / 5.0 - 5).alias("v12"),
    )
    reasons = scoring.explain("amount", "hour", F.lit(0.0), scoring.anomaly_signals("v17", "v14", "v12"))
    return e.select("event_id", scoring.verdict("score", 8.32, reasons).alias("verdict"))


SIMILAR_SQL = """SELECT p_partkey, round(abs(s - p_size) / rs::DOUBLE + abs(r - p_retailprice) / rr, 9) AS distance FROM {src} p,
  (SELECT p_size AS s, p_retailprice AS r FROM {src} WHERE p_partkey = 7), (SELECT max(p_size) - min(p_size) AS rs, max(p_retailprice) - min(p_retailprice) AS rr FROM {src})
  WHERE p_partkey <> 7 ORDER BY distance, p_partkey LIMIT {n}"""


@query("p7_similar_rows", SIMILAR_SQL.format(src="part", n=5))
@query("d5_nearest_to_one_row", SIMILAR_SQL.format(src="part", n=5))
@query("g3_k_nearest", SIMILAR_SQL.format(src="part", n=5))
def _(t):
    return scoring.similar_rows(t.part, "p_partkey", 7, ["p_size", "p_retailprice", "not_there"], 5).select("p_partkey", "distance")


P8_SQL = f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS a,
    CASE WHEN p_partkey % 6 <> 0 THEN CAST(substr(p_brand, 7) AS DOUBLE) END AS b, p_size::DOUBLE AS s,
    CASE WHEN p_partkey % 4 <> 0 THEN length(p_name)::DOUBLE END AS l FROM {PART_NULLS_SQL}),
  q AS (SELECT k, a, b, CASE WHEN k % 13 = 0 THEN 200000::DOUBLE ELSE s END AS s, l FROM p),
  t AS (SELECT stddev(a) AS da, stddev(b) AS db, stddev(s) AS ds, median(s) AS sm, quantile_cont(s, 0.05) AS s5, quantile_cont(s, 0.95) AS s95,
    median(l) AS lm, quantile_cont(l, 0.05) AS l5, quantile_cont(l, 0.95) AS l95 FROM p),
  d AS (SELECT q.k, r.k AS rk, r.s, r.l, round((coalesce(abs(q.a - r.a) * 2 / da, 0) + coalesce(abs(q.b - r.b) / db, 0))
      / ((q.a IS NOT NULL AND r.a IS NOT NULL)::INT + (q.b IS NOT NULL AND r.b IS NOT NULL)::INT), 9) AS d
    FROM q, p r, t WHERE (q.a IS NOT NULL AND r.a IS NOT NULL) OR (q.b IS NOT NULL AND r.b IS NOT NULL)),
  n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, rk) <= 10),
  f AS (SELECT k, median(s) AS s, median(s) FILTER (abs(s - sm) < 3 * ds) AS s3, median(l) AS l FROM n, t GROUP BY k)
  SELECT q.k AS p_partkey, round(greatest(s5, least(s95, CASE WHEN q.s IS NULL THEN coalesce(f.s, sm) WHEN abs(q.s) > 100000 THEN coalesce(s3, sm) ELSE q.s END)), 6) AS p_size,
    round(greatest(l5, least(l95, coalesce(q.l, f.l, lm))), 6) AS name_length
  FROM q LEFT JOIN f ON f.k = q.k, t"""


@query("p8_fill_from_similar", P8_SQL)
def _(t):
    key = F.col("p_partkey")
    p = part_nulls(t).select(
        "p_partkey",
        F.when(key % 7 != 0, F.col("p_retailprice")).alias("price"),
        F.when(key % 6 != 0, F.substring("p_brand", 7, 9).cast("double")).alias("brand"),
        F.col("p_size").cast("double").alias("p_size"),
        F.when(key % 4 != 0, F.length("p_name").cast("double")).alias("name_length"),
    )
    asked = p.withColumn("p_size", F.when(key % 13 == 0, 200000.0).otherwise(F.col("p_size")))
    out = scoring.fill_from_similar(asked, p, "p_partkey", {"price": 2.0, "brand": 1.0}, ["p_size", "name_length"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("name_length", 6).alias("name_length"))


@query("p9_default_features", f"SELECT 'p_size' AS feature, median(p_size) AS median FROM {PART_NULLS_SQL} UNION ALL SELECT 'p_retailprice', round(median(p_retailprice), 9) FROM {PART_NULLS_SQL} UNION ALL SELECT 'empty', 0.0::DOUBLE")
def _(t):
    p = part_nulls(t).withColumn("empty", F.lit(None).cast("double"))
    return scoring.column_medians(p, ["p_size", "p_retailprice", "empty"]).withColumn("median", F.round("median", 9))


@query("p10_typical_row", "SELECT p_partkey, p_size, p_retailprice FROM part, (SELECT median(p_retailprice) AS m FROM part) ORDER BY round(abs(p_retailprice - m), 9), p_partkey LIMIT 1")
def _(t):
    return scoring.typical_row(t.part, "p_retailprice", "p_partkey").select("p_partkey", "p_size", "p_retailprice")


@query(
    "p11_default_chain",
    f"""SELECT p_partkey, CASE WHEN p_size IS NOT NULL THEN p_size WHEN p_type IS NOT NULL THEN m ELSE round(a, 6) END AS value FROM {PART_NULLS_SQL}, (SELECT median(p_size) AS m, avg(p_size) AS a FROM {PART_NULLS_SQL})""",
)
def _(t):
    p = part_nulls(t)
    med = quantile_row(p, {"m": ("p_size", 0.5)})
    mean = p.agg(F.round(F.avg("p_size"), 6).alias("a"))
    joined = p.join(F.broadcast(med)).join(F.broadcast(mean))
    value = scoring.default_chain(F.col("p_size").cast("double"), F.when(F.col("p_type").isNotNull(), F.col("m")), "a")
    return joined.select("p_partkey", value.alias("value"))


@query(
    "p12_batch_summary",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (score >= 8.32) AS flagged, round(count(*) FILTER (score >= 8.32)::DOUBLE / count(*), 4) AS rate FROM {SCORED_SQL} GROUP BY 1""",
)
def _(t):
    flagged = F.count_if(F.col("score") >= 8.32)
    return scored_events(t).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), flagged.alias("flagged"), F.round(flagged / F.count("*"), 4).alias("rate")
    )


@query(
    "p13_comparison_table",
    "SELECT p_partkey, feature, v AS value FROM (SELECT p_partkey, p_size::DOUBLE AS p_size, p_retailprice FROM part WHERE p_partkey IN (3, 5, 8)) UNPIVOT (v FOR feature IN (p_size, p_retailprice))",
)
def _(t):
    chosen = t.part.where(F.col("p_partkey").isin(3, 5, 8)).select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return chosen.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "feature", "value")


# ---------------------------------------------------------------- D7, F windows


@query(
    "d7_outcome_join",
    """SELECT o_orderpriority, count(*) AS n, round(avg(abs(o_totalprice - pred)), 4) AS mae, round(avg(o_totalprice - pred), 4) AS bias FROM
        (SELECT l_orderkey, sum(l_extendedprice) * 1.5 AS pred FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _(t):
    pred = t.lineitem.groupBy("l_orderkey").agg((F.sum("l_extendedprice") * 1.5).alias("pred"))
    e = F.col("o_totalprice") - F.col("pred")
    return (
        pred.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.avg(e), 4).alias("bias"))
    )


@query("f3_last_n_rows", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def _(t):
    return drift.last_n(t.events, "ts", "event_id", 1000).select("event_id", "value")


ROLLING_SQL = """WITH r AS (SELECT value AS y, 45 + length(event_type) + value * 0.5::DOUBLE AS p, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
  w AS (SELECT k * 50 + 100 AS end_index, y, p FROM r, LATERAL (SELECT unnest(range(greatest(0, (i - 50) // 50)::BIGINT, i // 50 + 1)) AS k) WHERE i >= k * 50 AND i < k * 50 + 100 AND k * 50 + 100 < n),
  f AS (SELECT end_index, count(*) AS n, round(CASE WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) ELSE 0 END, 8) AS r2 FROM w GROUP BY 1)"""


def rolling(t):
    e = t.events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("value").alias("y"),
        (F.length("event_type") + 45 + F.col("value") * 0.5).alias("p"),
    )
    return drift.rolling_fit(e, "us", "event_id", "y", "p", 100).withColumn("r2", F.round("r2", 8))


@query("f4_rolling_fit", ROLLING_SQL + "SELECT end_index, n, r2 FROM f")
def _(t):
    return rolling(t)


TREND_SQL = ROLLING_SQL + """SELECT a.end_index, a.r2, b.r2 AS previous, CASE WHEN a.r2 < b.r2 THEN 'declining' ELSE 'stable' END AS trend
  FROM f a JOIN f b ON b.end_index = a.end_index - 50 ORDER BY a.end_index DESC LIMIT 1"""


@query("f5_trend_direction", TREND_SQL)
@query("q9_performance_trend", TREND_SQL)
def _(t):
    return drift.trend_direction(rolling(t))


@query(
    "f7_head_per_group",
    "SELECT label, rn, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rn FROM embeddings) WHERE rn <= 25",
)
def _(t):
    e = t.embeddings.select("label", "vec_id", F.get("embedding", F.lit(0)).alias("e"))
    return head_per_group(e, ["label"], [F.desc("e"), "vec_id"], 25).drop("e")


@query(
    "f8_rolling_median_ratio",
    """SELECT event_id, user_id, value / round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS ratio FROM events""",
)
def _(t):
    e = t.events.select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = drift.rolling_per_entity(e, "user_id", "us", "event_id", 10, {"m": F.percentile("value", 0.5)})
    # by a zero median as floating-point numbers are divided: infinite, NaN for 0 / 0; a rounded zero keeps its sign
    median, endless = F.round("m", 6), F.when(F.col("m") < 0, float("-inf")).otherwise(float("inf"))
    ratio = F.when(median == 0, F.col("value") * endless).otherwise(F.col("value") / median)
    return out.select("event_id", "user_id", ratio.alias("ratio"))


# ---------------------------------------------------------------- Q monitoring


def weekly(t):
    k = F.get_json_object("props", "$.k").cast("double")
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7).cast("int")
    drifted = F.col("value") * (1 + week * 0.15)
    return t.events.select("event_id", "ts", week.alias("week"), F.when(week > 0, drifted).otherwise(F.col("value")).alias("value"), k.alias("k"))


WEEKLY = """(SELECT event_id, ts, date_diff('day', DATE '2024-01-01', ts::DATE) // 7 AS week, value * CASE WHEN date_diff('day', DATE '2024-01-01', ts::DATE) // 7 > 0
  THEN (1 + (date_diff('day', DATE '2024-01-01', ts::DATE) // 7) * 0.15::DOUBLE) ELSE 1 END AS value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
PSI_CTE = f"""WITH l AS (SELECT week, feature, v FROM {WEEKLY} UNPIVOT (v FOR feature IN (value, k))),
  e AS (SELECT feature, min(v) AS lo, max(v) AS hi, avg(v) AS rm, stddev_pop(v) AS rs, count(*) AS rt FROM l WHERE week = 0 GROUP BY 1),
  h AS (SELECT week, feature, CASE WHEN v BETWEEN lo AND hi THEN least(CAST(floor((v - lo) / (hi - lo) * 10) AS INT) + 1, 10) END AS bin, count(*) AS n FROM l JOIN e USING (feature) GROUP BY 1, 2, 3),
  g AS (SELECT week, feature, bin, inside, rows FROM (SELECT week, feature, sum(n) FILTER (bin IS NOT NULL) AS inside, sum(n) AS rows FROM h GROUP BY 1, 2), (SELECT unnest(range(1, 11)) AS bin)),
  s AS (SELECT g.week, g.feature, g.rows, greatest(coalesce(h.n, 0)::DOUBLE / inside, 1e-4) AS a, greatest(coalesce(r.n, 0)::DOUBLE / rt, 1e-4) AS x FROM g
    LEFT JOIN h ON h.week = g.week AND h.feature = g.feature AND h.bin = g.bin LEFT JOIN h r ON r.week = 0 AND r.feature = g.feature AND r.bin = g.bin JOIN e ON e.feature = g.feature),
  p AS (SELECT week, feature, max(rows)::BIGINT AS n, sum((a - x) * ln(a / x)) AS psi FROM s GROUP BY 1, 2)"""


@query("q1_feature_psi", PSI_CTE + " SELECT week, feature, n, round(psi, 7) + 0 AS psi FROM p")
def _(t):
    e = weekly(t)
    d = drift.psi_table(e.where("week = 0"), e, ["value", "k"], ["week"])
    return d.withColumn("psi", F.round("psi", 7) + 0)


@query(
    "q2_drift_report",
    PSI_CTE
    + """, m AS (SELECT week, feature, (avg(v) - any_value(rm)) / (any_value(rs) + 1e-10) AS shift FROM l JOIN e USING (feature) GROUP BY 1, 2)
       SELECT week, max(n) AS n, CASE WHEN max(n) >= 100 THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN max(n) >= 100 THEN max((psi >= 0.2)::INT) ELSE 0 END AS drift,
         round(CASE WHEN max(n) >= 100 THEN avg(psi) END, 7) + 0 AS mean_psi, round(CASE WHEN max(n) >= 100 THEN max(psi) END, 7) + 0 AS max_psi, CASE WHEN max(n) >= 100 THEN count(*) FILTER (psi >= 0.2) ELSE 0 END AS n_drifted,
         round(CASE WHEN max(n) >= 100 THEN max(abs(shift)) END, 7) AS max_shift FROM p JOIN m USING (week, feature) GROUP BY week""",
)
def _(t):
    e = weekly(t)
    d = drift.drift_report(e.where("week = 0"), e, ["value", "k"], ["week"])
    return d.withColumns({"mean_psi": F.round("mean_psi", 7) + 0, "max_psi": F.round("max_psi", 7) + 0, "max_shift": F.round("max_shift", 7)})


@query(
    "q3_drift_history",
    PSI_CTE
    + """, d AS (SELECT week, avg(psi) AS mean_psi, max((psi >= 0.2)::INT) AS drift FROM p WHERE n >= 100 GROUP BY 1)
       SELECT count(*) AS checks, round(avg(drift), 9) AS drift_rate, max(week) AS last_week, round(arg_max(mean_psi, week), 7) + 0 AS last_mean_psi,
         (SELECT CAST(sum(drift) AS BIGINT) FROM (SELECT drift FROM d ORDER BY week DESC LIMIT 10)) AS drifts_in_last_10 FROM d""",
)
def _(t):
    e = weekly(t)
    log = drift.drift_report(e.where("week = 0"), e, ["value", "k"], ["week"]).where("status = 'ok'")
    recent = log.orderBy(F.desc("week")).limit(10).agg(F.sum("drift").cast("long").alias("drifts_in_last_10"))
    return log.agg(
        F.count("*").alias("checks"),
        F.round(F.avg("drift"), 9).alias("drift_rate"),
        F.max("week").alias("last_week"),
        (F.round(F.max_by("mean_psi", "week"), 7) + 0).alias("last_mean_psi"),
    ).join(F.broadcast(recent))


QPSI_CTE = f"""WITH s AS (SELECT event_id, ts, week, value FROM {WEEKLY}),
  q AS (SELECT DISTINCT unnest(quantile_cont(value, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edge FROM s WHERE week = 0),
  b AS (SELECT edge AS lo, lead(edge) OVER (ORDER BY edge) AS hi, row_number() OVER (ORDER BY edge) AS bin, count(*) OVER () - 1 AS k FROM q),
  c AS (SELECT week, bin, count(*) AS c FROM s JOIN b ON hi IS NOT NULL AND value >= lo AND (value < hi OR (bin = k AND value <= hi)) GROUP BY 1, 2),
  w AS (SELECT week, count(*) AS n FROM s GROUP BY 1), t AS (SELECT week, sum(c) AS inside FROM c GROUP BY 1),
  f AS (SELECT w.week, w.n, b.bin, (coalesce(c.c, 0) + 1) / (coalesce(t.inside, 0) + k)::DOUBLE AS a, (coalesce(r.c, 0) + 1) / (rt.inside + k)::DOUBLE AS x FROM w JOIN b ON hi IS NOT NULL LEFT JOIN t ON t.week = w.week
    LEFT JOIN c ON c.week = w.week AND c.bin = b.bin LEFT JOIN c r ON r.week = 0 AND r.bin = b.bin, (SELECT inside FROM t WHERE week = 0) rt),
  p AS (SELECT week, n, CASE WHEN n < 100 THEN 0 ELSE sum((a - x) * ln(a / x + 1e-10)) END AS psi FROM f GROUP BY 1, 2)"""


@query("q4_score_psi", QPSI_CTE + " SELECT week, n, round(psi, 6) + 0 AS psi FROM p")
def _(t):
    e = weekly(t)
    return drift.score_psi(e.where("week = 0"), e, "value", ["week"]).withColumn("psi", F.round("psi", 6) + 0)


@query(
    "q5_monitor_statistics",
    QPSI_CTE
    + """, m AS (SELECT week, avg((value > 250)::INT) AS rate, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.95) AS p95 FROM s GROUP BY 1)
       SELECT week, n, round(psi, 4) + 0 AS psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.2 THEN 'warn' ELSE 'alert' END AS psi_status, round(rate, 5) AS flag_rate, round(mean, 3) AS mean, round(std, 3) AS std, round(p95, 3) AS p95,
         concat_ws(',', CASE WHEN psi >= 0.2 THEN 'score_drift:' || CASE WHEN psi > 0.25 THEN 'high' ELSE 'medium' END END, CASE WHEN rate > 3 * 0.00172 THEN 'fraud_spike:high' END) AS alerts FROM p JOIN m USING (week)""",
)
def _(t):
    e = weekly(t)
    psi = drift.score_psi(e.where("week = 0"), e, "value", ["week"])
    p95 = exact_quantiles(e, ["value"], [0.95], ["week"]).select("week", F.round("value", 3).alias("p95"))
    stats = e.groupBy("week").agg(
        F.avg((F.col("value") > 250).cast("int")).alias("rate"),
        F.round(F.avg("value"), 3).alias("mean"),
        F.round(F.stddev_pop("value"), 3).alias("std"),
    )
    s = F.col("psi")
    # fixed values: expected flag rate and alert limits
    alerts = F.concat_ws(
        ",",
        F.when(s >= 0.2, F.concat(F.lit("score_drift:"), F.when(s > 0.25, "high").otherwise("medium"))),
        F.when(F.col("rate") > 3 * 0.00172, "fraud_spike:high"),
    )
    return psi.join(stats, "week").join(p95, "week").select(
        "week",
        "n",
        (F.round(s, 4) + 0).alias("psi"),
        F.when(s < 0.1, "ok").when(s < 0.2, "warn").otherwise("alert").alias("psi_status"),
        F.round("rate", 5).alias("flag_rate"),
        "mean",
        "std",
        "p95",
        alerts.alias("alerts"),
    )


@query(
    "q7_mean_shift",
    """WITH r AS (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), z AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT avg(value) FROM r) AS recent_mean, (SELECT stddev_pop(value) FROM r) AS recent_std,
        avg(value) AS ref_mean, stddev_pop(value) AS ref_std FROM events)
       SELECT n, round(recent_mean, 6) AS recent_mean, round(recent_std, 6) AS recent_std, round(ref_mean, 6) AS ref_mean, round(ref_std, 6) AS ref_std,
         round((recent_mean - ref_mean) / (ref_std + 1e-10), 6) AS z, (abs((recent_mean - ref_mean) / (ref_std + 1e-10)) > 2)::INT AS alert FROM z""",
)
def _(t):
    d = drift.mean_shift(t.events, drift.last_n(t.events, "ts", "event_id", 100), "value")
    return d.withColumns({c: F.round(c, 6) for c in ("recent_mean", "recent_std", "ref_mean", "ref_std", "z")})


@query(
    "q8_recent_performance",
    f"""WITH r AS (SELECT y, p FROM (SELECT x.*, l.l_shipdate FROM {REG} x JOIN lineitem l USING ({KEYS})) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 100)
       SELECT n, round(r2, 6) AS r2, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape, 4) AS mape, CASE WHEN n < 10 THEN 'insufficient' WHEN r2 < 0.85 THEN 'alert' ELSE 'normal' END AS status FROM
        (SELECT count(*) AS n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, 100 * avg(CASE WHEN y <> 0 THEN abs((y - p) / y) ELSE 0 END) AS mape FROM r)""",
)
def _(t):
    c = F.col
    rows = t.lineitem.select(
        *LINE_KEY,
        "l_shipdate",
        (c("l_extendedprice") * 0.1 + c("l_quantity") * 500 - c("l_discount") * 3000).alias("y"),
        (c("l_quantity") * 500 + 5000).alias("p"),
    )
    recent = rows.orderBy(F.desc("l_shipdate"), *[F.desc(k) for k in LINE_KEY]).limit(100)
    d = drift.recent_performance(recent, "y", "p")
    return d.withColumns({"r2": F.round("r2", 6), "rmse": F.round("rmse", 4), "mae": F.round("mae", 4), "mape": F.round("mape", 4)})


@query(
    "q10_retraining_decision",
    PSI_CTE
    + """, st AS (SELECT week, round(max(psi), 6) AS psi, week * 14 AS days, 0.95 - week * 0.04::DOUBLE AS metric FROM p GROUP BY week),
       x AS (SELECT week, concat_ws('; ', CASE WHEN days >= 30 THEN 'Scheduled: ' || days || ' days since last retrain' END, CASE WHEN metric < 0.85 THEN 'Performance: ' || printf('%.3f', metric) || ' < 0.85' END,
         CASE WHEN psi > 0.2 THEN 'Drift: PSI ' || printf('%.3f', psi) || ' > 0.2' END) AS r FROM st)
       SELECT week, (r <> '')::INT AS retrain, CASE WHEN r = '' THEN 'No retraining needed' ELSE r END AS reason FROM x""",
)
def _(t):
    e = weekly(t)
    status = (
        drift.psi_table(e.where("week = 0"), e, ["value", "k"], ["week"])
        .groupBy("week")
        .agg(F.round(F.max("psi"), 6).alias("psi"))
        .withColumns({"days": F.col("week") * 14, "metric": F.lit(0.95) - F.col("week") * 0.04})
    )
    out = drift.retraining_decision("days", "metric", "psi")
    return status.select("week", *[c.alias(n) for n, c in out.items()])


#: first and end day of the rows that each attempt learns from; validation rows begin at the last end
RETRAIN_WINDOWS = (("1900-01-01", "1997-01-01"), ("1996-01-01", "1999-01-01"), ("1998-01-01", "2000-07-01"))
RETRAIN_SQL = """WITH l AS (SELECT l_shipdate AS d, l_quantity::DOUBLE AS x, ln(1 + l_extendedprice::DOUBLE) AS y FROM lineitem),
  w AS (SELECT * FROM (VALUES {windows}) AS w(version, a, b)),
  m AS (SELECT version, count(*) AS n_rows, regr_slope(y, x) AS w, regr_intercept(y, x) AS b0 FROM l JOIN w ON d >= a AND d < b GROUP BY version),
  s AS (SELECT version, any_value(n_rows) AS n_rows, any_value(w) AS w, any_value(b0) AS b0, sqrt(avg(pow(exp(y) - exp(w * x + b0), 2))) AS rmse
    FROM l, m WHERE d >= TIMESTAMP '{end}' GROUP BY version),
  p AS (SELECT *, min(rmse) OVER (ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM s)
  SELECT version, n_rows, round(w, 7) AS weight, round(b0, 7) AS intercept, round(rmse, 3) AS rmse, round(previous, 3) AS previous_rmse,
    CAST(previous IS NULL OR rmse < previous AS INT) AS published FROM p""".format(
    windows=", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(RETRAIN_WINDOWS, 1)),
    end=RETRAIN_WINDOWS[-1][1],
)


@query("q11_retrain_job", RETRAIN_SQL)
def _(t):
    """Three attempts on a moving window: newer rows are added to the stored statistics, old ones subtracted."""
    from granary.models.retrain import registry, retrain
    from granary.session import fresh_path

    rows = t.lineitem.withColumn("log_price", F.log1p("l_extendedprice"))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    between = lambda a, b: rows.where((F.col("l_shipdate") >= day(a)) & (F.col("l_shipdate") < day(b)))
    root = fresh_path(t.spark, "models")
    valid = rows.where(F.col("l_shipdate") >= day(RETRAIN_WINDOWS[-1][1]))
    first, end = RETRAIN_WINDOWS[0]
    retrain(root, between(first, end), valid, ["l_quantity"], "log_price")
    for a, b in RETRAIN_WINDOWS[1:]:
        retrain(root, between(end, b), valid, ["l_quantity"], "log_price", removed=between(first, a))
        first, end = a, b
    fitted = lambda path: F.get_json_object("record", path).cast("double")
    return registry(t.spark, root).select(
        "version",
        "n_rows",
        F.round(fitted("$.weights[0]"), 7).alias("weight"),
        F.round(fitted("$.intercept"), 7).alias("intercept"),
        F.round("rmse", 3).alias("rmse"),
        F.round("previous_rmse", 3).alias("previous_rmse"),
        F.col("published").cast("int").alias("published"),
    )


@query(
    "q12_window_reset",
    """WITH m AS (SELECT max((ts, event_id)) AS m FROM events WHERE value > 250)
       SELECT count(*) AS n_total, count(*) FILTER (event_type = 'error') AS flagged_total, count(*) FILTER ((ts, event_id) > m) AS n_window,
         round(avg(value) FILTER ((ts, event_id) > m), 6) AS window_mean FROM events, m""",
)
def _(t):
    marker = t.events.where("value > 250").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    after = F.struct("ts", "event_id") > F.col("m")
    return t.events.join(F.broadcast(marker)).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col("event_type") == "error").alias("flagged_total"),
        F.count_if(after).alias("n_window"),
        F.round(F.avg(F.when(after, F.col("value"))), 6).alias("window_mean"),
    )


@query(
    "q15_live_counters",
    """SELECT count(*) AS total, count(*) FILTER (ts::DATE = d) AS today, count(*) FILTER (value > 150 AND event_type <> 'view') AS active_alerts FROM events, (SELECT max(ts)::DATE AS d FROM events)""",
)
def _(t):
    day = t.events.agg(F.max("ts").cast("date").alias("d"))
    return t.events.join(F.broadcast(day)).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("ts").cast("date") == F.col("d")).alias("today"),
        F.count_if((F.col("value") > 150) & (F.col("event_type") != "view")).alias("active_alerts"),
    )


@query(
    "q16_metric_series",
    """SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type <> 'view' GROUP BY 1""",
)
def _(t):
    stamp = F.when(F.col("event_type") == "view", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = t.events.select(F.try_to_timestamp(stamp).alias("at"), "value").where("at IS NOT NULL")
    return parsed.groupBy(F.date_format("at", "yyyy-MM-dd HH").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy("hour")


