"""Scans, sinks, filters, joins, aggregates, sorts, set operations, scalar functions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import arrays as A
from granary.functions import scalars as S
from granary.operators import filters
from granary.operators.quantiles import quantile_row
from granary.operators.ranking import key_hash
from granary.plans.common import LINE_KEY, PART_NULLS_SQL, part_nulls
from granary.plans.registry import query
from granary.session import fresh_path
from granary.sources import archives, artifacts, files, payloads

# ---------------------------------------------------------------- A sources and sinks

ORDERS_TEXT = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
    ]
)


@query(
    "a1_csv_without_header",
    """SELECT o_orderkey AS col_0, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS col_1,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS col_2 FROM orders""",
)
def _(t):
    path = fresh_path(t.spark, "csv")
    t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, "N/A").otherwise(F.col("o_orderpriority")).alias("p"),
        F.when(F.col("o_orderkey") % 4 == 0, "nan").otherwise(F.col("o_totalprice").cast("string")).alias("v"),
    ).write.csv(path, sep=";", header=False, quoteAll=True)
    return files.read_csv(t.spark, path, ORDERS_TEXT, sep=";", header=False)


@query("a2_csv_scan", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 250000")
def _(t):
    path = fresh_path(t.spark, "csv")
    files.write_csv(t.orders.select(*[f.name for f in ORDERS_TEXT]), path)
    return files.read_csv(t.spark, path, ORDERS_TEXT).where("o_totalprice > 250000")


@query(
    "a3_archive_scan",
    "SELECT source AS folder, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY 1",
)
def _(t):
    named = t.documents.select("source", F.format_string("%d.txt", "doc_id").alias("name"), "text")
    root = fresh_path(t.spark, "archives")
    archives.write_files(archives.pack(named, "source", "name", "text", kind="bz2"), root, "path", "content")
    members = archives.read_archives(t.spark, root)
    return members.groupBy(F.element_at(F.split("member", "/"), 1).alias("folder")).agg(
        F.count("*").alias("n_files"), F.sum(F.length(F.col("content").cast("string"))).alias("n_chars")
    )


@query("a3_arff_scan", "SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(t):
    path = fresh_path(t.spark, "arff")
    archives.write_arff(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), path, "orders")
    return archives.read_arff(t.spark, path)


@query(
    "a4_document_files",
    """SELECT lang AS folder, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
       WHERE length('mail-' || doc_id || '.' || source || '.txt') > 17 GROUP BY 1""",
)
def _(t):
    path = F.format_string("%s/mail-%d.%s.txt", "lang", "doc_id", "source")
    root = fresh_path(t.spark, "mails")
    archives.write_files(t.documents.select(path.alias("path"), "text"), root, "path", "text")
    docs = archives.read_documents(t.spark, root, min_name=17)
    return docs.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


LOG = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("scores", T.MapType(T.StringType(), T.LongType())),
    ]
)


@query(
    "a5_json_log",
    "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    path = fresh_path(t.spark, "log")
    before = files.read_json_log(t.spark, path, LOG)
    scores = F.from_json("props", "map<string,bigint>").alias("scores")
    files.append_json_log(t.events.where("value < 20").select("event_id", "event_type", scores), path)
    files.append_json_log(t.events.where("value >= 20").select("event_id", "event_type", scores), path)
    log = files.read_json_log(t.spark, path, LOG).unionByName(before)
    return log.select("event_id", "event_type", F.element_at("scores", "k").alias("k"))


@query(
    "a6_array_dataset",
    """SELECT vec_id, label, len(embedding) AS width, CAST(embedding[1] AS DOUBLE) AS first,
       CAST(embedding[64] AS DOUBLE) AS last FROM embeddings""",
)
def _(t):
    path = fresh_path(t.spark, "arrays")
    files.write_arrays(t.embeddings.select("vec_id", "embedding", "label"), path)
    back = files.read_arrays(t.spark, path, "embedding", "vec_id", "label")
    return back.select(
        "vec_id",
        "label",
        F.size("embedding").alias("width"),
        F.get("embedding", F.lit(0)).cast("double").alias("first"),
        F.get("embedding", F.lit(63)).cast("double").alias("last"),
    )


@query(
    "a7_dataset_metadata",
    """SELECT count(*) AS n_rows, 2 AS n_features, count(*) FILTER (toxic = 1) AS n_positive,
        round(count(*) FILTER (toxic = 1)::DOUBLE / count(*), 9) AS positive_rate,
        round(count(*)::DOUBLE / (2 * count(*) FILTER (toxic = 1)), 9) AS weight_positive,
        round(count(*)::DOUBLE / (2 * count(*) FILTER (toxic <> 1)), 9) AS weight_negative FROM labels""",
)
def _(t):
    path = fresh_path(t.spark, "meta")
    meta = files.dataset_metadata(t.labels, "toxic", 2)
    meta.write.json(path)
    back = t.spark.read.schema(meta.schema).json(path)
    return back.withColumns({c: F.round(c, 9) for c in ("positive_rate", "weight_positive", "weight_negative")})


@query("a8_csv_sink", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 2) AS total FROM orders")
def _(t):
    path = fresh_path(t.spark, "csv")
    files.write_csv(t.orders.select(*[f.name for f in ORDERS_TEXT]), path)
    back = files.read_csv(t.spark, path, ORDERS_TEXT)
    return back.agg(
        F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "a9_batch_payload",
    """SELECT event_id, 0 AS position, CASE WHEN value < 5 THEN 'Field Amount must be >= 0' END AS error FROM events
       UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'click' THEN 'Missing field: Amount'
         WHEN event_type = 'view' THEN 'Field Amount must be numeric' END FROM events""",
)
def _(t):
    v = F.col("value")
    good = F.create_map(F.lit("Amount"), F.when(v < 5, -v).otherwise(v).cast("string"), F.lit("Time"), F.lit("3600"))
    odd = (
        F.when(F.col("event_type") == "click", F.create_map(F.lit("Time"), F.lit("7200")))
        .when(F.col("event_type") == "view", F.create_map(F.lit("Amount"), F.lit("x12"), F.lit("Time"), F.lit("7200")))
        .otherwise(F.create_map(F.lit("Amount"), v.cast("string"), F.lit("Time"), F.lit("7200")))
    )
    bodies = t.events.select("event_id", F.to_json(F.struct(F.array(good, odd).alias("transactions"))).alias("body"))
    rows = payloads.explode_json(bodies, "body", ["event_id"])
    return rows.select(
        "event_id", "position", payloads.first_error(F.col("fields"), {"Amount": True, "Time": True}).alias("error")
    )


@query(
    "a9_csv_payload",
    """SELECT event_id, NULL::INT AS position, 'CSV header must include column: Time' AS error, NULL::DOUBLE AS amount FROM events WHERE event_type = 'click'
       UNION ALL SELECT event_id, 1, CASE WHEN event_type = 'error' THEN 'Row 1: Amount is not a number' END, CASE WHEN event_type <> 'error' THEN value END FROM events WHERE event_type <> 'click'
       UNION ALL SELECT event_id, 2, CASE WHEN event_type = 'view' THEN 'Row 2: not enough columns' END, CASE WHEN event_type <> 'view' THEN 0.0::DOUBLE END FROM events WHERE event_type <> 'click'""",
)
def _(t):
    kind, v = F.col("event_type"), F.col("value").cast("string")
    header = F.when(kind == "click", "Amount,V1").otherwise(" Time , Amount")
    first = F.concat(F.lit("3600, "), F.when(kind == "error", "x12").otherwise(v))
    second = F.when(kind == "view", "7200").otherwise("7200,")
    bodies = t.events.select("event_id", F.concat_ws("\r\n", header, first, F.lit(""), second).alias("body"))
    rows = payloads.explode_csv(bodies, "body", ["Amount", "Time"], ["event_id"])
    amount = F.element_at("fields", "Amount")
    amount = F.when(amount == "", 0.0).otherwise(amount.cast("double"))
    return rows.select("event_id", "position", "error", amount.alias("amount"))


@query("a10_model_save_load")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    root = fresh_path(t.spark, "models")
    features = ["l_quantity", "l_discount", "l_tax"]
    stages = [VectorAssembler(inputCols=features, outputCol="features"), LinearRegression(labelCol="l_extendedprice")]
    model = Pipeline(stages=stages).fit(t.lineitem)
    meta = {"features": features, "target": "l_extendedprice", "metrics": {"rmse": model.stages[-1].summary.rootMeanSquaredError}}
    for version in ("20240101T000000", "20240201T000000"):
        artifacts.save_model(model, root, version, meta)
    loaded, record = artifacts.load_model(t.spark, root)
    scored = loaded.transform(t.lineitem)
    return scored.groupBy("l_returnflag").agg(
        F.lit(record["version"]).alias("version"),
        F.count("*").alias("n"),
        F.round(F.avg("prediction"), 4).alias("mean_prediction"),
    )


@query(
    "a11_prediction_log",
    """WITH r AS (SELECT *, l_quantity * 1000 + l_extendedprice * 0.01 AS prediction,
         (l_quantity + l_extendedprice + l_discount + l_tax) / 4 AS m FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, prediction,
         round(m, 6) AS f_mean, round(sqrt(((l_quantity - m) * (l_quantity - m) + (l_extendedprice - m) * (l_extendedprice - m)
           + (l_discount - m) * (l_discount - m) + (l_tax - m) * (l_tax - m)) / 4), 6) AS f_std,
         least(l_quantity, l_extendedprice, l_discount, l_tax) AS f_min,
         greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS f_max
       FROM r ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC LIMIT 10000""",
)
def _(t):
    row = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    log = t.lineitem.select(
        *LINE_KEY,
        "l_shipdate",
        (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.01).alias("prediction"),
        F.round(A.mean(row), 6).alias("f_mean"),
        F.round(A.std_pop(row), 6).alias("f_std"),
        F.array_min(row).alias("f_min"),
        F.array_max(row).alias("f_max"),
    )
    last = log.orderBy(F.desc("l_shipdate"), *[F.desc(k) for k in LINE_KEY]).limit(10000)
    return last.withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


# ---------------------------------------------------------------- C projections and filters


@query("c1_select_columns", "SELECT o_orderkey, o_totalprice, o_totalprice * 2 AS doubled FROM orders")
def _(t):
    return t.orders.select("o_orderkey", "o_totalprice").withColumn("doubled", F.col("o_totalprice") * 2)


@query("c2_drop_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return t.orders.drop("o_orderstatus", "o_orderdate", "o_orderpriority", "not_there")


@query("c3_select_by_type", "SELECT p_partkey, p_size, p_retailprice, 3 AS n_strings FROM part")
def _(t):
    from granary.operators.profile import numeric_columns, string_columns

    p = t.part
    return p.select(*numeric_columns(p), F.lit(len(string_columns(p))).alias("n_strings"))


@query(
    "c4_feature_target",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_extendedprice AS target FROM lineitem",
)
def _(t):
    return t.lineitem.select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("target"))


@query(
    "c5_faceted_filter",
    """SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_size >= 10
       AND p_retailprice <= 980 AND (contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')
       OR contains(lower(p_type), 'ring') OR contains(lower(CAST(p_partkey AS VARCHAR)), 'ring'))""",
)
def _(t):
    return filters.faceted_filter(
        t.part,
        equals={"p_type": None, "p_brand": ""},
        ranges={"p_size": (10, 0), "p_retailprice": (0, 980)},
        search="RING",
        search_columns=["p_name", "p_brand", "p_type", "p_partkey"],
    )


@query(
    "u4_rule_columns",
    "SELECT o_orderkey FROM orders WHERE o_totalprice > 5000 AND o_totalprice < 450000 AND o_orderstatus <> 'P'",
)
def _(t):
    return filters.apply_rules(t.orders, order_rules()).select("o_orderkey")


@query(
    "c6_domain_rules",
    """SELECT 0 AS step, 'price_positive' AS rule, count(*) FILTER (NOT o_totalprice > 5000) AS removed FROM orders
       UNION ALL SELECT 1, 'not_extreme', count(*) FILTER (o_totalprice > 5000 AND NOT o_totalprice < 450000) FROM orders
       UNION ALL SELECT 2, 'complete', count(*) FILTER (o_totalprice > 5000 AND o_totalprice < 450000 AND o_orderstatus = 'P') FROM orders
       UNION ALL SELECT 3, 'kept', count(*) FILTER (NOT (o_totalprice > 5000 AND o_totalprice < 450000 AND o_orderstatus <> 'P')) FROM orders""",
)
def _(t):
    return filters.rule_effects(t.orders, order_rules())


def order_rules():
    return [
        ("price_positive", ["o_totalprice"], F.col("o_totalprice") > 5000),
        ("pool_small", ["o_poolarea"], F.lit(True)),
        ("not_extreme", ["o_totalprice"], F.col("o_totalprice") < 450000),
        ("complete", ["o_orderstatus"], F.col("o_orderstatus") != "P"),
    ]


@query(
    "c7_outlier_predicate",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45 AND l_extendedprice < 10000",
)
def _(t):
    return t.lineitem.where("l_quantity > 45 AND l_extendedprice < 10000").select(*LINE_KEY)


@query(
    "c8_log_filter",
    """SELECT event_id, value FROM (SELECT event_id, value, CASE WHEN event_type = 'view' THEN 'bad'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events)
       WHERE TRY_CAST(stamp AS TIMESTAMP)::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'
         AND value BETWEEN 20 AND 80 ORDER BY stamp, event_id LIMIT 100""",
)
def _(t):
    log = t.events.select(
        "event_id",
        "value",
        F.when(F.col("event_type") == "view", "bad")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("stamp"),
    )
    day = F.try_to_timestamp("stamp").cast("date")
    hit = day.between("2024-01-05", "2024-01-12") & F.col("value").between(20, 80)
    return log.where(hit).orderBy("stamp", "event_id").limit(100).select("event_id", "value")


@query(
    "c9_alert_filter",
    """SELECT event_id, CASE WHEN value > 200 THEN 'high' ELSE 'medium' END AS severity,
        (event_type IN ('click', 'view') OR value < 120)::INT AS acknowledged
       FROM events WHERE value > 100 AND NOT event_type = 'signup'""",
)
def _(t):
    alerts = t.events.where("value > 100").select(
        "event_id",
        "event_type",
        "value",
        F.when(F.col("value") > 200, "high").otherwise("medium").alias("severity"),
        F.col("event_type").isin("click", "view").alias("acknowledged"),
    )
    acked = alerts.withColumn("acknowledged", F.when(F.col("value") < 120, True).otherwise(F.col("acknowledged")))
    return acked.where("event_type <> 'signup'").select("event_id", "severity", F.col("acknowledged").cast("int"))


@query(
    "c10_severity_bands",
    """SELECT CASE WHEN value / 500 < 0.1 THEN 'Normal' WHEN value / 500 < 0.2 THEN 'Warning'
         WHEN value / 500 < 0.25 THEN 'Alert' ELSE 'Critical' END AS status, count(*) AS n FROM events GROUP BY 1""",
)
def _(t):
    # fixed values: drift bands
    status = S.band(F.col("value") / 500, [0.1, 0.2, 0.25], ["Normal", "Warning", "Alert", "Critical"])
    return t.events.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(
    "c11_class_pair_rows",
    """WITH p AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END AS pred,
         CASE WHEN label >= 5 THEN 1 ELSE 0 END AS truth FROM embeddings)
       SELECT truth, pred, rn, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY truth, pred ORDER BY vec_id) AS rn FROM p) WHERE rn <= 25""",
)
def _(t):
    p = t.embeddings.select(
        "vec_id",
        (F.get("embedding", F.lit(0)) > 0).cast("int").alias("pred"),
        (F.col("label") >= 5).cast("int").alias("truth"),
    )
    return filters.head_per_group(p, ["truth", "pred"], ["vec_id"], 25)


@query(
    "c12_binary_targets",
    """SELECT vec_id, (CAST(label AS VARCHAR) = '5')::INT AS is_5, (CAST(label AS VARCHAR) >= '7')::INT AS is_large,
        (label % 2 = 1)::INT AS is_odd FROM embeddings""",
)
def _(t):
    text = F.col("label").cast("string")
    return t.embeddings.select(
        "vec_id",
        (text == "5").cast("int").alias("is_5"),
        (text >= "7").cast("int").alias("is_large"),
        (F.col("label") % 2 == 1).cast("int").alias("is_odd"),
    )


# ---------------------------------------------------------------- D joins


@query(
    "d1_lookup_join",
    """SELECT c_custkey, coalesce(n_name, 'UNKNOWN') AS nation, coalesce(n_regionkey, -1) AS region FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey""",
)
def _(t):
    codes = t.nation.where("n_regionkey <> 3")
    return t.customer.join(codes, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        "c_custkey",
        F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"),
        F.coalesce("n_regionkey", F.lit(-1)).alias("region"),
    )


@query(
    "d2_recover_mapping",
    """SELECT c_mktsegment AS category, arg_min(c_acctbal, c_custkey) AS code FROM customer GROUP BY 1""",
)
def _(t):
    from granary.operators.encode import recover_mapping

    raw = t.customer.select("c_custkey", F.col("c_mktsegment").alias("category"))
    encoded = t.customer.select("c_custkey", F.col("c_acctbal").alias("code"))
    return recover_mapping(raw, encoded, "c_custkey", "category", "code")


@query(
    "d3_unknown_categories",
    """SELECT p_type, count(*) AS n FROM part WHERE p_type NOT IN (SELECT DISTINCT p_type FROM part WHERE p_size < 25
       AND p_type <> 'PROMO') GROUP BY 1""",
)
def _(t):
    known = t.part.where("p_size < 25 AND p_type <> 'PROMO'").select("p_type").distinct()
    return t.part.join(known, "p_type", "left_anti").groupBy("p_type").agg(F.count("*").alias("n"))


@query(
    "d4_train_without_fold",
    """WITH f AS (SELECT *, CAST(('0x' || substr(md5(o_orderkey || ':42'), 1, 7)) AS BIGINT) % 5 AS fold FROM orders),
        s AS (SELECT fold, count(*) AS n, sum(o_totalprice) AS y FROM f GROUP BY fold)
       SELECT a.fold, CAST(sum(b.n) AS BIGINT) AS n_train, round(sum(b.y) / sum(b.n), 4) AS mean_train
       FROM s a JOIN s b ON a.fold <> b.fold GROUP BY a.fold""",
)
def _(t):
    from granary.operators.split import hash_fold

    folded = t.orders.withColumn("fold", hash_fold(["o_orderkey"], 5, 42))
    per_fold = folded.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("y"))
    total = folded.agg(F.count("*").alias("nt"), F.sum("o_totalprice").alias("yt"))
    return per_fold.join(F.broadcast(total)).select(
        "fold",
        (F.col("nt") - F.col("n")).alias("n_train"),
        F.round((F.col("yt") - F.col("y")) / (F.col("nt") - F.col("n")), 4).alias("mean_train"),
    )


@query(
    "d8_broadcast_bounds",
    """WITH b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem)
       SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(l_extendedprice - m) > s) AS n_far FROM lineitem, b GROUP BY 1""",
)
def _(t):
    b = t.lineitem.agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("s"))
    far = F.abs(F.col("l_extendedprice") - F.col("m")) > F.col("s")
    return (
        t.lineitem.join(F.broadcast(b))
        .groupBy("l_returnflag")
        .agg(F.count("*").alias("n"), F.count_if(far).alias("n_far"))
    )


# ---------------------------------------------------------------- E aggregations


@query(
    "e1_group_statistics",
    """SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean, round(median(p_retailprice), 2) AS median,
       min(p_retailprice) AS min, max(p_retailprice) AS max, round(stddev(p_retailprice), 2) AS std FROM part GROUP BY 1""",
)
def _(t):
    p = t.part.select("p_brand", "p_retailprice")
    stats = p.groupBy("p_brand").agg(
        F.count("*").alias("n"),
        F.round(F.avg("p_retailprice"), 2).alias("mean"),
        F.min("p_retailprice").alias("min"),
        F.max("p_retailprice").alias("max"),
        F.round(F.stddev("p_retailprice"), 2).alias("std"),
    )
    med = quantile_row(p, {"median": ("p_retailprice", 0.5)}, ["p_brand"])
    return stats.join(med, "p_brand").withColumn("median", F.round("median", 2)).orderBy(F.desc("mean"), "p_brand")


@query(
    "e2_top_group_means",
    """SELECT n_name, round(avg(c_acctbal), 4) AS mean_bal FROM customer JOIN nation ON c_nationkey = n_nationkey
       GROUP BY 1 ORDER BY avg(c_acctbal) DESC, n_name LIMIT 10""",
)
def _(t):
    # aggregate on the key first, then look the few names up
    means = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m"))
    named = means.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.orderBy(F.desc("m"), "n_name").limit(10).select("n_name", F.round("m", 4).alias("mean_bal"))


@query(
    "e3_group_rate",
    """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS pos,
       round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*), 9) AS rate FROM events GROUP BY 1""",
)
def _(t):
    pos = F.count_if(F.col("event_type") == "error")
    return t.events.groupBy("user_id").agg(
        F.count("*").alias("n"), pos.alias("pos"), F.round(pos / F.count("*"), 9).alias("rate")
    )


@query(
    "e4_structure_counts",
    """SELECT regexp_extract(url, '^(https?://(?:www\\.|m\\.)?)', 1) || '|' || (contains(html, '<nav'))::INT || '|' || (contains(html, '<article'))::INT AS structure,
        count(*) AS n FROM pages GROUP BY 1""",
)
def _(t):
    structure = F.concat_ws(
        "|",
        F.regexp_extract("url", r"^(https?://(?:www\.|m\.)?)", 1),
        F.contains("html", F.lit("<nav")).cast("int"),
        F.contains("html", F.lit("<article")).cast("int"),
    )
    return t.pages.groupBy(structure.alias("structure")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "structure")


@query(
    "e6_reference_statistics",
    """SELECT feature, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min,
        quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
       FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_extendedprice, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem)
       UNPIVOT (v FOR feature IN (l_quantity, l_extendedprice, l_linenumber)) GROUP BY feature""",
)
def _(t):
    from granary.operators.profile import reference_statistics

    d = reference_statistics(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"])
    return d.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query(
    "e7_prediction_log_statistics",
    """SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
        round(median(value), 6) AS median, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
        (SELECT round(avg(value), 6) FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)) AS recent_mean FROM events""",
)
def _(t):
    from granary.operators.drift import last_n

    e = t.events
    stats = e.agg(
        F.count("*").alias("n"),
        F.round(F.avg("value"), 6).alias("mean"),
        F.round(F.stddev_pop("value"), 6).alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
    )
    med = quantile_row(e, {"median": ("value", 0.5)}).select(F.round("median", 6).alias("median"))
    recent = last_n(e, "ts", "event_id", 1000).agg(F.round(F.avg("value"), 6).alias("recent_mean"))
    return stats.join(F.broadcast(med)).join(F.broadcast(recent))


@query(
    "e8_class_weights",
    """SELECT doc_id, toxic, round(n::DOUBLE / (k * c), 9) AS weight FROM labels JOIN
        (SELECT toxic, count(*) AS c FROM labels GROUP BY 1) USING (toxic),
        (SELECT count(*) AS n, count(DISTINCT toxic) AS k FROM labels)""",
)
def _(t):
    from granary.operators.split import with_class_weights

    return with_class_weights(t.labels.select("doc_id", "toxic"), "toxic").withColumn("weight", F.round("weight", 9))


@query("e9_distinct_values", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return t.part.select("p_brand", "p_type").distinct()


# ---------------------------------------------------------------- G sorts and top-k


@query(
    "g1_sort_head",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
       ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 5""",
)
def _(t):
    return t.lineitem.select(*LINE_KEY, "l_extendedprice").orderBy(F.desc("l_extendedprice"), *LINE_KEY).limit(5)


@query(
    "g4_result_order",
    """SELECT event_id, risk, flagged::INT AS flagged FROM (SELECT event_id, value * 0.01 AS risk, value > 150 AS flagged FROM events)
       WHERE flagged""",
)
def _(t):
    scored = t.events.select("event_id", (F.col("value") * 0.01).alias("risk"), (F.col("value") > 150).cast("int").alias("flagged"))
    return scored.where("flagged = 1").orderBy(F.desc("flagged"), F.desc("risk"), "event_id")


@query("g5_temporal_order", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate, o_orderkey")
def _(t):
    return t.orders.orderBy("o_orderdate", "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("g6_random_shuffle", "SELECT o_orderkey, md5(o_orderkey || ':7') AS h FROM orders")
def _(t):
    return t.orders.select("o_orderkey", key_hash(["o_orderkey"], 7).alias("h")).orderBy("h")


# ---------------------------------------------------------------- H set operations


@query(
    "h1_union_all",
    """SELECT part, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (SELECT 'long' AS part, n_chars FROM documents WHERE n_chars > 2000
       UNION ALL SELECT 'short', n_chars FROM documents WHERE n_chars <= 2000) GROUP BY 1""",
)
def _(t):
    d = t.documents.select("doc_id", "n_chars")
    a = d.where("n_chars > 2000").withColumn("part", F.lit("long"))
    b = d.where("n_chars <= 2000").withColumn("part", F.lit("short"))
    return a.unionByName(b).groupBy("part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "h3_difference",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE
       CAST(('0x' || substr(md5(o_orderkey || ':42'), 1, 7)) AS BIGINT) % 5 = 0)""",
)
def _(t):
    from granary.operators.split import hash_fold

    fold0 = t.orders.where(hash_fold(["o_orderkey"], 5, 42) == 0)
    return t.orders.select("o_orderkey").join(fold0.select("o_orderkey"), "o_orderkey", "left_anti")


@query("h4_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t.documents.select("lang", "source").distinct()


# ---------------------------------------------------------------- I scalar functions


@query("i1_log1p_clip", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS l, round(exp(ln(1 + greatest(c_acctbal, 0))) - 1, 6) AS back FROM customer")
def _(t):
    log = S.log1p_clipped("c_acctbal")
    return t.customer.select("c_custkey", F.round(log, 9).alias("l"), F.round(F.expm1(log), 6).alias("back"))


@query("i2_log_exp", "SELECT o_orderkey, round(ln(o_totalprice), 9) AS l, round(exp(ln(o_totalprice)), 4) AS back FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(F.log("o_totalprice"), 9).alias("l"), F.round(F.exp(F.log("o_totalprice")), 4).alias("back"))


@query(
    "i3_guarded_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax > 0 THEN l_discount / l_tax ELSE 0 END AS ratio,
       CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS unguarded FROM lineitem""",
)
def _(t):
    return t.lineitem.select(*LINE_KEY, S.safe_ratio("l_discount", "l_tax").alias("ratio"), F.try_divide("l_discount", "l_tax").alias("unguarded"))


@query(
    "i4_clip",
    f"SELECT p_partkey, CASE WHEN p_size < 5 THEN 5 WHEN p_size > 40 THEN 40 ELSE p_size END AS clipped FROM {PART_NULLS_SQL}",
)
def _(t):
    return part_nulls(t).select("p_partkey", S.clip("p_size", 5, 40).alias("clipped"))


@query(
    "i5_cyclic_hour",
    """SELECT event_id, h AS hour, round(sin(2 * pi() * h / 24), 9) + 0 AS hour_sin, round(cos(2 * pi() * h / 24), 9) + 0 AS hour_cos FROM
       (SELECT event_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1e6 / 3600) AS BIGINT) % 24 AS h FROM events)""",
)
def _(t):
    e = t.events.join(F.broadcast(t.events.agg(F.min("ts").alias("t0"))))
    hour = S.hour_of(S.elapsed_seconds("ts", "t0"))
    s, c = S.cyclic(hour, 24)
    return e.select("event_id", hour.alias("hour"), (F.round(s, 9) + 0).alias("hour_sin"), (F.round(c, 9) + 0).alias("hour_cos"))


@query("i6_floor_bucket", "SELECT CAST(floor(value / 15) * 15 AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(S.floor_bucket("value", 15).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "i7_interval_bins",
    """SELECT c_custkey, CASE WHEN x <= 0 THEN NULL WHEN x <= 1.5 THEN 1 WHEN x <= 3 THEN 2 WHEN x <= 4.5 THEN 3 WHEN x <= 6 THEN 4 ELSE 5 END AS cat
       FROM (SELECT c_custkey, c_acctbal / 1000 AS x FROM customer)""",
)
def _(t):
    inf = float("inf")
    return t.customer.select("c_custkey", S.cut(F.col("c_acctbal") / 1000, [0, 1.5, 3.0, 4.5, 6.0, inf], [1, 2, 3, 4, 5]).alias("cat"))


@query(
    "i8_season",
    """SELECT CASE WHEN m BETWEEN 3 AND 5 THEN 'spring' WHEN m BETWEEN 6 AND 8 THEN 'summer' WHEN m BETWEEN 9 AND 11 THEN 'fall' ELSE 'winter' END AS season,
       count(*) AS n FROM (SELECT month(o_orderdate) AS m FROM orders) GROUP BY 1""",
)
def _(t):
    return t.orders.groupBy(S.season(F.month("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


@query(
    "i9_year_difference",
    "SELECT o_orderkey, greatest(0, year(o_orderdate) - 1998) AS age, (year(o_orderdate) = 1998)::INT AS is_new FROM orders",
)
def _(t):
    y = F.year("o_orderdate")
    return t.orders.select("o_orderkey", F.greatest(F.lit(0), y - 1998).alias("age"), (y == 1998).cast("int").alias("is_new"))


@query("i10_null_safe_sum", f"SELECT p_partkey, coalesce(p_size, 0) + coalesce(p_retailprice, 0) AS total FROM {PART_NULLS_SQL}")
def _(t):
    return part_nulls(t).select("p_partkey", S.null_safe_sum("p_size", "p_retailprice").alias("total"))


@query(
    "i11_sigmoid_log_odds",
    """SELECT event_id, round(p, 9) AS p, round(ln(p / (1 - p + 1e-10)), 6) + 0 AS odds FROM
       (SELECT event_id, 1 / (1 + exp(-0.1::DOUBLE * (value - 50))) AS p FROM events)""",
)
def _(t):
    p = S.sigmoid(F.col("value") - 50, 0.1)
    return t.events.select("event_id", F.round(p, 9).alias("p"), (F.round(S.log_odds(p), 6) + 0).alias("odds"))


@query(
    "i12_string_functions",
    """SELECT p_partkey, lower(p_brand) || '_' || p_type AS name, contains(lower(p_name), 'red')::INT AS has_red,
       trim('"' || p_name || '" ', '" ') AS unquoted, CAST(p_size AS VARCHAR) AS size_text FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        F.concat_ws("_", F.lower("p_brand"), "p_type").alias("name"),
        F.lower("p_name").contains("red").cast("int").alias("has_red"),
        F.btrim(F.concat(F.lit('"'), "p_name", F.lit('" ')), F.lit('" ')).alias("unquoted"),
        F.col("p_size").cast("string").alias("size_text"),
    )


@query(
    "i15_dates",
    """SELECT o_orderkey, TRY_CAST(s AS TIMESTAMP) IS NULL AS skipped, strftime(TRY_CAST(s AS TIMESTAMP), '%Y-%m-%d') AS day,
       date_diff('day', TRY_CAST(s AS TIMESTAMP)::DATE, DATE '2002-01-01') AS age_days FROM
       (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS s FROM orders)""",
)
def _(t):
    s = F.when(F.col("o_orderstatus") == "P", "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    ts = F.try_to_timestamp(s)
    return t.orders.select(
        "o_orderkey",
        ts.isNull().alias("skipped"),
        F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.datediff(F.lit("2002-01-01").cast("date"), ts.cast("date")).cast("long").alias("age_days"),
    )


@query(
    "i16_array_functions",
    """SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 9) AS dot_rev,
       round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 9) AS norm,
       round(CAST(embedding[9] AS DOUBLE), 9) AS second_row_first, round(CAST(embedding[1] + embedding[64] AS DOUBLE), 6) AS added FROM embeddings""",
)
def _(t):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, 8))
    return t.embeddings.select(
        "vec_id",
        F.round(A.dot("embedding", F.reverse("embedding")), 9).alias("dot_rev"),
        F.round(A.norm("embedding"), 9).alias("norm"),
        F.round(rows[1][0].cast("double"), 9).alias("second_row_first"),
        F.round(F.get(A.add("embedding", F.reverse("embedding")), F.lit(0)).cast("double"), 6).alias("added"),
    )


@query(
    "i17_map_functions",
    """SELECT event_id, least(CAST(json_extract_string(props, '$.k') AS BIGINT), 10) AS capped, 0 AS absent FROM events""",
)
def _(t):
    m = F.from_json("props", "map<string,bigint>")
    capped = F.transform_values(m, lambda k, v: F.least(v, F.lit(10)))
    return t.events.select(
        "event_id", F.element_at(capped, "k").alias("capped"), F.coalesce(F.element_at(capped, "zz"), F.lit(0)).cast("int").alias("absent")
    )


@query(
    "i18_json",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS doc FROM events""",
)
def _(t):
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"),
    )


@query(
    "i19_distance_band",
    """SELECT event_id, CASE WHEN abs(value - 60) > 5 THEN 'high' WHEN abs(value - 60) > 2 THEN 'medium' ELSE 'low' END AS confidence FROM events""",
)
def _(t):
    from granary.operators.scoring import confidence_band

    return t.events.select("event_id", confidence_band(F.col("value"), 60.0).alias("confidence"))


@query(
    "i20_row_statistics",
    """SELECT vec_id, round(list_avg(e), 9) AS mean, round(list_stddev_pop(e), 9) AS std, round(list_min(e), 9) AS min, round(list_max(e), 9) AS max
       FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)""",
)
def _(t):
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select(
        "vec_id",
        F.round(A.mean(e), 9).alias("mean"),
        F.round(A.std_pop(e), 9).alias("std"),
        F.round(F.array_min(e), 9).alias("min"),
        F.round(F.array_max(e), 9).alias("max"),
    )


@query(
    "i21_type_validation",
    """SELECT event_id, CASE WHEN raw IS NULL THEN 'Missing field: Amount' WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN 'Field Amount must be numeric'
         WHEN isinf(TRY_CAST(raw AS DOUBLE)) OR isnan(TRY_CAST(raw AS DOUBLE)) THEN 'Field Amount must be finite'
         WHEN TRY_CAST(raw AS DOUBLE) < 0 THEN 'Field Amount must be >= 0' END AS error FROM
       (SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'abc' WHEN 'signup' THEN 'Infinity'
          WHEN 'error' THEN CAST(50 - value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS raw FROM events)""",
)
def _(t):
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", None)
        .when(kind == "view", "abc")
        .when(kind == "signup", "Infinity")
        .when(kind == "error", (50 - F.col("value")).cast("string"))
        .otherwise(F.col("value").cast("string"))
    )
    return t.events.select("event_id", payloads.first_error(F.create_map(F.lit("Amount"), raw), {"Amount": True}).alias("error"))


