"""Streaming queries; each has a batch twin as SQL where the result is fixed."""

from pyspark.sql import functions as F

from granary.operators import scoring
from granary.plans.common import SCORED_SQL, scored_events
from granary.plans.registry import query
from granary.streaming import jobs


def scored_feed(t):
    e = jobs.event_feed(t.spark, t.path("events"))
    score = F.floor(F.col("value") * 0.5 - F.length("event_type")) / 10.0 + 0.0
    return e.withColumn("score", score)


@query(
    "p5_stream_scoring",
    f"""SELECT event_id, (score >= 8.32)::INT AS flagged, CASE WHEN abs(score - 8.32) > 5 THEN 'high' WHEN abs(score - 8.32) > 2 THEN 'medium' ELSE 'low' END AS confidence FROM {SCORED_SQL}""",
)
def _(t):
    risk = scoring.risk_columns("score", 8.32)
    return jobs.run_to_table(scored_feed(t).select("event_id", risk["flagged"].alias("flagged"), risk["confidence"].alias("confidence")))


WINDOW_SQL = """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(score), 8) AS mean, round(stddev_pop(score), 8) AS std, round(avg((score >= 8.32)::INT), 9) AS flag_rate
  FROM (SELECT {start} AS start, score FROM {src}{extra}) GROUP BY start"""


def window_rows(t, length, slide):
    def build(feed):
        return jobs.windowed_statistics(feed, "ts", "score", F.col("score") >= 8.32, length, slide, None)

    out = jobs.run_and_close(scored_feed(t), "ts", build, length, "10 minutes")
    return out.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"),
        "n",
        F.round("mean", 8).alias("mean"),
        F.round("std", 8).alias("std"),
        F.round("flag_rate", 9).alias("flag_rate"),
    )


@query("q13_tumbling_statistics", WINDOW_SQL.format(start="date_trunc('hour', ts)", src=SCORED_SQL, extra=""))
def _(t):
    return window_rows(t, "1 hour", None)


@query(
    "q13_sliding_statistics",
    WINDOW_SQL.format(start="date_trunc('hour', ts) - INTERVAL 1 HOUR * k", src=SCORED_SQL, extra=", (SELECT unnest([0, 1]) AS k)"),
)
def _(t):
    return window_rows(t, "2 hours", "1 hour")


@query(
    "q14_last_n_per_key",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20",
)
def _(t):
    feed = jobs.event_feed(t.spark, jobs.spread_feed(t.events, "ts", 4), files_per_batch=2)
    out = jobs.latest_per_key(feed, "user_id", ["ts", "event_id"], 20, ["user_id", "event_id", "ts", "value"])
    return out.select("user_id", "event_id", "value")


def learning_rows(df):
    return df.select(
        "event_id",
        (F.get_json_object("props", "$.k").cast("double") / 50 - 1).alias("x1"),
        (F.hour("ts") / 12 - 1).alias("x2"),
        (F.col("value") / 50 + F.get_json_object("props", "$.k").cast("double") / 25).alias("y"),
    )


@query("q6_online_learning")
def _(t):
    """Learning curve: every 10th event is held out, the others are learned; scores after every 8 updates."""
    aside = F.col("event_id") % 10 == 0
    feed = jobs.event_feed(t.spark, jobs.spread_feed(t.events.where(~aside), "ts", 4), files_per_batch=1)
    holdout = learning_rows(t.events.where(aside))
    learned = jobs.online_ridge(
        learning_rows(feed), ["x1", "x2"], "y", rate=0.2, warn_below=0.8, order=["event_id"], evaluate_every=8, holdout=holdout
    )
    return jobs.evaluations(learned)


@query("m27_online_ridge")
def _(t):
    feed = jobs.event_feed(t.spark, jobs.spread_feed(t.events, "ts", 4), files_per_batch=1)
    out = jobs.online_ridge(learning_rows(feed), ["x1", "x2"], "y", rate=0.2)
    names = [F.round(F.get("weights", F.lit(i)), 6).alias(n) for i, n in enumerate(("intercept", "w1", "w2"))]
    return out.select("batch", "n", "updates", "rmse", "r2", "warning", *names)


@query("q1_stream_psi")
def _(t):
    feed = jobs.event_feed(t.spark, jobs.spread_feed(t.events, "ts", 4), files_per_batch=1)
    return jobs.stream_psi(feed, scored_events(t), ["value"])


@query(
    "d7_stream_outcome_join",
    "SELECT event_id, value AS prediction, value * 1.1::DOUBLE AS actual FROM events WHERE event_type <> 'view'",
)
def _(t):
    feed = jobs.event_feed(t.spark, t.path("events"))
    predictions = feed.select("event_id", "ts", F.col("value").alias("prediction"))
    outcomes = feed.where("event_type <> 'view'").select(
        "event_id", (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("o_ts"), (F.col("value") * 1.1).alias("actual")
    )
    joined = jobs.join_outcomes(predictions, outcomes, "event_id", "ts", "o_ts", "1 hour", "2 HOURS")
    return jobs.run_to_table(joined.select("event_id", "prediction", "actual"))
