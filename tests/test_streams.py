"""Streaming jobs: a job that goes on from its root gives what one run over the whole feed gives."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.session import fresh_path
from granary.streaming import jobs

SCHEMA = "id long, x double, y double"


def rows(spark, start, end):
    return spark.createDataFrame([(i, float(i % 7), 2.0 * (i % 7) + 1.0) for i in range(start, end)], SCHEMA)


def last_n(feed, root):
    return jobs.latest_per_key(feed, "x", ["id"], 3, ["id", "x"], root)


def ridge(feed, root):
    return jobs.online_ridge(feed, ["x"], "y", rate=0.1, root=root, order=["id"], evaluate_every=5).drop("rmse", "r2")


def psi(feed, root):
    return jobs.stream_psi(feed, rows(feed.sparkSession, 0, 500), ["x"], root)


def table(feed, root):
    return jobs.run_to_table(feed.select("id", "x"), root=root)


def contents(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("job", [last_n, ridge, psi, table])
def test_jobs_resume(spark, job):
    path, root = fresh_path(spark, "feed"), fresh_path(spark, "job")
    feed = lambda: jobs.event_feed(spark, path, "id", files_per_batch=1).withColumn("id", F.col("id").cast("long"))
    for i in range(4):
        rows(spark, i * 100, (i + 1) * 100).coalesce(1).write.mode("append").parquet(path)
        got = job(feed(), root)
        n = len(got.collect())
        # nothing new: the same result again
        assert len(job(feed(), root).collect()) == n
    assert contents(got) == contents(job(feed(), None))
    if job is last_n:
        assert sorted(r.id for r in got.collect()) == list(range(379, 400))
    if job is ridge:
        assert sorted(r.batch for r in got.collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("job", [last_n, ridge, psi])
def test_jobs_without_rows(spark, job):
    path = fresh_path(spark, "feed")
    rows(spark, 0, 1).limit(0).write.parquet(path)
    feed = jobs.event_feed(spark, path, "id").withColumn("id", F.col("id").cast("long"))
    assert all(not r.n for r in job(feed, None).collect()) if job is ridge else job(feed, None).count() >= 0


def replayed(batches, hashes, steps, every, recent, holdout, rate, decay, alpha):
    """The evaluation series of row-wise plain Python: sub-batches in order, rows in order inside each."""
    w, t, seen, held, out = np.zeros(2), 0, 0, [], []
    for batch in batches:
        for k in range(steps):
            part = sorted(r for r in batch if hashes[r] % steps == k)
            if not part:
                continue
            x = np.array([[1.0, r[1]] for r in part])
            y = np.array([r[2] for r in part])
            grad = x.T @ (x @ w - y) / len(part) + np.array([0.0, alpha * w[1]])
            w = w - rate / (1 + decay * t) * grad
            t, seen, held = t + 1, seen + len(part), (held + part)[-recent:]
            if t % every == 0:
                r2 = []
                for rows in (holdout, held):
                    v = np.array([r[2] for r in rows])
                    sse = sum((r[2] - w[0] - w[1] * r[1]) ** 2 for r in rows)
                    r2.append(1 - sse / ((v - v.mean()) ** 2).sum())
                out.append((t, seen, *r2))
    return out


def test_online_evaluation_is_a_replay(spark):
    draw = np.random.default_rng(7)
    data = [(i, float(x), float(3 * x - 1 + e)) for i, (x, e) in enumerate(zip(draw.normal(size=900), draw.normal(size=900)))]
    path = fresh_path(spark, "feed")
    df = spark.createDataFrame(data[:800], SCHEMA)
    hashes = {(r.id, r.x, r.y): r.h for r in df.select("*", F.xxhash64("id", "x", "y").alias("h")).collect()}
    root = fresh_path(spark, "job")
    holdout = spark.createDataFrame(data[800:], SCHEMA)
    for i in range(4):
        df.where(f"id >= {i * 200} and id < {i * 200 + 200}").coalesce(1).write.mode("append").parquet(path)
        feed = jobs.event_feed(spark, path, "id", files_per_batch=1).withColumn("id", F.col("id").cast("long"))
        learned = jobs.online_ridge(
            feed, ["x"], "y", rate=0.3, steps=7, root=root, order=["id"], evaluate_every=3, holdout=holdout, recent=60, warn_below=0.5
        )
    got = [tuple(r)[1:] for r in jobs.evaluations(learned).orderBy("updates").collect()]
    want = replayed([data[i * 200 : i * 200 + 200] for i in range(4)], hashes, 7, 3, 60, data[800:], 0.3, 0.01, 0.01)
    assert [g[:2] for g in got] == [w[:2] for w in want] and len(got) == 9
    assert np.allclose([g[2:4] for g in got], [w[2:] for w in want], rtol=1e-9)
    assert [g[4] for g in got] == [w[2] < 0.5 for w in want]
    assert len(learned.orderBy(F.desc("batch")).first().recent) == 60


def test_windows_close_behind_the_last_row(spark):
    path, root = fresh_path(spark, "feed"), fresh_path(spark, "job")
    start = datetime.datetime(2024, 5, 1)
    table = lambda a, b: spark.createDataFrame(
        [(start + datetime.timedelta(minutes=7 * i), float(i)) for i in range(a, b)], "ts timestamp, v double"
    )

    def build(feed):
        return jobs.windowed_statistics(feed, "ts", "v", F.col("v") > 3, "1 hour", None, None)

    def run():
        feed = jobs.event_feed(spark, path, files_per_batch=1)
        return sorted((r.start, r.n) for r in jobs.run_and_close(feed, "ts", build, "1 hour", "10 minutes", root).collect())

    table(0, 20).coalesce(1).write.mode("append").parquet(path)
    first = run()
    assert sum(n for _, n in first) == 20 and len(first) == 3
    assert run() == first  # closed already, nothing new
    # rows of later windows are counted, and closed again
    table(60, 80).coalesce(1).write.mode("append").parquet(path)
    again = run()
    assert again[: len(first)] == first and sum(n for _, n in again) == 40, again


def test_last_rows_of_a_busy_key(spark):
    path, root = fresh_path(spark, "feed"), fresh_path(spark, "job")
    feed = lambda: jobs.event_feed(spark, path, "id", files_per_batch=1).withColumn("id", F.col("id").cast("long"))
    data = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id") % 100 + 0.0).alias("x"), F.lit(None).cast("double").alias("y"))
    for i in range(3):
        data.where(f"id % 3 = {i} or id % 7 = {i}").coalesce(1).write.mode("append").parquet(path)
        got = jobs.latest_per_key(feed(), "x", ["id"], 5, ["id", "x", "y"], root)
    seen = sorted({r.id: r.x for r in data.where("id % 3 < 3").collect()}.items())
    want = {}
    for i, x in seen:
        times = sum(i % 3 == k or i % 7 == k for k in range(3))
        want[x] = (want.get(x, []) + [i] * times)[-5:]
    have = {}
    for r in got.orderBy("id").collect():
        assert r.y is None
        have.setdefault(r.x, []).append(r.id)
    assert have == want
