"""Structured Streaming jobs over an event feed.

Every job runs until the input is used up (``availableNow``), keeps its progress
and state under one root folder and writes parquet that is read back as the
result. A job called again with the same ``root`` goes on where it ended or was
broken off; without one it gets a fresh root under the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from granary.functions.scalars import col
from granary.models.linear import r_squared
from granary.operators.drift import psi_from_bins, reference_bins
from granary.operators.gram import moments, total
from granary.session import fresh_path, sized


def event_feed(spark: SparkSession, table_path: str, ts: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; the event time gets a zone so it can carry a watermark.

    The path is given as a pattern because a stream accepts a single file only
    through one; it matches exactly that file or folder.
    """
    schema = spark.read.parquet(table_path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    exact = f"{table_path[:-1]}[{table_path[-1]}]"
    return reader.parquet(exact).withColumn(ts, col(ts).cast("timestamp"))


def spread_feed(df: DataFrame, order: str, files: int) -> str:
    """Write a table as time-ordered files, so that a feed of it has several batches."""
    path = fresh_path(df.sparkSession, "feed")
    df.repartitionByRange(files, order).write.parquet(path)
    return path


def run_to_table(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run a stream into a parquet table and read it."""
    root = root or fresh_path(stream.sparkSession, "stream")
    _run(stream, mode, root)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/table")


def _run(stream: DataFrame, mode: str, root: str) -> StreamingQuery:
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start(f"{root}/table")
    )
    q.awaitTermination()
    return q


def run_and_close(
    feed: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], length: str, delay: str, root: str | None = None
) -> DataFrame:
    """Run ``build(feed)`` into a table and close the feed behind its last row.

    Windows still open when the input is used up are emitted too: a second
    source, a folder of marks under ``root``, then brings one row without
    values, so late that the watermark passes the end of every window of
    ``length``. The mark itself is taken out behind the watermark; ``build``
    must not set another. Rows that come to the same root afterwards count as
    late if they belong to a closed window. A call that was broken off before
    the mark closes the feed when it is repeated. Rows without a time are left
    out.
    """
    spark = feed.sparkSession
    root = root or fresh_path(spark, "stream")
    marks = f"{root}/marks"
    marked = feed.withColumn("_mark", F.lit(None).cast("timestamp"))
    # a row of its own, long past, so that there is a batch, and with it a watermark, without new rows too
    _write_mark(spark, marked.schema, ts, marks, F.lit(0).cast("timestamp"))
    both = marked.unionByName(spark.readStream.schema(marked.schema).parquet(marks)).withWatermark(ts, delay)
    # one comparison with the time itself, which the optimizer does not move before the watermark
    real = F.col(ts) != F.coalesce(F.col("_mark"), F.lit("0001-01-01").cast("timestamp"))
    stream = build(both.where(real).drop("_mark"))
    progress = _run(stream, "append", root).lastProgress
    reached = F.lit(progress["eventTime"]["watermark"]).cast("timestamp")
    wait = F.expr(f"INTERVAL {delay}")
    last = spark.read.schema(marked.schema).parquet(marks).agg(F.max(ts).alias("last"))
    after = (reached + wait + wait + F.expr(f"INTERVAL {length}") + F.expr("INTERVAL 1 SECOND")).alias("after")
    # no row so far, or none later than the last mark: closed already
    done = (reached <= F.col("last") - wait) | (reached <= F.lit(0).cast("timestamp"))
    row = last.select(after, done.alias("done")).first()
    if not row.done:
        _write_mark(spark, marked.schema, ts, marks, F.lit(row.after))
        _run(stream, "append", root)
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


def _write_mark(spark: SparkSession, schema: StructType, ts: str, marks: str, at: Column) -> None:
    value = lambda f: at if f.name in (ts, "_mark") else F.lit(None)
    row = spark.range(1).select(*[value(f).cast(f.dataType).alias(f.name) for f in schema])
    row.coalesce(1).write.mode("append").parquet(marks)


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], root: str) -> None:
    q = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def windowed_statistics(
    stream: DataFrame, ts: str, value: str, flag: Column, length: str, slide: str | None, delay: str | None, by: Sequence[str] = ()
) -> DataFrame:
    """Score statistics per event-time window; rows later than ``delay`` are dropped.

    Without ``delay`` the stream has a watermark already.
    """
    return (
        (stream.withWatermark(ts, delay) if delay else stream)
        .groupBy(F.window(ts, length, slide) if slide else F.window(ts, length), *by)
        .agg(
            F.count("*").alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_pop(value).alias("std"),
            F.avg(flag.cast("int")).alias("flag_rate"),
        )
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "mean", "std", "flag_rate")
    )


def _version(root: str, batch: int) -> str:
    return f"{root}/state/v{batch + 1:012d}"


def _empty_version(spark: SparkSession, path: str, schema) -> None:
    """The version before the first batch, so that a feed without rows has a result too."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


class _LastRows(StatefulProcessor):
    """List state with the last rows of one part of one key."""

    def __init__(self, schema: StructType, order: Sequence[str], n: int):
        self.schema, self.order, self.n = schema, list(order), n

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        place = lambda r: tuple((r[c] is not None, r[c]) for c in self.order)
        names = self.schema.names
        held = [Row(**dict(zip(names, r))) for r in self.rows.get()]
        last = heapq.nlargest(self.n, chain(held, rows), key=place)
        self.rows.put([tuple(r[c] for c in names) for r in last])
        return iter(())

    def close(self) -> None:
        pass


def latest_per_key(
    stream: DataFrame, key: str, order: Sequence[str], n: int, cols: Sequence[str], root: str | None = None, parts: int = 4
) -> DataFrame:
    """The last n rows of every key over the whole feed, as kept state.

    State is a list of at most n rows per (key, part) in the state store: a
    batch reads and writes the lists of its own keys only, and rows of a busy
    key go to ``parts`` tasks. Reading takes the lists from the store and cuts
    each key once more. ``parts`` is fixed by the first run of a root.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, "last-n")
    kinds = stream.select(*cols).schema
    times = [f.name for f in kinds if f.dataType.typeName().startswith("timestamp")]
    # times are kept as microseconds: Python rows and stored rows differ in their zones
    stream = stream.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in times})
    schema = stream.select(*cols).schema
    rows = stream.select(*cols, F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int").alias("_part"))
    kept = rows.groupBy(key, "_part").transformWithState(
        _LastRows(schema, order, n), outputStructType="part int", outputMode="Update", timeMode="None"
    )
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/progress")
        q.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    state = spark.read.format("statestore").option("path", f"{root}/progress").option("stateVarName", "rows").load()
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    found = state.select("list_element.*")
    found = found.withColumns({c: F.timestamp_micros(c).cast(kinds[c].dataType) for c in times})
    return found.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


RIDGE_SCHEMA = """batch long, n long, updates long, samples long, rmse double, r2 double, warning boolean, weights array<double>,
  recent array<struct<x: array<double>, y: double>>,
  evaluations array<struct<updates: long, samples: long, r2_holdout: double, r2_recent: double, warning: boolean>>"""
LEAST_EVALUATED = 10


def _recent_r2(recent: list, w: np.ndarray) -> float | None:
    """R2 over the last rows; none if they are too few, 0 if their targets are all equal."""
    if len(recent) < LEAST_EVALUATED:
        return None
    x, y = np.array([r[0] for r in recent]), np.array([r[1] for r in recent])
    total = float(((y - y.mean()) ** 2).sum())
    return 1.0 - float(((y - w[0] - x @ w[1:]) ** 2).sum()) / total if total > 0 else 0.0


def online_ridge(
    stream: DataFrame,
    features: Sequence[str],
    target: str,
    rate: float = 0.05,
    decay: float = 0.01,
    alpha: float = 0.01,
    steps: int = 16,
    warn_below: float = 0.0,
    root: str | None = None,
    order: Sequence[str] = (),
    evaluate_every: int = 0,
    holdout: DataFrame | None = None,
    recent: int = 200,
) -> DataFrame:
    """Ridge weights updated by every micro-batch; each batch is scored before it is learned.

    A batch becomes ``steps`` sub-batches by a hash of the row, each reduced to
    cross products by one aggregation and learned as one update; the rate falls
    as rate / (1 + decay t). After every ``evaluate_every`` updates the weights
    are scored on the ``holdout``, through its cross products, and on the last
    ``recent`` learned rows: those of the latest sub-batches, by ``order`` (and
    the row's hash) inside one. A score below ``warn_below`` sets the warning;
    the holdout's decides if there is one. Weights, last rows and evaluations
    are one row of a versioned table, so a repeated batch starts from the same
    state.
    """
    spark = stream.sparkSession
    root = root or fresh_path(spark, "online")
    p = len(features)
    _empty_version(spark, _version(root, -1), RIDGE_SCHEMA)
    aside = moments(holdout, features, target).get(None) if holdout is not None and evaluate_every else None

    def last_rows(batch: DataFrame) -> dict[int, list]:
        """The last rows of every sub-batch, oldest first; at most steps x recent rows."""
        w = Window.partitionBy("_k").orderBy(*[F.desc(c) for c in order], F.desc("_h"))
        rows = batch.select("*", F.xxhash64(*batch.columns).alias("_h")).dropna(subset=[*features, target])
        rows = rows.withColumn("_k", F.pmod("_h", F.lit(steps))).withColumn("_rn", F.row_number().over(w))
        x = F.array(*[F.col(c).cast("double") for c in features])
        out: dict[int, list] = {}
        for r in rows.where(F.col("_rn") <= recent).select("_k", "_rn", x.alias("x"), F.col(target).cast("double").alias("y")).orderBy("_k", F.desc("_rn")).collect():
            out.setdefault(r._k, []).append((list(r.x), r.y))
        return out

    def handle(batch: DataFrame, batch_id: int) -> None:
        prev = spark.read.schema(RIDGE_SCHEMA).parquet(_version(root, batch_id - 1)).first()
        w, t, seen = (np.array(prev.weights), prev.updates, prev.samples) if prev else (np.zeros(p + 1), 0, 0)
        held = [(list(r.x), r.y) for r in prev.recent] if prev else []
        part = F.pmod(F.xxhash64(*batch.columns), F.lit(steps))
        cells = moments(batch, features, target, part)
        tails = last_rows(batch) if evaluate_every and cells else {}
        found = []
        n, rmse, r2 = 0, None, None
        if cells:
            sse = sum(m.squared_error(w[1:], float(w[0])) for m in cells.values())
            whole = total(cells)
            n, rmse, r2 = int(whole.n), float(np.sqrt(sse / whole.n)), float(r_squared(sse, whole.total_squares()))
        for k in sorted(cells):
            m = cells[k]
            mu = m.mean
            second = m.scatter / m.n + np.outer(mu, mu)
            error_mean = w[0] + mu[:-1] @ w[1:] - mu[-1]
            grad = np.append(error_mean, mu[:-1] * w[0] + second[:-1, :-1] @ w[1:] - second[:-1, -1] + alpha * w[1:])
            w = w - rate / (1 + decay * t) * grad
            t, seen = t + 1, seen + int(m.n)
            held = (held + tails.get(k, []))[-recent:]
            if evaluate_every and t % evaluate_every == 0:
                apart = None
                if aside is not None and aside.n >= LEAST_EVALUATED:
                    apart = float(r_squared(aside.squared_error(w[1:], float(w[0])), aside.total_squares()))
                last = _recent_r2(held, w)
                score = last if apart is None else apart
                if score is not None:
                    found.append((t, seen, apart, last, bool(score < warn_below)))
        warning = bool(r2 is not None and r2 < warn_below)
        row = (batch_id, n, t, seen, rmse, r2, warning, [float(x) for x in w], held, found)
        spark.createDataFrame([row], RIDGE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(_version(root, batch_id))

    run_batches(stream, handle, root)
    return spark.read.schema(RIDGE_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{root}/state")


def evaluations(learned: DataFrame) -> DataFrame:
    """(batch, updates, samples, r2_holdout, r2_recent, warning): the learning curve of ``online_ridge``."""
    return learned.select("batch", F.inline("evaluations"))


def stream_psi(stream: DataFrame, reference: DataFrame, cols: Sequence[str], root: str | None = None) -> DataFrame:
    """PSI of every micro-batch against a fixed reference."""
    spark = stream.sparkSession
    root = root or fresh_path(spark, "psi")
    schema = "feature string, n long, psi double, batch int"
    _empty_version(spark, _version(root, -1), schema)
    bins = sized(reference_bins(reference, cols), "bins")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = psi_from_bins(bins, batch, cols).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(_version(root, batch_id))

    run_batches(stream, handle, root)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/state")


def join_outcomes(
    predictions: DataFrame, outcomes: DataFrame, key: str, p_ts: str, o_ts: str, delay: str, within: str
) -> DataFrame:
    """Predictions with their outcome arriving up to ``within`` later; both sides carry watermarks."""
    p = predictions.withWatermark(p_ts, delay)
    o = outcomes.withWatermark(o_ts, delay).withColumnRenamed(key, "_key")
    in_time = (F.col(o_ts) >= F.col(p_ts)) & (F.col(o_ts) <= F.col(p_ts) + F.expr(f"INTERVAL {within}"))
    return p.join(o, (F.col(key) == F.col("_key")) & in_time).drop("_key")
