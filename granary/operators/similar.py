"""Nearest rows by the features that both rows have, found in one index of boxes.

Rows lie in cells: rows that have the same features, near each other in a
z-order of them. A cell is known by its box, the least and greatest value of
every feature. Distances to the near and the far side of a box bound those to
its rows, so a query visits only the cells that can hold one of its nearest.
The number of cells is bounded; inside a cell, tiles of rows are pruned by
their own boxes and by the distances found so far.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.ranking import default_buckets, sorted_positions
from granary.session import materialize

CELLS = 8192  # boxes that every searching task holds
CELL_ROWS = 256
TILE_ROWS = 64
QUERY_ROWS = 4096
_BITS = 8  # of a feature's place in the z-order


def _vectors(df: DataFrame, key: str, features: Sequence[str], scale: Sequence[float]) -> DataFrame:
    """(id, v, mask): scaled values, null where missing, and the set of features that are there."""
    values = [F.nanvl(col(c).cast("double"), F.lit(None).cast("double")) * F.lit(float(s)) for c, s in zip(features, scale)]
    rows = df.select(col(key).cast("long").alias("id"), F.array(*values).alias("v"))
    bits = reduce(lambda a, b: a + b, [F.when(F.col("v")[i].isNotNull(), 1 << i).otherwise(0) for i in range(len(features))])
    return rows.withColumn("mask", bits).where("mask <> 0")


def _z_order(rows: DataFrame, p: int) -> DataFrame:
    """Adds ``z``: the interleaved bits of every feature's place among its quantiles."""
    share = [i / (1 << _BITS) for i in range(1, 1 << _BITS)]
    got = rows.agg(*[F.percentile_approx(F.col("v")[i], share, 10_000).alias(f"c{i}") for i in range(p)]).first()
    cuts = [np.unique(c or []) for c in got]
    bits = max(1, min(_BITS, 60 // p))

    def run(batches):
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("v")]), p)
            z = np.zeros(len(v), np.int64)
            for i, known in enumerate(cuts):
                place = np.searchsorted(known, np.nan_to_num(v[:, i])) >> (_BITS - bits)
                for b in range(bits):
                    z |= ((place >> b) & 1) << (b * p + i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z)], names=["id", "v", "mask", "z"])

    return rows.select("id", "v", "mask").mapInArrow(run, "id long, v array<double>, mask int, z long")


def _matrix(lists: pa.Array, p: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p) if len(lists) else np.zeros((0, p))


def _mean(parts: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sum over the last axis divided by the number of common features; infinite where there is none."""
    n = common.sum(-1)
    return np.where(n > 0, np.where(common, parts, 0.0).sum(-1) / np.maximum(n, 1), np.inf)


def box_bounds(v: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible distance of every row of v to the rows in every box; features that are NaN do not count."""
    q, lo, hi = v[:, None, :], low[None], high[None]
    common = ~np.isnan(q) & ~np.isnan(lo)
    near = np.maximum(np.maximum(lo - q, q - hi), 0.0)
    far = np.maximum(np.abs(q - lo), np.abs(q - hi))
    return _mean(near, common), _mean(far, common)


def _searched(a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of queries: (query, id, distance) of the n nearest rows, ties by id; rows b lie in z-order."""
    starts = np.arange(0, len(b), TILE_ROWS)
    with np.errstate(invalid="ignore"):
        low, high = (np.array([f(b[s : s + TILE_ROWS], axis=0) for s in starts]) for f in (np.min, np.max))
    out = []
    step = max(1, min(256, 4_000_000 // (len(starts) * TILE_ROWS * a.shape[1])))
    for at in range(0, len(a), step):
        q = a[at : at + step]
        near, far = box_bounds(q, low, high)
        # enough rows lie within the far side of the nearest tiles
        order = np.argsort(far, axis=1)
        sizes = np.minimum(TILE_ROWS, len(b) - starts)
        reached = np.argmax(np.cumsum(sizes[order], axis=1) >= min(n, len(b)), axis=1)
        limit = far[np.arange(len(q)), order[np.arange(len(q)), reached]]
        who, tile = np.nonzero(near <= limit[:, None] + 1e-9)
        rows = np.minimum(starts[tile][:, None] + np.arange(TILE_ROWS), len(b) - 1)
        real = starts[tile][:, None] + np.arange(TILE_ROWS) < len(b)
        d = np.abs(q[who][:, None, :] - b[rows])
        d = np.round(_mean(d, ~np.isnan(d)), 9)
        keep = real & (d <= limit[who][:, None] + 1e-9) & np.isfinite(d)
        i, c = np.nonzero(keep)
        query, row, d = who[i], rows[i, c], d[i, c]
        order = np.lexsort((ids[row], d, query))
        query, row, d = query[order], row[order], d[order]
        first = np.searchsorted(query, np.arange(len(q)))
        best = np.arange(len(query)) - first[query] < n
        out.append((at + query[best], ids[row[best]], d[best]))
    return out


def nearest_by_common(asked: DataFrame, table: DataFrame, key: str, given: dict[str, float], n: int) -> DataFrame:
    """(key, rank, neighbor): the n rows of ``table`` nearest to every row of ``asked``, ties by key.

    Distance is the mean, over the features that both rows have, of weight x
    |difference| / deviation. Rows without a common feature are no neighbours;
    NaN counts as missing. Equal rows are searched once, and of equal rows of
    the table only the n least keys are candidates. Repeated keys of ``asked``
    get one answer each.
    """
    names = list(given)
    p = len(names)
    spark = table.sparkSession
    dev = table.agg(*[F.stddev(F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))).alias(f"d{i}") for i, c in enumerate(names)]).first()
    scale = [given[c] / (dev[i] or 1.0) for i, c in enumerate(names)]
    least = Window.partitionBy("v").orderBy("id")
    rows = _vectors(table, key, names, scale).withColumn("_rn", F.row_number().over(least)).where(F.col("_rn") <= n).drop("_rn")
    rows = materialize(rows, "similar-rows")
    size = max(CELL_ROWS, -(-rows.count() // CELLS))
    placed = sorted_positions(_z_order(rows, p), ["mask", "z", "id"], "_at")  # a written table
    cells = placed.withColumn("cell", F.floor(F.col("_at") / size))
    # at most CELLS boxes, and one more for every set of features
    ends = [f(F.col("v")[i]).alias(f"{m}{i}") for m, f in (("a", F.min), ("b", F.max)) for i in range(p)]
    boxes = cells.groupBy("mask", "cell").agg(F.count("*").alias("n"), *ends).orderBy("mask", "cell").collect()
    wanted = _vectors(asked, key, names, scale).select(F.col("id").alias("q"), "v")
    if not boxes:
        return wanted.select(F.col("q").alias(key), F.lit(1).alias("rank"), F.col("q").alias("neighbor")).limit(0)
    nan = lambda x: np.nan if x is None else x
    low, high = (np.array([[nan(r[f"{m}{i}"]) for i in range(p)] for r in boxes]) for m in "ab")
    shared = spark.sparkContext.broadcast((low, high, np.array([r.n for r in boxes])))

    def visits(batches):
        low, high, sizes = shared.value
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("v")]), p)
            step = max(1, 2_000_000 // (len(low) * p))
            for at in range(0, len(v), step):
                near, far = box_bounds(v[at : at + step], low, high)
                order = np.argsort(far, axis=1, kind="stable")
                known = np.where(np.isfinite(np.take_along_axis(far, order, 1)), sizes[order], 0)
                enough = np.cumsum(known, axis=1) >= n
                line = np.arange(len(near))
                limit = np.where(enough.any(1), far[line, order[line, enough.argmax(1)]], np.inf)
                who, cell = np.nonzero((near <= limit[:, None] + 1e-9) & np.isfinite(near))
                part = batch.take(pa.array(at + who))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], names=["qid", "v", "box"])

    groups = wanted.groupBy("v").agg(F.min("q").alias("qid"))
    visiting = materialize(groups.select("qid", "v").mapInArrow(visits, "qid long, v array<double>, box long"), "similar-visits")
    names_of = spark.createDataFrame([(r.mask, r.cell, i) for i, r in enumerate(boxes)], "mask int, cell long, box long")
    counts = visiting.groupBy("box").agg(F.ceil(F.count("*") / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
    counts = F.broadcast(counts)  # at most one row per box
    block = F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")
    none = F.lit(None).cast("long")
    left = visiting.join(counts, "box").select("box", block.alias("block"), "qid", none.alias("id"), F.lit(0).cast("long").alias("z"), "v")
    members = cells.join(F.broadcast(names_of), ["mask", "cell"]).join(counts, "box")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    right = members.select("box", each, none.alias("qid"), "id", "_at", "v")

    def compare(t: pa.Table) -> pa.Table:
        asking = t.column("id").is_null().to_numpy()
        v, at = _matrix(t.column("v"), p), t.column("z").to_numpy()
        ids = t.column("id").fill_null(0).to_numpy()
        rows = np.flatnonzero(~asking)
        rows = rows[np.argsort(at[rows], kind="stable")]
        who = np.flatnonzero(asking)
        qid = t.column("qid").fill_null(0).to_numpy()[who]
        found = _searched(v[who], v[rows], ids[rows], n)
        q, i, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        return pa.table({"qid": pa.array(qid[q]), "id": pa.array(i), "d": pa.array(d, pa.float64())})

    # little data, much work: a stated number of partitions is not merged into few
    tasks = max(default_buckets(table), 3 * spark.sparkContext.defaultParallelism)
    found = left.union(right).repartition(tasks, "box", "block").groupBy("box", "block").applyInArrow(compare, "qid long, id long, d double")
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).where(F.col("rank") <= n)
    same = wanted.distinct().join(groups, "v").select("q", "qid")
    return same.join(top, "qid").select(F.col("q").alias(key), "rank", F.col("id").alias("neighbor"))
