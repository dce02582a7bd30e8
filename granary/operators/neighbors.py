"""Exact k nearest neighbours as a pruned, blocked join.

Rows are assigned to the nearest of a few pivots. Triangle inequalities tell
which cells can hold neighbours of a query. Cells are bundled into blocks of a
bounded number of rows, and a query is sent once to a block in which it has a
cell to visit. Each task compares one block of queries with one block of rows,
cell by cell, and keeps k per query, so pairs are never emitted. Equal vectors
are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scalars import col
from granary.operators.ranking import default_buckets
from granary.session import materialize

BLOCK_ROWS = 32_768  # vectors of one side that a task holds
LEAST_ROWS = 1024  # smaller blocks are not worth a task
STEP = 256  # queries compared at a time
MAX_PIVOTS = 256


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()).astype(float)


def _distances(a: np.ndarray, b: np.ndarray, metric: str = "l2") -> np.ndarray:
    if metric == "l1":
        return sum(np.abs(a[:, j, None] - b[None, :, j]) for j in range(a.shape[1]))
    d2 = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d2, 0.0))


def _vectors(c: pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix."""
    if pc.count_distinct(pc.list_value_length(c), "all").as_py() > 1 or c.null_count:
        raise ValueError("vectors must have the same length")
    return pc.list_flatten(c).to_numpy().astype(float).reshape(len(c), -1)


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances in a fast form, squared ones for l2."""
    if metric == "l1":
        return _distances(a, b, metric)
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T


def _ceiling(d: np.ndarray, norm: np.ndarray, metric: str) -> np.ndarray:
    """What the fast form may show for exact distances up to ``d``; ``norm``: largest squared norms that went into it."""
    return (d + 1e-5 if metric == "l1" else (d + 1e-5) ** 2) + 1e-12 * norm


def _search(a, b, cell, limit, pivots, radius, want: int, metric: str):
    """(query, row, distance) of the ``want`` nearest rows of a block, or as many as lie within ``limit``, by query.

    Queries that lie near each other go together, nearest cells first.
    """
    order = np.argsort(cell, kind="stable")
    cells, starts = np.unique(cell[order], return_index=True)
    rows = np.split(order, starts[1:])
    far = _distances(a, pivots[cells], metric)
    near = np.argsort(far.argmin(1), kind="stable")
    longest = (b * b).sum(1).max()
    for at in range(0, len(a), STEP):
        part = near[at : at + STEP]
        x, d = a[part], far[part]
        norm = (x * x).sum(1) + longest
        open_ = d - radius[cells] <= limit[part, None] + 1e-6
        cap = _ceiling(limit[part], norm, metric)
        best = np.full((len(part), want), np.inf)
        found = []
        for c in np.argsort(d.mean(0)):
            s = np.flatnonzero(open_[:, c])
            if not len(s):
                continue
            v = _rough(x[s], b[rows[c]], metric)
            i, j = np.nonzero(v <= cap[s, None])
            if len(i) > 4 * want * len(s):  # no close limit yet
                cap[s] = np.minimum(cap[s], _raised(np.partition(v, want - 1, axis=1)[:, want - 1], norm[s], metric))
                i, j = np.nonzero(v <= cap[s, None])
            if not len(i):
                continue
            v = v[i, j]
            found.append((s[i], rows[c][j], v))
            by = np.lexsort((v, i))
            i, v = i[by], v[by]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            new = np.full((len(s), want), np.inf)
            new[i[place < want], place[place < want]] = v[place < want]
            best[s] = np.sort(np.concatenate([best[s], new], axis=1), axis=1)[:, :want]
            cap[s] = np.minimum(cap[s], _raised(best[s, -1], norm[s], metric))
        if not found:
            continue
        i, j, v = (np.concatenate(f) for f in zip(*found, strict=True))
        kept = v <= cap[i]
        i, j = i[kept], j[kept]
        # candidates by the fast form, exact differences decide
        exact = np.empty(len(i))
        for m in range(0, len(i), BLOCK_ROWS):
            z = slice(m, m + BLOCK_ROWS)
            diff = b[j[z]] - x[i[z]]
            exact[z] = np.abs(diff).sum(1) if metric == "l1" else np.sqrt((diff**2).sum(1))
        yield part[i], j, np.round(exact, 9)


def _raised(v: np.ndarray, norm: np.ndarray, metric: str) -> np.ndarray:
    """The ceiling for distances up to that of the fast form's value ``v``."""
    v = v + 1e-12 * norm
    return _ceiling(v if metric == "l1" else np.sqrt(np.maximum(v, 0.0)), norm, metric)


def _bundled(size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and its number of blocks: small cells share one, those above ``most`` rows are cut."""
    first, parts = np.zeros(len(size), dtype=int), np.maximum(1, -(-size // most))
    blocks, shared, held = 0, 0, most
    for c, n in enumerate(size):
        if parts[c] == 1 and held + n <= most:
            first[c], held = shared, held + n
            continue
        first[c] = blocks
        blocks += parts[c]
        if parts[c] == 1:
            shared, held = first[c], n
    return first, parts


def _pick_pivots(rows: DataFrame, n: int) -> np.ndarray:
    """A repeatable spread of vectors: the smallest hashes of distinct ones."""
    k = int(min(MAX_PIVOTS, max(1, np.sqrt(n))))
    picked = rows.select("v").orderBy(F.md5(F.to_json("v"))).limit(k).collect()
    return np.array([r.v for r in picked], dtype=float)


def _nearest_pivot(pivots: np.ndarray, metric: str):
    def assign(batches):
        for b in batches:
            d = _distances(_matrix(b["v"]), pivots, metric)
            cell = d.argmin(1)
            yield b.assign(cell=cell.astype("int32"), dist=d[np.arange(len(d)), cell])

    return assign


def _vector(df: DataFrame, vector: str) -> Column:
    """Single precision stays as it is; tasks compare in double."""
    kind = df.select(col(vector)).schema[0].dataType.simpleString()
    return col(vector).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v")


def nearest(
    queries: DataFrame,
    rows: DataFrame,
    query_key: str,
    row_key: str,
    vector: str,
    k: int,
    payload: str | None = None,
    exclude_self: bool = False,
    metric: str = "l2",
) -> DataFrame:
    """(query_key, rank, neighbor, distance, payload): k nearest rows, ties by row key.

    ``metric`` is l2 or l1; distances are compared to nine decimals.
    """
    want = k + 1 if exclude_self else k
    value = col(payload).cast("double") if payload else F.lit(None).cast("double")
    base = rows.select(col(row_key).cast("long").alias("id"), _vector(rows, vector), value.alias("y"))
    # equal vectors: only the smallest keys can be among k neighbours
    first = Window.partitionBy("v").orderBy("id")
    base = base.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= want).drop("_rn")
    base = materialize(base, "knn-rows")
    n = base.count()
    if n == 0:
        raise ValueError("no rows to search")
    pivots = _pick_pivots(base, n)
    kind = base.schema["v"].dataType.simpleString()
    cells = materialize(base.mapInPandas(_nearest_pivot(pivots, metric), f"id long, v {kind}, y double, cell int, dist double"), "knn-cells")
    near = Window.partitionBy("cell").orderBy("dist", "id")
    ranked = cells.select("cell", "dist", "id").withColumn("_rn", F.row_number().over(near)).where(F.col("_rn") <= want)
    kth = ranked.groupBy("cell").agg(F.max(F.when(F.col("_rn") == want, F.col("dist"))).alias("kth"))
    stats = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).join(kth, "cell").collect()

    p = len(pivots)
    size, radius = np.zeros(p, dtype=int), np.full(p, -1.0)
    bound = np.full(p, np.inf)
    for r in stats:
        size[r.cell], radius[r.cell] = r.n, r.radius
        bound[r.cell] = np.inf if r.kth is None else r.kth
    total = int(size.sum())

    cores = rows.sparkSession.sparkContext.defaultParallelism
    # enough blocks for all cores while there are few rows
    most = min(BLOCK_ROWS, max(LEAST_ROWS, -(-n // math.isqrt(4 * cores))))
    first_block, row_parts = _bundled(size, most)
    held = np.zeros((p, int((first_block + row_parts).max())), dtype=np.float32)
    for c in range(p):
        held[c, first_block[c] : first_block[c] + row_parts[c]] = 1

    def reach(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within which distance the neighbours of the queries lie, and the blocks that they visit."""
        d = _distances(v, pivots, metric)
        limit = (d + bound).min(1)
        if not np.isfinite(limit).all() and total >= want:
            # no single cell holds k rows: reach far enough to cover k rows over several
            order = np.argsort(d + radius, axis=1)
            enough = np.cumsum(size[order], axis=1) >= want
            at = order[np.arange(len(d)), enough.argmax(1)]
            limit = np.minimum(limit, (d + radius)[np.arange(len(d)), at])
        hit = (d - radius <= limit[:, None] + 1e-6) & (size > 0)
        return limit, hit.astype(np.float32) @ held > 0

    def visited(batches):
        for b in batches:
            n = reach(_matrix(b["v"]))[1].sum(0)
            yield pd.DataFrame({"block": np.arange(len(n), dtype="int32"), "n": n})

    def visits(batches):
        for b in batches:
            limit, hit = reach(_matrix(b["v"]))
            b = b.assign(limit=limit)
            for k in np.flatnonzero(hit.any(0)):
                yield b[hit[:, k]].assign(block=np.int32(k))

    asked = queries.select(col(query_key).cast("long").alias("q"), _vector(queries, vector))
    groups = materialize(asked.groupBy("v").agg(F.min("q").alias("qid")).select("qid", "v"), "knn-queries")
    # counted first, so that the copies of the queries need not be written
    asked_per_block = groups.select("v").mapInPandas(visited, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()
    query_parts = [1] * held.shape[1]
    for r in asked_per_block:
        query_parts[r.block] = max(1, -(-r.n // most))

    def at(values, i) -> Column:
        return F.get(F.lit([int(v) for v in values]), F.col(i))

    spread = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    kind = groups.schema["v"].dataType.simpleString()
    left = groups.mapInPandas(visits, f"qid long, v {kind}, limit double, block int").withColumn("part", spread("qid", at(query_parts, "block")))
    right = (
        cells.withColumn("block", (at(first_block, "cell") + spread("id", at(row_parts, "cell"))).cast("int"))
        .select("id", "v", "y", "cell", "block", F.explode(F.sequence(F.lit(0), at(query_parts, "block") - 1)).alias("part"))
    )

    def compare(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
        if q.num_rows and r.num_rows:
            ids = r["id"].to_numpy()
            found = _search(
                _vectors(q["v"]), _vectors(r["v"]), r["cell"].to_numpy(), q["limit"].to_numpy(), pivots, radius, want, metric
            )
            for i, c, exact in found:
                order = np.lexsort((ids[c], exact, i))
                i, c, exact = i[order], c[order], exact[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < want
                out.append((i[keep], c[keep], exact[keep]))
        i, c, exact = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"qid": q["qid"].take(pa.array(i)), "id": r["id"].take(pa.array(c)), "d": exact, "y": r["y"].take(pa.array(c))})

    keys = ["block", "part"]
    # little data, much work: a stated number of partitions is not merged into few
    tasks = max(default_buckets(rows), 3 * cores)
    found = (
        left.repartition(tasks, *keys)
        .groupBy(*keys)
        .cogroup(right.repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(compare, "qid long, id long, d double, y double")
    )
    best = Window.partitionBy("qid").orderBy("d", "id")
    top = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= want)
    # back to every query with the same vector
    same = asked.join(groups, "v").select("q", "qid")
    out = same.join(top, "qid")
    if exclude_self:
        out = out.where(F.col("q") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(
        F.col("q").alias(query_key), "rank", F.col("id").alias("neighbor"), F.col("d").alias("distance"), F.col("y").alias("payload")
    )


def vote(neighbors: DataFrame, query_key: str, weights: str = "uniform", out: str = "prediction") -> DataFrame:
    """Majority class of the neighbours, the smallest class on a tie."""
    w = F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
    votes = neighbors.groupBy(query_key, "payload").agg(F.sum(w).alias("w"))
    best = F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("payload")).alias("c")))
    return votes.groupBy(query_key).agg((-best["c"]).cast("int").alias(out))


