"""Exact search for the highest inner products through a pivot-distance index.

Inner products become distances: every vector gets one more coordinate that
brings all lengths to the greatest one, so the nearest vectors are those of
the highest product. A vector is keyed by its nearest pivot and its distance
to it; cut along this order, the keys form annuli around the pivots. A query
looks into the annulus it falls into first and then into every annulus whose
distance, by the triangle inequality, may still be below that of its k-th
best. Annuli and query blocks meet as matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import materialize
from granary.operators.ranking import sorted_positions

PIVOTS = 64  # vectors of least hash; their number bounds what is sent to every task
ANNULUS = 1024  # most vectors in an annulus
QUERY_BLOCK = 1024


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))),
        F.lit(False),
    )


def scaled(vector: Column, factor: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0.0))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest products over all other vectors.

    ``vectors`` and ``queries`` are (vec_id, v array<double>) of whole numbers;
    shorter vectors count as filled with zeros. Ties go to the smaller vec_id.
    Rows with the query's own vec_id are left out; repeated query rows are one
    query, repeated vectors are candidates each. Null ids take no part, and
    without other vectors a query has no rows. Products are exact below 2^53.
    """
    spark = vectors.sparkSession
    vectors = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    queries = queries.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), "v")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    facts = vectors.agg(F.max(F.size("v")).alias("d"), F.max(square).alias("m")).first()
    wide = queries.agg(F.max(F.size("v")).alias("d")).first()
    dim, top = max(facts.d or 0, wide.d or 0, 1), float(facts.m or 0.0)
    chosen = vectors.orderBy(F.xxhash64("v"), "vec_id").limit(pivots).toPandas()
    if chosen.empty:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centers = spark.sparkContext.broadcast(_lifted(_matrix(chosen.v, dim), top))

    def keyed(frames):
        for f in frames:
            d = _distances(_lifted(_matrix(f.v, dim), top), centers.value)
            at = d.argmin(1)
            yield f.assign(pivot=at.astype("int32"), dist=d[np.arange(len(f)), at])

    index = vectors.mapInPandas(keyed, "vec_id long, v array<double>, pivot int, dist double")
    index = sorted_positions(index, ["pivot", "dist", "vec_id"])
    index = index.withColumn("annulus", F.floor(F.col("position") / ANNULUS))
    blocks = materialize(
        index.groupBy("pivot", "annulus").agg(
            F.min("dist").alias("inner"),
            F.max("dist").alias("outer"),
            F.collect_list(F.struct("vec_id", "v")).alias("rows"),
        ),
        "annuli",
    )
    annuli = blocks.select("pivot", "annulus", "inner", "outer")

    asked = queries.distinct()
    n = asked.count()
    parts = max(1, -(-n // QUERY_BLOCK))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "queries")

    def reached(frames):
        for f in frames:
            x = _matrix(f.v, dim)
            # a query's own last coordinate is 0
            d = _distances(np.column_stack([x, np.zeros(len(x))]), centers.value)
            p = d.shape[1]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(f.query_id.to_numpy(), p),
                    "block": np.repeat(f.block.to_numpy(), p),
                    "square": np.repeat((x * x).sum(1), p),
                    "pivot": np.tile(np.arange(p, dtype="int32"), len(f)),
                    "reach": d.ravel(),
                }
            )

    reach = materialize(
        asked.mapInPandas(reached, "query_id long, block int, square double, pivot int, reach double"), "reach"
    )
    below = F.greatest(F.lit(0.0), F.col("inner") - F.col("reach"), F.col("reach") - F.col("outer"))
    by_query = Window.partitionBy("query_id")
    nearest = (
        reach.withColumn("_i", F.row_number().over(by_query.orderBy("reach", "pivot"))).where("_i <= 2").drop("_i")
    )
    seeds = nearest.join(annuli, "pivot").withColumn("below", below)
    seeds = seeds.withColumn("_i", F.row_number().over(by_query.orderBy("below", "annulus", "pivot"))).where("_i <= 2")
    seeds = materialize(seeds.select("query_id", "block", "pivot", "annulus", F.lit(None).cast("long").alias("least")), "seeds")

    packed = asked.groupBy("block").agg(F.collect_list(F.struct("query_id", "v")).alias("asked"))

    def looked(visits: DataFrame) -> DataFrame:
        """Up to k best of every visited annulus for every visiting query."""
        tiles = visits.groupBy("pivot", "annulus", "block").agg(F.collect_list(F.struct("query_id", "least")).alias("who"))
        tiles = tiles.join(blocks.select("pivot", "annulus", "rows"), ["pivot", "annulus"]).join(packed, "block")

        def products(frames):
            for f in frames:
                for who, rows, asked_rows in zip(f.who, f.rows, f.asked):
                    ids = np.array([r["vec_id"] for r in rows], np.int64)
                    order = np.argsort(ids, kind="stable")
                    ids = ids[order]
                    x = _matrix([rows[i]["v"] for i in order], dim)
                    least = {w["query_id"]: w["least"] for w in who}
                    chosen_rows = [r for r in asked_rows if r["query_id"] in least]
                    s = _matrix([r["v"] for r in chosen_rows], dim) @ x.T
                    out = []
                    for r, line in zip(chosen_rows, s):
                        line = np.where(ids == r["query_id"], -np.inf, line)
                        floor = least[r["query_id"]]
                        if len(line) > k:
                            # everything at least as good as the k-th, then ties by id
                            cut = np.partition(line, -k)[-k]
                            at = np.flatnonzero(line >= cut)
                            at = at[np.argsort(-line[at], kind="stable")][:k]
                        else:
                            at = np.argsort(-line, kind="stable")
                        at = at[np.isfinite(line[at])]
                        if floor is not None and floor == floor:
                            at = at[line[at] >= floor]
                        out.append(
                            pd.DataFrame({"query_id": r["query_id"], "vec_id": ids[at], "score": line[at].astype("int64")})
                        )
                    yield pd.concat(out)

        return tiles.mapInPandas(products, "query_id long, vec_id long, score long")

    ranked = by_query.orderBy(F.desc("score"), "vec_id")
    first = materialize(looked(seeds), "found")
    bounds = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    bounds = reach.join(bounds.select("query_id", F.col("score").alias("least")), "query_id", "left")
    # distance of the k-th best so far; the slack covers rounding
    radius = F.sqrt(F.greatest(F.col("square") + top - F.col("least") * 2, F.lit(0.0)))
    # a query that has not found k vectors yet goes everywhere
    radius = F.when(F.col("least").isNotNull(), radius).otherwise(float("inf"))
    near = bounds.withColumn("radius", radius).join(annuli, "pivot")
    near = near.where(below <= F.col("radius") * (1 + 1e-9) + 1e-6)
    rest = near.join(seeds.select("query_id", "pivot", "annulus"), ["query_id", "pivot", "annulus"], "left_anti")
    found = first.unionByName(looked(rest.select("query_id", "block", "pivot", "annulus", "least")))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
