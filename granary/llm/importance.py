"""Importance resampling: documents whose features look like those of a target corpus are likelier to be drawn.

Features are hashed into buckets and counted in the corpus and in the target.
A document's weight is the mean gain of its features, looked up in one array;
a seeded Gumbel term makes the highest scores a draw without replacement. The
cutoff is found by bisection: jobs that count the persisted scores on one side
of a threshold, then the ids among the rows that tie at it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import columnar
from granary.llm.common import materialize, text_or_empty
from granary.operators.ranking import sorted_positions

BUCKETS = 10_000
LONGEST = 1  # words of the longest feature
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
WAYS = 16  # parts that one counting job cuts the open interval into
_LAST = (1 << 63) - 1

#: bytes of a word: ASCII digits and small letters, and everything beyond ASCII
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def feature_buckets(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, buckets) of all features of the texts, and the number of words of each text.

    A feature is a run of 1 to ``longest`` words joined by one space; its bucket
    is the CRC-32 of its bytes. The checksum of a longer run goes on from that
    of the run without its last word.
    """
    offsets, data = columnar.text_bytes(texts)
    data = columnar.LOWER[data]
    starts, ends, rows = columnar.runs(offsets, _WORD[data])
    words = np.bincount(rows, minlength=len(texts))
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    held, begun = [], np.arange(len(starts))
    blank = np.full(1, 32, np.uint8)
    for k in range(longest):
        if k:
            keep = begun + k < len(starts)
            keep[keep] = rows[begun[keep]] == rows[begun[keep] + k]
            begun = begun[keep]
            none = np.zeros(len(begun), int)
            state = columnar.checksum_state(state[keep], blank, none, none + 1)
        state = columnar.checksum_state(state, data, starts[begun + k], ends[begun + k])
        held.append((rows[begun], (~state % np.uint32(buckets)).astype(np.int64)))
    return np.concatenate([r for r, _ in held]), np.concatenate([b for _, b in held]), words


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket; every task sends one row per bucket it met."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for part in columnar.slices(b):
                counts += np.bincount(feature_buckets(part.column("text"), longest, buckets)[1], minlength=buckets)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["bucket", "n"])

    parts = docs.select(text_or_empty("text").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    # as many rows as there are buckets
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) per bucket, target over corpus."""
    size, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((int(b) + 1) * (s + size)) / float((int(a) + 1) * (t + size))))
            for a, b in zip(corpus, target)
        ],
        np.int64,
    )


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variate, from a digest of the id; a null id counts as an empty text."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, eligible of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for b in batches:
            for part in columnar.slices(b):
                rows, buckets, words = feature_buckets(part.column("text"), longest, len(gain))
                n = np.bincount(rows, minlength=len(part))
                total = np.zeros(len(part), np.int64)
                np.add.at(total, rows, gain[buckets])
                weight = total // np.maximum(n, 1)
                draw = np.array([gumbel(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, (n.astype(np.int64), weight, weight + draw, words >= least_words))],
                    names=["doc_id", "n_features", "weight", "score", "eligible"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_features bigint, weight bigint, score bigint, eligible boolean")


def kth_value(rows: DataFrame, key: str, k: int, ways: int = WAYS) -> tuple[int, int]:
    """(the k-th least value of an integer column without nulls, how many rows are below it).

    Every job counts the rows up to ``ways`` - 1 thresholds inside the interval
    that still holds the value; the interval shrinks to its part between two.
    """
    first = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi, below = first.lo, first.hi, 0
    while lo < hi:
        step = -(-(hi - lo) // ways)
        cuts = list(range(lo + step - 1, hi, step))
        counts = rows.agg(*[F.count(F.when(F.col(key) <= c, 1)) for c in cuts]).first()
        at = next((i for i, n in enumerate(counts) if n >= k), len(cuts))
        lo, hi = (cuts[at - 1] + 1 if at else lo), (cuts[at] if at < len(cuts) else hi)
        below = counts[at - 1] if at else below
    return lo, below


def lowest(rows: DataFrame, keys: list[str], k: int) -> Column:
    """A condition that holds for the first ``k`` rows in ascending order of integer keys, which are unique together."""
    same, cut = F.lit(True), F.lit(False)
    for key in keys:
        tied = rows.where(same)
        if tied.count() <= k:
            break
        value, below = kth_value(tied, key, k)
        cut = cut | (same & (F.col(key) < value))
        same = same & (F.col(key) == value)
        k -= below
    return cut | same


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every document.

    Of the documents with at least ``least_words`` words, ``percent`` per cent
    with the highest scores are drawn; ties go to the smaller doc_id (null
    last), and between repeated rows to the one stored first. Null and empty
    texts have no features and weight 0. Very long texts are hashed alone, as
    any other. Empty tables give no rows; an empty target weighs all buckets as
    unseen. Further columns, whatever their names, are ignored.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    rows = scored(docs, gains, longest, least_words, seed)
    rows = materialize(
        rows.select(
            "*",
            (-F.col("score")).alias("_score"),
            F.coalesce("doc_id", F.lit(_LAST)).alias("_doc"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "scores",
    )
    open_rows = rows.where("eligible")
    wanted = open_rows.count() * percent // 100
    order, shown = ["_score", "_doc", "_row"], ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*shown, F.lit(None).cast("long").alias("rank"))
    drawn = F.col("eligible") & lowest(open_rows.select(*order), order, wanted)
    ranked = sorted_positions(rows.where(drawn).select(*shown, *order), order, "_at")
    rest = rows.where(~drawn).select(*shown, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(ranked.select(*shown, (F.col("_at") + 1).cast("long").alias("rank")))
