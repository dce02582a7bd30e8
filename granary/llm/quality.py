"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are grown level by level from histograms of gradients over binned
statistics of a bounded, hash-chosen sample of labelled rows, then flattened
into one set of arrays (split feature, threshold, children, leaf value) that
numpy walks for a whole batch of documents at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, text_or_empty

FEATURES = (
    "log_bytes log_words word_length letters upper digits punctuation spaces marks pipes lines_per_word "
    "distinct_words distinct_lines line_end_marks long_words shouted_words marked_words".split()
)
TRAINING_ROWS = 20_000  # most labelled rows that the fit uses
BINS = 64
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!#$%&*@^~=<>{}[]\\_+`"]] = True


def text_statistics(text: str) -> list[float]:
    """The features of one whole text; all zero for an empty one."""
    raw = text.encode("utf-8")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    k = max(len(words), 1)
    distinct = set(words)
    letters, upper, digits = int(by[_LETTER].sum()), int(by[65:91].sum()), int(by[48:58].sum())
    spaces = int(by[[9, 10, 11, 12, 13, 32]].sum())
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    shouted = sum(map(bytes.isupper, words))
    marked = int(_MARK[np.frombuffer(bytes([w[-1] for w in words]), np.uint8)].sum()) if words else 0
    return [
        np.log1p(n),
        np.log1p(len(words)),
        float(sizes.mean()) if words else 0.0,
        letters / n,
        upper / max(letters, 1),
        digits / n,
        max(n - letters - digits - spaces, 0) / n,
        spaces / n,
        int(by[_MARK].sum()) / n,
        int(by[124]) / k,
        len(lines) / k,
        len(distinct) / k,
        len(set(lines)) / len(lines),
        sum(x.endswith((b".", b"!", b"?", b".\r")) for x in lines) / len(lines),
        float((sizes > 12).mean()) if words else 0.0,
        shouted / k,
        marked / k,
    ]


@dataclass
class Forest:
    """Flattened trees: node i goes left to ``left[i]`` if its feature is <= threshold, else to the next one."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                # leaves point at themselves
                at = self.left[at] + (x[rows, self.feature[at]] > self.threshold[at])
            total += self.value[at]
        return 1.0 / (1.0 + np.exp(-total))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    least: float = 5.0,
    ridge: float = 1.0,
    bins: int = BINS,
) -> Forest:
    """Logistic loss, second-order gains. No rows: score 0.5 everywhere; one class: its smoothed share."""
    n, p = x.shape
    share = (float(y.sum()) + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []

    def leaf(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(v)
        return len(left) - 1

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        flat = binned + np.arange(p) * bins
        margin = np.full(n, base)
        for _ in range(trees):
            prob = 1.0 / (1.0 + np.exp(-margin))
            g, h = prob - y, prob * (1 - prob)
            roots.append(leaf(0.0))
            node = np.full(n, roots[-1])
            level = [roots[-1]]
            for _ in range(depth):
                nxt = []
                for at in level:
                    rows = np.flatnonzero(node == at)
                    if len(rows) < 2 * least:
                        continue
                    sg, sh, sn = (
                        np.bincount(flat[rows].ravel(), np.repeat(v, p), p * bins).reshape(p, bins).cumsum(1)
                        for v in (g[rows], h[rows], np.ones(len(rows)))
                    )
                    tg, th, tn = sg[:, -1:], sh[:, -1:], sn[:, -1:]
                    gain = sg**2 / (sh + ridge) + (tg - sg) ** 2 / (th - sh + ridge) - tg**2 / (th + ridge)
                    gain[(sn < least) | (tn - sn < least)] = -1.0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] <= 1e-6 or b >= len(cuts[j]):
                        continue
                    a, c = leaf(0.0), leaf(0.0)
                    feature[at], threshold[at], left[at] = int(j), float(cuts[j][b]), a
                    node[rows] = np.where(binned[rows, j] <= b, a, c)
                    nxt += [a, c]
                level = nxt
            for at in np.unique(node):
                rows = node == at
                value[at] = -rate * float(g[rows].sum() / (h[rows].sum() + ridge))
            margin += np.array(value)[node]
    return Forest(
        base,
        np.array(feature, np.int64),
        np.array(threshold, float),
        np.array(left, np.int64),
        np.array(value, float),
        np.array(roots, np.int64),
        depth,
    )


def _statistics(rows: DataFrame, carried: list[str]) -> DataFrame:
    """carried columns and ``stats``, an array of the features of ``text``."""

    def run(batches):
        for b in batches:
            stats = [text_statistics(t) for t in b.column("text").to_pylist()]
            arrays = [b.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(stats, pa.list_(pa.float64()))], names=[*carried, "stats"]
            )

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, f"{kinds}, stats array<double>")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = TRAINING_ROWS, held_out: int = 2) -> Forest:
    """Fits ``labels.quality`` from rows whose crc32(doc_id) mod 4 is not ``held_out``.

    At most ``most_rows`` labelled rows are used, those of least hash; so the
    sample joined to the documents is bounded and is broadcast. Documents that
    share a sampled id are all candidates, and again at most ``most_rows`` of
    least hash are learned from. Null labels and ids are left out; repeated
    labels are repeated rows.
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~crc_mod("doc_id", 4, held_out))
        .select("doc_id", (F.col("quality") > 0).cast("double").alias("_y"), F.xxhash64("doc_id").alias("_h"))
        .orderBy("_h", "doc_id", "_y")
        .limit(most_rows)
        .select("doc_id", "_y")
        .toPandas()
    )
    if chosen.empty:
        return fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0))
    sample = spark.createDataFrame(chosen, labels.select("doc_id").schema.add("_y", "double"))
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(sample), "doc_id")
    got = _statistics(rows, ["doc_id", "_y"]).orderBy(F.xxhash64("doc_id", "_y", "stats"), "doc_id").limit(most_rows)
    got = got.select("_y", "stats").toPandas()
    if got.empty:
        return fit_forest(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.stack(got.stats.to_numpy()), got._y.to_numpy()
    order = np.lexsort((*x.T, y))  # the order of arriving rows must not matter
    return fit_forest(x[order], y[order])


def quality_scores(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Only the text decides: null and empty texts get the score of an all-zero
    row. A null doc_id counts as not held out. Repeated rows get equal scores.
    Other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(forest))

    def run(batches):
        for b in batches:
            score = _scored(b.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        crc_mod("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, with all their columns, whatever their names.

    Scores are those of ``quality_scores``; a null text is scored as an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(forest))

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_scored(b.column("text"), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _scored(texts: pa.Array, forest: dict) -> np.ndarray:
    x = np.array([text_statistics(t or "") for t in texts.to_pylist()], float).reshape(-1, len(FEATURES))
    return Forest(**forest).score(x)
