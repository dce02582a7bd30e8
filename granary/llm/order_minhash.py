"""Near-duplicate classes by order MinHash, verified by banded alignment.

A text is the sequence of its five-word shingles, each labelled with how often
it occurred before. One sketch keeps the few labelled shingles of least hash,
in text order, so it agrees for two texts with a probability that falls with
their edit distance. Texts that share a sketch are candidates; their shingle
sequences are aligned inside a band that holds every alignment good enough.

Similarity of two texts is aligned / (shingles of both - aligned): the Jaccard
similarity of their shingles, counted along one alignment.
"""

from __future__ import annotations

from bisect import bisect_left

import re
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import connected_classes, materialize, text_or_empty

WORDS = 5
THRESHOLD = 0.8
SKETCHES = 20
KEPT = 4  # shingles in a sketch
BLOCK = 256  # texts of a sketch bucket that one unit of work holds on each side
SLICE = 1 << 17  # shingles hashed at once

_word = re.compile(r"\w+")


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the consecutive word shingles; a shorter text is one shingle, one without words has none.

    Words are lower-case runs of letters, digits and underscores, or if there
    are none, the runs without white space.
    """
    tokens = _word.findall(text.lower()) or text.split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    n = max(len(h) - words + 1, 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ (h[i : i + n] + np.uint64(i + 1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def occurrence_labelled(h: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, number of earlier occurrences): all different within a text."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    seen = np.empty(len(s), np.uint64)
    seen[order] = (np.arange(len(s)) - start).astype(np.uint64)
    x = (h + seen * np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def order_sketches(labelled: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> list[int]:
    """For every seed the hash of the ``kept`` labelled shingles of least hash, in text order."""
    out = []
    n = len(labelled)
    for j in range(sketches):
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF)
        best_at, best_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for a in range(0, n, SLICE):  # a bounded part of a very long text at a time
            x = (labelled[a : a + SLICE] ^ seed) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            at = np.argpartition(x, kept - 1)[:kept] if len(x) > kept else np.arange(len(x))
            best_at = np.concatenate([best_at, at + a])
            best_hash = np.concatenate([best_hash, x[at]])
        pick = np.argsort(best_hash, kind="stable")[:kept]
        in_order = labelled[np.sort(best_at[pick])]
        out.append(xxhash.xxh3_64_intdigest(in_order.tobytes(), seed=j) - (1 << 63))
    return out


def enough(n: int, m: int, threshold: float) -> int:
    """Least number of aligned shingles that makes two sequences similar."""
    return int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> int:
    """Shingles of ``a`` and ``b`` that one alignment pairs, or 0 if they are too few.

    A similar pair has at most n + m - 2 * enough unpaired shingles, so only
    matches within that distance of the diagonal count; equal ends are paired
    without a look. An alignment is a run of matches that rises in both
    sequences: matches are listed in the order of one, the longest rising run
    of their places in the other is found by its least ends. Labelled shingles
    are distinct in a text, so there is one match each at most.
    """
    n, m = len(a), len(b)
    need = enough(n, m, threshold)
    if min(n, m) < need:
        return 0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[n - (k - head) :][::-1] != b[m - (k - head) :][::-1]) if head < k else []
    tail = int(differ[0]) if len(differ) else k - head
    band = n + m - 2 * need
    x, y = a[head : n - tail], b[head : m - tail]
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    first, last = np.searchsorted(ranked, x, "left"), np.searchsorted(ranked, x, "right")
    many = last - first
    at = np.repeat(np.arange(len(x)), many)
    # of several places for one shingle the later ones come first, so that one of them at most is in a run
    nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    place = order[np.repeat(last, many) - 1 - nth]
    ends: list[int] = []
    for j in place[np.abs(place - at) <= band].tolist():
        e = bisect_left(ends, j)
        if e == len(ends):
            ends.append(j)
        else:
            ends[e] = j
    total = head + tail + len(ends)
    return total if total >= need else 0


def _sequences(docs: DataFrame, sketched: bool) -> DataFrame:
    """(doc_id, digest, n, sketches) or (digest, seq) of the texts that have words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            ids, digests, sizes, found = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = shingle_hashes(t)
                if len(h):
                    x = occurrence_labelled(h)
                    digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                    ids.append(i)
                    sizes.append(len(x))
                    found.append(order_sketches(x) if sketched else (x >> np.uint64(1)).astype(np.int64))
            arrays = {"digest": pa.array(digests, pa.binary())}
            if sketched:
                arrays |= {"doc_id": pa.array(ids, b.column(0).type), "n": pa.array(sizes, pa.int64())}
            arrays["found"] = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))

    front = f"doc_id {kind}, n long, " if sketched else ""
    schema = f"digest binary, {front}found array<bigint>"
    rows = docs.mapInArrow(run, schema)
    return rows if not sketched else rows.select("doc_id", "digest", "n", F.col("found").alias("sketches"))


def _checked(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of digests whose sequences align well enough."""

    def run(batches):
        for t in batches:
            x, y = t.column("sa"), t.column("sb")
            good = [
                bool(aligned(np.array(p.values), np.array(q.values), threshold)) for p, q in zip(x, y)
            ]
            yield t.select(["a", "b"]).append_column("similar", pa.array(good, pa.bool_()))

    left = seqs.select(F.col("digest").alias("a"), F.col("found").alias("sa"))
    right = seqs.select(F.col("digest").alias("b"), F.col("found").alias("sb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    return rows.mapInArrow(run, "a binary, b binary, similar boolean")


def _block_links(threshold: float):
    """Links between the two sides of a unit (open texts x a block of a bucket)."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        open_texts, block = unit[unit.asks], unit[~unit.asks]
        links: list[tuple[bytes, bytes]] = []
        if len(open_texts) and len(block):
            seqs = list(block.found)
            flat = np.concatenate(seqs)
            ends = np.cumsum([len(s) for s in seqs])
            starts = np.concatenate([[0], ends[:-1]])
            sizes = ends - starts
            roots = block.root.to_numpy()
            joined: dict[bytes, bytes] = {}

            def top(r: bytes) -> bytes:
                while r in joined:
                    r = joined[r]
                return r

            for d, root, s in zip(open_texts.digest, open_texts.root, open_texts.found):
                shared = np.add.reduceat(np.isin(flat, s), starts)
                # labelled shingles are distinct in a text, so shared ones bound the aligned ones
                near = shared * (1 + threshold) >= threshold * (len(s) + sizes) - 1e-9
                for i in np.flatnonzero(near):
                    if top(root) != top(roots[i]) and aligned(np.asarray(s), np.asarray(seqs[i]), threshold):
                        links.append((d, block.digest.iloc[i]))
                        joined[top(root)] = top(roots[i])
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id, the least doc_id among the near duplicates of the document, for every row.

    Equal shingle sequences become one text first. Every sketch bucket has a
    centre, the text that shares most sketches with others, which is aligned
    with the bucket's texts; the pairs of all buckets are made distinct before.
    Texts of a bucket that are then still in another class than its centre are
    compared with all of the bucket, in blocks: shared shingles are counted for
    a block at once, and what can be similar is aligned, so no link between two
    candidates is lost and none of a bucket's pairs is emitted.

    Rows whose text has no words (or is null) and rows without doc_id are in
    no class with others: class_id is their own doc_id, null for null. Repeated
    rows are in one class. Other columns are ignored; an empty table gives no
    rows.
    """
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    told = rows.where(F.col("doc_id").isNotNull())
    sketched = materialize(_sequences(told, True), "sketches")
    members = sketched.select("doc_id", "digest")
    reps = sketched.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches")
    )
    marks = reps.select("digest", "doc_id", F.posexplode("sketches").alias("sketch", "mark"))
    counts = marks.groupBy("sketch", "mark").agg(F.count("*").alias("c")).where("c > 1")
    marks = materialize(marks.join(counts, ["sketch", "mark"]), "marks")
    popular = marks.groupBy("digest").agg(F.sum("c").alias("popular"))
    marks = materialize(marks.drop("c").join(popular, "digest"), "marks")
    centres = marks.groupBy("sketch", "mark").agg(F.max_by("digest", F.struct("popular", "digest")).alias("centre"))
    marked = materialize(marks.join(centres, ["sketch", "mark"]).select("sketch", "mark", "digest", "centre"), "marks")

    needed = marks.select("doc_id", "digest").distinct()
    # the wanted ids grow with the corpus, so this join never broadcasts them
    wanted = needed.select("doc_id").distinct().hint("merge")
    texts = rows.join(wanted, "doc_id").select("doc_id", "text")
    seqs = _sequences(texts, False).join(needed.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
    seqs = materialize(seqs, "sequences")

    pairs = marked.where("digest <> centre").select(F.col("centre").alias("a"), F.col("digest").alias("b")).distinct()
    links = materialize(_checked(pairs, seqs, threshold).where("similar").select("a", "b"), "links")
    roots = connected_classes(links)

    # texts in another class than their bucket's centre meet the rest of the bucket in blocks
    def rooted(df: DataFrame, col: str) -> DataFrame:
        named = roots.select(F.col("node").alias(col), F.col("root").alias(f"{col}_root"))
        return df.join(named, col, "left").withColumn(f"{col}_root", F.coalesce(f"{col}_root", col))

    placed = rooted(rooted(marked, "digest"), "centre")
    open_rows = placed.where("digest_root <> centre_root").select("sketch", "mark", "digest", "digest_root")
    sizes = open_rows.groupBy("sketch", "mark").agg(F.count("*").alias("open_n"))
    placed = placed.join(sizes, ["sketch", "mark"])
    totals = placed.groupBy("sketch", "mark").agg(F.count("*").alias("all_n"))
    # a bucket of its centre and one other text has been decided already
    totals = totals.where("all_n > 2")
    salt = F.xxhash64("digest", "sketch")
    n_open = F.ceil(F.col("open_n") / BLOCK).cast("int")
    n_all = F.ceil(F.col("all_n") / BLOCK).cast("int")
    near = seqs.select("digest", "found")
    unit = ["sketch", "mark", "o", "w"]
    base = materialize(
        placed.join(totals, ["sketch", "mark"]).select(
            "sketch",
            "mark",
            "digest",
            F.col("digest_root").alias("root"),
            (F.col("digest_root") != F.col("centre_root")).alias("open"),
            F.pmod(salt, n_open).cast("int").alias("o_own"),
            F.pmod(salt, n_all).cast("int").alias("w_own"),
            n_open.alias("n_open"),
            n_all.alias("n_all"),
        ),
        "open",
    )
    base = base.join(near, "digest")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["digest", "root", "found"]
    asking = base.where("open").select("sketch", "mark", F.col("o_own").alias("o"), every("n_all").alias("w"), *kept)
    block = base.select("sketch", "mark", every("n_open").alias("o"), F.col("w_own").alias("w"), *kept)
    units = asking.withColumn("asks", F.lit(True)).unionByName(block.withColumn("asks", F.lit(False)))
    more = units.groupBy(*unit).applyInPandas(_block_links(threshold), "a binary, b binary")
    more = materialize(more.distinct(), "links")
    if not more.isEmpty():
        roots = connected_classes(links.union(more))

    classes = members.join(roots, members.digest == roots.node, "left").select(
        "doc_id", F.coalesce("root", "digest").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("c")).where("c > 1")
    # only documents with a partner need a lookup; the rest are their own class
    found = classes.join(least.select("root", "class_id"), "root").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return rows.select("doc_id").join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id")
    )


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one of least doc_id; columns as in ``docs``.

    Rows repeated under one doc_id stay or go together. Rows without doc_id stay.
    """
    classes = near_duplicate_classes(docs, threshold)
    dropped = classes.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti")
