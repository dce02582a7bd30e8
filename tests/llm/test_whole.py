"""What the operators once left out: words, chains, long tokens and texts beyond their former bounds."""

import random

import numpy as np
from pyspark.sql import functions as F

from granary.llm import brown, credentials, spotsigs
from granary.llm.common import connected_classes


def test_words_without_core_neighbours_get_classes(spark):
    core = {w: i for i, w in enumerate([b"a1", b"b1", b"a2", b"b2"])}
    classes = np.array([0, 1, 0, 1, 2])  # a and b alternate
    # p and v stand among words outside the core only
    texts = ["a1 b1 a2 q1 p q2 a1 b2", "b1 u1 v u2 b2 a1"] * 3
    docs = spark.createDataFrame([(i, t, False) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    between = np.array([[1.0, 90, 1], [90, 1, 1], [1, 1, 0]])
    fit = np.vstack([brown._log_shares(between[:, :2]), brown._log_shares(between.T[:, :2])])
    blocks = brown.coded_blocks(docs.coalesce(1), core, classes).persist()
    words = [bytes(w) for w in blocks.first().word]
    once = brown.placed_words(blocks, fit)
    got = {words[r.i]: r.cls for r in once.collect()}
    assert got[b"p"] == got[b"v"] == brown.NONE
    twice = brown.placed_words(brown.second_contexts(blocks, once, classes), fit, 0)
    got = {words[r.i]: (r.cls, r.c) for r in twice.collect()}
    assert got == {b"q1": (1, 3), b"p": (0, 3), b"q2": (1, 3), b"u1": (0, 3), b"v": (1, 3), b"u2": (0, 3)}
    blocks.unpersist()


def test_core_is_collected_whole(spark):
    docs = spark.createDataFrame([("x y x z",), ("y",), (None,)], "text string").select(F.coalesce("text", F.lit("")).alias("text"))
    x, y, n = brown.collected_bigrams(docs, {b"x": 0, b"y": 1})
    assert list(zip(x.tolist(), y.tolist(), n.tolist())) == [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1)]
    assert brown.CORE >= 2000


def test_long_chains_are_one_class(spark):
    n, draw = 4000, random.Random(1)
    names = list(range(n))
    draw.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(n - 1) if i != 2500]
    links += [(n + i + 1, n + i) for i in range(2999)]  # in order
    links += [(8000, 8000), (9000 + 1, 9000), (9000 + 1, 9002)]
    draw.shuffle(links)
    want = {names[i]: min(names[:2501]) if i <= 2500 else min(names[2501:]) for i in range(n)}
    want |= {n + i: n for i in range(3000)} | {8000: 8000, 9000: 9000, 9001: 9000, 9002: 9000}
    rows = connected_classes(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(rows) == len(want) and {r.node: r.root for r in rows} == want


def test_spots_are_even_and_local(spark):
    draw = random.Random(7)
    plain = [f"w{draw.randrange(10**6)}" for _ in range(240)]  # no listed anchor
    tail = [f"v{draw.randrange(10**6)}" for _ in range(79)]
    edited = [*plain[:160], "the", *tail]
    few = [*plain[:100], "of", *plain[100:]]
    df = spark.createDataFrame([(" ".join(w),) for w in (plain, edited, few)], "text string")
    a, b, c = (set(r.s) for r in df.select(spotsigs.signatures(F.col("text")).alias("s")).collect())
    assert min(map(len, (a, b, c))) >= 15
    assert len(a & b) / len(a | b) > 0.3
    assert len(a & c) / len(a | c) > 0.8
    # only a text without any spot is cut at every word
    none = spark.createDataFrame([("the of the",), ("",)], "text string").select(spotsigs.signatures(F.col("text")).alias("s"))
    assert [len(r.s) for r in none.collect()] == [3, 0]


def test_secrets_of_any_length_are_linked(spark):
    draw = random.Random(3)
    rows, want = [], []
    for i, length in enumerate((16, 64, 65, 88, 300, 5000)):
        run = "".join(draw.choice("ghkZQWx") for _ in range(length - 1)) + "7"  # the digit comes last
        front = "é user: anna.berg" + " ." * draw.randrange(100)
        whole = f"{front} {run} " + ". " * 100 + "host=db.internal.example " + ". " * 200 + "login: far.away"
        at, host = len(front) + 1, whole.index("host=")
        rows.append((i, whole))
        want.append([("identifier", 2, 17), ("secret", at, at + length), ("endpoint", host, host + 24)])
    # runs without a digit, a capital or a small letter are no secrets
    rows += [(10 + i, f"user: anna.berg {w * 40}") for i, w in enumerate(("kB", "k7", "B7"))]
    got = {
        r.doc_id: [(w.kind, w.start, w.end) for w in sorted(r.weak, key=lambda w: w.start)]
        for r in credentials.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    }
    assert [got[i] for i in range(6)] == want and got[10] == got[11] == got[12] == []
