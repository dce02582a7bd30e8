"""Training-data operators against libraries, brute force and hand-made edge cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from granary.llm import brown, curriculum, order_minhash, pieces, pivots, quality, queries, spotsigs, trie_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lang " * 30_000
EDGE_ROWS = [
    (1, None, "a", 0, 1),
    (1, None, "a", 0, 1),
    (2, "", None, 0, 2),
    (None, "one two three", "b", 13, None),
    (3, LONG, "b", len(LONG), 3),
    (3, "  sp\t\n ▁x é🙂 ", "b", 13, 3),
    (5, "The cat of the house and a dog.", "a", 31, 4),
    (5, "The cat of the house and a dog.", "a", 31, 4),
]
SCHEMA = "doc_id long, text string, source string, n_chars long, score int"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_codec_equals_library():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = pieces.Codec(pieces.Vocabulary(MODEL))
    draw = random.Random(5)
    letters = list("aeiounthsrdl  \n\t.,▁éñ世🙂\x00<s>09")
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    for t in [*texts, "", "a" * 20_000 + " " * 999 + "x"]:
        ids = lib.encode(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == lib.decode(ids)
        n, ids_sha, text_sha = codec.digest(t)
        assert n == len(ids) and ids_sha == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert text_sha == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_trie_counts_equal_library(tables):
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    scores = trie_counts.unigram_pieces(MODEL)
    for p in model.pieces:
        if p.type == 1:
            p.score = scores[p.piece]
    lib = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = {r.doc_id: r.text for r in tables.documents.collect()}
    got = {r.doc_id: r.n_tokens for r in trie_counts.token_counts(tables.documents, scores).collect()}
    assert got == {i: len(lib.encode(t)) for i, t in texts.items()}
    small = trie_counts.CountTrie({"▁a": -1.0, "b": -1.0, "ab": -1.5})
    assert [small.document(t) for t in ("", "a", "ab ab", "aé", " ")] == [0, 1, 4, 3, 6]


def test_quality_held_out():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit_forest(np.zeros((0, 4)), np.zeros(0)).score(x).tolist() == [0.5] * 3000


def test_quality_on_documents(spark, tables, edge, nothing):
    forest = quality.train(tables.documents, tables.labels)
    rows = quality.quality_scores(tables.documents, forest).collect()
    labels = {r.doc_id: r.quality for r in tables.labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.doc_id in labels]) > 0.9
    assert quality.quality_scores(edge, forest).count() == len(EDGE_ROWS)
    assert quality.quality_scores(nothing, quality.train(nothing, tables.labels)).count() == 0


def test_class_scores_base(tables, edge, nothing):
    rows = {r.doc_id: r for r in brown.class_scores(tables.documents, 200, 8, 2).collect()}
    words = {r.doc_id: [*r.text.encode().lower().split(), None] for r in tables.documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    counts = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        r = rows[i]
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    got = brown.class_scores(edge).collect()
    assert len(got) == len(EDGE_ROWS) and all(np.isfinite(r.score) for r in got)
    assert brown.class_scores(nothing).count() == 0


def plain_class_scores(texts, core_words, classes, sweeps):
    """Class n-gram scores by loops over tokens."""
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    train = [ws for i, ws in words.items() if not held[i]]
    counts = collections.Counter(w for ws in train for w in ws)
    core = {w: j for j, (w, _) in enumerate(sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:core_words])}
    end, used = len(core), min(classes, len(core))
    pairs = collections.Counter()
    for ws in train:
        codes = [end, *[core.get(w) for w in ws], end]
        pairs.update((a, b) for a, b in zip(codes, codes[1:]) if a is not None and b is not None)
    x, y = np.array(sorted(pairs)).T
    n = np.array([pairs[p] for p in sorted(pairs)], float)
    cls = brown.exchange_classes(x, y, n, end, used, sweeps)
    k = used + 1
    between = np.zeros((k, k))
    np.add.at(between, (cls[x], cls[y]), n)
    fit = np.vstack([brown._log_shares(between[:, :used]), brown._log_shares(between.T[:, :used])])
    named = {w: int(cls[j]) for w, j in core.items()}
    usual = int(between[:, :used].sum(0).argmax())
    for last in (False, True):
        seen = collections.defaultdict(lambda: np.zeros(2 * k))
        for ws in train:
            c = [used, *[named.get(w) for w in ws], used]
            for j, w in enumerate(ws, 1):
                if w not in core:
                    row = seen[w]
                    for side, other in ((0, c[j - 1]), (k, c[j + 1])):
                        if other is not None:
                            row[side + other] += 1
        placed = {w: int((row @ fit).argmax()) if row.any() else (usual if last else None) for w, row in seen.items()}
        named = {**placed, **{w: int(cls[j]) for w, j in core.items()}}
    steps = np.zeros((k + 1, k + 1))
    sequence = lambda ws: [used, *[named[w] if w in counts else k for w in ws], used]
    for ws in train:
        c = sequence(ws)
        np.add.at(steps, (c[:-1], c[1:]), 1)
    total = sum(counts.values()) + len(train)
    table = brown.transition_table(steps, sum(c == 1 for c in counts.values()) / total)
    out = {}
    for i, ws in words.items():
        c = sequence(ws)
        out[i] = table[c[:-1], c[1:]].sum() + sum(math.log10(max(counts[w], 1)) for w in ws) + math.log10(len(train))
    return out


@pytest.mark.parametrize("blocks", [3_000_000, 500])
def test_class_scores_equal_plain(tables, monkeypatch, blocks):
    monkeypatch.setattr(brown, "BLOCK_TOKENS", blocks)
    monkeypatch.setattr(brown, "WORDS_A_PART", 3_000_000 if blocks > 500 else 700)
    docs = tables.documents.repartition(3)
    want = plain_class_scores({r.doc_id: r.text for r in tables.documents.collect()}, 60, 7, 2)
    got = {r.doc_id: r.score for r in brown.class_scores(docs, 60, 7, 2).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_transitions_sum_to_one():
    between = np.zeros((4, 4))
    between[:3, :3] = [[5, 1, 2], [0, 0, 0], [3, 1, 0]]
    table = 10 ** brown.transition_table(between, 0.1)
    in_class = between[:3, :3].sum(0)
    assert np.allclose((table[:, :3] * np.maximum(in_class, 1)).sum(1) + table[:, 3], 1.0)


def test_exchange_finds_classes():
    draw = np.random.default_rng(3)
    kinds = draw.integers(0, 2, 40)
    word = lambda kind: draw.choice(np.flatnonzero(kinds == kind))
    text = np.array([word(i % 2) for i in range(20_000)])
    pairs, n = np.unique(text[:-1] * 41 + text[1:], return_counts=True)
    cls = brown.exchange_classes(pairs // 41, pairs % 41, n.astype(float), 40, 2)
    assert len({(a, b) for a, b in zip(kinds, cls)}) == 2


def test_mix(tables, edge, nothing):
    rows = curriculum.training_plan(tables.documents).collect()
    again = curriculum.training_plan(tables.documents.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.copies, tuple(r.positions))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    size = collections.Counter()
    taken, target, longest = collections.Counter(), {}, 0
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        longest = max(longest, r.size)
        assert r.copies <= 3 and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(size))}
    want, open_ = {}, set(size)
    while True:
        unit = (sum(size.values()) - sum(want.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * unit > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    want |= {s: weights[s] * unit for s in open_}
    assert all(target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= longest for s in size)
    plan = curriculum.training_plan(edge)
    assert plan.count() == len(EDGE_ROWS)
    mixed = curriculum.mixed(edge, plan)
    assert mixed.columns == edge.columns and mixed.count() == plan.agg(F.sum("copies")).first()[0]
    assert curriculum.training_plan(nothing).count() == 0


def test_demand_is_inverted(spark):
    knots = ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5))
    df = spark.range(101).select((F.col("id") / 100).alias("s"))
    for r in df.select("s", curriculum.time_of_demand(F.col("s"), knots).alias("t")).collect():
        grid = np.linspace(0, r.t, 20_001)
        area = np.trapezoid(np.interp(grid, *zip(*knots)), grid)
        assert area == pytest.approx(r.s * 1.0, abs=1e-6)


def test_fingerprints(tables, edge, nothing):
    rows = {r.doc_id: r for r in spotsigs.edited_fingerprints(tables.documents).collect()}
    docs = sorted(((r.doc_id, r.text) for r in tables.documents.collect()), reverse=True)
    by_text = collections.defaultdict(set)
    for i, (doc, text) in enumerate(docs):
        m = len(text) // 3
        edited = text[: len(text) - m] + docs[(i + 1) % len(docs)][1][:m]
        r = rows[doc]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(text)
        a, b = set(r.fingerprint.split()), set(r.edited_fingerprint.split())
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        by_text[text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert spotsigs.edited_fingerprints(edge).count() == len(EDGE_ROWS)
    assert spotsigs.edited_fingerprints(nothing).count() == 0


def test_similar_sets(spark):
    draw = random.Random(4)
    sets = []
    for i in range(120):
        s = set(draw.sample(range(1000), draw.randint(5, 40))) if i % 3 or not i else set(list(sets[-1])[1:]) | {2000 + i}
        sets.append(s or {1})
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, sigs array<int>")
    want = {
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8
    }
    got = [(r.a, r.b) for r in spotsigs.similar_sets(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_top_products_equal_sql(spark):
    assert compare(queries.op6_pivot_top_products(spark, SMALL), queries.OP6_SQL, connect(SMALL)) == ""


def test_top_products_edges(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, float("nan")]), (2, [0.5]), (3, [1.0, None]), (4, []), (None, [9.0, 9.0])]
    rows += [(7, [1.0, 2.0])] * 3
    df = spark.createDataFrame(rows, "vec_id long, e array<double>").where(pivots.usable(F.col("e")))
    df = df.select("vec_id", pivots.scaled(F.col("e")).alias("v"))
    got = pivots.top_products(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [
        (0, 7, 327680), (0, 7, 327680), (0, 7, 327680), (0, 2, 32768), (0, 4, 0)
    ]
    assert pivots.top_products(df.limit(0), df.limit(0)).count() == 0


def test_alignment():
    draw = random.Random(2)

    def common(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(line[j] + 1 if x == y else max(line[j + 1], new[j]))
            line = new
        return line[-1]

    for _ in range(1500):
        a = [draw.randint(0, 50) for _ in range(draw.randint(1, 40))]
        b = [x for x in a if draw.random() > 0.06] or [1]
        b[draw.randrange(len(b))] = 99
        n = common(a, b)
        want = n if n >= 0.8 * (len(a) + len(b) - n) - 1e-9 else 0
        assert order_minhash.aligned(np.array(a), np.array(b)) == want


def test_near_duplicate_classes(spark, edge, nothing):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, base = [], draw.choices(vocabulary, k=150)
    for i in range(120):  # variants of one text, some of them far from every other
        w = list(base)
        for _ in range(draw.choice([0, 1, 2, 3, 6, 20])):
            w[draw.randrange(len(w))] = draw.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(draw.choices(vocabulary, k=100))) for i in range(60)]
    rows += [(300 + i, "an exact copy of few words") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seqs = {i: order_minhash.occurrence_labelled(order_minhash.shingle_hashes(t)) for i, t in rows}
    root = {i: i for i in seqs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in seqs:
        for j in seqs:
            if i < j and order_minhash.aligned(seqs[i], seqs[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(df).collect()}
    assert got == {i: top(i) for i in seqs}
    kept = order_minhash.without_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({top(i) for i in seqs})
    assert order_minhash.near_duplicate_classes(edge).count() == len(EDGE_ROWS)
    assert order_minhash.near_duplicate_classes(nothing).count() == 0


def test_encoding_edges(edge, nothing):
    rows = pieces.encode_documents(edge, MODEL).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == len(EDGE_ROWS)
    assert sum(r.n_tokens == 0 and r.ids_sha256 == empty and r.decoded_sha256 == empty for r in rows) == 3
    assert pieces.encode_documents(nothing, MODEL).count() == 0
    assert trie_counts.token_counts(nothing, {"a": -1.0}).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{i}")
        assert docs.columns == names and docs.count() > 0
    whole = corpus_pipeline.run(spark, SMALL)
    assert whole.count() == docs.count()


#: names that the stages use themselves
CLASHING = "_score score _h _d _k _at _doc _text _row l r position copies positions class_id root digest sketches n mark email value s".split()


@pytest.mark.parametrize("rows", [EDGE_ROWS, []])
def test_stages_keep_clashing_columns(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA).drop("score")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHING})
    told = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert len(got) <= len(rows) * curriculum.MOST_COPIES
        assert all(r[c] == told[r.doc_id][c] for r in got for c in CLASHING)
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, SMALL).count() == len(rows)


def test_good_documents_are_those_predicted(spark, tables):
    forest = quality.train(tables.documents, tables.labels)
    predicted = quality.quality_scores(tables.documents, forest).where("predicted = 1").select("doc_id")
    kept = quality.good_documents(tables.documents, forest)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in predicted.collect())
    assert kept.dtypes == tables.documents.dtypes
