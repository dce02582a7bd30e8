"""Spans of any length, contexts found step by step, very many spans, very long alignments."""

import random
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import credentials, order_minhash, pieces, private

SECRET = "aB3" + "xY9" * 10


def weak_spans(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = credentials.secret_spans(rows).orderBy("doc_id").collect()
    return [sorted((s.kind, s.start, s.end) for s in r.weak) for r in got]


def test_long_addresses_and_names_are_linked(spark):
    url = "https://" + "h" * 600 + ".example"
    name = "user: " + "n" * 400
    spaced = "account:" + " " * 300 + "somebody"
    got = weak_spans(spark, f"{url} {SECRET}", f"{name} {SECRET}", f"{spaced} {SECRET}", f"{url} none")
    end = len(url)
    assert got[0] == [("endpoint", 0, end), ("secret", end + 1, end + 1 + len(SECRET))]
    assert got[1] == [("identifier", 0, len(name)), ("secret", len(name) + 1, len(name) + 1 + len(SECRET))]
    assert got[2] == [("identifier", 0, len(spaced)), ("secret", len(spaced) + 1, len(spaced) + 1 + len(SECRET))]
    assert got[3] == []


def test_covered_parts_are_not_reported_but_complete_others(spark):
    text = f"password={SECRET} user: somebody"
    assert weak_spans(spark, text) == [[("identifier", text.index("user"), len(text))]]


def identifiers(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = private.private_spans(rows).collect()
    return {r.doc_id: [t[s.start : s.end] for s in r.identifier] for r in found for t in [texts[r.doc_id]]}


def seeds(n):
    return [f"please mail to reach name{i}@example.org today" for i in range(n)]


def test_uuid_and_long_identifiers(spark):
    uuid, odd = "550e8400-e29b-41d4-a716-446655440000", "deadbeef-cafe-4bad-8bad-0123456789ab"
    long_id = "Z" * 40 + "-7" + "k" * 200
    texts = [*seeds(15), *[f"please mail to reach {x} now" for x in (uuid, odd, long_id, "AB-123456")], f"nothing of {uuid}x1 here"]
    got = identifiers(spark, texts)
    assert [got[15 + i] for i in range(5)] == [[uuid], [odd], [long_id], ["AB-123456"], []]


def test_context_words_are_whole(spark):
    word = "w" * 100
    texts = [f"the {word} name{i}@example.org" for i in range(15)] + [f"the {word} AB-123456", f"the {word[1:]} CD-123456"]
    got = identifiers(spark, texts)
    assert got[15] == ["AB-123456"] and got[16] == []


def test_discovered_values_lead_further(spark):
    ids = [f"QX-{100000 + i}" for i in range(12)]
    texts = seeds(40) + [f"please mail to reach {x} today" for x in ids]
    # the same values in a context without any seed, and one more there
    texts += [f"ledger entry holds {x} as stated" for x in ids] + ["ledger entry holds RY-777777 as stated"]
    got = identifiers(spark, texts)
    assert got[len(texts) - 1] == ["RY-777777"]
    assert identifiers(spark, texts[-13:])[12] == []


def plain_redacted(text, spans):
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join(out) + text[at:]


def test_redaction_equals_plain(spark):
    draw = random.Random(1)
    parts = ["a@b.cd", "10.0.0.1", "+49 (30) 1234-5678", "4111 1111 1111 1111", "word", "é🙂", "\n", "+1 4111111111111111", "x" * 5000, "user1@1.2.3.4"]
    texts = [" ".join(draw.choices(parts, k=k)) for k in (0, 1, 3, 8, 300, 900)] + ["é" * 4096 + " a@b.cd", "x" * 4089 + " a@b.cd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r for r in private.private_spans(rows).collect()}
    for r in private.redacted(rows).collect():
        found = [(s.start, s.end, s.kind) for k in (*private.KINDS, private.EXTRA) for s in spans[r.doc_id][k]]
        assert r.text == plain_redacted(texts[r.doc_id], found)


def test_many_spans_in_one_text(spark):
    times = []
    for n in (8_000, 64_000):
        text = " ".join(f"m{i}@x.org ID-{i}00000" for i in range(n // 2))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.time()
        assert private.redacted(rows).select(F.length("text")).first()[0] > n
        times.append(time.time() - start)
    assert times[1] < 60 and times[1] < 8 * max(times[0], 2.0)


@pytest.mark.parametrize("n", [1_000_000])
def test_alignment_of_very_long_texts(n):
    a = np.arange(n, dtype=np.uint64)
    b = np.delete(a, [5, n // 2, n - 3])
    b[n // 3] = n + 7
    tracemalloc.start()
    assert order_minhash.aligned(a, b) == n - 4
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_models_do_not_share_a_codec(tmp_path):
    import public_tokenizers
    from sentencepiece import sentencepiece_model_pb2

    first = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_model_pb2.ModelProto()
    with open(first, "rb") as f:
        model.ParseFromString(f.read())
    normal = [p for p in model.pieces if p.type == 1]
    normal[0].score, normal[-1].score = normal[-1].score, normal[0].score
    other = tmp_path / "other.model"
    other.write_bytes(model.SerializeToString())
    a, b = (pieces.codec_of(pieces.Vocabulary(str(x))) for x in (first, other))
    assert a is not b


def test_pipeline_equals_plain_stages(spark, tables):
    """Every stage of the pipeline on what its predecessor kept, against plain versions."""
    import hashlib
    from collections import Counter

    import public_tokenizers
    import sentencepiece

    import corpus_pipeline
    from granary.llm import curriculum, quality

    folder = "/root/testdata/sf0.001"
    docs = tables.documents
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "private_data", "mix", "encode"]
    kept = lambda df: {r.doc_id: r.text for r in df.collect()}

    forest = quality.train(docs, tables.labels)
    texts = kept(docs)
    scores = forest.score(np.array([quality.text_statistics(t or "") for t in texts.values()], float))
    good = {i: t for (i, t), s in zip(texts.items(), scores) if s >= quality.THRESHOLD}
    first = stages["quality"](spark, docs, folder)
    assert kept(first) == good and 0 < len(good) < len(texts)

    seqs = {i: order_minhash.occurrence_labelled(order_minhash.shingle_hashes(t)) for i, t in good.items()}
    root = {i: i for i in seqs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(seqs):
        for j in sorted(seqs):
            if i < j and len(seqs[i]) and len(seqs[j]) and order_minhash.aligned(seqs[i], seqs[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    alone = {i: t for i, t in good.items() if top(i) == i}
    second = stages["near_duplicates"](spark, first, folder)
    assert kept(second) == alone

    third = stages["private_data"](spark, second, folder)
    clean = {}
    for r in private.private_spans(second).collect():
        found = [(s.start, s.end, s.kind) for k in (*private.KINDS, private.EXTRA) for s in r[k]]
        clean[r.doc_id] = plain_redacted(alone[r.doc_id], found)
    assert kept(third) == clean and clean != alone

    fourth = stages["mix"](spark, third, folder)
    copies = {r.doc_id: r.copies for r in curriculum.training_plan(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({i: n for i, n in copies.items() if n})

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    for i, n in copies.items():
        ids = lib.encode(clean[i])
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += n
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +want
