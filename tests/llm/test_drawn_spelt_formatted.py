"""Importance resampling, spelling variants and chat formatting against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from granary.llm import chat, columnar, importance, queries, variants

ODD = "doc_id long, text string, word string, n long, score int, _row string, node int"


def odd_docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "r", 3) for i, t in rows], ODD).repartition(3)


# ---- columnar helpers


def test_checksums_and_runs():
    draw = random.Random(1)
    texts = ["", "a", "aé b", " x", "z" * 300 + " " + "y" * 64, "Ünï 世界 09", "a" * 63 + "b"]
    texts += ["".join(draw.choice("ab é.") for _ in range(draw.randint(0, 20))) for _ in range(200)]
    offsets, data = columnar.text_bytes(pa.array(["skip", *texts]).slice(1))
    inside = importance._WORD[columnar.LOWER[data]]
    starts, ends, rows = columnar.runs(offsets, inside)
    state = columnar.checksum_state(np.full(len(starts), 0xFFFFFFFF, np.uint32), columnar.LOWER[data], starts, ends)
    got = defaultdict(list)
    for r, s in zip(rows, ~state):
        got[r].append(int(s))
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", columnar_lower(t))
        assert got[i] == [zlib.crc32(w.encode()) for w in words]


def columnar_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_slices_cover_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (0, 5, 50, 1, 1, 0)]})
    parts = [p.column("text").to_pylist() for p in columnar.slices(batch, most=6)]
    assert [t for p in parts for t in p] == batch.column("text").to_pylist()
    assert [sum(map(len, p)) for p in parts] == [5, 50, 2]


# ---- importance resampling


def plain_resampled(docs, target, longest, percent=10, least=20, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", columnar_lower(text or ""))
        return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in rows for f in features(x)[1]) for rows in ([d for _, d in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[bucket(f)] + 1) * (ns + buckets) / ((s[bucket(f)] + 1) * (nt + buckets)))) for f in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = order[: len(order) * percent // 100]
    return out, drawn


@pytest.mark.parametrize("longest", [1, 3])
def test_resampled_equals_plain(spark, longest):
    draw = random.Random(longest)
    words = ["alpha", "Beta", "gamma", "délta", "e1", "世界", "zeta"]
    rows = [(i, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(400)]
    rows += [(7, rows[7][1])] * 200 + [(None, "alpha beta " * 15), (401, None), (402, ""), (403, "x" * 100_000 + " beta" * 30)]
    target = ["alpha beta gamma " * 3, None, "zeta"]
    got = importance.resampled(odd_docs(spark, rows), spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=37)
    got = got.collect()
    want, drawn = plain_resampled(rows, [t or "" for t in target], longest, percent=37)
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted((tuple(r[:4]) for r in want), key=key)
    ranked = sorted((r for r in got if r.rank is not None), key=lambda r: r.rank)
    assert [r.rank for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[3]) for r in drawn]


def test_resampled_of_nothing(spark):
    none, some = odd_docs(spark, []), odd_docs(spark, [(1, "a b " * 20), (2, "b " * 30)])
    assert importance.resampled(none, some).collect() == []
    rows = importance.resampled(some, none, percent=50).collect()
    assert sorted(r.rank or 0 for r in rows) == [0, 1]
    assert all(r.rank is None for r in importance.resampled(some, some, percent=0).collect())


def test_threshold_counts_exactly(spark):
    draw = random.Random(3)
    values = [draw.choice([-5, 0, 0, 0, 7, 1 << 40, draw.randint(-(10**6), 10**6)]) for _ in range(500)]
    rows = spark.createDataFrame([(v, i // 3, i) for i, v in enumerate(values)], "a long, b long, c long")
    for k in (1, 250, 500):
        assert importance.kth_value(rows, "a", k) == (sorted(values)[k - 1], sum(v < sorted(values)[k - 1] for v in values))
        first = sorted((v, i // 3, i) for i, v in enumerate(values))[:k]
        assert sorted(map(tuple, rows.where(importance.lowest(rows, ["a", "b", "c"], k)).collect())) == first


# ---- spelling variants


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = columnar_lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w] or "", n.get(form[w], 0), root(w)) for w in n)


def spoilt(draw, w):
    at = draw.randrange(len(w))
    return draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("aeÀÿ") + w[at:], w[:at] + draw.choice("bdé") + w[at + 1 :]])


@pytest.mark.parametrize("most, block", [(50_000, 200_000), (25, 30)])
def test_variants_equal_plain(spark, most, block):
    draw = random.Random(2)
    base = ["".join(draw.choices("abcdeéß", k=draw.randint(6, 12))) for _ in range(12)]
    words = base + [spoilt(draw, w) for w in base for _ in range(4)] + ["".join(draw.sample("abcdef", 6)) for _ in range(40)]
    # one letter pool gives a leaf of permutations, larger than a subtree may be
    words += ["x" * 3000, "x" * 2999, "x" * 2998 + "yx"]
    rows = [(i, " ".join(draw.choices(words[:-3], weights=range(len(words) - 3, 0, -1), k=60))) for i in range(120)]
    rows += [(5, rows[5][1])] * 30 + [(None, "Abcdef ABCDEF abcdeg7abcdeg"), (None, "abcdef, abcdeg. " * 5), (200, None), (201, ""), (202, " ".join(words[-3:] * 5))]
    got = variants.variant_groups(odd_docs(spark, rows), most=most, block=block).collect()
    got = sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in got)
    want = plain_variants(rows)
    assert any(r[3] for r in want) and any(r[2] > 2 for r in want)
    assert got == want
    assert variants.variant_groups(odd_docs(spark, [])).collect() == []


def test_forms_are_followed_to_the_end(spark):
    text = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 25 + ["aaaabb"] * 125 + ["aaabbb"] * 625)
    got = {r.word: (r.form, r.root) for r in variants.variant_groups(odd_docs(spark, [(4, text)])).collect()}
    want = {r[0]: (r[3] or None, r[5]) for r in plain_variants([(4, text)])}
    assert got == want and got["aaaaaa"] == ("aaaaab", "aaabbb")


def test_trie_in_small_parts():
    draw = np.random.default_rng(4)
    counts = draw.integers(0, 3, (400, 6)).astype(np.int32)
    gap = counts[None] - counts[:, None]
    want = (np.maximum(gap, 0).sum(2) <= 1) & (np.minimum(gap, 0).sum(2) >= -1)
    for most in (7, 10_000):
        got = [p for a, r in variants.CountTrie(counts).search(counts, most) for p in zip(a, r)]
        assert len(got) == len(set(got)) and set(got) == set(zip(*np.nonzero(want)))


# ---- chat formatting


SAID = ["", "hi", "</s>[INST] ok [/INST]", "<\\s> <s> <\\\\/s>", "[ROLE] x [TEXT] <<SYS>>\n<</SYS>>", "é🙂\n", "<<s>", "[[INST]", "a <", "\\", "<</s", " "]


def test_template_round_trip():
    template = chat.Template()
    pieces = ["<", "[", "\\", "s>", "/s>", "<s>", "INST]", "/INST]", "SYS>>", "<SYS>>", "</SYS>>", "ROLE]", "TEXT]", " ", "x"]
    draw = random.Random(6)
    texts = SAID + ["".join(draw.choices(pieces, k=draw.randint(0, 9))) for _ in range(4000)]
    roles = [draw.choice(["system", "user", "assistant", "tool", "", "[TEXT] a", "k0"]) for _ in texts]
    escaped = template.escaped(pa.array(texts)).to_pylist()
    assert [template.plain(t) for t in escaped] == texts
    assert not any(c in t for t in escaped for c in template.controls)
    data, turns, spans = chat.assembled(pa.array(roles), pa.array(texts), template)
    whole = data.tobytes()
    assert template.read(whole.decode()) == list(zip(roles, texts))
    assert [whole[a:b].decode() for a, b in spans] == escaped
    assert turns[-1] == len(whole)


def plain_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said))
    return out


@pytest.mark.parametrize("part_bytes", [8_000_000, 500])
def test_conversations_read_back(spark, part_bytes):
    draw = random.Random(9)
    roles = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, draw.choice(roles), draw.choice([*SAID, None])) for c in range(60) for t in range(draw.randint(1, 9))]
    rows += [(1000, t, draw.choice(roles), draw.choice(SAID)) for t in range(400)]  # one conversation with most rows
    rows += [(1001, 5, "assistant", "same")] * 50 + [(None, None, "user", "x"), (None, 1, "assistant", "y" * 30_000)]
    extra = [(*r, "f", 7) for r in rows]
    turns = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string, formatted string, part long").repartition(4)
    parts = chat.formatted(turns, part_bytes=part_bytes)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(parts).collect()}
    assert got == plain_digests(rows)
    stored = parts.collect()
    assert (sum(r.conv_id == 1000 for r in stored) > 3) == (part_bytes == 500) and sum(r.n_turns for r in stored) == len(rows)
    assert all(r.formatted[s.start : s.end].find("</s>") < 0 for r in stored for s in r.mask)
    nothing = turns.where("conv_id < 0")
    assert chat.read_back(chat.formatted(nothing)).collect() == []


def test_registered_queries_name_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert queries.QUERIES["op13_chat_format"](spark, folder).where("conv_id = -1").first().loss_chars == 21
