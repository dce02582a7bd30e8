"""Class-based n-gram scoring: exchange clustering of words, class transitions and word emissions.

P(word | before) = P(class | class before) * P(word | class). Frequent words
are clustered by the exchange algorithm on their bigram counts; every other
word then joins the class that fits the classes around its occurrences best:
first by its neighbours in the core, then by all that have a class by now.
Counts come from the whole training part of the corpus.

Texts are coded once into blocks, each with its own short dictionary. Words are
dealt into parts by a checksum; what is shuffled is one packed row per block
and part, with one entry per word and context, not one per token, and what
comes back is one byte per word.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import crc_mod, materialize, text_or_empty
from granary.operators.ranking import default_buckets

CORE, CORE_SHARE, CORE_MOST = 2000, 1000, 5000  # words clustered among themselves: one in 1000 distinct words, at least 2000, at most 5000
WORDS_A_PART = 40_000  # distinct words that a task places at a time, about
CLASSES = 48  # classes of words, at most 100; one more is that of the end of a text
SWEEPS = 4
BLOCK_TOKENS = 3_000_000
HELD_OUT = (5, 1)  # crc32(doc_id) mod 5 = 1
SMOOTHED = 0.05  # share of a transition that comes from class frequencies
COUNTED = 150_000  # distinct words a task counts before it hands them on


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case; white space is the six ASCII characters."""
    return text.encode("utf-8").lower().split()


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", text_or_empty("text").alias("text"), crc_mod("doc_id", *HELD_OUT).alias("held_out")
    )


def word_counts(train: DataFrame) -> DataFrame:
    """(word binary, c): occurrences in the texts; each task adds up what it meets before the shuffle."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def out():
            rows = pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "c"]
            )
            counts.clear()
            return rows

        for b in batches:
            for t in b.column(0).to_pylist():
                for w in tokens(t):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    return train.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def core_bigrams(train: DataFrame, core: dict[bytes, int]) -> DataFrame:
    """(x, y, n): neighbouring core words; the number of core words stands for the end, on either side."""
    shared = train.sparkSession.sparkContext.broadcast(core)

    def run(batches):
        ids, end = shared.value, len(shared.value)
        other, width = end + 1, end + 2
        held: list[np.ndarray] = []
        size = 0

        def out():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            keys, n = keys[(keys // width != other) & (keys % width != other)], n[(keys // width != other) & (keys % width != other)]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["x", "y", "n"],
            )

        for b in batches:
            for t in b.column(0).to_pylist():
                c = np.array([end, *[ids.get(w, other) for w in tokens(t)], end], np.int64)
                held.append(c[:-1] * width + c[1:])
                size += len(c)
                if size > 2_000_000:
                    yield out()
                    size = 0
        if held:
            yield out()

    return (
        train.select("text").mapInArrow(run, "x int, y int, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n"))
    )


def collected_bigrams(train: DataFrame, core: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y, n of ``core_bigrams``, sorted by x and y.

    At most the square of the core; they come a partition at a time, as packed
    bytes, so that the driver holds 16 bytes a pair and no row objects.
    """

    def run(batches):
        for b in batches:
            x, y, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            row = [x.astype(np.int32), y.astype(np.int32), n.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], names=["x", "y", "n"])

    pairs = materialize(core_bigrams(train, core), "bigrams")
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]]
    for r in pairs.mapInArrow(run, "x binary, y binary, n binary").toLocalIterator():
        for held, raw in zip(parts, r):
            held.append(np.frombuffer(raw, held[0].dtype))
    x, y, n = (np.concatenate(p) for p in parts)
    order = np.lexsort((y, x))
    return x[order], y[order], n[order]


def exchange_classes(x: np.ndarray, y: np.ndarray, n: np.ndarray, words: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each of the ``words`` and, last, of the end, by the exchange algorithm.

    Starting from a deal by frequency rank, every word in turn goes to the
    class that raises the class bigram likelihood most. The end keeps a class
    of its own. The matrices are of ``words`` and ``classes``, both parameters.
    """
    k = classes + 1
    cls = np.append(np.arange(words) % classes, classes)
    right = [(y[i], n[i]) for i in _groups(x, words + 1)]
    left = [(x[i], n[i]) for i in _groups(y, words + 1)]
    between = np.zeros((k, k))
    np.add.at(between, (cls[x], cls[y]), n)

    def xlogx(v: np.ndarray) -> np.ndarray:
        return v * np.log(np.maximum(v, 1e-12))

    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            (ys, ny), (xs, nx) = right[w], left[w]
            own = int(ny[ys == w].sum())
            ys_, ny_, xs_, nx_ = ys[ys != w], ny[ys != w], xs[xs != w], nx[xs != w]
            after = np.bincount(cls[ys_], ny_, k)
            before = np.bincount(cls[xs_], nx_, k)
            c = cls[w]
            between[c] -= after
            between[:, c] -= before
            between[c, c] -= own
            # the word's neighbours stay in their classes, whichever one it joins
            rows, cols = between.sum(1) + before, between.sum(0) + after
            out_all, in_all = after.sum() + own, before.sum() + own
            # change of sum f(N_cd) - f(N_c.) - f(N_.d) when the word joins class c, f(v) = v log v
            gain = (xlogx(between + after[None, :]) - xlogx(between)).sum(1)
            gain += (xlogx(between + before[:, None]) - xlogx(between)).sum(0)
            d = np.diag(between)
            gain += xlogx(d + after + before + own) - xlogx(d + after) - xlogx(d + before) + xlogx(d)
            gain -= xlogx(rows + out_all) - xlogx(rows) + xlogx(cols + in_all) - xlogx(cols)
            gain[classes] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = c
            moved += best != c
            cls[w] = best
            between[best] += after
            between[:, best] += before
            between[best, best] += own
        if not moved:
            break
    return cls


def _groups(keys: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.cumsum(np.bincount(keys, minlength=n))[:-1])


NONE = 255  # stands for the class of a word that has none yet


def _contexts(codes: np.ndarray, lengths: np.ndarray, held: np.ndarray, core: np.ndarray, own: np.ndarray):
    """Training occurrences of a block's own words, and their contexts: word, context and how often, sorted.

    ``core``: classes of the core and of the end; ``own``: classes of the own
    words, or NONE. A context is a class on one side; the end stands on both
    sides of a text. A word has at most two contexts a class, however often it
    occurs.
    """
    end, k = len(core) - 1, int(core.max()) + 1
    train = np.repeat(~held, lengths)
    ends = np.cumsum(lengths)
    at_class = np.concatenate([core[:end], own]).astype(np.uint8)[codes]
    last = np.full(1, core[end], np.uint8)
    before = np.concatenate([last, at_class[:-1]]) if len(codes) else at_class
    after = np.concatenate([at_class[1:], last]) if len(codes) else at_class
    full = lengths > 0
    before[(ends - lengths)[full]] = last
    after[ends[full] - 1] = last
    rare = (codes >= end) & train
    local = codes[rare].astype(np.int64) - end
    n = np.bincount(local, minlength=len(own))
    before, after = before[rare], after[rare]
    keys = np.concatenate([local[before < k] << 8 | before[before < k], local[after < k] << 8 | (after[after < k] + k)])
    keys, times = np.unique(keys, return_counts=True)
    return n, keys >> 8, (keys & 255).astype(np.uint8), times


def _small(v: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as one byte each; those of 255 and more stand in the second string."""
    return np.minimum(v, 255).astype(np.uint8).tobytes(), v[v >= 255].astype(np.int64).tobytes()


def _large(small: bytes, rest: bytes) -> np.ndarray:
    v = np.frombuffer(small, np.uint8).astype(np.int64)
    v[v == 255] = np.frombuffer(rest, np.int64)
    return v


BLOCK_FIELDS = ["block", "doc_id", "held_out", "size", "codes", "wide", "words"]


def coded_blocks(marked: DataFrame, core: dict[bytes, int]) -> DataFrame:
    """Blocks of texts: the codes of their tokens and the block's own words.

    Codes below the core's size are core words, those above number the block's
    own words, the frequent ones first; so most codes take two bytes, and the
    others stand in ``wide``. Words are joined by line ends, which no word holds.
    """
    shared = marked.sparkSession.sparkContext.broadcast(core)
    kind = marked.schema["doc_id"].dataType.simpleString()
    schema = f"block bigint, doc_id array<{kind}>, held_out array<boolean>, size array<int>, codes binary, wide binary, words binary"

    def run(batches):
        ids = shared.value
        end = len(ids)
        own: dict[bytes, int] = {}
        docs: list = []
        held: list[bool] = []
        parts: list[np.ndarray] = []
        size = 0

        def out(id_type):
            codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            rare = codes >= end
            order = np.argsort(-np.bincount(codes[rare] - end, minlength=len(own)), kind="stable")
            rank = np.empty(len(own), np.int32)
            rank[order] = np.arange(len(own))
            codes[rare] = rank[codes[rare] - end] + end
            named = list(own)
            row = {
                "block": pa.array([uuid.uuid4().int >> 65], pa.int64()),
                "doc_id": pa.array([docs], pa.list_(id_type)),
                "held_out": pa.array([held], pa.list_(pa.bool_())),
                "size": pa.array([np.array([len(p) for p in parts], np.int32)], pa.list_(pa.int32())),
                "codes": pa.array([np.minimum(codes, 65535).astype(np.uint16).tobytes()], pa.binary()),
                "wide": pa.array([codes[codes >= 65535].astype(np.int32).tobytes()], pa.binary()),
                "words": pa.array([b"\n".join([named[i] for i in order])], pa.binary()),
            }
            own.clear(), docs.clear(), held.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([row[f] for f in BLOCK_FIELDS], names=BLOCK_FIELDS)

        id_type = None
        for b in batches:
            id_type = b.column(0).type
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                codes = []
                for w in tokens(t):
                    c = ids.get(w)
                    if c is None:
                        c = own.get(w)
                        if c is None:
                            c = own[w] = len(own)
                        c += end
                    codes.append(c)
                docs.append(i)
                held.append(h)
                parts.append(np.array(codes, np.int32))
                size += len(codes) + 1
                if size >= BLOCK_TOKENS:
                    yield out(id_type)
                    size = 0
        if docs:
            yield out(id_type)

    return marked.mapInArrow(run, schema)


class _Block:
    """One row of the blocks: its codes, texts and own words, and the order of the words by part."""

    def __init__(self, b: pa.RecordBatch, r: int, parts: int):
        self.block = b.column("block")[r].as_py()
        self.codes = np.frombuffer(b.column("codes")[r].as_py(), np.uint16).astype(np.int32)
        self.codes[self.codes == 65535] = np.frombuffer(b.column("wide")[r].as_py(), np.int32)
        self.size = b.column("size")[r].values.to_numpy()
        self.held = b.column("held_out")[r].values.to_numpy(zero_copy_only=False).astype(bool)
        raw = b.column("words")[r].as_py()
        self.words = raw.split(b"\n") if raw else []
        part = np.fromiter((zlib.crc32(w) % parts for w in self.words), np.int64, len(self.words))
        self.order = np.argsort(part, kind="stable")
        self.bounds = np.searchsorted(part[self.order], np.arange(parts + 1))

    def found(self, b: pa.RecordBatch, r: int, name: str, kind: type, missing: int) -> np.ndarray:
        """What came back for the own words, part after part."""
        out = np.full(len(self.words), missing, np.int64)
        if b.column("found")[r].is_valid:
            rows = sorted((f["part"], f[name]) for f in b.column("found")[r].as_py())
            out[self.order] = np.concatenate([np.frombuffer(v, kind) for _, v in rows])
        return out


PART_SCHEMA = "part int, block bigint, words binary, n binary, n_more binary, many binary, context binary, times binary, times_more binary"
PART_NAMES = [f.split()[0] for f in PART_SCHEMA.split(", ")]


def _parts(block: _Block, core: np.ndarray, own: np.ndarray):
    """Per part of the words: the block's words, their training occurrences and contexts, as one row."""
    n, owner, context, times = _contexts(block.codes, block.size, block.held, core, own)
    many = np.bincount(owner, minlength=len(own))
    starts = np.cumsum(many) - many
    moved = many[block.order]
    upto = np.cumsum(moved)
    at = np.repeat(starts[block.order] - (upto - moved), moved) + np.arange(len(context))
    context, times = context[at], times[at]
    upto = np.concatenate([[0], upto])
    rows = []
    for p in np.flatnonzero(np.diff(block.bounds)):
        a, z = block.bounds[p], block.bounds[p + 1]
        mine = block.order[a:z]
        c = slice(upto[a], upto[z])
        words = b"\n".join([block.words[i] for i in mine])
        rows.append((p, block.block, words, *_small(n[mine]), many[mine].astype(np.uint8).tobytes(), context[c].tobytes(), *_small(times[c])))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], names=PART_NAMES)


def first_contexts(blocks: DataFrame, classes: np.ndarray, parts: int) -> DataFrame:
    """A row per block and part of the words, with the contexts that the core gives."""
    shared = blocks.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = _Block(b, r, parts)
                yield _parts(block, shared.value, np.full(len(block.words), NONE))

    return blocks.mapInArrow(run, PART_SCHEMA)


def second_contexts(blocks: DataFrame, words: DataFrame, classes: np.ndarray, parts: int) -> DataFrame:
    """As ``first_contexts``, with the classes that the first pass gave to neighbours outside the core."""
    shared = blocks.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = _Block(b, r, parts)
                yield _parts(block, shared.value, block.found(b, r, "cls", np.uint8, NONE))

    return _with_words(blocks, words).mapInArrow(run, PART_SCHEMA)


def placed_words(sent: DataFrame, parts: int, fit: np.ndarray, usual: int = NONE, counted: bool = False) -> DataFrame:
    """(block, part, cls, c): class and count of the words of every row that was sent, in the order of that row.

    A task meets the rows of one part after another: the same words from all
    blocks. It keeps one row of context counts per distinct word and, per
    block, the numbers of its words. ``fit``: log probability of each (side and
    class) context for each class. A word without any context has the class
    ``usual``. Counts come only if ``counted``.
    """
    shared = sent.sparkSession.sparkContext.broadcast(fit)
    names = ["block", "part", "cls", "c"]

    def run(batches):
        table = shared.value  # (contexts, classes)
        width = len(table)
        part, ids, seen, total, blocks = None, {}, np.zeros((0, width)), np.zeros(0, np.int64), []

        def grown(v: np.ndarray, n: int) -> np.ndarray:
            return v if len(v) >= n else np.concatenate([v, np.zeros((max(n - len(v), len(v)), *v.shape[1:]), v.dtype)])

        def settled():
            score = seen[: len(ids)] @ table
            cls = score.argmax(1).astype(np.uint8)
            cls[seen[: len(ids)].sum(1) == 0] = usual
            for at in range(0, len(blocks), 64):
                some = blocks[at : at + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _ in some], pa.int64()),
                        pa.array([part] * len(some), pa.int32()),
                        pa.array([cls[i].tobytes() for _, i in some], pa.binary()),
                        pa.array([total[i].tobytes() if counted else None for _, i in some], pa.binary()),
                    ],
                    names=names,
                )

        for b in batches:
            for r in range(b.num_rows):
                row = [c[r].as_py() for c in b.columns]
                if row[0] != part:
                    if blocks:
                        yield from settled()
                    part, ids, blocks = row[0], {}, []
                    seen[:], total[:] = 0, 0
                at = np.array([ids.setdefault(w, len(ids)) for w in row[2].split(b"\n")], np.int32)
                seen, total = grown(seen, len(ids)), grown(total, len(ids))
                total[at] += _large(row[3], row[4])
                many = np.frombuffer(row[5], np.uint8)
                # a word has one entry per context in a row
                seen[np.repeat(at, many), np.frombuffer(row[6], np.uint8)] += _large(row[7], row[8])
                blocks.append((row[1], at))
        if blocks:
            yield from settled()

    rows = sent.repartition(parts, "part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "block bigint, part int, cls binary, c binary")


def _with_words(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """The blocks and what was found of their own words; both joins with blocks share one exchange of them."""
    packed = words.groupBy("block").agg(F.collect_list(F.struct("part", "cls", "c")).alias("found"))
    return blocks.select(*BLOCK_FIELDS).join(packed, "block", "left")


def classed_texts(
    blocks: DataFrame, words: DataFrame, core_counts: np.ndarray, classes: np.ndarray, total: int, distinct: int, parts: int
) -> DataFrame:
    """One row per text: counts, base score, summed log10 word counts, and its sequence of classes.

    A word that training did not see has the class after the last.
    """
    kind = blocks.schema["doc_id"].dataType.elementType.simpleString()
    rows = _with_words(blocks, words)
    k = int(classes.max()) + 1
    end_count = float(core_counts[-1])
    whole = np.log10(total + 0.5 * (distinct + 1))

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                block = _Block(b, r, parts)
                size = block.size
                count = np.concatenate([core_counts[:-1].astype(np.int64), block.found(b, r, "c", np.int64, 0)])
                cls = np.concatenate([classes[:-1], block.found(b, r, "cls", np.uint8, 0)])
                cls[count == 0] = k
                n, c = count[block.codes], cls[block.codes].astype(np.uint8)
                text = np.repeat(np.arange(len(size)), size)
                fold = lambda v: np.bincount(text, v, len(size))  # noqa: E731, B023
                base = fold(np.log10(n + 0.5)) + np.log10(end_count + 0.5) - (size + 1) * whole
                words = fold(np.log10(np.maximum(n, 1))) + np.log10(max(end_count, 1))
                known = fold(n > 0).astype(np.int64) + (end_count > 0)
                bounds = np.concatenate([[0], np.cumsum(size)])
                raw = c.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[r].values,
                        b.column("held_out")[r].values,
                        pa.array(size.astype(np.int64) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.array(words),
                        pa.array([raw[x:y] for x, y in zip(bounds, bounds[1:])], pa.binary()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes"],
                )

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary",
    )


def _steps(raw: bytes, end: int) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(raw, np.uint8).astype(np.int64)
    return np.append(end, c), np.append(c, end)


def class_bigrams(texts: DataFrame, k: int) -> np.ndarray:
    """Training transitions between the k classes, unseen words being class k (never met in training)."""

    def run(batches):
        held = np.zeros((k + 1) ** 2, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                x, y = _steps(raw, k - 1)
                held += np.bincount(x * (k + 1) + y, minlength=len(held))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["at", "n"])

    rows = texts.where(~F.col("held_out")).select("classes").mapInArrow(run, "at bigint, n bigint")
    got = rows.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most (k + 1)^2 rows
    out = np.zeros((k + 1) ** 2)
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return out.reshape(k + 1, k + 1)


def transition_table(between: np.ndarray, singles: float) -> np.ndarray:
    """log10 P(class | class before) - log10 n(class), with a share for unseen words.

    ``singles``: share of training tokens whose word occurs once, the estimate
    of how often a word is new (Good and Turing).
    """
    k = len(between) - 1
    known = between[:k, :k]
    n = known.sum(0)
    whole = max(n.sum(), 1.0)
    new = min(max(singles, 0.5 / (whole + 1)), 0.5)
    rows = known.sum(1, keepdims=True)
    seen = np.where(rows > 0, known / np.maximum(rows, 1), n / whole)
    p = (1 - SMOOTHED) * seen + SMOOTHED * (n + 0.5) / (whole + 0.5 * k)
    p = np.vstack([p, (n + 0.5) / (whole + 0.5 * k)])  # after an unseen word: class frequencies
    out = np.full((k + 1, k + 1), np.log10(new))
    out[:, :k] = np.log10((1 - new) * p) - np.log10(np.maximum(n, 1))
    return out


def class_scores(docs: DataFrame, core_words: int | None = None, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every whole text.

    ``score`` is the class model's log10 probability of the text and its end,
    ``base_score`` that of smoothed word frequencies. Both learn from the rows
    that are not held out; a null doc_id is not held out.

    Null and empty texts are their end alone. Without training rows every token
    is unseen: train_tokens is 0. Repeated rows count as often as they occur.
    Other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= classes <= 100:
        raise ValueError("classes must be 1 to 100: a context is one byte")
    marked = _marked(docs)
    train = marked.where(~F.col("held_out"))
    counts = materialize(word_counts(train), "words")
    facts = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("one")).first()
    ends = train.count()
    total, distinct = int(facts.n or 0) + ends, int(facts.v) + (ends > 0)
    # the core's word pairs are held by the driver: at most ``CORE_MOST`` squared
    core_words = core_words or min(max(CORE, distinct // CORE_SHARE), CORE_MOST)
    top = counts.orderBy(F.desc("c"), "word").limit(core_words).toPandas()
    core = {bytes(w): i for i, w in enumerate(top.word)}
    core_counts = np.append(top.c.to_numpy(np.int64), ends)
    used = max(1, min(classes, len(core)))
    x, y, n = collected_bigrams(train, core)
    cls = exchange_classes(x, y, n.astype(float), len(core), used, sweeps)

    k = used + 1
    between = np.zeros((k, k))
    np.add.at(between, (cls[x], cls[y]), n)
    # context columns: class before a word of class c, class after it
    fit = np.vstack([_log_shares(between[:, :used]), _log_shares(between.T[:, :used])])

    blocks = materialize(coded_blocks(marked, core), "blocks")
    # what even then has no neighbour with a class joins the most frequent one
    usual = int(between[:, :used].sum(0).argmax())
    parts = max(default_buckets(docs), -(-distinct // WORDS_A_PART))
    first = placed_words(first_contexts(blocks, cls, parts), parts, fit)
    words = placed_words(second_contexts(blocks, first, cls, parts), parts, fit, usual, True)
    texts = materialize(classed_texts(blocks, words, core_counts, cls, total, distinct, parts), "texts")
    table = transition_table(class_bigrams(texts, k), int(facts.one) / max(total, 1))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = []
            for raw in b.column("classes").to_pylist():
                x, y = _steps(raw, k - 1)
                score.append(float(table[x, y].sum()))
            score = pc.add(pa.array(score, pa.float64()), pc.multiply(b.column("emitted"), 1.0))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), score], names=[*names, "score"])

    out = texts.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _log_shares(n: np.ndarray) -> np.ndarray:
    """log P(context class | class), smoothed; rows are context classes."""
    return np.log((n + 0.5) / (n.sum(0, keepdims=True) + 0.5 * len(n)))
