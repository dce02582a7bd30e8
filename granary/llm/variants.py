"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is arranged by how many letters it has of each group. One inserted,
deleted or replaced letter raises at most one count and lowers at most one, so
a search down the trie carries a surplus and a deficit of one each, and the
words of the leaves that it reaches are verified letter by letter.

The upper part of the trie is a table: nodes are opened until each holds a
bounded number of words, and every word is led down to the nodes within its
budget by joins. Below, a task searches one subtree for one block of words.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize, sized, text_or_empty

LETTERS = r"[A-Za-zÀ-ÿ]"
GROUPS = 32  # a letter's group is its code modulo 32: one for each small ASCII letter, accented ones beside them
SLIP = 199  # one run in so many has a letter deleted
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
SUBTREE = 30_000  # words of a subtree at most, unless their counts are all equal
BLOCK = 60_000  # searching words of a task
COUNTED = 300_000  # distinct words a task adds up before it hands them on
_SMALL_LEAF = 4
_FRONTIER = 150_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all whole texts; each task adds up what it meets before the shuffle.

    A run of letters loses one of them where ``SLIP`` divides the CRC-32 of
    ``<doc_id>:<run>``. Runs that are too short either way are passed over.
    """
    pattern = re.compile(LETTERS + "{%d,}" % least_length)

    def run(batches):
        counts: dict[bytes, int] = {}

        def out():
            words = [w.decode("latin-1") for w in counts]
            rows = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return rows

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own: dict[bytes, int] = {}
                for m in pattern.findall(text):
                    w = m.encode("latin-1").translate(_LOWER)
                    own[w] = own.get(w, 0) + 1
                begun = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w, n in own.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun)
                    if h % SLIP == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > COUNTED:
                    yield out()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty("text").alias("text"))
    counted = rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def group_counts(words: list[bytes]) -> np.ndarray:
    """Letters per group, a row per word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer(b"".join(words), np.uint8) % GROUPS
    cells = np.repeat(np.arange(len(words)) * GROUPS, lengths) + letters
    return np.bincount(cells, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def arranged(words: DataFrame) -> tuple[DataFrame, list[int]]:
    """The words with ``counts``, and the order of the groups: those that differ most between words first."""

    def run(batches):
        for b in batches:
            found = group_counts([w.encode("latin-1") for w in b.column(0).to_pylist()])
            lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, GROUPS, dtype=np.int32), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=["word", "n", "counts"])

    rows = materialize(words.select("word", "n").mapInArrow(run, "word string, n bigint, counts array<int>"), "arranged")
    spread = rows.agg(*[F.var_pop(F.col("counts")[i]) for i in range(GROUPS)]).first()
    order = sorted(range(GROUPS), key=lambda i: (-(spread[i] or 0.0), i))
    return rows.select("word", "n", F.array(*[F.col("counts")[i] for i in order]).alias("counts")), order


def subtrees(words: DataFrame, most: int = SUBTREE) -> tuple[DataFrame, DataFrame]:
    """(word, n, node) twice: every word's subtree, and the subtrees that its search visits.

    From the root down, nodes with more than ``most`` words are replaced by
    their children, level by level; a node's name is its path of counts. A
    search goes on to every child whose count differs by what is left of its
    surplus and deficit. Only whether nodes are still open reaches the driver.
    """
    root = F.array().cast("array<int>").alias("node")
    inside = words.select("word", "n", "counts", root)
    search = words.select("word", "n", "counts", root, F.lit(1).alias("plus"), F.lit(1).alias("minus"), F.lit(False).alias("there"))
    homes = []
    for level in range(GROUPS + 1):
        last = level == GROUPS
        nodes = inside.groupBy("node").agg(F.count("*").alias("_n"))
        nodes = sized(nodes.select("node", ((F.col("_n") > most) & F.lit(not last)).alias("_open")), "nodes")
        # a search that has arrived goes on through the lower levels, whose nodes have longer names
        led = search.join(nodes, "node", "left").where("there or _open is not null")
        search = led.withColumn("there", F.col("there") | ~F.col("_open")).drop("_open")
        placed = inside.join(nodes, "node")
        homes.append(placed.where("not _open").select("word", "n", "node"))
        if last or nodes.where("_open").isEmpty():
            break
        own = F.col("counts")[level]
        inside = placed.where("_open").select("word", "n", "counts", F.concat("node", F.array(own)).alias("node"))
        inside = materialize(inside, "inside")
        stay = F.struct("node", "plus", "minus", "there")

        def step(d: int, plus: Column, minus: Column) -> Column:
            to = F.struct(F.concat("node", F.array(own + d)).alias("node"), plus.alias("plus"), minus.alias("minus"), F.col("there"))
            return F.when((plus >= 0) & (minus >= 0), to)

        plus, minus = F.col("plus"), F.col("minus")
        steps = F.array(step(0, plus, minus), step(1, plus - 1, minus), step(-1, plus, minus - 1))
        ways = F.when(F.col("there"), F.array(stay)).otherwise(F.filter(steps, lambda w: w.isNotNull()))
        search = search.select("word", "n", "counts", F.explode(ways).alias("_w")).select("word", "n", "counts", "_w.*")
    return reduce(DataFrame.union, homes), search.select("word", "n", "node")


class CountTrie:
    """Rows of counts as a trie in arrays: per level the keys (parent, count), and the rows below every leaf."""

    def __init__(self, counts: np.ndarray):
        self.order = np.lexsort(counts.T[::-1])
        self.counts = counts[self.order]
        self.width = int(counts.max(initial=0)) + 3  # leaves room for the counts just outside
        self.keys: list[np.ndarray] = []
        self.starts: list[np.ndarray] = [np.array([0, len(counts)])]
        node = np.zeros(len(counts), np.int64)
        for level in range(counts.shape[1]):
            key = node * self.width + self.counts[:, level] + 1
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            node = np.cumsum(np.r_[False, key[1:] != key[:-1]]) if len(key) else node
            self.keys.append(key[first])
            self.starts.append(np.r_[first, len(key)])

    def search(self, asked: np.ndarray, most: int = _FRONTIER):
        """Yields (asked, row) pairs whose counts differ by a surplus and a deficit of at most one.

        Depth first over parts of at most ``most`` open (asked, node) pairs; a
        node with few rows below is a leaf, whose rows are compared as a whole.
        """
        if not len(self.counts):
            return
        n = len(asked)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.ones(n, np.int8), np.ones(n, np.int8))]
        while stack:
            level, who, node, plus, minus = stack.pop()
            if len(who) > most:
                half = len(who) // 2
                stack += [(level, who[s], node[s], plus[s], minus[s]) for s in (slice(half, None), slice(half))]
                continue
            size = self.starts[level][node + 1] - self.starts[level][node]
            leaf = size <= _SMALL_LEAF if level < len(self.keys) else np.ones(len(who), bool)
            if leaf.any():
                yield from self._leaves(asked, who[leaf], self.starts[level][node[leaf]], size[leaf], most)
                who, node, plus, minus = (x[~leaf] for x in (who, node, plus, minus))
            if not len(who):
                continue
            keys, parts = self.keys[level], []
            for d, p, m in ((0, plus, minus), (1, plus - 1, minus), (-1, plus, minus - 1)):
                ok = (p >= 0) & (m >= 0)
                count = np.clip(asked[who[ok], level].astype(np.int64) + d, -1, self.width - 2)
                key = node[ok] * self.width + count + 1
                at = np.searchsorted(keys, key)
                hit = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == key)
                parts.append((who[ok][hit], at[hit], p[ok][hit], m[ok][hit]))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))

    def _leaves(self, asked, who, start, size, most):
        upto = np.cumsum(size)
        at = 0
        while at < len(who):
            done = upto[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(upto, done + most, "right")))
            k = size[at:stop]
            rows = np.repeat(start[at:stop] - (upto[at:stop] - k - done), k) + np.arange(int(k.sum()))
            a = np.repeat(who[at:stop], k)
            gap = self.counts[rows] - asked[a]
            near = (np.maximum(gap, 0).sum(1) <= 1) & (np.minimum(gap, 0).sum(1) >= -1)
            yield a[near], self.order[rows[near]]
            at = stop


class Words:
    """Words as bytes, one letter each, in one array."""

    def __init__(self, words: list[bytes]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(words), np.uint8)


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether the words differ by exactly one inserted, deleted or replaced letter.

    The common beginning and, behind it, the common end must cover all but one
    letter. All pairs step through their words together until they differ.
    """
    la, lb = a.lengths[i], b.lengths[j]
    short, gap = np.minimum(la, lb), np.abs(la - lb)
    same = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero((gap <= 1) & (short > 0))
    step = 0
    while len(open_):
        open_ = open_[a.data[a.starts[i[open_]] + step] == b.data[b.starts[j[open_]] + step]]
        step += 1
        same[open_] = step
        open_ = open_[short[open_] > step]
    rest = np.where(gap == 0, short - same - 1, short - same)  # letters behind the edit
    good = (gap <= 1) & (rest >= 0)
    open_ = np.flatnonzero(good & (rest > 0))
    step = 1
    while len(open_):
        x, y = i[open_], j[open_]
        fits = a.data[a.starts[x] + a.lengths[x] - step] == b.data[b.starts[y] + b.lengths[y] - step]
        good[open_[~fits]] = False
        open_ = open_[fits]
        open_ = open_[rest[open_] > step]
        step += 1
    return good


def _searched(order: list[int]):
    """For applyInArrow: (word, n_near, form_n, form) of the searching words of one block in one subtree."""

    def run(table: pa.Table) -> pa.Table:
        names = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n = table.column("n").to_numpy()
        member = table.column("member").to_numpy()
        kept, asking = np.flatnonzero(member), np.flatnonzero(~member)
        counts = group_counts(names)[:, order]
        words, trie = Words(names), CountTrie(counts[kept])
        found = np.zeros(len(names), np.int64)
        best_n, best = np.zeros(len(names), np.int64), np.full(len(names), -1)
        rank = np.argsort(np.argsort(np.array(names, object), kind="stable"), kind="stable")
        for who, row in trie.search(counts[asking]):
            who, row = asking[who], kept[row]
            fits = one_edit(words, who, words, row)
            who, row = who[fits], row[fits]
            at = np.lexsort((rank[row], -n[row], who))
            who, row = who[at], row[at]
            first, many = np.unique(who, return_index=True, return_counts=True)[1:]
            w, r = who[first], row[first]
            found[w] += many
            better = (n[r] > best_n[w]) | ((n[r] == best_n[w]) & (rank[r] < rank[best[w]]))
            best_n[w[better]], best[w[better]] = n[r[better]], r[better]
        hit = np.flatnonzero(found)
        text = lambda at: pa.array([names[k].decode("latin-1") for k in at], pa.string())
        return pa.table([text(hit), pa.array(found[hit]), pa.array(best_n[hit]), text(best[hit])], names=["word", "n_near", "form_n", "form"])

    return run


def near_words(words: DataFrame, most: int = SUBTREE, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form) for every word with near words; form is that of largest n, then least.

    A task gets the words of one subtree, at most ``most``, and at most about
    ``block`` of the words that visit it. Words whose counts are all equal (the
    same letters in other order) make one leaf; a leaf beyond ``most`` is cut
    into parts that every visitor goes to.
    """
    rows, order = arranged(words)
    home, visit = subtrees(rows, most)
    home, visit = materialize(home, "homes"), materialize(visit, "visits")
    many = home.groupBy("node").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_parts"))
    asked = visit.groupBy("node").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    cells = sized(many.join(asked, "node"), "cells")

    def dealt(rows: DataFrame, member: bool) -> DataFrame:
        own, other = ("_parts", "_blocks") if member else ("_blocks", "_parts")
        mine = F.pmod(F.xxhash64("word"), F.col(own)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        rows = rows.join(cells, "node").select("word", "n", "node", mine.alias(own), each.alias(other))
        return rows.select("word", "n", "node", F.col("_parts").alias("part"), F.col("_blocks").alias("block"), F.lit(member).alias("member"))

    both = dealt(home, True).union(dealt(visit, False))
    found = both.groupBy("node", "part", "block").applyInArrow(_searched(order), "word string, n_near bigint, form_n bigint, form string")
    top = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("_top"))
    return found.select("word", "n_near", (-F.col("_top.m")).alias("form_n"), F.col("_top.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: forms followed to the last, each round twice as far."""
    hops = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        joined = hops.join(further, "root", "left")
        hops = materialize(joined.select("word", F.coalesce("_further", "root").alias("root"), F.col("_further").isNotNull().alias("_moved")), "roots")
        if hops.where("_moved").isEmpty():
            return hops.select("word", "root")
        hops = hops.select("word", "root")


def variant_groups(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, most: int = SUBTREE, block: int = BLOCK
) -> DataFrame:
    """word, n, n_near, form, form_n, root of the distinct words of all texts.

    A word's form is its near word of largest n (ties: least in code-point
    order) if that is at least ``ratio`` times the word's own, else null; its
    root is where following forms ends, the word itself if it has none.

    Null texts have no words, a null doc_id counts as an empty one, repeated
    rows count again, and very long runs of letters are words like others. An
    empty table gives no rows. Further columns, whatever their names, are
    ignored.
    """
    words = materialize(word_counts(docs, least_length, least_count), "words")
    near = near_words(words, most, block)
    given = F.col("form_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(given, F.col("form")).alias("form"), F.when(given, F.col("form_n")).alias("form_n")
    )
    rows = materialize(rows, "forms")
    return rows.join(roots(rows), "word", "left").withColumn("root", F.coalesce("root", "word"))
