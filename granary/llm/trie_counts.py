"""Token counts of a unigram model, with forward scores shared along a trie.

Distinct pre-tokens go into a trie. The best score of a prefix is computed
once, at its node, from the scores of the nodes above it, and every pre-token
that runs through the node uses it again; the node where a pre-token ends keeps
its number of tokens.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from granary.llm.common import text_or_empty
from granary.llm.pieces import SPACE, Vocabulary

UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much below the worst piece
MOST_NODES = 700_000  # a full trie is begun anew; counts do not depend on it
LONGEST_SHARED = 64


class CountTrie:
    def __init__(self, pieces: dict[str, float]):
        self.piece = pieces
        # lengths of pieces by last character, so that most spans need no lookup
        self.lengths: dict[str, list[int]] = {}
        for p in pieces:
            self.lengths.setdefault(p[-1], []).append(len(p))
        self.lengths = {c: sorted(set(ns), reverse=True) for c, ns in self.lengths.items()}
        self.worst = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        line = "" if any("\n" in p for p in pieces if len(p) > 1) else "\n"
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))
        self.clear()

    def clear(self) -> None:
        #: a node is reached by its prefix: (best score, its number of tokens)
        self.node: dict[str, tuple[float, int]] = {"": (0.0, 0)}
        self.terminal: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a pre-token; the nodes that its path still lacks are inserted and scored."""
        if len(text) > LONGEST_SHARED:
            return self.count_alone(text)
        if len(self.node) > MOST_NODES:
            self.clear()
        node, piece = self.node, self.piece
        known = len(text)
        while text[:known] not in node:
            known -= 1
        for end in range(known + 1, len(text) + 1):
            last = text[end - 1]
            best, n = None, 0
            for k in self.lengths.get(last, ()):  # ties go to the longest last piece
                if k <= end:
                    s = piece.get(text[end - k : end])
                    if s is not None:
                        above = node[text[: end - k]]
                        if best is None or above[0] + s > best:
                            best, n = above[0] + s, above[1] + 1
            if last not in piece:  # no piece of its own: unknown, as bytes
                above = node[text[: end - 1]]
                if best is None or above[0] + self.worst > best:
                    best, n = above[0] + self.worst, above[1] + len(last.encode("utf-8"))
            node[text[:end]] = (best, n)
        n = self.terminal[text] = node[text][1]
        return n

    def count_alone(self, text: str) -> int:
        """The same scores for a very long pre-token, which is not inserted."""
        score, tokens = [0.0], [0]
        for end in range(1, len(text) + 1):
            last, best, n = text[end - 1], None, 0
            for k in self.lengths.get(last, ()):
                if k <= end:
                    s = self.piece.get(text[end - k : end])
                    if s is not None and (best is None or score[end - k] + s > best):
                        best, n = score[end - k] + s, tokens[end - k] + 1
            if last not in self.piece and (best is None or score[end - 1] + self.worst > best):
                best, n = score[end - 1] + self.worst, tokens[end - 1] + len(last.encode("utf-8"))
            score.append(best)
            tokens.append(n)
        return tokens[-1]

    def document(self, text: str) -> int:
        """Pre-tokens: a run of spaces with the word after it; a line end is one of its own."""
        if not text:
            return 0
        units = self.unit.findall(SPACE + text.replace(" ", SPACE))
        counts = list(map(self.terminal.get, units))
        if None in counts:
            counts = [self.terminal.get(u) or self.count(u) if c is None else c for c, u in zip(counts, units)]
        return sum(counts)


_tries: dict[int, CountTrie] = {}


def trie_of(pieces: dict[str, float]) -> CountTrie:
    key = hash((len(pieces), sum(pieces.values())))
    if key not in _tries:
        _tries.clear()
        _tries[key] = CountTrie(pieces)
    return _tries[key]


def unigram_pieces(model_file: str) -> dict[str, float]:
    """Pieces of a model file with log probabilities by Zipf's law over their order of score."""
    v = Vocabulary(model_file)
    ranked = sorted((-s, i, p) for i, (p, s, ok) in enumerate(zip(v.pieces, v.scores, v.normal)) if ok)
    whole = math.log(sum(1.0 / (r + 1) for r in range(len(ranked))))
    return {p: -math.log(r + 1) - whole for r, (_, _, p) in enumerate(ranked)}


def token_counts(docs: DataFrame, pieces: dict[str, float]) -> DataFrame:
    """doc_id, n_tokens, n_words for every whole text.

    Pre-tokens start at a space, which no piece goes across. Each worker keeps
    one trie of bounded size over its tasks; nothing is shuffled. Null and
    empty texts have 0 tokens, repeated rows repeated results; further columns
    are ignored.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("a piece goes on past a word's end")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        trie = trie_of(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([trie.document(t) for t in texts], pa.int64()),
                    pa.array([len(t.split()) for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_tokens", "n_words"],
            )

    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_words long")
