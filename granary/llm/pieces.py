"""Exact merge-type (BPE) encoding by backtracking, and decoding.

A greedy walk takes the longest vocabulary piece at each place (all matches
come from one Aho-Corasick pass), keeps it if merging the text of the last
piece and this one again yields just these two, else tries the next shorter
piece, and marks places from which no continuation exists in a bit field so
that none is tried twice. A sequence whose neighbours are all compatible is
the one that merging by rank produces.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from granary.llm.common import text_or_empty

SPACE = "▁"
CACHED_UNITS = 250_000  # per generation and worker
CACHED_LENGTH = 48
CACHED_PAIRS = 400_000


class Vocabulary:
    """Pieces, scores and kinds of a model file, small enough to send to every task."""

    def __init__(self, model_file: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            content = f.read()
        model.ParseFromString(content)
        self.digest = hashlib.sha256(content).hexdigest()
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("only models with identity normalization and a dummy prefix are supported")
        if model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models with white space as prefix and byte fallback are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        kind = sentencepiece.sentencepiece_model_pb2.ModelProto.SentencePiece
        self.normal = [p.type == kind.NORMAL for p in model.pieces]
        self.bytes = {p: int(p[1:-1], 16) for p, m in zip(self.pieces, model.pieces) if m.type == kind.BYTE}
        self.control = {i for i, m in enumerate(model.pieces) if m.type == kind.CONTROL}
        self.unknown = next(i for i, m in enumerate(model.pieces) if m.type == kind.UNKNOWN)
        self.unknown_surface = model.trainer_spec.unk_surface
        longer = [p for p, ok in zip(self.pieces, self.normal) if ok and len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("a piece goes on past a word's end")
        #: pieces never continue over a line end, so units can be cut there
        self.lines_apart = not any("\n" in p for p in longer)


    @classmethod
    def of(cls, fields: dict) -> Vocabulary:
        made = cls.__new__(cls)
        made.__dict__.update(fields)
        return made


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.rank = {p: -s for p, s, ok in zip(v.pieces, v.scores, v.normal) if ok}
        self.id = {p: i for i, (p, ok) in enumerate(zip(v.pieces, v.normal)) if ok}
        self.byte_id = {b: v.pieces.index(p) for p, b in v.bytes.items()}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.surface = [p.replace(SPACE, " ") if ok else None for p, ok in zip(v.pieces, v.normal)]
        self.automaton = ahocorasick.Automaton()
        reachable = [p for p in self.id if len(p) == 1 or self.merge(p) == [p]]
        known = set(reachable)
        self.shorter = {}
        for p in reachable:
            self.automaton.add_word(p, p)
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.young: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}
        line = "\n" if v.lines_apart else ""
        self.unit = re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))

    def merge(self, text: str) -> list[str]:
        """Pieces from merging the best-ranked neighbours, the leftmost of equals, until none is left."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def split_unit(self, text: str) -> list[str]:
        """Pieces of a text; characters without a piece of their own stay single."""
        n = len(text)
        longest = list(text)
        for end, piece in self.automaton.iter(text):
            longest[end - len(piece) + 1] = piece
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        at, piece = 0, longest[0]
        while True:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1 and (not out or self.compatible(out[-1], piece)):
                out.append(piece)
                if end == n:
                    return out
                at, piece = end, longest[end]
                continue
            piece = self.shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)

    def unit_ids(self, text: str) -> list[int]:
        pieces = self.split_unit(text)
        ids = list(map(self.id.get, pieces))
        if None not in ids:
            return ids
        out = []
        for i, p in zip(ids, pieces):
            out += [i] if i is not None else [self.byte_id[b] for b in p.encode("utf-8")]
        return out

    def units(self, text: str) -> list[str]:
        """Stretches that no piece crosses."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self.unit_ids(u)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Text of ids; ``first``: they begin a text, whose added space goes."""
        v, out, run = self.vocabulary, [], bytearray()
        for i in [*ids, None]:
            if i in self.id_byte:
                run.append(self.id_byte[i])
                first = False
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i is None or i in v.control:
                continue
            piece = v.unknown_surface if i == v.unknown else v.pieces[i].replace(SPACE, " ")
            if first and piece.startswith(" ") and i != v.unknown:
                piece = piece[1:]
            first = False
            out.append(piece)
        return "".join(out)

    def coded(self, unit: str) -> tuple[int, str, str]:
        """(number of ids, ids as text, decoded) of a unit; short units are kept in two generations."""
        got = self.old.get(unit)
        if got is None:
            ids = self.unit_ids(unit)
            parts = [self.surface[i] for i in ids]
            plain = self.decode(ids, first=False) if None in parts else "".join(parts)
            got = (len(ids), ",".join(map(str, ids)), plain)
        if len(unit) <= CACHED_LENGTH:
            if len(self.young) >= CACHED_UNITS:
                self.old, self.young = self.young, {}
            self.young[unit] = got
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        units = self.units(text)
        coded = list(map(self.young.get, units))
        if None in coded:
            coded = [c or self.young.get(u) or self.coded(u) for c, u in zip(coded, units)]
        counts, texts, decoded = zip(*coded) if coded else ((), (), ())
        ids, decoded = ",".join(texts), "".join(decoded)[1:]
        return (
            sum(counts),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
        )


def _utf8(raw: bytes) -> str:
    """Bytes as text; every byte that is not part of valid UTF-8 becomes U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode("utf-8"))
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec_of(vocabulary: Vocabulary) -> Codec:
    """One codec per worker process and vocabulary, with its caches."""
    if vocabulary.digest not in _codecs:
        _codecs.clear()
        _codecs[vocabulary.digest] = Codec(vocabulary)
    return _codecs[vocabulary.digest]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document.

    Whole texts, no shuffle; the vocabulary (of a size fixed by its file) is
    read on the driver and sent with the tasks. A null text is an empty one:
    no ids, digests of the empty string. A null doc_id stays null. Repeated
    rows give repeated results, further columns are ignored.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_file)))

    def run(batches):
        codec = codec_of(Vocabulary.of(vocabulary.value))
        for batch in batches:
            got = [codec.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], pa.string()),
                    pa.array([g[2] for g in got], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded_ids(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and the ids themselves."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(model_file)))

    def run(batches):
        codec = codec_of(Vocabulary.of(vocabulary.value))
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")
