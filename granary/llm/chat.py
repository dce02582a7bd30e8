"""Chat formatting: conversations as one text with marked turns and a loss mask, assembled column-wise.

Every turn becomes header, text and footer. Control strings inside texts are
escaped by one backslash behind their first letter (and what looks escaped by
one more), so a text never ends its own turn and can be read back.

Rows are dealt by ranges of (conversation, turn). A task lays the bytes of many
turns at computed offsets of one buffer; no bytes are joined one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import columnar
from granary.llm.common import text_or_empty

LEARNED = "assistant"
PART_BYTES = 8_000_000  # a longer conversation is several parts


@dataclass(frozen=True)
class Template:
    """Header and footer of every known role; other roles are named in the header."""

    turns: tuple[tuple[str, str, str], ...] = (
        ("system", "<<SYS>>\n", "\n<</SYS>>\n"),
        ("user", "[INST] ", " [/INST]"),
        ("assistant", "<s> ", " </s>"),
    )
    other: tuple[str, str, str] = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
    controls: tuple[str, ...] = ("<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TEXT]")

    def escaped(self, texts: pa.Array) -> pa.Array:
        """One more backslash in everything that is a control string but for its backslashes."""
        for first in sorted({c[0] for c in self.controls}):
            rest = "|".join(re.escape(c[1:]) for c in self.controls if c[0] == first)
            texts = pc.replace_substring_regex(
                texts, pattern=f"({re.escape(first)})(\\\\*)({rest})", replacement="\\1\\\\\\2\\3"
            )
        return texts

    def plain(self, text: str) -> str:
        """What ``escaped`` was made of."""
        if "\\" not in text:
            return text
        controls = "|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in self.controls)
        return re.sub(controls, lambda m: m[0][0] + m[0][2:], text)

    def header(self, role: str) -> tuple[str, str]:
        """Header and footer of a role."""
        for name, head, foot in self.turns:
            if role == name:
                return head, foot
        name = self.escaped(pa.array([role])).to_pylist()[0]
        return self.other[0] + name + self.other[1], self.other[2]

    def read(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text."""
        known = [f"{re.escape(h)}(?P<k{i}>.*?){re.escape(f)}" for i, (_, h, f) in enumerate(self.turns)]
        a, b, c = map(re.escape, self.other)
        turn = re.compile("|".join([*known, f"{a}(?P<name>.*?){b}(?P<text>.*?){c}"]), re.S)
        at, out = 0, []
        while at < len(text):
            m = turn.match(text, at)
            if not m:
                raise ValueError(f"no turn at {at}")
            at = m.end()
            name = self.plain(m["name"]) if m.lastgroup == "text" else self.turns[int(m.lastgroup[1:])][0]
            out.append((name, self.plain(m[m.lastgroup])))
        return out


def assembled(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, turn offsets, text offsets): the turns laid one behind the other in one buffer.

    Lengths of headers, texts and footers alternate in one array; its running
    sum gives where every segment goes. The bytes of all texts are moved by one
    scatter, those of headers and footers by one scatter per distinct string.
    """
    offsets, data = columnar.text_bytes(template.escaped(texts))
    coded = roles.dictionary_encode()
    kind = coded.indices.to_numpy(zero_copy_only=False)
    frames = [[np.frombuffer(s.encode(), np.uint8) for s in template.header(r)] for r in coded.dictionary.to_pylist()]
    framed = np.array([[len(h), len(f)] for h, f in frames], np.int64).reshape(-1, 2)
    lengths = np.empty((len(texts), 3), np.int64)
    lengths[:, 0], lengths[:, 1], lengths[:, 2] = framed[kind, 0], np.diff(offsets), framed[kind, 1]
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(-1, 3)
    total = int(ends[-1]) if len(ends) else 0
    out = np.frombuffer(pa.allocate_buffer(total), np.uint8)
    if len(texts) == 1:
        out[starts[0, 1] : starts[0, 2]] = data
    else:
        out[np.repeat(starts[:, 1] - offsets[:-1], lengths[:, 1]) + np.arange(len(data))] = data
    for k, pair in enumerate(frames):
        mine = np.flatnonzero(kind == k)
        for side, piece in zip((0, 2), pair):
            out[starts[mine, side][:, None] + np.arange(len(piece))] = piece
    return out, np.r_[starts[:, 0], total], starts[:, 1:]


def _parts(batches: Iterator[pa.RecordBatch], template: Template, part_bytes: int) -> Iterator[pa.Table]:
    """Runs of turns that end with their conversation, or after ``part_bytes``."""
    held, size = [], 0
    least = min(columnar.SLICE_BYTES, part_bytes)
    for b in batches:
        for piece in columnar.slices(b, most=least):
            held.append(piece)
            size += piece.column("text").nbytes
            if size < least:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            conv = rows.column("_c").to_numpy()
            last = int(np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])[-1])
            if last:
                yield rows.slice(0, last)
                held, size = rows.slice(last).combine_chunks().to_batches(), rows.slice(last).column("text").nbytes
            if size >= part_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


MASK = "mask array<struct<start:bigint,end:bigint>>"
PART_SCHEMA = f"conv_id bigint, part bigint, whole boolean, n_turns bigint, formatted string, {MASK}"
PART_FIELDS = ["conv_id", "part", "whole", "n_turns", "formatted", "mask"]


def formatted(turns: DataFrame, template: Template = Template(), part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id, part, whole, n_turns, formatted, mask: the formatted conversations.

    ``mask`` holds the code-point ranges of ``formatted`` that a model learns
    from: the texts of the assistant. A conversation is one row, ``whole``,
    unless it is longer than ``part_bytes`` or lies on a border of two tasks;
    then its parts follow one another in ascending ``part``, so one task never
    holds more than that of a long conversation.

    Turns go by turn number (null first); equal numbers by a hash of role and
    text, then by these. Null texts and roles count as empty, a null
    conv_id is a conversation of its own, repeated rows are repeated turns. An
    empty table gives no rows. Further columns, whatever their names, are ignored.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")
    )
    # equal turn numbers are spread too: the hash is part of the range
    rows = rows.select("*", F.xxhash64("role", "text").alias("_h"), F.coalesce("conv_id", F.lit(-(1 << 63))).alias("_c"))
    order = [F.col("conv_id"), F.col("turn"), F.col("_h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").drop("turn", "_h")

    def run(batches):
        number, before, held = TaskContext.get().partitionId() << 33, None, None
        for rows in chain(_parts(batches, template, part_bytes), [None]):
            laid = None if rows is None else _laid(rows.combine_chunks(), template)
            if held is not None:
                conv, *columns = held
                whole = np.ones(len(conv), bool)
                # the first and the last conversation may go on in another part, or another task
                whole[0] &= before is not None and before != conv[0]
                whole[-1] &= laid is not None and laid[0][0] != conv[-1]
                named = dict(zip(["conv_id", "n_turns", "formatted", "mask"], columns))
                named |= {"part": pa.array(number + np.arange(len(conv))), "whole": pa.array(whole)}
                yield pa.RecordBatch.from_arrays([named[f] for f in PART_FIELDS], names=PART_FIELDS)
                number, before = number + len(conv), conv[-1]
            held = laid

    return rows.mapInArrow(run, PART_SCHEMA)


def _laid(rows: pa.Table, template: Template) -> tuple:
    """Keys of the conversations in some rows and, as Arrow columns, their ids, turns, texts and masks."""
    roles, conv = rows.column("role").combine_chunks(), rows.column("_c").to_numpy()
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    data, turn_at, text_at = assembled(roles, rows.column("text").combine_chunks(), template)
    bounds = np.r_[turn_at[first], turn_at[-1]].astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_utf8(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    learned = np.flatnonzero(pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False))
    owner = np.searchsorted(first, learned, "right") - 1
    spans, origin = text_at[learned], bounds[owner][:, None]
    if (data & 0x80).any():
        # code points before a byte: those that do not go on with one
        points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        spans, origin = points[spans], points[origin]
    spans = spans - origin
    structs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=["start", "end"])
    mask = pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32), structs)
    n_turns = pa.array(np.diff(np.r_[first, len(conv)]))
    return conv[first], rows.column("conv_id").combine_chunks().take(pa.array(first)), n_turns, texts.cast(pa.string()), mask


class _Reading:
    """Digests of the turns and of the learned text of one conversation, part after part."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, mask: list[dict], template: Template) -> None:
        for role, content in template.read(text):
            self.turns.update(f"{role}\n{content}\n".encode())
            self.n_turns += 1
        for span in mask:
            learned = template.plain(text[span["start"] : span["end"]])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(text)

    def row(self) -> list:
        return [self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


def read_back(parts: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from formatted texts and masks.

    Whole conversations are read where they are. Only parts of the others are
    shuffled, and read one after the other in a running digest.
    """

    def whole(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                reading = _Reading()
                if r["whole"]:
                    reading.add(r["formatted"], r["mask"], template)
                    r["formatted"] = r["mask"] = None
                out.append([r["conv_id"], r["part"], *reading.row(), r["formatted"], r["mask"]])
            yield _batch(out, [*_DIGEST, "formatted string", MASK], b.schema.field("mask").type)

    def rest(batches):
        conv, reading = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if reading is not None and (r["formatted"] is None or r["conv_id"] != conv):
                    out.append([conv, 0, *reading.row()])
                    reading = None
                if r["formatted"] is None:
                    out.append([r[d.split()[0]] for d in _DIGEST])
                    continue
                conv, reading = r["conv_id"], reading or _Reading()
                reading.add(r["formatted"], r["mask"], template)
            yield _batch(out, _DIGEST)
        if reading is not None:
            yield _batch([[conv, 0, *reading.row()]], _DIGEST)

    first = parts.mapInArrow(whole, ", ".join([*_DIGEST, "formatted string", MASK]))
    sorted_rows = first.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return sorted_rows.mapInArrow(rest, ", ".join(_DIGEST)).drop("part")


_DIGEST = ["conv_id bigint", "part bigint", "n_turns bigint", "turns_sha256 string", "loss_chars bigint", "loss_sha256 string", "formatted_chars bigint"]


def _batch(rows: list[list], fields: list[str], mask: pa.DataType | None = None) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    named = [f.split(" ", 1) for f in fields]
    arrays = [pa.array([r[i] for r in rows], kinds.get(kind, mask)) for i, (_, kind) in enumerate(named)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in named])
