"""Arrow text columns as numpy bytes: slices of bounded size, word borders and checksums without a Python loop over words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4_000_000
_LONG = 64  # from here on a word's checksum goes on word by word


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CHECKSUMS = _checksum_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column without nulls; offsets start at 0."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1, column.offset * 8)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], held[offsets[0] : offsets[-1]]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` text bytes; a longer text is a run of its own."""
    offsets, _ = text_bytes(batch.column(text))
    start = 0
    while start < len(batch):
        stop = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        stop = min(max(stop, start + 1), len(batch))
        yield batch.slice(start, stop - start)
        start = stop


def runs(offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows) of the maximal runs of marked bytes; a run ends with its row."""
    size = len(inside)
    before, after = np.zeros(size, bool), np.zeros(size, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < size]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def checksum_state(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of every run; the finished value is the state with all bits turned."""
    order = np.argsort(starts - ends, kind="stable")  # longest first: the runs still open are a prefix
    s, at, lengths = state[order], starts[order], (ends - starts)[order]
    for step in range(min(int(lengths[0]), _LONG) if len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -step, "left"))
        s[:m] = CHECKSUMS[(s[:m] ^ data[at[:m] + step]) & 255] ^ (s[:m] >> np.uint32(8))
    for i in range(int(np.searchsorted(-lengths, -_LONG, "left"))):
        rest = data[at[i] + _LONG : at[i] + lengths[i]].tobytes()
        s[i] = zlib.crc32(rest, int(s[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = s
    return out
