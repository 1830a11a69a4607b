"""Numpy kernels over the text buffers of Arrow batches; all work inside tasks.

Words are maximal runs of bytes other than [\\x20\\x09-\\x0D]. A word's hash is a polynomial over
its bytes modulo 2**64, taken for all words of a chunk at once from one running sum. Texts are
taken in chunks of about ``CHUNK_BYTES``; a longer text is a chunk of its own and is never cut.
"""

from __future__ import annotations

import string
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_STORE = "_assayline_worker_store"


def worker_store() -> dict:
    """A dict that lives as long as this Python worker, for tables costly to build."""
    return sys.modules.setdefault(_STORE, types.ModuleType(_STORE)).__dict__


class Words(NamedTuple):
    """The words of a chunk of texts: byte spans, hashes, and where each text's words begin."""

    data: np.ndarray  # uint8, all texts of the chunk
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # texts + 1 word numbers
    hashes: np.ndarray  # uint64

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def powers(name: str, base: int, count: int) -> np.ndarray:
    """base**i modulo 2**64 for i under ``count`` (or more), kept by the worker."""
    store = worker_store()
    kept = store.get(name)
    if kept is None or len(kept) < count:
        kept = np.full(max(count, CHUNK_BYTES + 1), base, np.uint64)
        kept[0] = 1
        kept = store[name] = np.multiply.accumulate(kept)
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span."""
    up = powers(f"{base:x}", base, len(values) + 1)
    down = powers(f"1/{base:x}", pow(base, -1, 1 << 64), len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and len(column) + 1 offsets."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHUNK_BYTES``; a row of more bytes is a range of its own."""
    _, offsets = text_buffer(column)
    row = 0
    while row < len(column):
        after = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1
        after = min(max(after, row + 1), len(column))
        yield row, after
        row = after


def word_spans(
    data: np.ndarray, offsets: np.ndarray, also: bytes = b""
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32, *also]] = False
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``word_spans`` with runs of ASCII punctuation as words of their own."""
    if not len(data):
        return word_spans(data, offsets)
    kinds = np.ones(256, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[list(string.punctuation.encode())] = 2
    kind = kinds[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:-1] & (kind > 0))
    ends = np.flatnonzero(edge[1:] & (kind > 0)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words_of(
    column: pa.Array, lower: bool = False, also: bytes = b"", punctuation: bool = False
) -> Words:
    """The words of a chunk; ``lower`` lower-cases A-Z first, ``also`` adds separators,
    ``punctuation`` makes runs of it words of their own."""
    data, offsets = text_buffer(column)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[65:91] += 32
        data = table[data]
    starts, ends, first = token_spans(data, offsets) if punctuation else word_spans(data, offsets, also)
    hashed = span_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)
    return Words(data, starts, ends, first, hashed)
