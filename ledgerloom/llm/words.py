"""Words of whole texts as arrays.

A word is a run of bytes other than ``\\x20\\x09-\\x0D``. Texts come as Arrow string columns, whose buffers are read in place: no
Python string is made. Words are named by 64-bit hashes; for ten million different words the chance of one clash is about 3e-6.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_A, _B, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x2545F4914F6CDD1D)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


@dataclass
class Texts:
    """Some rows of a batch: ``data[offsets[i]:offsets[i + 1]]`` is text i (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name)


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Cuts batches so that a block holds at most ``limit`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
            own = offsets[low:high + 1]
            yield Texts(batch.slice(low, high - low), data[own[0]:own[-1]], own - own[0])
            low = high


@dataclass
class Words:
    """``start[i]:end[i]`` is word i; text d has the words ``bounds[d]:bounds[d + 1]``."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def hash_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices, eight bytes at a step."""
    size = end - start
    out = (size.astype(np.uint64) + _SEED) * _A
    if not len(start):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, at, left = np.flatnonzero(size > 0), start[size > 0], size[size > 0]
    while len(live):
        piece = eight[at] & _MASKS[np.minimum(left, 8)]
        out[live] = mix(out[live] ^ piece)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return mix(out)


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several hashes, order counting."""
    out = np.full(len(parts[0]), _SEED, np.uint64)
    for part in parts:
        out = (out ^ part) * _A
        out ^= out >> np.uint64(31)
    return mix(out)


def take_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices laid end to end, and their offsets."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])], offsets


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    flat, offsets = take_slices(data, start, end)
    kind = pa.large_string()
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)])


def shingle_sets(words: Words, hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of ``size`` words in a row.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    n = len(hashes)
    runs = combine([hashes[k:n - size + 1 + k] for k in range(size)]) if n >= size else np.zeros(0, np.uint64)
    for low, high in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if high - low >= size:
            own = np.sort(runs[low:high - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif high > low:
            yield combine([hashes[k:k + 1] for k in range(low, high)])
        else:
            yield np.zeros(0, np.uint64)


def crc_mod(doc_ids: pa.Array, divisor: int) -> np.ndarray:
    """crc32 of each id as decimal text, modulo ``divisor``; -1 for a null id."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % divisor for i in doc_ids.to_pylist()], np.int64)
