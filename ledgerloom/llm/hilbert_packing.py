"""Packing along a space-filling curve.

A document's words are hashed into a signed vector of ``VECTOR`` places, which a fixed Gaussian matrix projects to three coordinates.
Their cell's number along the Hilbert curve is the document's key. Documents are range-sorted by key and id, so that many equal keys
spread over ranges too, and each range is one stream of tokens that is cut into sequences of ``LENGTH``: neighbours along the curve share
sequences. The rest of a range is cut into sequences whose lengths are powers of two, which need no padding.

Ids come from the byte-level BPE of the tokenizer file, special tokens being ordinary text, and each document ends with ``END_ID``.
The different pieces between single spaces and line breaks are tokenized once in a block of texts. That is exact, since the
vocabulary's pattern always ends a piece before a space that a visible character follows.

Null and empty texts consist of their end only. Repeated rows are documents of their own. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import math
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches
from ledgerloom.llm.words import BLOCK_BYTES, LOWER, find_words, hash_slices, mix, take_slices, text_blocks

LENGTH = 2048
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
VECTOR, BITS = 256, 16
RANGE_BYTES = 16 << 20
ENCODED_BYTES = 1 << 18

_PROJECTION = np.random.default_rng(11).standard_normal((VECTOR, 3))
#: First bytes of characters that may be white space; a space before such a byte ends no piece.
_MAY_BE_SPACE = np.isin(np.arange(256), [*range(0x21), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3])


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places along the Hilbert curve of rows of unsigned coordinates (transpose method: undo excess work, Gray-code, interleave)."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x = [v ^ turn for v in x]
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> bit) & 1)
    return key


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    data = LOWER[data]
    words = find_words(data, offsets)
    hashes, n = mix(hash_slices(data, words.start, words.end)), len(offsets) - 1
    sign = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    cell = words.doc * VECTOR + (hashes & np.uint64(VECTOR - 1)).astype(np.int64)
    vectors = np.bincount(cell, weights=sign, minlength=n * VECTOR).reshape(n, VECTOR)
    vectors /= np.maximum(np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)), 1e-9)
    spots = np.clip((vectors @ _PROJECTION / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_keys(spots.astype(np.int64))


def _keyed(batches):
    for block in text_blocks(batches):
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(curve_keys(block.data, block.offsets)), block.column("text")], ["doc_id", "key", "text"])


@cache
def _encoding(path: str):
    """The file's vocabulary as byte strings with their ids, which are the merges' ranks, and each id's number of bytes."""
    import tiktoken

    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    letters = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {t["content"].encode(): t["id"] for t in content.get("added_tokens", [])}
    special = set(added.values())
    ranks = {bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if i not in special}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes, added


def _added_places(added: dict[bytes, int], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start and end of every added token in the texts; the longest where several begin."""
    pattern = re.compile(b"|".join(map(re.escape, sorted(added, key=len, reverse=True))))
    whole, found = data.tobytes(), []
    if added and pattern.search(whole):
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            found += [m.span() for m in pattern.finditer(whole, low, high)]
    return np.array(found, np.int64).reshape(-1, 2)


def encode_texts(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts laid end to end, without end ids, and the texts' bounds among them."""
    encoding, sizes, added = _encoding(path)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    places = _added_places(added, data, offsets)
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, places[:, 0], 1)
    np.add.at(inside, places[:, 1], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    clear = ~_MAY_BE_SPACE[data] & ~inside  # a text ends where an added token begins
    cut = np.zeros(n + 1, bool)
    cut[:-1] |= (data == 32) & np.concatenate([clear[1:], [False]])
    alone = (data == 10) & np.concatenate([[False], (clear & (data < 128))[:-1]]) & np.concatenate([clear[1:], [False]])
    cut[:-1] |= alone
    cut[1:] |= alone
    cut[:-1] &= ~inside
    cut[places] = True
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    start, end = edges[:-1], edges[1:]
    _, first, which = np.unique(hash_slices(data, start, end), return_index=True, return_inverse=True)
    start, end = start[first], end[first]
    # pieces that are one visible run after one space are encoded many at a time
    bare = _MAY_BE_SPACE[data]
    shy = np.concatenate([[0], np.cumsum(bare)])
    plain = np.flatnonzero((data[start] == 32) & (shy[end] - shy[start] == 1) & ~inside[start])
    odd = np.setdiff1d(np.arange(len(start)), plain)
    ids: list[np.ndarray] = []
    counts = np.zeros(len(start), np.int64)
    flat, bounds = take_slices(data, start[plain], end[plain])
    low = 0
    while low < len(plain):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + ENCODED_BYTES, "right")) - 1)
        own = encoding.encode_to_numpy(flat[bounds[low]:bounds[high]].tobytes().decode("utf-8"), disallowed_special=())
        reach = np.concatenate([[0], np.cumsum(sizes[own])])
        counts[plain[low:high]] = np.diff(np.searchsorted(reach, bounds[low:high + 1] - bounds[low]))
        ids.append(own)
        low = high
    for k in odd:
        piece = data[start[k]:end[k]].tobytes()
        own = np.array([added[piece]]) if piece in added else encoding.encode_to_numpy(piece.decode("utf-8"), disallowed_special=())
        counts[k] = len(own)
        ids.append(own)
    pool = np.concatenate(ids).astype(np.uint32)
    order = np.concatenate([plain, odd])
    begin = np.zeros(len(start), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    laid, reach = take_slices(pool, begin[which], begin[which] + counts[which])
    return laid, reach[np.searchsorted(edges, offsets)]


class Stream:
    """Cuts a range's documents into sequences; what is in the open sequence is held back."""

    def __init__(self, number: int):
        self.next_sequence = number << 32
        self.held: list[tuple] = []

    def add(self, documents: list[tuple]) -> list[tuple]:
        """Documents are (id, ids before, all ids of the document, ids); gives the pieces of the sequences that are full now."""
        documents = self.held + documents
        total = sum(len(d[3]) for d in documents)
        pieces, self.held = self._cut(documents, [LENGTH] * (total // LENGTH))
        return pieces

    def close(self) -> list[tuple]:
        left = sum(len(d[3]) for d in self.held)
        pieces, self.held = self._cut(self.held, [1 << k for k in range(left.bit_length() - 1, -1, -1) if left >> k & 1])
        return pieces

    def _cut(self, documents: list[tuple], lengths: list[int]) -> tuple[list[tuple], list[tuple]]:
        pieces, rest, at, used = [], [], 0, 0
        for doc_id, start, total, ids in documents:
            low = 0
            while low < len(ids):
                if at == len(lengths):
                    rest.append((doc_id, start + low, total, ids[low:]))
                    break
                high = min(len(ids), low + lengths[at] - used)
                pieces.append((doc_id, start + low, high - low, zlib.crc32(ids[low:high]), total, self.next_sequence, used))
                used += high - low
                low = high
                if used == lengths[at]:
                    at, used, self.next_sequence = at + 1, 0, self.next_sequence + 1
        return pieces, rest


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _NAMES)


def _packed(path: str):
    def run(batches):
        stream = Stream(TaskContext.get().partitionId())
        for block in text_blocks(batches, limit=BLOCK_BYTES // 2):
            ids, bounds = encode_texts(path, block.data, block.offsets)
            end = np.array([END_ID], "<u4")
            documents = []
            for doc_id, low, high in zip(block.column("doc_id").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                documents.append((doc_id, 0, int(high - low) + 1, np.concatenate([ids[low:high], end]).astype("<u4")))
            yield _batch(stream.add(documents))
        yield _batch(stream.close())
    return run


def pack_along_curve(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = docs.mapInArrow(_keyed, "doc_id long, key long, text string")
    ranges = keyed.repartitionByRange(max(1, math.ceil(size / RANGE_BYTES)), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ranges.select("doc_id", "text").mapInArrow(_packed(path), ", ".join(f"{n} long" for n in _NAMES))
