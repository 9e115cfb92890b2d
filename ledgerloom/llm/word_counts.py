"""Counts of whole-text words by a small key, folded inside each task before anything is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import BLOCK_BYTES, LOWER, combine, find_words, hash_slices, strings, text_blocks

#: Larger blocks fold more repeated words.
COUNTED_BYTES = 2 * BLOCK_BYTES


def key_codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Codes of a key column, and the value of each code; null is a value of its own."""
    coded = column.dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()


def _counter(lower: bool):
    def count(batches):
        for block in text_blocks(batches, limit=COUNTED_BYTES):
            data = LOWER[block.data] if lower else block.data
            words = find_words(data, block.offsets)
            if not len(words.start):
                continue
            codes, values = key_codes(block.column("key"))
            hashes = hash_slices(data, words.start, words.end)
            own = codes[words.doc]
            _, first, n = np.unique(combine([hashes, own.astype(np.uint64)]), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(values, pa.string()).take(pa.array(own[first])),
                pa.array(hashes[first].view(np.int64)),
                strings(data, words.start[first], words.end[first]).cast(pa.string()),
                pa.array(n, pa.int64()),
            ], ["key", "hash", "word", "n"])
    return count


def counted_words(docs: DataFrame, key, lower: bool) -> DataFrame:
    """``key, hash, word, n``: how often each word occurs in the texts of each key."""
    rows = docs.select(F.col("text").cast("string").alias("text"), key.cast("string").alias("key"))
    counts = rows.mapInArrow(_counter(lower), "key string, hash long, word string, n long")
    return counts.groupBy("key", "hash", "word").agg(F.sum("n").alias("n"))


GATHERED_ROWS = 200_000


def gathered(batches, rows: int = GATHERED_ROWS):
    """Joins small batches, so that equal keys fold better."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def spelled(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' characters as one stream, each word between two spaces; the stream's word and place in the word."""
    text = words.to_pylist()
    points = np.frombuffer((" " + "  ".join(text) + " ").encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in text], np.int64)
    owner = np.repeat(np.arange(len(text)), size)
    return points, owner, np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)


def char_grams(words: pa.ChunkedArray | pa.Array, n: np.ndarray, sizes):
    """For each size the different n-grams of the spaced words that end after the first space, and their summed counts."""
    if not len(words):
        return
    points, owner, place = spelled(words)
    for size in sizes:
        ends = np.flatnonzero(place >= max(1, size - 1))
        keys = combine([points[ends - size + 1 + k] for k in range(size)])
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, which, n[owner[ends]])
        chosen = ends[first][:, None] + np.arange(1 - size, 1)[None, :]
        flat = points[chosen].astype("<u4").tobytes().decode("utf-32-le")
        yield [flat[k:k + size] for k in range(0, len(flat), size)], sums
