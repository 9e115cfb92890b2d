"""Language of a text, word first.

Words are runs of letters, lower-cased. A word known from training counts by its log frequency in each language. A word that is not known
falls back to its character n-grams of four, then three, two, one characters, spaces around the word included: the longest size of which
at least one n-gram is known counts, by the mean log frequency of those known. A text's language has the largest sum over its words.

The model holds the words and n-grams that make up at least ``LEAST_SHARE`` of a language's counts, so at most 1 / ``LEAST_SHARE`` of a
kind in a language; counts cover all training documents. Every item of a kind has ``SMALLEST`` more counts in each language.

Training documents have a text and a language, and crc32(id as text) mod 4 other than 2. Null texts and texts without a letter are
``und`` with score 0, and so is every text if nothing was learned. Ties go to the language first in order. ``score`` is the softmax of
the mean log frequencies times the number of words, ``FIRM_WORDS`` at most. Repeated rows are rows of their own. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.suffix_tree import held_out
from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.word_counts import char_grams, gathered, key_codes
from ledgerloom.llm.words import Texts, combine, hash_slices, take_slices, text_blocks

FOLDS = 4
SIZES = (4, 3, 2, 1)
LEAST_SHARE = 1e-5
SMALLEST = 0.5
FIRM_WORDS = 30
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in regex.findall(r"\p{L}", "".join(map(chr, every)))]] = True
    return out


def letter_words(block: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a block; start, end and hash of its words; the words' bounds by text."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    offsets = lead[block.offsets]
    if not len(points):
        none = np.zeros(0, np.int64)
        return points, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = _letters()[points]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = solid[heads], solid[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return points, start, end, hash_slices(points.view(np.uint8), start * 4, end * 4), np.searchsorted(start, offsets)


def _pick(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    flat, offsets = take_slices(points, start, end)
    text = flat.astype("<u4").tobytes().decode("utf-32-le")
    return [text[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _count(batches):
    for block in text_blocks(batches):
        points, start, end, hashes, bounds = letter_words(block)
        codes, values = key_codes(block.column("lang"))
        own = np.repeat(codes, np.diff(bounds))
        _, first, n = np.unique(combine([hashes, own.astype(np.uint64)]), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(values, pa.string()).take(pa.array(own[first])), pa.array(_pick(points, start[first], end[first]), pa.string()), pa.array(n, pa.int64())],
            ["lang", "word", "n"])


def _grams(batches):
    for table in gathered(batches):
        codes, values = key_codes(table.column("lang").combine_chunks())
        n = np.asarray(table.column("n"))
        for code, value in enumerate(values):
            own = np.flatnonzero(codes == code)
            for gram, sums in char_grams(table.column("word").take(pa.array(own)), n[own], SIZES):
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(gram), pa.string()), pa.array(gram, pa.string()), pa.array(sums, pa.int64())], ["lang", "item", "n"])


def model_rows(docs: DataFrame) -> DataFrame:
    """``lang, size, item, n, total``: words (size 0) and n-grams that are frequent enough in their language."""
    words = docs.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = stored(words, "words")
    grams = words.mapInArrow(_grams, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    grams = stored(grams, "grams").select("lang", F.length("item").alias("size"), "item", "n")
    items = words.select("lang", F.lit(0).alias("size"), F.col("word").alias("item"), "n").unionByName(grams)
    totals = items.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return items.join(totals, ["lang", "size"]).where(F.col("n") >= LEAST_SHARE * F.col("total"))


def frequency_tables(rows) -> tuple[list[str], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The languages in order; for each size sorted hashes of the items and their log frequencies by language."""
    languages = sorted(rows.lang.unique())
    out = {}
    for size, own in rows.groupby("size"):
        items = sorted(own["item"].unique())
        place = {item: k for k, item in enumerate(items)}
        table = np.full((len(items), len(languages)), SMALLEST)
        totals = dict(zip(own.lang, own.total, strict=True))
        table[own["item"].map(place), own.lang.map({x: k for k, x in enumerate(languages)})] += own.n
        logs = np.log(table / (np.array([totals.get(x, 0) for x in languages]) + SMALLEST * len(items)))
        points = np.frombuffer("".join(items).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(i) for i in items])
        starts = ends - np.array([len(i) for i in items])
        hashes = hash_slices(points.view(np.uint8), starts * 4, ends * 4)
        order = np.argsort(hashes)
        out[int(size)] = hashes[order], logs[order]
    return languages, out


def word_logs(tables: dict, n_languages: int, points: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Log frequencies by language of each word, by the longest form of it that is known; zeros if none is."""
    out = np.zeros((len(hashes), n_languages))
    left = np.arange(len(hashes))
    if 0 in tables:
        known, logs = tables[0]
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hit = known[at] == hashes
        out[hit] = logs[at[hit]]
        left = np.flatnonzero(~hit)
    for size in SIZES:
        if not len(left) or size not in tables:
            continue
        known, logs = tables[size]
        length = end[left] - start[left] + 2
        begin = np.cumsum(length) - length
        stream = np.full(int(length.sum()) + size, 32, "<u4")
        flat, offsets = take_slices(points, start[left], end[left])
        stream[np.repeat(begin + 1 - offsets[:-1], length - 2) + np.arange(len(flat))] = flat
        owner = np.repeat(np.arange(len(left)), length)
        spot = np.flatnonzero(np.arange(len(owner)) - begin[owner] >= max(1, size - 1)) - size + 1
        keys = hash_slices(stream.view(np.uint8), spot * 4, (spot + size) * 4)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[at] == keys
        who = owner[spot + size - 1][hit]
        n = np.bincount(who, minlength=len(left))
        for k in range(n_languages):
            total = np.bincount(who, weights=logs[at[hit], k], minlength=len(left))
            out[left, k] = total / np.maximum(n, 1)
        left = left[n == 0]
    return out


def _predict(model):
    def run(batches):
        languages, tables = model.value
        names = pa.array([*languages, UNKNOWN], pa.string())
        for block in text_blocks(batches):
            points, start, end, hashes, bounds = letter_words(block)
            n = np.diff(bounds)
            best, score = np.full(len(n), len(languages)), np.zeros(len(n))
            if languages and len(hashes):
                _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
                logs = word_logs(tables, len(languages), points, start[first], end[first], hashes[first])
                sums = np.stack([np.diff(np.concatenate([[0], np.cumsum(logs[which, k])])[bounds]) for k in range(len(languages))], axis=1)
                some = n > 0
                firm = sums[some] / n[some][:, None] * np.minimum(n[some], FIRM_WORDS)[:, None]
                shares = np.exp(firm - firm.max(axis=1, keepdims=True))
                best[some] = firm.argmax(axis=1)
                score[some] = shares.max(axis=1) / shares.sum(axis=1)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("held_out"), names.take(pa.array(best)), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"),
                       F.col("lang").cast("string").alias("lang")).withColumn("held_out", held_out(F.col("doc_id"), FOLDS))
    train = docs.where("text is not null and lang is not null and not held_out").select("text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(frequency_tables(model_rows(train).toPandas()))
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
