"""Phrase collocations by multikey three-way quicksort of suffix pointers.

A-Z are lower-cased, texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these into words ``[^\\x20\\x09]+``. A suffix is a word of a
piece with up to four that follow it. Suffixes are routed by their two leading words; the task that has a route's suffixes sorts pointers
to them word by word into smaller, equal and larger ones. The size of an equal part is the count of the words that its suffixes begin with;
parts of fewer than ``LEAST`` suffixes are abandoned, whatever the depth.

Before routing, words and then pairs of words are counted, folded in the tasks first. Suffixes are cut where a pair is infrequent, since no
candidate holds it. A route's suffixes are about ``ROUTE_ROWS``; prefixes that have more themselves are counted with one word more, and
their suffixes are routed by that many words, up to all five, where equal suffixes fold in the tasks. So no group grows with the input.

Which words and pairs are frequent or hot is sent to the tasks as bits of their hashes, ``MOST_BITS`` (8 MB) at most. A wrong bit costs
time only: counts are exact in any case. Words are named by 64-bit hashes of language and word.

A candidate is a phrase of 2 to 5 words with ``LEAST`` occurrences. Cut after its first k words, with l and r occurrences of the two parts,
its score is floor(1000 * a * n / (l * r)) in exact integers; the lowest cut counts. Candidates all of whose occurrences lie in a longer one
are dropped. ``TOP`` candidates of a language are returned, found in shares of the candidates first, then among the shares' best.

Null and empty texts have no words; null languages count as ``und`` and are one with that name. Repeated rows are separate texts; ids and
other columns are not used. An empty table gives an empty result. Ties end with the phrase's bytes, so results don't depend on row order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.word_counts import COUNTED_BYTES
from ledgerloom.llm.words import LOWER, combine, find_words, hash_slices, strings, text_blocks

LEAST = 100
MOST_WORDS = 5
TOP = 2000
ROUTE_ROWS = 200_000
MOST_BITS = 1 << 26
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
CODES = [f"c{k}" for k in range(MOST_WORDS)]


@dataclass
class Bits:
    """A set of 64-bit hashes as bits; what is not in it certainly isn't in the set."""

    packed: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(8 * len(self.packed) - 1)
        return (self.packed[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bits_of(hashes: DataFrame) -> Bits:
    """Bits of the column ``hash``: 32 for each different hash, ``MOST_BITS`` at most, in words of 64 that Spark folds."""
    size = 1 << 16
    while size < min(MOST_BITS, 32 * hashes.count()):
        size *= 2
    at = F.col("hash").bitwiseAND(F.lit(size - 1))
    words = hashes.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {size - 1}) & 63 as int))")).alias("bits"))
    got = words.toPandas()
    packed = np.zeros(size // 64, np.int64)
    packed[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return Bits(packed.view(np.uint8))


@dataclass
class Known:
    """What the counts so far say: frequent words and pairs, and by number of words the prefixes that are hot."""

    words: Bits | None = None
    pairs: Bits | None = None
    hot: dict[int, Bits] = field(default_factory=dict)


class Pieces:
    """The words of a block of texts, and which of them follow each other in a piece."""

    def __init__(self, block):
        lower = LOWER[block.data]
        breaks = _BREAK[lower]
        self.data = np.where(breaks, np.uint8(32), lower)
        words = find_words(self.data, block.offsets)
        self.start, self.end = words.start, words.end
        self.doc = words.doc
        self.key = np.asarray(block.column("key"))[self.doc]
        self.codes = combine([hash_slices(self.data, self.start, self.end), self.key.view(np.uint64)]) if len(self.start) else np.zeros(0, np.uint64)
        piece = np.cumsum(breaks)[self.start] if len(self.start) else self.start
        self.follows = np.zeros(len(self.start), bool)  # the next word is of the same piece
        self.follows[:-1] = (self.doc[1:] == self.doc[:-1]) & (piece[1:] == piece[:-1])

    def pairs(self, known: Known) -> np.ndarray:
        """Whether the pair that begins at each word can be frequent."""
        own = known.words.has(self.codes)
        good = self.follows.copy()
        good[:-1] &= own[:-1] & own[1:]
        if known.pairs:
            at = np.flatnonzero(good)
            good[at] = known.pairs.has(prefix(self.codes, at, 2))
        return good

    def reach(self, good: np.ndarray) -> np.ndarray:
        """The number of words, ``MOST_WORDS`` at most, of the suffix at each word that is cut at the first pair that isn't good."""
        size, alive = np.ones(len(good), np.int64), good.copy()
        for step in range(1, MOST_WORDS):
            size += alive
            left = max(0, len(good) - step)
            alive[:left] &= good[step:]
            alive[left:] = False
        return size


def prefix(codes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return combine([codes[at + k] for k in range(size)])


def _words(batches):
    for block in text_blocks(batches, limit=COUNTED_BYTES):
        own = Pieces(block)
        if len(own.start):
            _, first, n = np.unique(own.codes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(own.key[first]), pa.array(own.codes[first].view(np.int64)),
                strings(own.data, own.start[first], own.end[first]).cast(pa.string()), pa.array(n, pa.int64())], ["key", "code", "word", "n"])


def _prefixes(size: int, known: Known):
    """Folded prefixes of ``size`` words, all of whose shorter prefixes of two words or more are hot."""
    def find(batches):
        for block in text_blocks(batches, limit=COUNTED_BYTES):
            own = Pieces(block)
            at = np.flatnonzero(own.reach(own.pairs(known)) >= size)
            for k in range(2, size):
                at = at[known.hot[k].has(prefix(own.codes, at, k))]
            if len(at):
                _, first, n = np.unique(prefix(own.codes, at, size), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.key[at[first]])] + [pa.array(own.codes[at[first] + k].view(np.int64)) for k in range(size)] + [pa.array(n, pa.int64())],
                    ["key", *CODES[:size], "n"])
    return find


def _suffixes(known: Known, routes: int):
    """Folded suffixes with their route; those that end where the counts are known already are left out."""
    def find(batches):
        for block in text_blocks(batches, limit=COUNTED_BYTES):
            own = Pieces(block)
            reach = own.reach(own.pairs(known))
            at = np.flatnonzero(reach >= 3)
            if not len(at):
                continue
            size, lead = reach[at], np.full(len(at), 2)
            for k in range(2, MOST_WORDS):
                if k in known.hot:
                    more = (lead == k) & (size >= k)
                    more[more] = known.hot[k].has(prefix(own.codes, at[more], k))
                    lead[more] = k + 1
            at, size, lead = at[size >= lead], size[size >= lead], lead[size >= lead]
            padded = np.concatenate([own.codes, np.zeros(MOST_WORDS, np.uint64)])
            columns = [np.where(k < size, padded[at + k], np.uint64(0)) for k in range(MOST_WORDS)]
            _, first, n = np.unique(combine(columns), return_index=True, return_counts=True)
            route = combine([np.where(k < lead, columns[k], np.uint64(0))[first] for k in range(MOST_WORDS)]) % np.uint64(routes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.astype(np.int64)), pa.array(own.key[at[first]]), pa.array(lead[first], pa.int32())]
                + [pa.array(c[first].view(np.int64)) for c in columns] + [pa.array(n, pa.int64())], ["route", "key", "lead", *CODES, "n"])
    return find


def equal_parts(columns: list[np.ndarray], n: np.ndarray, least: int):
    """``row, words, count`` of each equal part with at least ``least`` suffixes; a word 0 ends a suffix."""
    stack = [(np.arange(len(n)), 0)]
    while stack:
        own, depth = stack.pop()
        if depth == len(columns) or n[own].sum() < least:
            continue
        word = columns[depth][own]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        same = own[word == pivot]
        if len(same) < len(own):
            stack += [(own[word < pivot], depth), (own[word > pivot], depth)]
        count = int(n[same].sum())
        if pivot and count >= least:
            yield same[0], depth + 1, count
            stack.append((same, depth + 1))


def _sorted(group: pa.Table) -> pa.Table:
    columns = [np.asarray(group.column(c).combine_chunks()).view(np.uint64) for c in CODES]
    n, lead = np.asarray(group.column("n").combine_chunks()), np.asarray(group.column("lead").combine_chunks())
    # a part of fewer words than its route's is complete here only in part
    found = [x for x in equal_parts(columns, n, LEAST) if x[1] >= max(3, lead[x[0]])]
    rows = [x[0] for x in found]
    codes = [[columns[k].view(np.int64)[row] for k in range(size)] for row, size, _ in found]
    return pa.table({"key": group.column("key").take(pa.array(rows, pa.int64())), "codes": pa.array(codes, pa.list_(pa.int64())),
                     "f": pa.array([x[2] for x in found], pa.int64())})


def phrase_counts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """``key, codes, f`` of all phrases of 1 to ``MOST_WORDS`` words with ``LEAST`` occurrences, for ``key, text`` and counted words."""
    known = Known(words=bits_of(words.where(F.col("n") >= LEAST).select(F.col("code").alias("hash"))))
    parts = [words.where(F.col("n") >= LEAST).select("key", F.array("code").alias("codes"), F.col("n").alias("f"))]
    routes = 1
    for size in range(2, MOST_WORDS):
        names = ", ".join(f"{c} long" for c in CODES[:size])
        rows = texts.mapInArrow(_prefixes(size, known), f"key long, {names}, n long").groupBy("key", *CODES[:size]).agg(F.sum("n").alias("n"))
        rows = stored(rows.where(F.col("n") >= LEAST), f"prefixes-{size}")
        parts.append(rows.select("key", F.array(*CODES[:size]).alias("codes"), F.col("n").alias("f")))
        hashed = rows.mapInArrow(_hashed(size), "hash long, n long")
        if size == 2:
            known.pairs = bits_of(hashed.select("hash"))
            routes = max(1, -(-rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // ROUTE_ROWS))
        hot = hashed.where(F.col("n") > ROUTE_ROWS).select("hash")
        if hot.isEmpty():
            break
        known.hot[size] = bits_of(hot)
    codes = ", ".join(f"{c} long" for c in CODES)
    suffixes = texts.mapInArrow(_suffixes(known, routes), f"route long, key long, lead int, {codes}, n long")
    parts.append(suffixes.groupBy("route").applyInArrow(_sorted, "key long, codes array<long>, f long"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a prefix may be counted both before routing and in its route, with one result
    return stored(every.groupBy("key", "codes").agg(F.max("f").alias("f")), "phrase-counts")


def _hashed(size: int):
    def find(batches):
        for batch in batches:
            if batch.num_rows:
                hashes = combine([np.asarray(batch.column(c)).view(np.uint64) for c in CODES[:size]])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), batch.column("n")], ["hash", "n"])
    return find


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """``key, codes, a, l, r, n, score`` of the candidates that no longer one covers; ``totals`` has ``key, n``."""
    phrases = counts.where(F.size("codes") > 1).withColumnRenamed("f", "a")
    size = F.size("codes")
    cuts = phrases.select("key", "codes", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "key", "codes", "a", "k", F.expr("slice(codes, 1, k)").alias("first"), F.expr("slice(codes, k + 1, size(codes))").alias("rest"))
    part = counts.select(F.col("codes").alias("first"), F.col("f").alias("l"))
    rest = counts.select(F.col("codes").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(part, "first").join(rest, "rest").join(totals, "key")
    whole = F.expr("(cast(a as decimal(18, 0)) * 1000 * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    cuts = cuts.withColumn("score", whole.cast("long"))
    least = cuts.groupBy("key", "codes", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where(size > 2).select("codes", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select(
        "codes", "a", "m", F.explode(F.expr("sequence(1, size(codes) - m + 1)")).alias("i"))
    covers = inner.groupBy(F.expr("slice(codes, i, m)").alias("codes")).agg(F.max("a").alias("longer"))
    left = least.join(covers, "codes", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    return left.select("key", "codes", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first phrases of each language; see the module's text."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    named = small_batches(docs).select(F.xxhash64(lang).alias("key"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    texts = named.select("key", "text").where("text is not null")
    words = stored(texts.mapInArrow(_words, "key long, code long, word string, n long").groupBy("key", "code", "word").agg(F.sum("n").alias("n")), "phrase-words")
    totals = words.groupBy("key").agg(F.sum("n").alias("n"))
    rows = scored(phrase_counts(texts, words), totals)

    numbered = rows.withColumn("phrase_id", F.xxhash64("codes"))
    spelling = words.where(F.col("n") >= LEAST).select("code", "word")
    spelled = numbered.select("phrase_id", F.posexplode("codes").alias("at", "code")).join(spelling, "code").groupBy("phrase_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = numbered.join(spelled, "phrase_id").withColumn("share", F.pmod("phrase_id", F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "share").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= top)
    names = named.select("key", "lang").distinct()
    return rows.join(names, "key").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
