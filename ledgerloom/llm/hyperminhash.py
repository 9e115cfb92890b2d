"""Near-duplicate documents by HyperMinHash registers.

A document's 64-bit shingle hashes are dealt into 128 buckets by their top bits; a bucket keeps its smallest hash, compressed to
the number of leading zeros and ten mantissa bits. An empty bucket copies a filled one, chosen by a fixed ranking of its own.
Bands of three registers give candidates, the share of equal registers, corrected for chance collisions, thins them, and full
shingle sets decide.

At the threshold of 0.75 a link escapes all 42 bands with probability (1 - 0.75^3)^42, about 1e-10. Pairs with a hub are compared on full
sets whatever their estimate; the estimate thins only the pairs beyond hubs (five standard deviations: less than 1e-6 of links).

Groups of any size: documents with one shingle set are one class. A band's members are compared with one of them only, its hub: the member
that shares most with others. If two members are linked to their hub they are in one component. Otherwise one of them, say r, is not linked
to the hub c, and then a document l can be linked to r only if the differences of r and l from c share elements, at least
(|r - c| + |l - c| - (|r| + |l|) / 7) / 2 of them and one at least (|x - y|: symmetric difference). Such pairs are found by a prefix
filter over difference elements, the rarest first, with size and position bounds, and then verified. So no link between components is
left out, and the pairs inside a group are never listed.

Null, empty and blank texts have an empty set and no links. Repeated rows of one id count as one document when their text is the
same (otherwise the set with fewest shingles counts, of these the one with the smallest sum of hashes). Rows without an id have
nothing to be named by: they come back one by one, with their set's size, without a component and kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.words import LOWER, combine, find_words, hash_slices, mix, shingle_sets, text_blocks

SHINGLE_WORDS = 5
PER_CENT = 75
BUCKETS, MANTISSA_BITS = 128, 10
BAND, BANDS = 3, 42
#: Five standard deviations of the share of equal registers at the threshold.
ESTIMATE_FLOOR = PER_CENT / 100 - 5 * (0.75 * 0.25 / BUCKETS) ** 0.5
#: Candidate ids are sent to every executor up to this number (16 MB); more are joined by a shuffle. The result is the same.
SENT_IDS = 2_000_000

_BUCKET_BITS = BUCKETS.bit_length() - 1
_ORDER = np.argsort(np.random.default_rng(7).random((BUCKETS, BUCKETS)), axis=1).argsort(axis=1).astype(np.uint8)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers for each sorted set; empty sets give zeros."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    bucket = (flat >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
    cell = doc * BUCKETS + bucket
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    rest = (flat[lead] << np.uint64(_BUCKET_BITS)).astype(np.float64)
    share, power = np.frexp(rest)
    zeros = np.where(rest > 0, 64 - power, 63 - MANTISSA_BITS)
    mantissa = np.where(rest > 0, (share - 0.5) * (1 << (MANTISSA_BITS + 1)), 0)
    filled = np.zeros((len(sets), BUCKETS), bool)
    filled.reshape(-1)[cell[lead]] = True
    out.reshape(-1)[cell[lead]] = (np.minimum(zeros, 63) * (1 << MANTISSA_BITS) + mantissa).astype(np.uint16)
    for d in np.flatnonzero((sizes > 0) & ~filled.all(axis=1)):
        own, gaps = np.flatnonzero(filled[d]), np.flatnonzero(~filled[d])
        out[d, gaps] = out[d, own[_ORDER[np.ix_(gaps, own)].argmin(axis=1)]]
    return out


def corrected_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers of sets with n and m members.

    Two different minima share a register with probability near 0.17 * 2^(1 - mantissa bits), less for sets of unequal size.
    """
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487159739 * 2.0 ** (1 - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def _sketch(batches):
    for block in text_blocks(batches):
        data = LOWER[block.data]
        words = find_words(data, block.offsets)
        sets = list(shingle_sets(words, hash_slices(data, words.start, words.end), SHINGLE_WORDS))
        yield pa.RecordBatch.from_arrays([
            block.column("doc_id").cast(pa.int64()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
            pa.array([int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
            pa.array([r.tobytes() for r in registers(sets)], pa.binary()),
        ], ["doc_id", "n_shingles", "sum_hash", "xor_hash", "registers"])


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _band_keys(batches):
    for batch in batches:
        if batch.num_rows:
            rows = _rows(batch.column("registers")).astype(np.uint64)
            keys = np.stack([combine([rows[:, BAND * k + j] for j in range(BAND)] + [np.full(len(rows), k, np.uint64)]) for k in range(BANDS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column("rep")), BANDS))], ["band", "doc"])


def _likely(batches):
    for batch in batches:
        if batch.num_rows:
            a, b = (_rows(batch.column(c)) for c in ("ra", "rb"))
            good = corrected_jaccard(a, b, np.asarray(batch.column("na")), np.asarray(batch.column("nb"))) >= ESTIMATE_FLOOR
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good)], ["a", "b", "likely"])


def _compared(batches):
    """Whether full shingle sets meet the threshold, and the elements in which b differs from a (removed ones with their last bit turned)."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part, sets = batch.slice(low, 64), {}
            for side in ("a", "b"):
                sets[side] = []
                for block in text_blocks([part], f"text_{side}"):
                    data = LOWER[block.data]
                    words = find_words(data, block.offsets)
                    sets[side] += shingle_sets(words, hash_slices(data, words.start, words.end), SHINGLE_WORDS)
            apart = [np.concatenate([np.setdiff1d(y, x, True), np.setdiff1d(x, y, True) ^ np.uint64(1)]) for x, y in zip(sets["a"], sets["b"], strict=True)]
            shared = [(len(x) + len(y) - len(d)) // 2 for x, y, d in zip(sets["a"], sets["b"], apart, strict=True)]
            good = [100 * s >= PER_CENT * (len(x) + len(y) - s) for s, x, y in zip(shared, sets["a"], sets["b"], strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column("a"), part.column("b"), pa.array(good, pa.bool_()), pa.array([len(y) for y in sets["b"]], pa.int64()),
                pa.array([d.view(np.int64) for d in apart], pa.list_(pa.int64()))], ["a", "b", "linked", "size", "apart"])


def _side(frame: DataFrame, key: str, **names: str) -> DataFrame:
    return frame.select(F.col("doc_id").alias(key), *[F.col(c).alias(n) for c, n in names.items()])


def _estimated(pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
    known = pairs.join(_side(reps, "a", registers="ra", n_shingles="na"), "a").join(_side(reps, "b", registers="rb", n_shingles="nb"), "b")
    return stored(known.mapInArrow(_likely, "a long, b long, likely boolean"), f"{name}-likely")


def _verified(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """``a, b, linked, size, apart`` of the pairs of class representatives ``a, b``."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    if 2 * pairs.count() <= SENT_IDS:
        ids = F.broadcast(ids)
    wanted = stored(texts.join(ids, "doc_id", "left_semi"), f"{name}-texts")
    both = pairs.join(_side(wanted, "b", text="text_b"), "b").join(_side(wanted, "a", text="text_a"), "a")
    return stored(both.select("a", "b", "text_a", "text_b").mapInArrow(
        _compared, "a long, b long, linked boolean, size long, apart array<long>"), f"{name}-compared")


def _hub_pairs(bands: DataFrame) -> DataFrame:
    """``a, b``: each band's hub and its other members."""
    sizes = bands.groupBy("band").agg(F.count("*").alias("n"))
    scores = stored(bands.join(sizes, "band").groupBy("doc").agg(F.sum("n").alias("score")), "scores")
    hubs = bands.join(scores, "doc").groupBy("band").agg(F.max_by("doc", F.struct("score", -F.col("doc"))).alias("a"))
    return bands.join(hubs, "band").where("doc != a").select("a", F.col("doc").alias("b")).distinct()


def _cross_pairs(compared: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b``: pairs of documents of different components that can be links, of which one at least is not linked to their common hub."""
    rows = compared.select("a", "b", "linked", "size", F.size("apart").alias("n"), F.explode("apart").alias("element"))
    common = rows.groupBy("a", "element").agg(F.count("*").alias("times"), F.bool_and("linked").alias("all")).where("times > 1 and not all")
    # an element that no other document has can match nothing, but it takes one of the first places
    rows = rows.join(common.select("a", "element", "times"), ["a", "element"])
    own = Window.partitionBy("a", "b")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("times", "element")) - 1
    rows = rows.withColumn("place", place).where(F.col("place") <= F.floor(F.col("size") / 3))
    rows = rows.join(groups.withColumnRenamed("node", "b"), "b", "left").withColumn("group", F.coalesce("component", "b"))
    rows = stored(rows.select("a", "element", "b", "linked", "size", "n", "place", "group"), "cells")
    r, l = rows.where("not linked").alias("r"), rows.alias("l")  # noqa: E741
    spare = (F.col("r.size") + F.col("l.size")) / 7
    least = F.greatest(F.lit(1.0), (F.col("r.n") + F.col("l.n") - spare) / 2)
    pairs = r.join(l, (F.col("r.a") == F.col("l.a")) & (F.col("r.element") == F.col("l.element")) & (F.col("r.group") != F.col("l.group"))
                   & (F.col("l.linked") | (F.col("r.b") < F.col("l.b"))) & (F.abs(F.col("r.n") - F.col("l.n")) <= spare)
                   & (4 * F.least("r.size", "l.size") >= 3 * F.greatest("r.size", "l.size"))
                   & (F.least(F.col("r.n") - F.col("r.place"), F.col("l.n") - F.col("l.place")) >= least))
    return pairs.select(F.least("r.b", "l.b").alias("a"), F.greatest("r.b", "l.b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document; see the module's text."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = "doc_id long, n_shingles long, sum_hash long, xor_hash long, registers binary"
    nameless = docs.where("doc_id is null").mapInArrow(_sketch, sketched)
    docs = docs.where("doc_id is not null")
    sketches = stored(docs.mapInArrow(_sketch, sketched), "sketches")
    key = ["n_shingles", "sum_hash", "xor_hash"]
    single = sketches.groupBy("doc_id").agg(F.min(F.struct(*key, "registers")).alias("s")).select("doc_id", "s.*")
    classes = sketches.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = stored(
        single.join(classes, key, "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"),
                                                 F.when(F.col("rep") == F.col("doc_id"), F.col("registers")).alias("registers")), "members")
    reps = members.where("registers is not null")
    bands = reps.select("rep", "registers").mapInArrow(_band_keys, "band long, doc long")
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    bands = stored(bands.join(shared, "band"), "bands")

    compared = _verified(stored(_hub_pairs(bands), "hub-pairs"), docs, "hub")
    links = compared.where("linked").select("a", "b")
    cross = _estimated(_cross_pairs(compared, stored(components(links), "groups")), reps, "cross")
    more = _verified(cross.where("likely"), docs, "cross").where("linked").select("a", "b")
    final = components(links.unionAll(more))
    out = members.join(final, members.rep == final.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
