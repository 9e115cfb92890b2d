"""Nearest neighbours by inner product in a forest of long hash strings.

Each of ``TREES`` trees gives a vector a string of ``BITS`` bits: on which side of the median it lies along random directions. Vectors are
divided by the largest norm and get one more component that makes their norm 1 (queries get 0 there), so a larger inner product means a
smaller angle. A tree is the array of all vectors sorted by their strings; it is stored in blocks of neighbours, and those with a common
prefix are a range of it. A query descends in each tree to its longest prefix that other vectors have, and ascends in all trees at once,
bit by bit, until the ranges together hold as many candidates as wanted. Every candidate is compared exactly, in the block that holds
it; one that several trees find is compared in the first.

How many candidates are wanted is measured: the true neighbours of ``ASKED`` vectors, by a plain pass over all vectors, say how far the
ascent must go for a recall of ``RECALL``. Vectors without structure need most of the table, vectors in clusters a small part; nothing is
assumed. Medians and largest norm: a sample of at most ``FITTED_BYTES`` of vectors, and all vectors. Every vector is in every tree.

Equal vectors are one node with their ``k`` + 1 smallest ids, of which no query needs more, so copies cost nothing, and equal queries are
asked once. Prefixes of up to ``ROUTE_BITS`` bits are counted, which is all that reaches the driver; a longer common prefix counts as one
of that length (more candidates, never fewer). A prefix with more than ``BLOCK_BYTES`` of vectors is dealt into several blocks, and a block that
many queries ask is asked by ``BLOCK_QUERIES`` of them at a time, so no task holds more than one block and so many queries.

Vectors that are null, zero, hold null or non-finite components, have no id, or another length than most, take no part. Rows equal in id
and vector are one. Where one id has several vectors each is a candidate and a query of its own, but never an answer to its own id. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored

TOP = 20
QUERY_EVERY = 20
TREES, BITS = 6, 32
ROUTE_BITS = 16
RECALL = 0.96
ASKED = 200
FITTED_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20
BLOCK_QUERIES = 20_000
_POWERS = (1 << np.arange(BITS, dtype=np.int64))[::-1]


@dataclass
class Forest:
    norm: float
    directions: np.ndarray
    medians: np.ndarray
    k: int
    bits: int = 0
    wanted: int = 0
    counts: np.ndarray | None = None
    #: By tree and prefix: the first prefix of its block, and the number of blocks that share it.
    base: np.ndarray | None = None
    split: np.ndarray | None = None
    #: By tree and first prefix of a block: parts of its queries.
    chunks: np.ndarray | None = None

    def strings(self, rows: np.ndarray, query: bool) -> np.ndarray:
        """One row of ``TREES`` strings for each vector."""
        x = rows / self.norm
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
        sides = (np.column_stack([x, more]) @ self.directions > self.medians).reshape(len(x), TREES, BITS)
        return sides @ _POWERS

    def prefixes(self, strings: np.ndarray, bits: int) -> np.ndarray:
        return strings >> (BITS - bits)

    def levels(self, strings: np.ndarray, wanted: int) -> np.ndarray:
        """For each query the longest prefix with which all its ranges hold enough vectors."""
        out = np.zeros(len(strings), np.int64)
        for level in range(1, self.bits + 1):
            within = self.counts.reshape(TREES, 1 << level, -1).sum(axis=2)
            own = self.prefixes(strings, level)
            out[sum(within[t, own[:, t]] for t in range(TREES)) >= wanted] = level
        return out

    def asked_blocks(self, strings: np.ndarray, levels: np.ndarray):
        """``query, tree, base`` of all blocks that hold a part of a query's ranges; without a prefix the first tree has all."""
        starts = [np.unique(self.base[t]) for t in range(TREES)]
        for t in range(TREES):
            rows = np.flatnonzero((levels > 0) | (t == 0))
            low = (strings[rows, t] >> (BITS - levels[rows])) << (self.bits - levels[rows])
            high = low + (1 << (self.bits - levels[rows])) - 1
            first, last = (np.searchsorted(starts[t], self.base[t, x]) for x in (low, high))
            size = last - first + 1
            place = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield np.repeat(rows, size), t, starts[t][place]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, in doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


def _vectors(embeddings: DataFrame, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Different vectors ``h1, h2, ids, v``, all rows ``vec_id, h1, h2`` that take part, and the vectors' length."""
    kind = embeddings.schema["embedding"].dataType.elementType.typeName()
    rows = small_batches(embeddings).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if kind == "float" else "array<double>").alias("v")).where("vec_id is not null")
    sound = rows.where(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = sound.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = length["size"] if length else 0
    keyed = sound.where(F.size("v") == dims).select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    place = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = keyed.withColumn("place", place).where(F.col("place") <= k + 1)
    folded = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    return stored(folded, "vectors"), keyed.select("vec_id", "h1", "h2"), dims


def _prefix_counts(forest: Forest):
    def count(batches):
        out = np.zeros(TREES << forest.bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                own = forest.prefixes(forest.strings(matrix(batch.column("v")), False), forest.bits) + (np.arange(TREES) << forest.bits)
                out += np.bincount(own.reshape(-1), minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])
    return count


def _true_neighbours(forest: Forest, queries: np.ndarray, own: set):
    """The best vectors of each sampled query in a partition, by comparing all."""
    def find(batches):
        score, strings = np.full((len(queries), 0), 0.0), np.zeros((len(queries), 0, TREES), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column("v"))
            more = queries @ rows.T
            for c, key in enumerate(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True)):
                if key in own:
                    more[own[key], c] = -np.inf
            score = np.concatenate([score, more], axis=1)
            strings = np.concatenate([strings, np.broadcast_to(forest.strings(rows, False), (len(queries), len(rows), TREES))], axis=1)
            best = np.argsort(-score, axis=1, kind="stable")[:, :forest.k]
            score, strings = np.take_along_axis(score, best, 1), np.take_along_axis(strings, best[:, :, None], 1)
        good = np.isfinite(score).reshape(-1)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(queries)), score.shape[1])[good]), pa.array(score.reshape(-1)[good]),
            pa.array(list(strings.reshape(-1, TREES)[good]), pa.list_(pa.int64()))], ["q", "score", "strings"])
    return find


def _calibrated(forest: Forest, vectors: DataFrame, queries: np.ndarray, keys: list) -> int:
    """The least number of candidates with which the sampled queries find ``RECALL`` of their true neighbours."""
    found = vectors.mapInArrow(_true_neighbours(forest, queries, {key: i for i, key in enumerate(keys)}), "q long, score double, strings array<long>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "strings"))
    near = found.withColumn("place", place).where(F.col("place") <= forest.k).select("q", "strings").toPandas()
    if not len(near):
        return 1
    own = forest.strings(queries, True)
    q, theirs = near["q"].to_numpy(), np.array(near["strings"].tolist())
    common = np.zeros(len(q), np.int64)
    for level in range(1, forest.bits + 1):
        common[(forest.prefixes(own[q], level) == forest.prefixes(theirs, level)).any(axis=1)] = level
    wanted, total = float(forest.k), int(forest.counts.sum())
    while wanted < total and (common >= forest.levels(own, int(wanted))[q]).mean() < RECALL:
        wanted *= 1.19
    return min(int(wanted), total)


def _blocks(forest: Forest, rows: int) -> None:
    """Cuts each tree into blocks of at most ``rows`` vectors."""
    size = 1 << forest.bits
    forest.base, forest.split = np.zeros((TREES, size), np.int64), np.ones((TREES, size), np.int64)
    for t in range(TREES):
        held = rows + 1
        for p, n in enumerate(forest.counts[t].tolist()):
            if held + n > rows:
                start, held = p, 0
            held += n
            forest.base[t, p] = start
            if n > rows:
                forest.split[t, p] = -(-n // rows)


def _index_rows(forest: Forest):
    """Every vector in its block of every tree, once for each part of the block's queries."""
    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            strings = forest.strings(matrix(batch.column("v")), False)
            own = forest.prefixes(strings, forest.bits)
            h2 = np.asarray(batch.column("h2")).view(np.uint64)
            texts = pa.array(list(strings), pa.list_(pa.int64()))
            for t in range(TREES):
                base = forest.base[t, own[:, t]]
                part = (h2 % forest.split[t, base].astype(np.uint64)).astype(np.int64)
                times = forest.chunks[t, base]
                rows = np.repeat(np.arange(len(base)), times)
                chunk = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
                if len(rows):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(rows), t)), pa.array(base[rows]), pa.array(part[rows]), pa.array(chunk),
                        batch.column("ids").take(take), batch.column("v").take(take), texts.take(take)],
                        ["tree", "base", "part", "chunk", "ids", "v", "strings"])
    return deal


def _query_counts(forest: Forest):
    def count(batches):
        out = np.zeros(TREES << forest.bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                strings = forest.strings(matrix(batch.column("v")), True)
                for _, t, base in forest.asked_blocks(strings, forest.levels(strings, forest.wanted)):
                    out += np.bincount((t << forest.bits) + base, minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["at", "n"])
    return count


def _query_rows(forest: Forest):
    """Every query at all blocks that hold a part of its ranges."""
    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            strings = forest.strings(matrix(batch.column("v")), True)
            levels = forest.levels(strings, forest.wanted)
            h1 = np.asarray(batch.column("h1"))
            texts = pa.array(list(strings), pa.list_(pa.int64()))
            for query, t, base in forest.asked_blocks(strings, levels):
                live = forest.chunks[t, base] > 0
                query, base = query[live], base[live]
                parts = forest.split[t, base]
                rows, bases = np.repeat(query, parts), np.repeat(base, parts)
                part = np.arange(len(rows)) - np.repeat(np.cumsum(parts) - parts, parts)
                chunk = (h1[rows].view(np.uint64) % forest.chunks[t, bases].astype(np.uint64)).astype(np.int64)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(rows), t)), pa.array(bases), pa.array(part), pa.array(chunk),
                    batch.column("h1").take(take), batch.column("h2").take(take), batch.column("v").take(take), texts.take(take), pa.array(levels[rows])],
                    ["tree", "base", "part", "chunk", "h1", "h2", "v", "strings", "level"])
    return deal


def _best(scores: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, bounds: np.ndarray, k: int):
    """Ids and scores of the best of one query; ``ids[bounds[i]:bounds[i + 1]]`` have the vector i."""
    good = np.flatnonzero(np.isfinite(scores))
    if len(good) > k:
        least = np.partition(scores[good], -k)[-k]
        good = good[scores[good] >= least - 1e-9 * (1 + abs(least))]  # matrix products round in their own order
    exact = (rows[good] * q).sum(axis=1)
    size = np.diff(bounds)[good]
    own = ids[np.repeat(bounds[good] - np.cumsum(size) + size, size) + np.arange(size.sum())]
    exact = np.repeat(exact, size)
    first = np.lexsort((own, -exact))[:k]
    return own[first], exact[first]


def _compared(k: int):
    """The best of a block for each query that asks it."""
    def compare(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"h1": [], "h2": [], "id": [], "score": []}
        if index.num_rows and asked.num_rows:
            t = asked.column("tree")[0].as_py()
            theirs = matrix(index.column("strings")).astype(np.int64)
            order = np.argsort(theirs[:, t], kind="stable")
            theirs, rows = theirs[order], matrix(index.column("v"))[order]
            listed = index.column("ids").combine_chunks().take(pa.array(order))
            ids, bounds = np.asarray(listed.flatten()), np.append(0, np.cumsum(np.asarray(listed.value_lengths())))
            own, vectors = matrix(asked.column("strings")).astype(np.int64), matrix(asked.column("v"))
            level = np.asarray(asked.column("level").combine_chunks())
            h1, h2 = (np.asarray(asked.column(c).combine_chunks()) for c in ("h1", "h2"))
            start = own[:, t] >> (BITS - level)
            groups, which = np.unique(np.stack([level, start]), axis=1, return_inverse=True)
            for g, (bits, at) in enumerate(groups.T.tolist()):
                low = np.searchsorted(theirs[:, t], at << (BITS - bits))
                high = np.searchsorted(theirs[:, t], (at + 1) << (BITS - bits))
                members = np.flatnonzero(which.reshape(-1) == g)
                for few in (members[i:i + 256] for i in range(0, len(members) if high > low else 0, 256)):
                    scores = vectors[few] @ rows[low:high].T
                    for before in range(t if bits else 0):  # found in an earlier tree
                        scores[(own[few, before] >> (BITS - bits))[:, None] == (theirs[low:high, before] >> (BITS - bits))[None, :]] = -np.inf
                    for i, row in zip(few, scores, strict=True):
                        found, exact = _best(row, vectors[i], rows[low:high], ids, bounds[low:high + 1], k)
                        for name, values in (("h1", np.full(len(found), h1[i])), ("h2", np.full(len(found), h2[i])), ("id", found), ("score", exact)):
                            out[name].append(values)
        return pa.table({name: pa.array(np.concatenate(values) if values else np.zeros(0), pa.float64() if name == "score" else pa.int64()) for name, values in out.items()})
    return compare


def _gathered(rows: DataFrame, shape: int) -> np.ndarray:
    """Sums by place, as an array; at most ``TREES`` times 2^``ROUTE_BITS`` rows."""
    out = np.zeros(shape, np.int64)
    got = rows.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(TREES, -1)


def grown(vectors: DataFrame, dims: int, k: int) -> Forest | None:
    """Fits directions, counts prefixes and measures how many candidates are wanted; none for an empty table."""
    norm, n = vectors.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))), F.count("*")).first()
    if not n:
        return None
    most = max(1000, FITTED_BYTES // (8 * dims))
    sample = vectors.where(F.pmod("h1", F.lit(-(-n // most))) == 0).select("h1", "h2", "v").orderBy("h1", "h2").limit(2 * most).toPandas()
    if not len(sample):
        sample = vectors.select("h1", "h2", "v").limit(1000).toPandas()
    rows = np.array(sample["v"].tolist(), np.float64)
    directions = np.random.default_rng(11).normal(size=(dims + 1, TREES * BITS))
    forest = Forest(norm, directions, np.zeros(TREES * BITS), k + 1)
    scaled = rows / norm
    forest.medians = np.median(np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))]) @ directions, axis=0)
    forest.bits = int(np.clip(np.ceil(np.log2(max(n, 2) / 64)), 1, ROUTE_BITS))
    forest.counts = _gathered(vectors.mapInArrow(_prefix_counts(forest), "at long, n long"), TREES << forest.bits)
    forest.wanted = _calibrated(forest, vectors, rows[:ASKED], list(zip(sample["h1"][:ASKED], sample["h2"][:ASKED], strict=True)))
    _blocks(forest, max(1, BLOCK_BYTES // (8 * dims)))
    return forest


def nearest(embeddings: DataFrame, k: int = TOP, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose id is divisible by ``every``; see the module's text."""
    spark = embeddings.sparkSession
    vectors, keyed, dims = _vectors(embeddings, k)
    forest = grown(vectors, dims, k)
    if forest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = stored(keyed.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), "vector-queries")
    asked = stored(vectors.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v"), "asked-vectors")
    asking = _gathered(asked.mapInArrow(_query_counts(forest), "at long, n long"), TREES << forest.bits)
    forest.chunks = -(-asking // BLOCK_QUERIES)
    v = vectors.schema["v"].dataType.simpleString()
    place = "tree long, base long, part long, chunk long"
    index = vectors.select("h2", "ids", "v").mapInArrow(_index_rows(forest), f"{place}, ids array<long>, v {v}, strings array<long>")
    asks = asked.mapInArrow(_query_rows(forest), f"{place}, h1 long, h2 long, v {v}, strings array<long>, level long")
    block = ["tree", "base", "part", "chunk"]
    found = index.groupBy(*block).cogroup(asks.groupBy(*block)).applyInArrow(_compared(k + 1), "h1 long, h2 long, id long, score double")
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    few = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("near"))
    out = queries.join(lists, ["h1", "h2"]).select(
        F.col("vec_id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
