"""Exact ranked lexical search by a dual tree: a hierarchy of items against hierarchies of documents.

Terms are maximal runs of ASCII letters, ASCII digits and characters beyond ASCII; only A-Z are lower-cased. One pass over the texts keeps
each document's terms that any item has, with their counts; statistics of the whole table come from it. In the search every task puts its
documents into blocks. A block's documents are ordered by the signs of a few random projections, so that like ones are neighbours; a node
is 512, 64 or 8 neighbours and holds the largest impact of each term among them. The items' tree halves them by a term that some have and
others don't; its nodes hold the largest weight of each term. The product of two nodes' maxima bounds every score between them: if it is
below the weakest kth score of the node's items, the whole batch of pairs is left out. What is left descends in both trees to single items
and single documents, whose bound is the score. A bound equal to the kth score is not left out, since a smaller id would win the tie, so the
result is exact.

The first kth scores come from a search of about ``SEED_DOCS`` documents. They only prune: any documents' kth score is a lower bound of the
final one.

Items go to every task in batches of at most ``BATCH_TERMS`` different terms each (an item with more is a batch of its own); each batch is
a pass of its own. A block holds ``BLOCK_POSTINGS`` terms of documents or one Arrow batch, a task keeps ``k`` documents an item.

Null and empty texts have no terms: such items find nothing, such documents are found by none and count for nothing. Each row of documents
is a document, also if ids repeat; a null id comes after all others in ties. Equal rows of items are one item, equal ids with different
texts are items of their own under that id. An empty table of either kind gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.words import LOWER, combine, find_words, hash_slices, text_blocks

TOP = 20
BATCH_TERMS = 200_000
BLOCK_POSTINGS = 2_000_000
SEED_DOCS = 20_000
#: Documents in a node, from the coarsest level to the single document.
NODE_DOCS = (512, 64, 8, 1)
ORDER_BITS = 8
LAST_ID = np.iinfo(np.int64).max

#: Bytes of a term keep their (lower-case) value, all others become spaces.
_TERM = LOWER.copy()
_TERM[[k for k in range(128) if not chr(k).isalnum()]] = 32


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and where each text's terms begin and end."""
    own = _TERM[data]
    words = find_words(own, offsets)
    return hash_slices(own, words.start, words.end), words.bounds


@dataclass
class Node:
    """Items and, for every term that one of them has, the largest weight."""

    items: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    children: list[Node] = field(default_factory=list)


def item_tree(rows: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray | None = None) -> Node:
    """The hierarchy of sparse rows ``(terms, weights)``: halves by the heaviest term that a fifth to four fifths of the items have."""
    own = np.arange(len(rows)) if own is None else own
    if len(own) == 1:
        return Node(own, *rows[own[0]])
    terms, place = np.unique(np.concatenate([rows[i][0] for i in own]), return_inverse=True)
    every = np.concatenate([rows[i][1] for i in own])
    most = np.zeros(len(terms))
    np.maximum.at(most, place, every)
    holders = np.bincount(place, minlength=len(terms))
    fit = (5 * holders >= len(own)) & (5 * holders <= 4 * len(own))
    if fit.any():
        chosen = terms[np.argmax(np.where(fit, np.bincount(place, every, len(terms)), -1))]
        has = np.array([chosen in rows[i][0] for i in own])
        halves = own[has], own[~has]
    else:
        halves = own[:len(own) // 2], own[len(own) // 2:]
    return Node(own, terms, most, [item_tree(rows, half) for half in halves])


@dataclass
class Level:
    """Entries (term, node, largest impact) of one level, by term and node; entry i covers ``below[i]:below[i + 1]`` of the next level."""

    term: np.ndarray
    node: np.ndarray
    impact: np.ndarray
    below: np.ndarray | None
    nodes: int


def document_levels(doc: np.ndarray, term: np.ndarray, impact: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[list[Level], np.ndarray]:
    """The block's hierarchy over postings sorted by document, and the documents in the hierarchy's order."""
    signs = np.random.default_rng(5).normal(size=(len(weight), ORDER_BITS)).astype(np.float32)
    code = np.zeros(n_docs, np.int64)
    scaled = (weight[term] * impact).astype(np.float32)
    for bit in range(ORDER_BITS):
        code = 2 * code + (np.bincount(doc, scaled * signs[term, bit], n_docs) > 0)
    gray = code.copy()
    for shift in (1, 2, 4):
        gray ^= gray >> shift  # the rank of a code word in Gray order
    order = np.lexsort((np.bincount(doc, minlength=n_docs), gray))
    place = np.empty(n_docs, np.int64)
    place[order] = np.arange(n_docs)
    at = place[doc]
    by = np.lexsort((at, term))
    term, at, impact = term[by], at[by], impact[by].astype(np.float64)
    levels = [Level(term, at, impact, None, n_docs)]
    for size in NODE_DOCS[-2::-1]:
        below = levels[0]
        shrink = size // NODE_DOCS[NODE_DOCS.index(size) + 1]
        node = below.node // shrink
        head = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (below.term[1:] != below.term[:-1])])) if len(node) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(below.impact, head) if len(head) else below.impact
        levels.insert(0, Level(below.term[head], node[head], most, np.append(head, len(node)), -(-below.nodes // shrink)))
    return levels, order


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, range by range."""
    size = end - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class Search:
    """The running best documents of every item, over any number of blocks."""

    def __init__(self, tree: Node, weight: np.ndarray, floors: np.ndarray, k: int):
        self.tree, self.weight, self.k = tree, weight, k
        self.floor = floors.astype(np.float64)
        self.best = {}
        self.row = np.zeros(len(weight))
        self.pairs = 0  # single items against single documents, for tests of the pruning

    def add(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, ids: np.ndarray) -> None:
        if not len(doc):
            return
        self.levels, order = document_levels(doc, term, impact, self.weight, len(ids))
        self.ids = ids[order]
        self.visit(self.tree, 0, np.arange(len(self.levels[0].term)))

    def visit(self, q: Node, depth: int, entries: np.ndarray) -> None:
        level = self.levels[depth]
        self.row[q.terms] = q.weights
        weight = self.row[level.term[entries]]
        self.row[q.terms] = 0
        entries, weight = entries[weight > 0], weight[weight > 0]
        nodes = level.node[entries]
        bound = np.bincount(nodes, weight * level.impact[entries], level.nodes)
        last = depth == len(self.levels) - 1
        # the factor covers rounding of sums beyond 2^53
        good = (bound > 0) & (bound >= self.floor[q.items].min() * (1 - 1e-9))
        held = good[nodes]
        if not held.any():
            return
        if last and not q.children:
            self.pairs += int(good.sum())
            self.keep(int(q.items[0]), np.flatnonzero(good), nodes[held], weight[held], level.impact[entries[held]])
            return
        entries = entries[held]
        if not last:
            entries = spans(level.below[entries], level.below[entries + 1])
        for child in q.children or [q]:
            self.visit(child, depth if last else depth + 1, entries)

    def keep(self, item: int, docs: np.ndarray, nodes: np.ndarray, weight: np.ndarray, impact: np.ndarray) -> None:
        place = np.searchsorted(docs, nodes)
        part = weight.astype(np.int64) * impact.astype(np.int64)
        # two sums of small numbers are exact in doubles
        score = (np.bincount(place, part >> 24, len(docs)).astype(np.int64) << 24) + np.bincount(place, part & 0xFFFFFF, len(docs)).astype(np.int64)
        ids = self.ids[docs]
        if item in self.best:
            score, ids = np.concatenate([self.best[item][0], score]), np.concatenate([self.best[item][1], ids])
        first = np.lexsort((ids, -score))[:self.k]
        self.best[item] = score[first], ids[first]
        if len(first) == self.k:
            self.floor[item] = max(self.floor[item], float(score[first[-1]]))


def _terms_of(vocabulary: np.ndarray):
    """For each document its number of terms, and its counted terms that are in the vocabulary (sorted hashes)."""
    def find(batches):
        for block in text_blocks(batches):
            hashes, bounds = term_hashes(block.data, block.offsets)
            doc = np.repeat(np.arange(len(block)), np.diff(bounds))
            place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            pair, tf = np.unique(doc[known] * max(len(vocabulary), 1) + place[known], return_counts=True)
            owner, term = np.divmod(pair, max(len(vocabulary), 1))
            offsets = pa.array(np.searchsorted(owner, np.arange(len(block) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id").cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))],
                ["doc_id", "n", "terms", "tfs"])
    return find


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 75 + (25 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _searcher(tree: Node, weight: np.ndarray, floors: np.ndarray, docs: int, total: int, k: int):
    def search(batches):
        found = Search(tree, weight, floors, k)
        held, size = [], 0

        def flush():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            offsets = np.asarray(whole.column("terms").offsets, dtype=np.int64)
            doc = np.repeat(np.arange(whole.num_rows), np.diff(offsets))
            term, tf = (np.asarray(whole.column(c).values)[offsets[0]:offsets[-1]] for c in ("terms", "tfs"))
            n = np.asarray(whole.column("n"))
            ids = np.asarray(whole.column("doc_id").fill_null(int(LAST_ID)))
            found.add(doc, term.astype(np.int64), impacts(tf, n[doc], docs, total), ids)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += len(batch.column("terms").values)
                if size >= BLOCK_POSTINGS:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        for item, (score, ids) in found.best.items():
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), item), pa.int64()), pa.array(ids, mask=ids == LAST_ID, type=pa.int64()), pa.array(score, pa.int64())],
                ["item", "doc_id", "score"])
    return search


def _item_terms(batches):
    for block in text_blocks(batches):
        hashes, bounds = term_hashes(block.data, block.offsets)
        owner = np.repeat(np.arange(len(block)), np.diff(bounds))
        _, first, n = np.unique(combine([hashes, owner.astype(np.uint64)]), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            block.column("item").take(pa.array(owner[first])), block.column("item_id").take(pa.array(owner[first])),
            pa.array(hashes[first].view(np.int64)), pa.array(n, pa.int64())], ["item", "item_id", "term", "n"])


def _batches(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """``item, item_id, term, n, batch`` of the items, dealt into batches of about ``BATCH_TERMS`` rows at most."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    rows = rows.withColumn("item", F.xxhash64(F.col("item_id").cast("string"), "text"))
    terms = stored(rows.select("item", F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(
        _item_terms, "item long, item_id long, term long, n long"), "item-terms")
    parts = max(1, -(-2 * terms.count() // BATCH_TERMS))
    terms = terms.withColumn("batch", F.pmod("item", F.lit(parts)))
    return terms, list(range(parts))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item; see the module's text."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms, parts = _batches(items)
    out = None
    for part in parts:
        own = terms.where(F.col("batch") == part).toPandas()
        names = own.groupby("item", sort=True)["item_id"].first()
        vocabulary = np.unique(own["term"].to_numpy().view(np.uint64))
        held = stored(texts.mapInArrow(_terms_of(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>"), "document-terms")
        n_docs, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not len(own):
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[row["term"]] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64).clip(min=0)
        rows = []
        for _, group in own.groupby("item", sort=True):
            place = np.searchsorted(vocabulary, group["term"].to_numpy().view(np.uint64))
            rows.append((place, (group["n"].to_numpy() * weight[place]).astype(np.float64)))
        tree, floors = item_tree(rows), np.zeros(len(rows))
        result = "item long, doc_id long, score long"
        useful = held.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
        seeds = useful.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(1, n_docs // SEED_DOCS))) == 0)
        first = _ranked(seeds.mapInArrow(_searcher(tree, weight, floors, n_docs, total, k), result), k)
        for row in first.where(F.col("rank") == k).toLocalIterator():
            floors[row["item"]] = row["score"]
        found = _ranked(useful.mapInArrow(_searcher(tree, weight, floors, n_docs, total, k), result), k)
        named = spark.createDataFrame([(k, None if v != v else int(v)) for k, v in enumerate(names)], "item long, item_id long")
        found = found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
