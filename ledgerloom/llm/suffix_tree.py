"""Language-model scores by a probabilistic suffix tree over words.

Symbols are the words of the training texts, the end of a text, and one symbol, REST, for every other word. Every row of up to ``DEPTH``
training words that occurs in the training texts is a context, however rare. It is a state if its next-symbol counts diverge from its
suffix's distribution: twice the count times the Kullback-Leibler divergence must exceed its degrees of freedom, d, by ``DEVIATIONS`` times
sqrt(2 d). Distributions are smoothed by absolute discounting towards the suffix's. A token is scored from the longest suffix of its
context that is a state.

The root's chance of a word is its count less a discount; the discounts' sum goes to unseen words (as much as words seen once make up,
after Good and Turing) and evenly to the seen ones.

No tree is held whole anywhere. Texts are coded once, in blocks of about ``BLOCK_BYTES``; a block gets the numbers of its distinct words
(by falling count, so that they pack well) by a join. For each length of contexts, a block asks for the counts of its own contexts and next
symbols: what it asks is dealt by context into parts of about ``PART_TOKENS`` tokens, a part adds up the blocks' counts, tests its contexts
and answers each block. Contexts of ``HOT`` or more tokens are dealt by their next symbols too; their sums (at most one row for each ``HOT``
tokens of the corpus) are put together on the driver. From the answers a block grows the part of the tree that its texts visit.

Null, empty and blank texts consist of their end only. Rows without an id are training rows. Repeated rows are rows of their own. An
empty table gives an empty result; without training texts every token has chance 1 of being unseen. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.words import LOWER, find_words, hash_slices, mix, text_blocks
from ledgerloom.session import drop_table

DEPTH = 2
DEVIATIONS = 4.0
DISCOUNT = 0.75
BLOCK_BYTES = 8 << 20
PART_TOKENS = 1 << 20
HOT = 1 << 20
HELD_OUT, FOLDS = 2, 7
REST, END = 0, 1


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


@dataclass
class Root:
    """Chances without context: of a word by its count, and of an unseen word."""

    tokens: int
    kinds: int
    once: int
    twice: int

    def chance(self, counts: np.ndarray) -> np.ndarray:
        if not self.tokens:
            return np.ones(len(counts))
        discount = self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5
        spare = discount * self.kinds / self.tokens
        unseen = min(0.9 * spare, max(self.once, 1) / self.tokens)
        return np.where(counts > 0, np.maximum(counts - discount, 0) / self.tokens + (spare - unseen) / self.kinds, unseen)


@dataclass
class Tree:
    """A small tree held whole, the rule that blocks follow: own symbols (sorted; symbol k + 2 is the kth) and, by depth, states and their chances.

    ``states[d]``: sorted contexts of d + 1 symbols as numbers, and the weight of the suffix's distribution in each.
    ``chances[d]``: sorted numbers of context and next symbol, and the full chance.
    """

    symbols: np.ndarray
    root: np.ndarray
    states: list[tuple[np.ndarray, np.ndarray]]
    chances: list[tuple[np.ndarray, np.ndarray]]

    @property
    def base(self) -> int:
        return len(self.symbols) + 2

    def given(self, contexts: np.ndarray, symbols: np.ndarray, depth: int) -> np.ndarray:
        """Chance of symbols after contexts of ``depth`` symbols that may be no states: then after their suffixes."""
        if depth == 0:
            return self.root[symbols]
        out = self.given(contexts % self.base ** (depth - 1), symbols, depth - 1)
        if depth > len(self.states) or not len(self.states[depth - 1][0]):
            return out
        states, weights = self.states[depth - 1]
        at = np.minimum(np.searchsorted(states, contexts), len(states) - 1)
        hit = states[at] == contexts
        own, full = self.chances[depth - 1]
        key = contexts * self.base + symbols
        to = np.minimum(np.searchsorted(own, key), len(own) - 1)
        return np.where(hit, np.where(own[to] == key, full[to], weights[at] * out), out)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as bytes: those of equal weight side by side, and compressed."""
    out = []
    for array in arrays:
        if array.dtype.kind != "f":
            array = array.astype(np.uint64)
        width = (int(array.max(initial=0)).bit_length() + 7) // 8 if array.dtype.kind != "f" else 8
        planes = np.ascontiguousarray(np.ascontiguousarray(array).view(np.uint8).reshape(-1, 8)[:, :width].T)
        small = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if planes.size else b""
        out += [np.array([len(array), width, array.dtype.kind == "f", len(small)], np.int64).tobytes(), small]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, width, real, size = np.frombuffer(data, np.int64, 4, at)
        at += 32
        array = np.zeros((n, 8), np.uint8)
        if size:
            array[:, :width] = np.frombuffer(pa.decompress(data[at:at + size], int(n * width), codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
        out.append(array.reshape(-1).view(np.float64 if real else np.int64))
        at += int(size)
    return out


def _lists(flat: np.ndarray, kind) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, kind))


def _coded(batches):
    """A row for each block: its texts' ids and sizes, its distinct words and their counts in training, and the words of all places."""
    row = TaskContext.get().partitionId() << 32
    for batch in text_blocks(batches, limit=BLOCK_BYTES):
        data = LOWER[batch.data]
        words = find_words(data, batch.offsets)
        hashes, _, which = distinct(hash_slices(data, words.start, words.end))
        held = np.asarray(batch.column("held_out").cast(pa.int8())).astype(bool)
        n = np.bincount(which[~held[words.doc]], minlength=len(hashes))
        ids = batch.column("doc_id").cast(pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array([row], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([packed(held, np.diff(words.bounds))], pa.binary()),
            pa.array([packed(which)], pa.binary()), _lists(hashes.view(np.int64), pa.int64()), _lists(n, pa.int64()),
        ], ["block", "doc_id", "texts", "places", "hash", "n"])
        row += 1


def _numbered(blocks: pa.Table, words: pa.Table) -> pa.Table:
    """A block's words by number (ascending, from 0), and the symbols of all tokens."""
    held, sizes = unpacked(blocks.column("texts")[0].as_py())
    (which,) = unpacked(blocks.column("places")[0].as_py())
    at, ids = np.asarray(words.column("at")), np.asarray(words.column("id"))
    order = np.argsort(ids)
    symbol = np.zeros(len(blocks.column("hash")[0].values or ()), np.int64) + REST
    symbol[at[order]] = np.arange(len(at)) + 2
    tokens = np.full(len(which) + len(sizes), END, np.int64)
    tokens[np.arange(len(which)) + np.repeat(np.arange(len(sizes)), sizes)] = symbol[which]
    return pa.table({"block": blocks.column("block"), "doc_id": blocks.column("doc_id"), "code": pa.array([packed(held, sizes + 1, ids[order], tokens)], pa.binary())})


class Block:
    """A block's texts as symbols of its own words, and the chances of its tokens by the contexts known so far."""

    def __init__(self, code: bytes, model: Model):
        held, sizes, self.ids, self.tokens = unpacked(code)
        self.held, self.model, self.bounds = held > 0, model, np.concatenate([[0], np.cumsum(sizes)])
        self.base = len(self.ids) + 2
        self.counts = np.concatenate([[0, model.n_texts], model.count(self.ids)])
        self.train = np.repeat(~self.held, sizes)
        # contexts of the last length by number: their names in the corpus, their counts, and for each token its own (-1: none)
        names = np.concatenate([[0, 0], self.ids + 1]) << 32
        self.contexts = names, self.counts, np.where(self.tokens > END, self.tokens, -1)
        # chances of context and next symbol, and each token's row there
        self.chances, self.row = model.root.chance(self.counts), self.tokens

    def ask(self) -> Asked:
        """What is asked about the contexts that are one symbol longer."""
        names, totals, own = self.contexts
        which = np.concatenate([[-1], own[:-1]])[:len(own)]
        which[self.bounds[:-1]] = -1
        at = np.flatnonzero(which >= 0)
        keys, first, back = distinct(which[at] * self.base + self.tokens[at])
        n = np.bincount(back[self.train[at]], minlength=len(keys))
        return Asked(self, names, totals, keys // self.base, keys % self.base, n, self.chances[self.row[at[first]]], at, back)

    def grow(self, asked: Asked, answers: list[tuple[int, bytes]], hot: dict) -> None:
        """Adds the states among the contexts that are one symbol longer, and the chances after them."""
        count, kinds = asked.told(answers, hot)
        total = np.maximum(asked.totals, 1)
        weight = np.where(kinds > 0, DISCOUNT * kinds / total, 1.0)[asked.context]
        own = np.where(kinds[asked.context] > 0, np.maximum(count - DISCOUNT, 0) / total[asked.context], 0.0)
        after = np.full(len(self.tokens), -1)
        after[asked.at] = np.where(asked.following > END, np.arange(len(count)), -1)[asked.back]
        named = asked.names[asked.context] >> 32 | np.concatenate([[0, 0], self.ids + 1])[asked.following] << 32
        self.contexts = named, count, after
        start = len(self.chances)
        row = np.array(self.row)
        row[asked.at] = start + asked.back
        self.chances, self.row = np.concatenate([self.chances, own + weight * asked.lower]), row

    def scores(self) -> dict[str, np.ndarray]:
        root = self.model.root
        add = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[self.bounds])
        base = np.log10((self.counts + 1) / (root.tokens + root.kinds + 1))
        return {"n_tokens": np.diff(self.bounds), "n_known": add((self.counts > 0)[self.tokens]), "base_score": add(base[self.tokens]),
                "score": add(np.log10(self.chances)[self.row])}


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and each place's key."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ordered[new], order[new], back


@dataclass
class Model:
    """What every task knows: the root, and the counts of words by their numbers (``first[k]``: the first word of count ``values[k]``)."""

    root: Root
    n_texts: int
    first: np.ndarray
    values: np.ndarray
    parts: int
    hot: int

    def count(self, ids: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.first, ids, "right") - 1] if len(ids) else ids


class Asked:
    """The distinct contexts and next symbols of a block, in order, dealt into parts by context (if frequent, by next symbol too)."""

    def __init__(self, block: Block, names, totals, context, following, n, lower, at, back):
        self.model, self.names, self.totals = block.model, names, totals
        self.context, self.following, self.n, self.lower, self.at, self.back = context, following, n, lower, at, back
        self.symbol = np.concatenate([[REST, END], block.ids + 2])[following]
        parts, mixed = np.uint64(self.model.parts), mix(names.astype(np.uint64))
        part = (mixed % parts).astype(np.int32)[context]
        often = np.flatnonzero((totals > self.model.hot)[context])
        if len(often):
            salts = -(-totals[context[often]] // self.model.hot)
            salted = mixed[context[often]] + mix(self.symbol[often].astype(np.uint64)) % salts.astype(np.uint64)
            part[often] = mix(salted) % parts
        # what never occurs in training needs no answer
        asked = np.flatnonzero((totals > 0)[context] & (following != REST))
        part = part[asked] if self.model.parts >= 1 << 16 else part[asked].astype(np.uint16)
        order = np.argsort(part, kind="stable")
        self.order, self.part = asked[order], part[order]

    def _runs(self):
        """Parts, their bounds, and where a new context starts."""
        parts, start = np.unique(self.part, return_index=True)
        own = self.context[self.order]
        heads = np.concatenate([[True], (own[1:] != own[:-1]) | (self.part[1:] != self.part[:-1])]) if len(own) else np.zeros(0, bool)
        return parts, np.append(start, len(own)), own, heads

    def messages(self, depth: int):
        """For each part: contexts, their keys' number and summed logarithms of the lower chances, next symbols, counts."""
        parts, bounds, own, heads = self._runs()
        n, at = self.n[self.order], np.flatnonzero(heads)
        context, symbols = own[at], self.symbol[self.order]
        if depth == 1:  # a part works them out from the words' numbers
            sums = np.zeros(0)
        else:
            sums = np.add.reduceat(n * np.log(self.lower[self.order]), at) if len(at) else np.zeros(0)
            once = self.totals[context] == 1  # the verdict is all that a context seen once needs
            sums = np.where(once, np.where(diverges(-sums, np.ones(len(sums))), -1000.0, 0.0), sums)
        sizes = np.diff(np.append(at, len(own)))
        names, often = self.names[context], self.totals[context] > self.model.hot
        for part, low, high in zip(parts, bounds[:-1], bounds[1:], strict=True):
            a, b = np.searchsorted(at, (low, high))
            yield int(part), packed(names[a:b], often[a:b], sizes[a:b], sums[a:b], symbols[low:high], n[low:high])

    def told(self, answers: list[tuple[int, bytes]], hot: dict) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the keys, and for each context its number of different next symbols if it is a state, else 0."""
        *_, own, heads = self._runs()
        found = [unpacked(data) for _, data in sorted(answers)]
        count, kinds = np.zeros(len(self.context), np.int64), np.zeros(len(self.totals), np.int64)
        if found:
            count[self.order] = np.concatenate([f[0] for f in found])
            kinds[own[heads]] = np.concatenate([f[1] for f in found])
        for k in np.flatnonzero(self.totals > self.model.hot):
            kinds[k] = hot.get(int(self.names[k]), 0)
        return count, kinds


def diverges(gain: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    freedom = np.maximum(kinds - 1, 1)
    return 2 * gain > freedom + DEVIATIONS * np.sqrt(2 * freedom)


def _answers(model, depth: int):
    """Adds up what the blocks count of a part's contexts; answers each block, and gives the sums of the part's frequent contexts."""
    def run(table: pa.Table) -> pa.Table:
        told, part = model.value, table.column("part")[0].as_py()
        rows = [unpacked(r) for r in table.column("asked").to_pylist()]
        name, often, sizes, sums, symbols, n = (np.concatenate([r[k] for r in rows]) for k in range(6))
        names, which = np.unique(name, return_inverse=True)
        own = np.repeat(which, sizes)
        keys, _, back = distinct(own << 34 | symbols)
        count = np.bincount(back, weights=n, minlength=len(keys))
        of, seen = keys >> 34, count > 0
        per = lambda values: np.bincount(of, weights=values, minlength=len(names))
        total, kinds, logs = per(count), per(seen), per(count * np.log(np.maximum(count, 1)))
        if depth == 1:
            symbol = keys & ((1 << 34) - 1)
            c = np.where(symbol == END, told.n_texts, told.count(np.maximum(symbol - 2, 0)))
            lower = per(count * np.log(told.root.chance(c)))
        else:
            lower = np.bincount(which, weights=sums, minlength=len(names))
        split = np.zeros(len(names), bool)
        split[which] = often > 0
        gain = logs - total * np.log(np.maximum(total, 1)) - lower
        verdict = np.where(diverges(gain, kinds) & (total > 0) & ~split, kinds, 0).astype(np.int64)
        blocks, out, at, key = table.column("block").to_pylist(), [], 0, 0
        count = count.astype(np.int64)
        for row in rows:
            contexts, own = len(row[0]), len(row[4])
            out.append(packed(count[back[key:key + own]], verdict[which[at:at + contexts]]))
            at, key = at + contexts, key + own
        if split.any():
            blocks.append(-1)
            out.append(packed(names[split], total[split].astype(np.int64), kinds[split].astype(np.int64), logs[split], lower[split]))
        return pa.table({"part": pa.array([part] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(out, pa.binary())})
    return run


def _hot_states(answers: DataFrame) -> dict[int, int]:
    """Of the contexts that are dealt into several parts: the states, and their numbers of different next symbols."""
    rows = [unpacked(bytes(r.answer)) for r in answers.where("block = -1").select("answer").collect()]
    if not rows:
        return {}
    name, total, kinds, logs, lower = (np.concatenate([r[k] for r in rows]) for k in range(5))
    names, which = np.unique(name, return_inverse=True)
    total, kinds, logs, lower = (np.bincount(which, weights=v) for v in (total, kinds, logs, lower))
    kept = diverges(logs - total * np.log(np.maximum(total, 1)) - lower, kinds) & (total > 0)
    return dict(zip(names[kept].tolist(), kinds[kept].astype(int).tolist(), strict=True))


def _grown(blocks: pa.Table, answers: pa.Table | None, model: Model, hot: list[dict]) -> Block:
    block, told = Block(blocks.column("code")[0].as_py(), model), {}
    if answers is not None:
        for depth, part, answer in zip(*(answers.column(c).to_pylist() for c in ("depth", "part", "answer")), strict=True):
            told.setdefault(depth, []).append((part, answer))
    for depth, states in enumerate(hot, 1):
        block.grow(block.ask(), told.get(depth, []), states)
    return block


def _messages(table: pa.Table, block: Block, depth: int) -> pa.Table:
    found = list(block.ask().messages(depth))
    return pa.table({"part": pa.array([p for p, _ in found], pa.int64()), "block": pa.array([table.column("block")[0].as_py()] * len(found), pa.int64()),
                     "asked": pa.array([m for _, m in found], pa.binary())})


def _first_asked(model):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                table = pa.Table.from_batches([batch.slice(k, 1)])
                yield from _messages(table, _grown(table, None, model.value, []), 1).to_batches()
    return run


def _next_asked(model, hot: list[dict]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        return _messages(blocks, _grown(blocks, answers, model.value, hot), len(hot) + 1)
    return run


def _block_scores(model, hot: list[dict]):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = _grown(blocks, answers, model.value, hot)
        found, n = block.scores(), len(block.held)
        return pa.table({
            "doc_id": blocks.column("doc_id").combine_chunks().flatten(), "held_out": pa.array(block.held), "n_tokens": pa.array(found["n_tokens"], pa.int64()),
            "n_known": pa.array(found["n_known"], pa.int64()), "train_tokens": pa.array([model.value.root.tokens] * n, pa.int64()),
            "base_score": pa.array(found["base_score"], pa.float64()), "score": pa.array(found["score"], pa.float64())})
    return run


def numbered_words(words: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``hash, id``: words by falling count; and which counts occur, from the highest, with the first word of each."""
    ranked = stored(words.orderBy(F.desc("c"), "hash").withColumn("at", F.monotonically_increasing_id()), "vocabulary")
    task = F.shiftright("at", 33)
    sizes = {r.task: r.n for r in ranked.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}
    start, starts = 0, {}
    for k in sorted(sizes):
        starts[k], start = start, start + sizes[k]
    steps = sorted(((r.c, r.n) for r in ranked.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    values, n = np.array([c for c, _ in steps], np.int64), np.array([n for _, n in steps], np.int64)
    begin = F.create_map(*[F.lit(x).cast("long") for pair in (starts or {0: 0}).items() for x in pair])
    numbered = ranked.select("hash", (begin[task] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("id"))
    return numbered, np.cumsum(n) - n, values


def suffix_tree_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row."""
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out(F.col("doc_id")))
    coded = stored(docs.mapInArrow(_coded, "block long, doc_id array<long>, texts binary, places binary, hash array<long>, n array<long>"), "coded")
    words = coded.select(F.explode(F.arrays_zip("hash", "n")).alias("w")).groupBy("w.hash").agg(F.sum("w.n").alias("c")).where("c > 0")
    vocabulary, first, values = numbered_words(words)
    n_texts, n_rows = docs.agg(F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0)), F.count("*")).first()
    blocks_of, n_words = coded.agg(F.count("*"), F.coalesce(F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)")), F.lit(0))).first()
    kinds = vocabulary.count()
    of = lambda k: int((np.append(first, kinds)[1:] - first)[values == k].sum()) if len(first) else 0
    root = Root(n_words + n_texts, kinds + int(n_texts > 0), of(1) + int(n_texts == 1), of(2) + int(n_texts == 2))
    model = spark.sparkContext.broadcast(Model(root, n_texts, first, values, -(-(n_words + n_rows) // PART_TOKENS) or 1, HOT))

    spread = max(blocks_of, 1)
    asked = coded.select(F.col("block").alias("asker"), F.posexplode("hash").alias("at", "hash")).join(vocabulary, "hash").select("asker", "at", "id")
    by_block = lambda rows, key="block": rows.repartition(spread, key).groupBy(key)
    blocks = stored(by_block(coded.select("block", "doc_id", "texts", "places", "hash")).cogroup(by_block(asked, "asker")).applyInArrow(
        _numbered, "block long, doc_id array<long>, code binary"), "blocks")
    drop_table(coded)

    hot, answers = [], None
    for depth in range(1, DEPTH + 1):
        form = "part long, block long, asked binary"
        asked = blocks.mapInArrow(_first_asked(model), form) if answers is None else by_block(blocks).cogroup(by_block(answers)).applyInArrow(_next_asked(model, hot), form)
        told = stored(asked.repartition(model.value.parts, "part").groupBy("part").applyInArrow(_answers(model, depth), "part long, block long, answer binary"), "answers")
        hot = [*hot, _hot_states(told)]
        told = told.where("block >= 0").withColumn("depth", F.lit(depth))
        answers = told if answers is None else answers.unionByName(told)
    return by_block(blocks).cogroup(by_block(answers)).applyInArrow(
        _block_scores(model, hot),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
