"""Quality rules: simple counts, and bands of perplexity under a Kneser-Ney model of each language.

The model is an interpolated modified Kneser-Ney model over the characters of words (order 4: three characters of context, spaces
before and after a word). It learns from every running text: documents of which at most ``MAX_SYMBOL_SHARE`` are the symbols below
and at most ``MAX_CAPITAL_SHARE`` capitals A-Z. Spark counts words by language, then n-grams, continuation counts, counts of counts, discounts and back-off
weights. What is sent to every task are sorted arrays of n-gram hashes with two weights each: the n-grams of an order that make up at
least ``LEAST_SHARE`` of a language's counts, so at most 1 / ``LEAST_SHARE`` n-grams an order, whatever the corpus holds. The rest is
looked up: words with an n-gram that is not among those sent are open. Open words are dealt into buckets of about ``BUCKET_BYTES``, a
bucket gets the rest's rows of the n-grams it misses by a join, and the words' scores go back to their texts. So every n-gram counts,
and no score depends on ``LEAST_SHARE``.

A document is rejected if a base rule fails, or if the logarithm of its perplexity lies outside its language's band: from
``LOWER_WIDTH`` robust standard deviations below the median to ``UPPER_WIDTH`` above it (1.4826 times the median absolute deviation,
``LEAST_DEVIATION`` at least), taken over all documents of the language that pass the base rules. The upper side is wide since a clean
text with a quoted passage in another language reaches that far.

Null and empty texts have zero counts and fail the base rules; their perplexity is null. A null language counts as the empty one.
Repeated rows are rows of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.word_counts import counted_words, key_codes
from ledgerloom.llm.words import SPACE, Texts, combine, find_words, hash_slices, mix, strings, take_slices, text_blocks

ORDER = 4
LEAST_SHARE = 1e-6
BUCKET_BYTES = 2 << 20
LOWER_WIDTH, UPPER_WIDTH = 8.0, 24.0
LEAST_DEVIATION = 0.01
MAX_SYMBOL_SHARE, MAX_CAPITAL_SHARE = 0.01, 0.3
MIN_WORDS = 50
MAX_REPEAT_PER_CENT = 50
SYMBOLS = "#*$%&|<>"
CODE_POINTS = 0x110000

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _grams(words: DataFrame) -> DataFrame:
    """``key, gram, n``: n-grams of full order, their last character the one that is predicted."""
    padded = F.concat(F.lit(" " * (ORDER - 1)), F.col("word"), F.lit(" "))
    grams = words.select("key", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))
    return grams.groupBy("key", "gram").agg(F.sum("n").alias("n"))


def model_rows(words: DataFrame) -> DataFrame:
    """``key, size, gram, share, frequent, weight``: the direct share of an n-gram and the weight of the next lower order after it.

    ``share`` is (count - discount) / context's count, ``weight`` what the discounts of all n-grams with this context add up to.
    ``frequent`` n-grams make up at least ``LEAST_SHARE`` of their order's counts.
    """
    counts, levels = stored(_grams(words.withColumn("key", F.coalesce("key", F.lit("")))), "grams"), []
    for size in range(ORDER, 0, -1):
        levels.append(counts.withColumn("size", F.lit(size)))
        counts = counts.select("key", F.substring("gram", 2, size - 1).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("n"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    counts = stored(counts, "levels")

    of = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int):
        plain = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{k}") > 0), F.greatest(F.lit(0.1), F.least(plain, F.lit(k - 0.1)))).otherwise(0.5)

    cuts = counts.groupBy("key", "size").agg(F.sum("n").alias("all"), *of).select("key", "size", "all", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = counts.join(cuts, ["key", "size"]).withColumn("context", F.expr("substring(gram, 1, size - 1)")).withColumn("taken", taken)
    contexts = cut.groupBy("key", "size", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("spare"))
    shares = cut.join(contexts, ["key", "size", "context"]).select(
        "key", "size", "gram", ((F.col("n") - F.col("taken")) / F.col("total")).alias("share"), (F.col("n") >= LEAST_SHARE * F.col("all")).alias("frequent"))
    weights = contexts.select("key", (F.col("size") - 1).alias("size"), F.col("context").alias("gram"), (F.col("spare") / F.col("total")).alias("weight"))
    base = weights.where("size = 0").withColumns({"share": F.lit(1.0 / CODE_POINTS), "frequent": F.lit(True)})
    return shares.join(weights, ["key", "size", "gram"], "left").unionByName(base.select("key", "size", "gram", "share", "frequent", "weight"))


def sorted_arrays(rows) -> dict:
    """Per language and order: sorted hashes, shares, weights (1 where an n-gram is no context)."""
    out = {}
    for (key, size), own in rows.groupby(["key", "size"], sort=True):
        points = np.frombuffer("".join(own.gram).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(len(own), size)
        hashes = combine([points[:, k] for k in range(size)]) if size else np.zeros(len(own), np.uint64)
        order = np.argsort(hashes)
        out.setdefault(key, {})[size] = (hashes[order], own.share.to_numpy()[order], own.weight.fillna(1.0).to_numpy()[order])
    return out


NOTHING = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


def joined_arrays(model: dict, more: dict) -> dict:
    """One language's arrays, those of ``more`` added."""
    out = dict(model)
    for size, own in more.items():
        both = [np.concatenate(parts) for parts in zip(model.get(size, NOTHING), own, strict=True)]
        order = np.argsort(both[0])
        out[size] = tuple(part[order] for part in both)
    return out


def score_words(model: dict | None, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the log10 probability and the number of characters predicted, the space after it included."""
    return walk_words(model, data, start, end)[:2]


def walk_words(model: dict | None, data: np.ndarray, start: np.ndarray, end: np.ndarray, pruned=()):
    """As ``score_words``, and for the orders ``pruned`` what the model misses: (order, first place in the stream, word), and the stream."""
    flat, offsets = take_slices(data, start, end)
    lead = np.concatenate([[0], np.cumsum(_LEAD[flat])])[offsets]
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    size = np.diff(lead)
    pad = ORDER - 1
    at = lead[:-1] + np.arange(len(size)) * (pad + 1)
    stream = np.full(len(points) + len(size) * (pad + 1) + 1, 32, np.uint64)
    stream[np.repeat(at + pad - lead[:-1], size) + np.arange(len(points))] = points
    told = np.ones(len(stream), bool)
    for k in range(pad):
        told[at + k] = False
    told[-1] = False
    places = np.flatnonzero(told)
    chance = np.full(len(places), 1.0 / CODE_POINTS)
    missed = []
    if model:
        chance *= model[0][2][0]
        n = len(stream)
        before = None
        for order in range(1, ORDER + 1):
            hashes, shares, weights = model.get(order, NOTHING)
            if not len(hashes):
                hashes, shares, weights = np.zeros(1, np.uint64), np.zeros(1), np.ones(1)
            own = combine([stream[k:n - order + 1 + k] for k in range(order)])
            found = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            hit = hashes[found] == own
            if before is not None:
                chance *= before[places - 1 - (order - 2)]
            chance += np.where(hit, shares[found], 0.0)[places - (order - 1)]
            before = np.where(hit, weights[found], 1.0)
            if order in pruned:  # an n-gram is asked for its share where it ends at a predicted place, else for its weight
                asked = np.zeros(len(own), bool)
                asked[places - (order - 1)] = True
                if order < ORDER:
                    asked[places - order] = True
                lost = np.flatnonzero(asked & ~hit)
                missed.append((order, lost, np.searchsorted(at, lost, "right") - 1))
    logs = np.log10(chance)
    sums = np.add.reduceat(logs, np.searchsorted(places, at)) if len(size) else np.zeros(0)
    return sums, size + 1, missed, stream


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def text_counts(block: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text, and its words and their hashes."""
    data, offsets, n = block.data, block.offsets, len(block)
    words = find_words(data, offsets)
    hashes = hash_slices(data, words.start, words.end)
    # lines: at each text's start, and after each newline (a text's last line may be empty and start where the next text does)
    breaks = np.flatnonzero(data == 10)
    line = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((line, owner))
    line, owner = line[order], owner[order]
    stop = np.minimum(np.concatenate([line[1:] - 1, [len(data)]]), offsets[1:][owner])
    stop = np.where(np.concatenate([owner[1:] != owner[:-1], [True]]), offsets[1:][owner], stop) if n else stop
    filled = np.searchsorted(words.start, stop) > np.searchsorted(words.start, line)
    line, stop, owner = line[filled], stop[filled], owner[filled]
    _, first = np.unique(hash_slices(data, line, stop) ^ mix(owner.astype(np.uint64)), return_index=True)
    again = np.bincount(owner, minlength=n) - np.bincount(owner[first], minlength=n)
    # three-word windows
    doc = words.doc
    inside = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = doc[2:] == doc[:-2]
        keys = combine([hashes[:-2], hashes[1:-1], hashes[2:], doc[2:].astype(np.uint64)])[whole]
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(whole)[times[which] > 1]
        for k in range(3):
            inside[twice + k] = True
    return {
        "words": words, "hashes": hashes, "n_words": np.diff(words.bounds), "word_chars": _per_text(_LEAD[data] & ~SPACE[data], offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets), "n_dup_lines": again,
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(inside)])[words.bounds]),
    }


def _features(model, pruned):
    def run(batches):
        arrays, lacking = model.value, pruned.value
        row = TaskContext.get().partitionId() << 40
        for block in text_blocks(batches):
            counts = text_counts(block)
            words, hashes = counts.pop("words"), counts.pop("hashes")
            codes, values = key_codes(block.column("lang"))
            own = codes[words.doc]
            logs, told = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
            _, first, which = np.unique(combine([hashes, own.astype(np.uint64)]), return_index=True, return_inverse=True)
            opened = np.zeros(len(first), bool)
            for code, value in enumerate(values):
                part = np.flatnonzero(own[first] == code)
                score, size = np.zeros(len(first)), np.zeros(len(first), np.int64)
                score[part], size[part], missed, _ = walk_words(
                    arrays.get(value or ""), block.data, words.start[first[part]], words.end[first[part]], lacking.get(value or "", ()))
                for _, _, word in missed:
                    opened[part[word]] = True
                score[opened] = 0.0
                logs += score[which]
                told += size[which]
            total = np.concatenate([[0.0], np.cumsum(logs)])[words.bounds]
            symbols = np.concatenate([[0], np.cumsum(told)])[words.bounds]
            # each text's open words
            at = np.flatnonzero(opened[which])
            pairs, times = np.unique(words.doc[at] * max(len(first), 1) + which[at], return_counts=True)
            word, bounds = first[pairs % max(len(first), 1)], np.searchsorted(pairs // max(len(first), 1), np.arange(len(block) + 1))
            open_words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([
                pa.array(hashes[word].view(np.int64)), strings(block.data, words.start[word], words.end[word]).cast(pa.string()), pa.array(times, pa.int64())],
                ["hash", "word", "n"]))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(len(block)), pa.int64()), block.column("doc_id"), block.column("lang"), *[pa.array(v, pa.int64()) for v in counts.values()],
                pa.array(np.diff(total)), pa.array(np.diff(symbols), pa.int64()), open_words],
                ["row", "doc_id", "lang", *counts, "log", "told", "open"])
            row += len(block)
    return run


def _by_key(table: pa.Table):
    """The words of a table by their key: key, bytes, starts, ends, and the words' rows."""
    for block in text_blocks(table.to_batches(), "word"):
        codes, values = key_codes(block.column("key"))
        for code, value in enumerate(values):
            part = np.flatnonzero(codes == code)
            yield value, block, block.offsets[:-1][part], block.offsets[1:][part], part


def _asked(model, pruned):
    """The different n-grams that a bucket's words miss."""
    def run(table: pa.Table) -> pa.Table:
        found = set()
        for key, block, start, end, _ in _by_key(table):
            *_, missed, stream = walk_words(model.value.get(key), block.data, start, end, pruned.value.get(key, ()))
            for size, lost, _ in missed:
                grams = np.unique(stream[lost[:, None] + np.arange(size)[None, :]].astype("<u4"), axis=0).tobytes().decode("utf-32-le")
                found.update((key, size, grams[k:k + size]) for k in range(0, len(grams), size))
        rows = sorted(found)
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int64()), "key": pa.array([r[0] for r in rows], pa.string()),
                         "size": pa.array([r[1] for r in rows], pa.int32()), "gram": pa.array([r[2] for r in rows], pa.string())})
    return run


def _exact(model):
    """Scores of a bucket's words by the arrays sent and the rows looked up."""
    def run(words: pa.Table, rest: pa.Table) -> pa.Table:
        more, known, out = sorted_arrays(rest.to_pandas()), {}, []
        for key, block, start, end, part in _by_key(words):
            if key not in known:
                known[key] = joined_arrays(model.value.get(key, {}), more.get(key, {}))
            sums, _ = score_words(known[key], block.data, start, end)
            out.append(pa.table({"key": block.column("key").take(pa.array(part)), "hash": block.column("hash").take(pa.array(part)), "log": pa.array(sums)}))
        return pa.concat_tables(out)
    return run


def open_scores(seen: DataFrame, rest: DataFrame, model, pruned) -> DataFrame:
    """``row, more``: what the open words of a text add to its logarithm, by the whole model."""
    opened = seen.select("row", F.coalesce("lang", F.lit("")).alias("key"), F.inline("open"))
    words = stored(opened.select("key", "hash", "word").distinct(), "open-words")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()[0]
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("key", "hash"), F.lit(size // BUCKET_BYTES + 1)))
    asked = dealt.groupBy("bucket").applyInArrow(_asked(model, pruned), "bucket long, key string, size int, gram string")
    told = asked.join(rest, ["key", "size", "gram"]).select("bucket", "key", "size", "gram", "share", "weight")
    scores = dealt.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_exact(model), "key string, hash long, log double")
    return opened.join(scores, ["key", "hash"]).groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more"))


def _running_text():
    size, capitals = F.length("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    others = lambda letters: F.length(F.translate("text", letters, ""))
    return (size - others(SYMBOLS) <= MAX_SYMBOL_SHARE * size) & (size - others(capitals) <= MAX_CAPITAL_SHARE * size)


def quality_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lang, log_perplexity, low, high, kept``."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = stored(counted_words(docs.where(_running_text()), F.col("lang"), lower=False), "words")
    rows, send = stored(model_rows(words), "model"), docs.sparkSession.sparkContext.broadcast
    rest, model, lacking = rows.where("not frequent"), send(sorted_arrays(rows.where("frequent").toPandas())), {}
    for key, size in rest.select("key", "size").distinct().collect():
        lacking.setdefault(key, []).append(size)
    pruned = send(lacking)
    fields = ["doc_id long", "lang string", "n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long"]
    seen = stored(docs.mapInArrow(_features(model, pruned), f"row long, {', '.join(fields)}, log double, told long, open array<struct<hash long, word string, n long>>"), "seen")
    log = F.col("log")
    if lacking:
        seen, log = seen.join(open_scores(seen, rest, model, pruned), "row", "left"), log + F.coalesce("more", F.lit(0.0))
    seen = seen.select(*[f.split()[0] for f in fields], F.when(F.col("n_words") > 0, -log / F.greatest("told", F.lit(1))).alias("log_perplexity")).withColumn(
        "base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PER_CENT} * n_words"))
    seen = (stored(seen, "quality") if lacking else seen).withColumn("language", F.coalesce("lang", F.lit("")))
    fair = seen.where(~F.col("base_failed"))
    middle = fair.groupBy("language").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("middle"))
    spread = fair.join(F.broadcast(middle), "language").groupBy("language", "middle").agg(
        (1.4826 * F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10_000)).alias("spread"))
    unit = F.greatest(F.col("spread"), F.lit(LEAST_DEVIATION))
    bands = stored(spread.select("language", (F.col("middle") - LOWER_WIDTH * unit).alias("low"),
                                 (F.col("middle") + UPPER_WIDTH * unit).alias("high")), "bands")
    out = seen.join(bands, "language", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumn("kept", kept).drop("language")
