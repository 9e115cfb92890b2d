"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Words are runs of letters and digits, lower-cased; in scripts without spaces every letter is a word. A seed is a window of ``SPAN`` words of which a fixed mask ignores some, so that a
substituted word spoils only the masks that look at it. Seeds of all documents are joined with those of the benchmark by hash; a document's
words stay one array while its windows are hashed, and only hits leave the join. Documents with hits are read again: around each hit,
document and item are laid side by side and equal words are counted from ``REACH`` words before the window to ``REACH`` after it; a hit
is verified if ``MIN_EQUAL`` words are equal, or ``SHORT_SHARE`` of an item that is shorter than ``SHORT_WORDS``.

Items of ``SPAN`` words have one window only, so they get masks of their own, of which one at least is spared by any two substitutions
(all that ``SHORT_SHARE`` allows). An item of fewer words is one seed of its own length, and a document must hold it word for word. Documents
get the seeds of these kinds and lengths only if the benchmark has such items.

The benchmark's seeds, its items and the ids of documents with hits are sent to every task up to ``SENT_SEEDS``, ``SENT_SEEDS`` and
``SENT_IDS`` of them; more are joined by a shuffle, with the same result.

Null and empty texts and items have no seeds and match nothing. Repeated rows of an id count together. Rows without an id are documents
of their own, one for each different text, and come back without an id. Empty tables give no matches. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import stored

#: Positions that count, of windows of 11 words.
MASKS = ((0, 1, 3, 4, 6, 9, 10), (0, 2, 3, 5, 7, 8, 10), (0, 1, 2, 5, 6, 8, 10))
SPAN, REACH = 11, 8
#: The same for items that are one window; every two positions are ignored together by one of them.
WHOLE_MASKS = ((0, 1, 3, 4, 9), (0, 5, 7, 9, 10), (1, 3, 4, 7, 10), (2, 4, 5, 6, 10), (2, 5, 6, 7, 8), (2, 6, 8, 9, 10))
MIN_EQUAL = 13
SHORT_WORDS, SHORT_SHARE = 16, 0.8
SENT_SEEDS, SENT_IDS = 500_000, 2_000_000


#: Letters of scripts that put no spaces between words.
SPACELESS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    spaced = F.when(text.rlike(SPACELESS), F.regexp_replace(text, f"({SPACELESS})", " $1 ")).otherwise(text)
    words = F.split(F.trim(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, words: str, whole: list[int], *keep: str) -> DataFrame:
    """``seed`` and ``at`` (0-based) for every window and mask of an array of word hashes, and for the windows of the lengths ``whole``."""
    # a filter on the size would be pushed below the words and have them hashed twice
    least = min([SPAN, *whole])
    windows = F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least))
    starts = rows.withColumn("at", F.explode(windows))
    masks = [*enumerate(MASKS), *((len(MASKS) + m, mask) for m, mask in enumerate(WHOLE_MASKS) if SPAN in whole)]
    seeds = [_seed(words, m, mask) for m, mask in masks]
    seeds = [F.when(F.col("at") <= F.size(words) - SPAN, seed) for seed in seeds] if least < SPAN else seeds
    seeds += [F.when(F.col("at") <= F.size(words) - n, _seed(words, -n, range(n))) for n in whole if n < SPAN]
    return starts.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))


def _seed(words: str, mask_no: int, mask) -> Column:
    return F.xxhash64(F.lit(mask_no), *[F.get(words, F.col("at") + k) for k in mask])


def _item_seeds(items: DataFrame, whole: list[int]) -> DataFrame:
    """``seed, item_id, item_at``: windows of long items; of an item of at most ``SPAN`` words, only those of its own length."""
    out = _seeds(items.where(F.size("item") > SPAN), "item", [], "item_id")
    for n in whole:
        out = out.unionByName(_seeds(items.where(F.size("item") == n), "item", [n], "item_id"))
    return out.where("seed is not null").select("seed", "item_id", F.col("at").alias("item_at")).distinct()


def _sent(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= most else rows


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _name() -> Column:
    """What hits are gathered by: the id, or a hash of the text of a row without one."""
    return F.coalesce("doc_id", F.xxhash64("text"))


def seed_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, equal``: verified overlaps, ``equal`` the most equal words around a hit. Rows without an id have a hash as theirs."""
    items = benchmark.select("item_id", word_hashes(F.col("text").cast("string")).alias("item")).where(F.size("item") > 0)
    whole = sorted(r[0] for r in items.select(F.size("item")).where(F.size("item") <= SPAN).distinct().collect())
    seeds = _item_seeds(items, whole)
    docs = _documents(docs).select(_name().alias("doc_id"), "text")
    texts = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    hits = _seeds(texts, "words", whole, "doc_id").join(_sent(seeds, SENT_SEEDS), "seed").select("doc_id", "item_id", "at", "item_at")
    # one row for each way an item lies in a document; it has at most as many hits as the item has words
    lying = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.collect_set("at").alias("ats"))
    lying = stored(lying, "seed-hits")

    ids = _sent(lying.select("doc_id").distinct(), SENT_IDS)
    found = docs.join(ids, "doc_id", "left_semi").select("doc_id", word_hashes(F.col("text")).alias("words"))
    both = lying.join(found, "doc_id").join(_sent(items, SENT_SEEDS), "item_id")
    words, item, shift = F.col("words"), F.col("item"), F.col("shift")

    def equal(at: Column) -> Column:
        before = F.least(at, at - shift, F.lit(REACH))
        after = F.least(F.size(words) - at, F.size(item) - at + shift, F.lit(SPAN + REACH))
        sides = [F.slice(array, start - before + 1, F.greatest(before + after, F.lit(0))) for array, start in ((words, at), (item, at - shift))]
        return F.size(F.filter(F.zip_with(*sides, lambda a, b: a == b), lambda same: same))

    enough = F.when(F.size("item") < SPAN, F.size("item")).when(F.size("item") < SHORT_WORDS, F.ceil(F.size("item") * SHORT_SHARE)).otherwise(MIN_EQUAL)
    inside = F.filter("ats", lambda at: (at < F.size(words)) & (at >= shift))
    rated = both.select("doc_id", "item_id", F.array_max(F.transform(inside, equal)).cast("long").alias("equal"), enough.alias("enough"))
    return rated.where("equal >= enough").groupBy("doc_id", "item_id").agg(F.max("equal").alias("equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_items, most_equal, contaminated`` for every document."""
    hit = seed_matches(docs, benchmark).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("equal").alias("most_equal"))
    docs = _documents(docs)
    # two scans: that of the ids needs no texts
    every = docs.where("doc_id is not null").select("doc_id", F.col("doc_id").alias("name")).distinct().unionByName(
        docs.where("doc_id is null").select("doc_id", _name().alias("name")).distinct())
    return every.join(hit.withColumnRenamed("doc_id", "name"), "name", "left").select(
        "doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("most_equal", F.lit(0)).alias("most_equal"),
        F.col("n_items").isNotNull().alias("contaminated"))
