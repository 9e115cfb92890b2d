"""Language-model scores, quality rules and language identification."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, ascii_words, frame, made_docs

from ledgerloom.llm import kneser_ney as K
from ledgerloom.llm import language_backoff as L
from ledgerloom.llm import suffix_tree as T
from ledgerloom.llm.words import text_blocks


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_base_scores_equal_plain_counting(spark):
    rows = made_docs(80) + ODD
    got = T.suffix_tree_scores(frame(spark, rows, clash=True)).collect()
    count = Counter()
    for doc_id, text, *_ in rows:
        if fold(doc_id, 7) != 2:
            count.update([*ascii_words(text), "\n"])
    n, v = sum(count.values()), len(count)
    want = sorted((doc_id, fold(doc_id, 7) == 2, len(ascii_words(text)) + 1, sum(count[w] > 0 for w in [*ascii_words(text), "\n"]), n,
                   round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*ascii_words(text), "\n"]), 6)) for doc_id, text, *_ in rows)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_scores_beat_the_base_on_held_out_texts(spark):
    # every word is followed by its successor most of the time, so contexts carry weight
    import random
    draw = random.Random(4)
    names = [f"w{k}" for k in range(30)]
    rows = []
    for k in range(400):
        at, text = draw.randrange(30), []
        for _ in range(60):
            at = (at + 1) % 30 if draw.random() < 0.8 else draw.randrange(30)
            text.append(names[at])
        rows.append((k, " ".join(text), "en", "s", None))
    got = [r for r in T.suffix_tree_scores(frame(spark, rows)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def whole_tree_scores(rows):
    """Scores by a tree of all contexts of the training texts, held in dictionaries."""
    texts = [(doc_id, [*ascii_words(text), "\n"]) for doc_id, text, *_ in rows]
    count, after = Counter(), {}
    for doc_id, words in texts:
        if fold(doc_id, 7) != 2:
            count.update(words)
            for size in range(1, T.DEPTH + 1):
                for k in range(size, len(words)):
                    after.setdefault(tuple(words[k - size:k]), Counter())[words[k]] += 1
    root = T.Root(sum(count.values()), len(count), sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values()))
    states = {}

    def chance(context, word):
        if not context:
            return float(root.chance(np.array([count[word]]))[0])
        lower = chance(context[1:], word)
        if context not in states:
            return lower
        own, total = after[context], sum(after[context].values())
        return max(own[word] - T.DISCOUNT, 0) / total + T.DISCOUNT * len(own) / total * lower

    for size in range(1, T.DEPTH + 1):
        for context, own in after.items():
            if len(context) == size:
                total, free = sum(own.values()), max(len(own) - 1, 1)
                if 2 * sum(n * math.log(n / total / chance(context[1:], w)) for w, n in own.items()) > free + T.DEVIATIONS * math.sqrt(2 * free):
                    states[context] = True
    return sorted((doc_id, round(sum(math.log10(chance(next((tuple(words[max(0, k - size):k]) for size in range(min(k, T.DEPTH), 0, -1)), ()), w))
                                     for k, w in enumerate(words)), 4)) for doc_id, words in texts)


def rare_rows():
    """12,000 common tokens, and texts of words that occur once or twice."""
    rows = made_docs(150, seed=5) + ODD
    rare = [(5000 + k, " ".join(f"q{k // 2}x{j}" for j in range(30)), "en", "s", None) for k in range(20)]
    return rows + [(2000 + k, "the river walks over the stone and " * 6, "en", "s", None) for k in range(60)] + rare


def test_scores_know_every_context_however_rare(spark):
    rows = rare_rows()
    got = sorted((r.doc_id, round(r.score, 4)) for r in T.suffix_tree_scores(frame(spark, rows, clash=True)).collect())
    want = whole_tree_scores(rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=2e-4)


def test_contexts_dealt_into_many_parts_give_the_same_scores(spark, monkeypatch):
    rows = rare_rows()
    monkeypatch.setattr(T, "HOT", 20)
    monkeypatch.setattr(T, "PART_TOKENS", 500)
    monkeypatch.setattr(T, "BLOCK_BYTES", 4000)
    got = sorted((r.doc_id, round(r.score, 4)) for r in T.suffix_tree_scores(frame(spark, rows).repartition(3)).collect())
    assert np.allclose([g[1] for g in got], [w[1] for w in whole_tree_scores(rows)], atol=2e-4)


def test_empty_table_and_no_training_text(spark):
    assert T.suffix_tree_scores(frame(spark, [])).collect() == []
    only = next(k for k in range(100) if fold(k, 7) == 2)
    (row,) = T.suffix_tree_scores(frame(spark, [(only, "a b", "en", "s", None)])).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_chances_after_a_state_sum_to_one(spark):
    rows = [(k, "a b a b a b c a b", "en", "s", None) for k in range(50)]
    symbols = np.sort(np.array([11, 22, 33], np.uint64))
    tree = T.Tree(symbols, np.array([0.1, 0.2, 0.3, 0.2, 0.2]), [(np.array([2, 3]), np.array([0.25, 0.5]))],
                  [(np.array([2 * 5 + 3, 3 * 5 + 2]), np.array([0.75 + 0.25 * 0.2, 0.5 + 0.5 * 0.3]))])
    for state in (2, 3, 4):
        got = tree.given(np.full(5, state), np.arange(5), 1)
        assert abs(got.sum() - 1) < 1e-9
    assert rows


def test_root_chances_sum_to_one():
    root = T.Root(tokens=100, kinds=20, once=8, twice=4)
    counts = np.array([1] * 8 + [2] * 4 + [10] * 7 + [14])
    assert counts.sum() == 100
    assert abs(root.chance(counts).sum() + root.chance(np.array([0]))[0] - 1) < 1e-9


def plain_counts(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    lines, seen, again = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def test_quality_counts_equal_plain_counting(spark):
    rows = made_docs(60) + ODD + [(3000, "a b c a b c x\n\nq\nq\n q\n# $ <>\r\nq", "en", "s", None), (3001, "x\r\nx\r\nx", None, "s", None)]
    got = K.quality_rules(frame(spark, rows, clash=True)).collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == \
        sorted((r[0], *plain_counts(r[1])) for r in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert K.quality_rules(frame(spark, [])).collect() == []


def test_perplexity_bands_part_junk_from_prose(spark):
    import random
    draw = random.Random(3)
    syllables = ["the", "on", "er", "ing", "sta", "ble", "ou", "re"]
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(1, 4)))
    rows = [(k, " ".join(word() for _ in range(120)), "en", "s", None) for k in range(120)]
    rows += [(500 + k, " ".join(word() + draw.choice(["%%%", "###", "$$$"]) for _ in range(120)), "en", "s", None) for k in range(15)]
    rows += [(600 + k, " | ".join(word() for _ in range(120)), "en", "s", None) for k in range(15)]
    kept = {r.doc_id for r in K.quality_rules(frame(spark, rows)).collect() if r.kept}
    assert kept == set(range(120))


def test_rare_n_grams_count_too(spark, monkeypatch):
    rows = made_docs(60) + ODD + [(2000 + k, " ".join(f"z{k}{j}qü" for j in range(60)), None if k == 1 else "de", "s", None) for k in range(3)]
    told = []
    for share in (0.0, 1e-3, 0.2):  # all are sent; few are; hardly any
        monkeypatch.setattr(K, "LEAST_SHARE", share)
        monkeypatch.setattr(K, "BUCKET_BYTES", 500)
        told.append(sorted((r.doc_id, r.n_words, -1.0 if r.log_perplexity is None else round(r.log_perplexity, 9), r.kept) for r in K.quality_rules(frame(spark, rows)).collect()))
    assert len(told[0]) == len(rows) and told[0] == told[1] == told[2]


def test_model_of_characters_equals_the_formula(spark):
    words = spark.createDataFrame([("en", 1, "ab", 3), ("en", 2, "abc", 2), ("en", 3, "b", 1)], "key string, hash long, word string, n long")
    model = K.sorted_arrays(K.model_rows(words).toPandas())["en"]
    data = np.frombuffer("ab xyz".encode(), np.uint8)
    sums, told = K.score_words({**model}, data, np.array([0, 3]), np.array([2, 6]))
    assert list(told) == [3, 4] and sums[0] > sums[1]
    # order 1: the three characters and the space, by how many different characters precede them
    size, gram_rows = 1, K.model_rows(words).where("size = 1").toPandas()
    assert set(gram_rows.gram) == {"a", "b", "c", " "} and size == 1
    for last in ("a", "zz", "ab"):  # the chances of all characters after a context sum to one; unseen ones have equal chances
        flat = np.frombuffer(last.encode(), np.uint8)
        ends = 10 ** K.score_words(model, flat, np.array([0]), np.array([len(flat)]))[0][0]
        goes = sum(10 ** prefix(model, last + c) for c in "abc") + (K.CODE_POINTS - 4) * 10 ** prefix(model, last + "q")
        assert abs((ends + goes) / 10 ** prefix(model, last) - 1) < 1e-6


def prefix(model, text):
    """log10 chance of the word's characters without the space after it."""
    return K.score_words(model, np.frombuffer(text.encode(), np.uint8), np.array([0]), np.array([len(text)]))[0][0] - after(model, text)


def after(model, text):
    """log10 chance of the space after a word, by a plain walk through the orders."""
    chance, padded = model[0][2][0] / K.CODE_POINTS, " " * (K.ORDER - 1) + text
    for order in range(1, K.ORDER + 1):
        context = padded[len(padded) - order + 1:]
        hashes, shares, weights = model[order]
        if order > 1:
            below = model[order - 1]
            spot = np.flatnonzero(below[0] == gram_hash(context))
            chance *= below[2][spot[0]] if len(spot) else 1.0
        spot = np.flatnonzero(hashes == gram_hash(context + " "))
        chance += shares[spot[0]] if len(spot) else 0.0
    return math.log10(chance)


def gram_hash(gram):
    from ledgerloom.llm.words import combine
    points = np.array([ord(c) for c in gram], np.uint64)
    return combine([points[k:k + 1] for k in range(len(gram))])[0]


def test_language_of_held_out_texts(spark):
    rows = made_docs(200, 9) + ODD
    got = {r.doc_id: r for r in L.identify_language(frame(spark, rows, clash=True)).collect()}
    held = [r for r in made_docs(200, 9) if fold(r[0], 4) == 2]
    assert held and all(got[r[0]].held_out for r in held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    for doc_id in (1000, 1001, 1002):
        assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_unseen_words_fall_back_to_character_runs(spark):
    rows = [(k, "grünlich freundlich heimlich" if k % 2 else "quickly boldly thinly", "de" if k % 2 else "en", "s", None) for k in range(60)]
    held = [k for k in range(100, 400) if fold(k, 4) == 2][:2]
    rows += [(held[0], "wirklich", "en", "s", None), (held[1], "sadly", "de", "s", None)]
    got = {r.doc_id: r.lang_pred for r in L.identify_language(frame(spark, rows)).collect()}
    assert (got[held[0]], got[held[1]]) == ("de", "en")


def test_language_without_training(spark):
    assert L.identify_language(frame(spark, [])).collect() == []
    (row,) = L.identify_language(frame(spark, [(1, "some text", None, "s", None)])).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)


@pytest.mark.parametrize("text,words", [("Ab-c1d", ["Ab", "c", "d"]), ("ñandú!", ["ñandú"]), ("", []), ("12 !", [])])
def test_letter_words(text, words):
    (block,) = text_blocks([pa.RecordBatch.from_arrays([pa.array([text])], ["text"])])
    points, start, end, _, bounds = L.letter_words(block)
    assert ["".join(map(chr, points[a:b])) for a, b in zip(start, end)] == words and bounds[-1] == len(words)
