import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, ascii_words, frame, made_docs

from ledgerloom.llm import hyperminhash as H
from ledgerloom.llm.components import components
from ledgerloom.llm.words import combine, find_words, hash_slices, shingle_sets, text_blocks


def shingles(text):
    w = ascii_words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """doc_id: (set size, component) by comparing all pairs."""
    sets = {r[0]: shingles(r[1]) for r in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


def drifting(seed=5, n=70):
    """A base text and copies with ever more replaced words, so that links form chains."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(400)}" for _ in range(120)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(draw.randrange(14)):
            text[draw.randrange(len(text))] = f"x{draw.randrange(10_000)}"
        if draw.random() < 0.3:
            base = text
        out.append((k + 2000, " ".join(text), "en", "d", None))
    return out


@pytest.mark.parametrize("rows", [made_docs(120, 3) + ODD, drifting(), drifting(6) + made_docs(40, 7)])
def test_components_equal_all_pairs(spark, rows):
    got = H.near_duplicates(frame(spark, rows, clash=True)).collect()
    want = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_group_of_a_third_of_the_rows(spark):
    same = [(5000 + k, "one text that very many documents share word for word", "en", "c", None) for k in range(60)]
    rows = same + made_docs(100, 11)
    got = {r.doc_id: r.component_id for r in H.near_duplicates(frame(spark, rows)).collect()}
    assert {got[r[0]] for r in same} == {5000}
    assert got == {k: c for k, (_, c) in brute(rows).items()}


def test_empty_table(spark):
    assert H.near_duplicates(frame(spark, [])).collect() == []


def test_estimates_are_near_the_truth():
    draw = np.random.default_rng(2)
    for n, share in ((40, 0.5), (400, 0.75), (3000, 0.9), (3000, 0.0)):
        a = np.unique(draw.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * share)], draw.integers(0, 2 ** 63, n - int(n * share)).astype(np.uint64)]))
        a, b = (np.sort(a * np.uint64(2)), np.sort(b * np.uint64(2)))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        r = H.registers([a, b])
        got = H.corrected_jaccard(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - truth) < 0.18


def test_words_and_shingles_equal_plain_ones():
    texts = [r[1] for r in made_docs(20) + ODD] + ["A\x0bB\x0cC  D\tE\nF"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    seen = 0
    for block in text_blocks([batch], limit=300):
        words = find_words(block.data, block.offsets)
        hashes = hash_slices(block.data, words.start, words.end)
        for k, own in enumerate(shingle_sets(words, hashes, 5)):
            text = texts[seen + k] or ""
            low, high = words.bounds[k:k + 2]
            assert [bytes(block.data[a:b]) for a, b in zip(words.start[low:high], words.end[low:high])] == text.encode().split()
            w = text.encode().split()
            assert len(own) == len({tuple(w[i:i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else len(own) == bool(w)
        seen += len(block)
    assert seen == len(texts)
    one = np.array([1, 2], np.uint64)
    assert combine([one, one[::-1]])[0] != combine([one[::-1], one])[0]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert len(got) == 81


def test_rows_without_an_id_come_back_kept(spark):
    rows = made_docs(20, 3)
    nameless = [(None, rows[0][1], "en", "x", None), (None, rows[0][1], "en", "x", None), (None, None, "en", "x", None)]
    got = [tuple(r) for r in H.near_duplicates(frame(spark, rows + nameless, clash=True)).collect()]
    size = len(shingles(rows[0][1]))
    assert sorted((r for r in got if r[0] is None), key=lambda r: r[1]) == [(None, 0, None, True), (None, size, None, True), (None, size, None, True)]
    assert {r[0]: r[1:3] for r in got if r[0] is not None} == brute(rows)
