import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, ODD, frame, made_docs

from ledgerloom.llm import dual_tree, phrase_quicksort, prefix_forest


# ranked search

def terms(text):
    return [re.sub(r"[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked(docs, items, k):
    """The definition, document by document."""
    own = [(d[0], Counter(terms(d[1]))) for d in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    big_n, big_l = len(own), sum(n for _, _, n in own)
    out = []
    for item_id, text in set(items):
        scores = []
        asked = Counter(terms(text))
        df = {t: sum(t in c for _, c, _ in own) for t in asked}
        for doc_id, c, n in own:
            m = 75 + (25 * n * big_n) // big_l
            score = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                        for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "The stone over the river"), (1, "bread, bread; BREAD"), (2, None), (3, ""), (None, "grün über Fluss"), (4, "nowhere-found"),
         (5, "the the the of"), (5, "the the the of"), (6, "one"), (7, "w" * 30_000 + " river is")]


@pytest.mark.parametrize("k", [1, 3, 20])
def test_ranked_search_equals_the_definition(spark, k):
    rows = made_docs(90, 11) + ODD + [(None, "stone river stone", "en", "x", None), (3, "the river and the stone", "en", "x", None)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dual_tree.ranked_search(frame(spark, rows, clash=True), items.selectExpr("*", "1 AS doc_id", "2 AS score", "3 AS item", "4 AS n"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, ITEMS, k)


def test_ranked_search_in_several_item_batches(spark, monkeypatch):
    monkeypatch.setattr(dual_tree, "BATCH_TERMS", 4)
    rows = made_docs(40, 12)
    got = dual_tree.ranked_search(frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string"), 5)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, ITEMS, 5)


def test_ranked_search_of_empty_tables(spark):
    items, docs = spark.createDataFrame(ITEMS, "item_id long, text string"), frame(spark, made_docs(5))
    assert dual_tree.ranked_search(docs.limit(0), items).count() == 0
    assert dual_tree.ranked_search(docs, items.limit(0)).count() == 0
    assert dual_tree.ranked_search(frame(spark, ODD[:3]), items).count() == 0


def test_whole_batches_are_pruned_exactly():
    """Documents of several subjects: the search meets a small part of all pairs, and its best equal those of all pairs."""
    draw = np.random.default_rng(3)
    subjects, own, n_docs = 20, 40, 6000
    subject = draw.integers(0, subjects, n_docs)
    doc = np.repeat(np.arange(n_docs), 12)
    pair = np.unique(doc * (subjects * own) + subject[doc] * own + draw.integers(0, own, len(doc)))
    doc, term = np.divmod(pair, subjects * own)
    impact = draw.integers(1, 1000, len(doc))
    weight = draw.integers(1, 9000, subjects * own)
    rows = []
    for k in range(100):
        t = np.unique(k % subjects * own + draw.integers(0, own, 6))
        rows.append((t, weight[t].astype(float)))
    found = dual_tree.Search(dual_tree.item_tree(rows), weight, np.zeros(len(rows)), 20)
    ids = draw.permutation(n_docs)
    for low in range(0, n_docs, 2000):
        own_rows = (doc >= low) & (doc < low + 2000)
        found.add(doc[own_rows] - low, term[own_rows], impact[own_rows], ids[low:low + 2000])
    dense = np.zeros((n_docs, subjects * own), np.int64)
    dense[doc, term] = impact
    for k, (t, w) in enumerate(rows):
        score = dense[:, t] @ w.astype(np.int64)
        best = np.lexsort((ids, -score))[:20]
        best = best[score[best] > 0]
        assert found.best[k][0].tolist() == score[best].tolist() and found.best[k][1].tolist() == ids[best].tolist()
    assert found.pairs < 0.05 * n_docs * len(rows)


# collocations

def phrases(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for row in rows:
        lang = "und" if row[2] is None else row[2]
        text = re.sub(r"[A-Z]", lambda m: m[0].lower(), row[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        good = {p: f for p, f in own.items() if f >= least}
        covered = set()
        for p, f in good.items():
            for size in range(2, len(p)):
                covered.update(p[i:i + size] for i in range(len(p) - size + 1) if f >= good[p[i:i + size]])
        best = []
        for p, a in good.items():
            if len(p) > 1 and p not in covered:
                score, k = min((1000 * a * totals[lang] // (good[p[:k]] * good[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), good[p[:k]], good[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def repeated(n, seed):
    rows = made_docs(n, seed)
    line = "hot line: never so long a line, of the same words again! Ünder a b a b a b\tend"
    return rows + [(5000 + k, line, None if k % 2 else "und", "x", None) for k in range(150)] + ODD


@pytest.mark.parametrize("rows_per_route,top", [(200_000, 2000), (500, 2000), (120, 7)])
def test_collocations_equal_loops(spark, monkeypatch, rows_per_route, top):
    monkeypatch.setattr(phrase_quicksort, "ROUTE_ROWS", rows_per_route)
    rows = repeated(700, 4)
    got = phrase_quicksort.collocations(frame(spark, rows, clash=True), top)
    assert sorted(tuple(r) for r in got.collect()) == phrases(rows, 100, top)


def test_collocations_of_empty_tables(spark):
    assert phrase_quicksort.collocations(frame(spark, ODD)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrase_quicksort.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrase_quicksort.collocations(frame(spark, [(k, None, "en", "x", None) for k in range(9)])).count() == 0


@pytest.mark.parametrize("least", [1, 3, 40])
def test_equal_parts_are_counts(least):
    draw = random.Random(least)
    rows = []
    for _ in range(3000):
        size = draw.randint(1, 5)
        rows.append([draw.randint(1, 4) for _ in range(size)] + [0] * (5 - size))
    n = np.array([draw.randint(1, 3) for _ in rows])
    columns = [np.array(c, np.uint64) for c in zip(*rows, strict=True)]
    want = Counter()
    for row, times in zip(rows, n.tolist(), strict=True):
        for size in range(1, 6):
            if row[size - 1]:
                want[tuple(row[:size])] += times
    got = {tuple(rows[row][:size]): count for row, size, count in phrase_quicksort.equal_parts(columns, n, least)}
    assert got == {p: f for p, f in want.items() if f >= least}


# nearest neighbours

def vectors(n, dims, clusters, seed, copies=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims)) * 1.5
    rows = (centres[draw.integers(0, clusters, n)] + draw.normal(size=(n, dims))).astype(np.float32)
    rows[n - copies:] = rows[0]
    return [(i, r.tolist(), 1) for i, r in enumerate(rows)]


def true_nearest(rows, k, every):
    sound = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    size = Counter(len(v) for _, v in sound).most_common(1)[0][0]
    sound = sorted((i, v) for i, v in sound if len(v) == size)
    ids, whole = np.array([i for i, _ in sound]), np.array([v for _, v in sound], float)
    out = {}
    for i, v in sound:
        if i % every == 0:
            score = (whole * np.array(v)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(frame_, k, every):
    out = defaultdict(list)
    for r in sorted(prefix_forest.nearest(frame_, k, every).collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("clusters,copies", [(1, 0), (40, 0), (40, 900)])
def test_recall_of_nearest(spark, monkeypatch, clusters, copies):
    monkeypatch.setattr(prefix_forest, "BLOCK_BYTES", 60 * 8 * 16)
    monkeypatch.setattr(prefix_forest, "BLOCK_QUERIES", 7)
    rows = vectors(2700, 16, clusters, 6, copies)
    got = answers(spark.createDataFrame(rows, VECTORS), 20, 20)
    want = true_nearest(rows, 20, 20)
    assert got.keys() == want.keys()
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert sum(found) / len(found) >= 0.9
    for q, own in got.items():
        true = {i: s for i, s in true_nearest([r for r in rows if r[0] in {q, *[i for i, _ in own]}], 20, 20)[q]}
        assert [i for i, _ in own] == sorted(true, key=lambda i: (-true[i], i)) and all(s == pytest.approx(true[i], abs=1e-12) for i, s in own)


def test_clusters_need_few_candidates(spark):
    """The measured number of candidates follows the data's structure."""
    def wanted(clusters, spread):
        draw = np.random.default_rng(1)
        rows = draw.normal(size=(clusters, 24))[draw.integers(0, clusters, 4000)] + spread * draw.normal(size=(4000, 24))
        frame_ = spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(rows / np.linalg.norm(rows, axis=1)[:, None])], VECTORS)
        held, _, dims = prefix_forest._vectors(frame_, 20)
        return prefix_forest.grown(held, dims, 20).wanted
    assert 3 * wanted(80, 0.05) < wanted(1, 5.0)


def test_nearest_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 2.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 1), (4, None, 1), (20, [], 1),
            (40, [1.0, None], 1), (60, [1.0, float("nan")], 1), (80, [float("inf"), 1.0], 1), (100, [1.0, 2.0, 3.0], 1), (None, [5.0, 5.0], 1), (5, [-3.0, 1.0], 1),
            (120, [1.0, 0.0], None)]
    got = defaultdict(list)
    table = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS h1", "2 AS tree", "3 AS score", "4 AS v")
    for r in prefix_forest.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert got.keys() == {0, 120}
    assert got[120] == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 0, 0.0), (5, 5, -3.0)]
    # the id 0 has two vectors: each is asked, neither answers the other
    assert sorted(got[0]) == sorted([(1, 1, 1.0), (2, 2, 1.0), (3, 120, 1.0), (4, 5, -3.0), (1, 5, 2.0), (2, 1, 0.0), (3, 2, 0.0), (4, 120, 0.0)])
    assert prefix_forest.nearest(table.limit(0)).count() == 0
    assert prefix_forest.nearest(table.where("embedding IS NULL")).count() == 0
    assert prefix_forest.nearest(table.where("vec_id = 120")).count() == 0


def test_exact_ties_take_the_smaller_ids(spark):
    """Vectors of few values tie in very many places."""
    rows = [(i, list(map(float, x)), 1) for i, x in enumerate(itertools.islice(itertools.product((-1, 0, 1), repeat=6), 600))]
    got = answers(spark.createDataFrame(rows, VECTORS), 20, 20)
    want = true_nearest(rows, 20, 20)
    hits = [len(set(got[q]) & set(want[q])) / len(want[q]) for q in want]
    assert got.keys() == want.keys() and sum(hits) / len(hits) >= 0.9
