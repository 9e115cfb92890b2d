import random
import unicodedata

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.functions.similarity import indel_ratio
from ledgerloom.operators import fuzzy


def naive(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200 * table[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def names(rng, n):
    parts = ["ana", "joao", "silva", "silvaa", "li", "lee", "costa", "de", "mo", "maria", "marco", "x", "aaaa"]
    out = set()
    while len(out) < n:
        word = " ".join(rng.sample(parts, rng.randrange(1, 4)))
        if rng.random() < 0.5:
            i = rng.randrange(len(word))
            word = word[:i] + rng.choice("abx") + word[i + rng.randrange(2):]
        out.add(" ".join(sorted(word.split())))
    return sorted(out)


def test_indel_ratio_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert abs(indel_ratio(a, b) - naive(a, b)) < 1e-9


@pytest.mark.parametrize("ratio", [0.7, 0.8, 0.85])
def test_similar_texts_misses_nothing(spark, ratio):
    rng = random.Random(2)
    left, right = names(rng, 120), names(rng, 120)
    got = fuzzy.similar_texts(spark.createDataFrame([(x,) for x in left], "text string"),
                              spark.createDataFrame([(x,) for x in right], "text string"), ratio)
    want = [(a, b) for a in left for b in right if naive(a, b) >= 100 * ratio - 1e-9]
    assert rows(got, "left", "right") == sorted(want, key=str)


@pytest.mark.parametrize("ratio", [0.7, 0.85])
def test_similar_texts_misses_nothing_among_long_names(spark, ratio):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 32))).strip() for _ in range(60)]

    def turned(text):
        out = list(text)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(out) + 1)
            out[at:at + rng.randrange(2)] = rng.choice(["", "x", "y"])
        return "".join(out)

    left, right = sorted(set(base)), sorted({turned(b) for b in base} | {"", "a", "ab"})
    got = fuzzy.similar_texts(spark.createDataFrame([(x,) for x in left], "text string"),
                              spark.createDataFrame([(x,) for x in right], "text string"), ratio)
    want = [(a, b) for a in left for b in right if naive(a, b) >= 100 * ratio - 1e-9]
    assert rows(got, "left", "right") == sorted(want, key=str)


def test_linkage_equals_full_comparison(spark):
    rng = random.Random(3)
    people = [(i, n.title(), rng.choice(["Porto", "FC Porto B", "Ajax", None])) for i, n in enumerate(names(rng, 80))]
    people += [(500, "João Silva", "Ajax"), (400, "Joao Silva", "Porto")]
    outside = [(n.upper(), rng.choice(["porto", "Ajax", "", None])) for n in names(rng, 60)]
    got = fuzzy.link_players(spark.createDataFrame(outside, "name string, team string"),
                             spark.createDataFrame(people, "player_id long, name string, current_club_name string"))

    import unicodedata

    def clean(s):
        s = (s or "").strip().lower()
        s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
        return " ".join(sorted(s.split()))

    want = []
    for name, team in set(outside):
        best = (0.0, None)
        for pid, pname, club in sorted(people):
            score = naive(clean(name), clean(pname))
            if 70 <= score < 85 and clean(team) and clean(club) and naive(clean(team), clean(club)) >= 80:
                score = max(score, min(score + 15, 95))
            if score > best[0]:
                best = (score, pid)
        hit = best[0] >= 85
        want.append((name, team, best[1] if hit else None, round(best[0], 6) if hit else None))
    found = [(r.name, r.team, r.player_id, r.match_score and round(r.match_score, 6)) for r in got.collect()]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_outside_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def noted(name):
        seen.add(1)
        return name

    rows = spark.createDataFrame([(f"green river {k % 4}", "Stone Club") for k in range(40)], "name string, team string")
    players = spark.createDataFrame([(k, f"green river {k}", "Stone Club") for k in range(3)], "player_id long, name string, current_club_name string")
    links = fuzzy.link_players(rows.withColumn("name", F.udf(noted, "string")("name")), players)
    assert len(links.collect()) == 4 and seen.value == 40


def test_best_club_needs_the_threshold(spark):
    targets = spark.createDataFrame([(1, "Real Madrid"), (2, "Zzz")], "target_id long, name string")
    results = spark.createDataFrame([(1, 10, "Real Madrid CF"), (1, 11, "Atletico"), (2, 12, "Ajax")],
                                    "target_id long, club_id long, name string")
    assert rows(fuzzy.best_club(targets, results), "target_id", "club_id") == [(1, 10)]


def test_crowded_keys_are_made_longer(spark, monkeypatch):
    """With every key crowded that joins more than one row the result stays the same."""
    monkeypatch.setattr(fuzzy, "CROWD", 1)
    rng = random.Random(9)
    left, right = names(rng, 90), names(rng, 90)
    got = fuzzy.similar_texts(spark.createDataFrame([(x,) for x in left], "text string"),
                              spark.createDataFrame([(x,) for x in right], "text string"), 0.85)
    want = [(a, b) for a in left for b in right if naive(a, b) >= 85 - 1e-9]
    assert rows(got, "left", "right") == sorted(want, key=str)


def test_crowded_keys_inside_blocks(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "CROWD", 1)
    rng = random.Random(10)
    left, right = ([(x, rng.randrange(3)) for x in names(rng, 40)] for _ in range(2))
    got = fuzzy.similar_texts(spark.createDataFrame(left, "text string, club int"), spark.createDataFrame(right, "text string, club int"), 0.7, ["club"])
    want = [(c, a, b) for a, c in left for b, d in right if c == d and naive(a, b) >= 70 - 1e-9]
    assert rows(got, "club", "left", "right") == sorted(want, key=str)


def test_folding_equals_nfkd_for_all_code_points(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(every[k:k + 997]) for k in range(0, len(every), 997)] + ["", "plain", None, "\ufdfa\ufb03\u00bd x", "\ufb03", "e\u0301a\u0323\u0302"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    folded = df.select("i", similarity.fold_accents(F.col("t")).alias("f"))
    want = {i: t if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii") for i, t in enumerate(texts)}
    assert {r.i: r.f for r in folded.collect()} == want
    assert "Python" not in folded._jdf.queryExecution().executedPlan().toString()


def test_gestalt_ratio_equals_the_library():
    from difflib import SequenceMatcher

    from ledgerloom.functions.similarity import gestalt_ratio
    rng = random.Random(3)
    texts = ["", "a", "supplier#000000437", "suplier#000014073", "ab" * 120, *("".join(rng.choices("abcä ", k=rng.randint(1, n))) for n in (3, 8, 30, 250) for _ in range(30))]
    for a in texts:
        for b in texts:
            assert gestalt_ratio(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)
