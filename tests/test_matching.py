import random
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions import identity
from ledgerloom.operators import matching

SCHEMA = ("player_id long, from_club_id long, to_club_id long, from_club_name string, to_club_name string, transfer_date date, "
          "transfer_season string, transfer_fee double")


def some(rng, n):
    return [(rng.randrange(3), rng.choice([None, 0, 1, 2]), rng.choice([None, 1, 2]), rng.choice([None, "FC A", "b"]),
             rng.choice([None, "a", "sc B"]), rng.choice([None, date(2001, 5, 5), date(2002, 8, 8)]),
             rng.choice([None, "", "2000-2001"]), rng.choice([None, 0.0, 2e5, 3e6])) for _ in range(n)]


def frames(spark, seed, ids=("s9", "s8", "")):
    rng = random.Random(seed)
    ledger = spark.createDataFrame([(i, rng.choice([None, None, None, *ids]), *r) for i, r in enumerate(some(rng, 120))],
                                   "transfer_id long, source_id string, " + SCHEMA)
    cands = spark.createDataFrame([(i, rng.choice([None, "", "s9", "s7"]), *r) for i, r in enumerate(some(rng, 80))],
                                  "candidate_id long, source_id string, " + SCHEMA)
    return cands, ledger


def compared(cands, ledger):
    """Every candidate with every row of its player, the best kept."""
    theirs = matching.fingerprints(ledger, derive_season=False).select(
        "player_id", "transfer_id", *[F.col(f).alias(f"l_{f}") for f in matching.FIELDS])
    both = matching.fingerprints(cands, derive_season=True).join(theirs, "player_id")
    evidence = identity.match_evidence(F.col, lambda f: F.col(f"l_{f}"))
    same = identity.same_source(F.col("source_id"), F.col("l_source_id"))
    score = F.when(same, 1.0).otherwise(identity.score_of(evidence))
    why = F.when(same, F.array(F.lit(identity.SAME_SOURCE))).otherwise(identity.reasons_of(evidence))
    best = {}
    for r in both.select("candidate_id", "transfer_id", score.alias("score"), why.alias("why")).collect():
        best[r.candidate_id] = max(best.get(r.candidate_id, (-1.0, 0, None)), (r.score, -r.transfer_id, tuple(r.why)))
    return {k: (round(s, 3), -i, w if s > 0 else ()) for k, (s, i, w) in best.items()}


@pytest.mark.parametrize("few", [0, 1000])
def test_best_match_equals_row_comparison(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "FEW", few)
    for seed in (5, 6):
        cands, ledger = frames(spark, seed)
        got = {r.candidate_id: (r.best_score, r.ledger_id, tuple(r.best_reasons)) for r in matching.best_match(cands, ledger).collect() if r.ledger_id is not None}
        assert got == compared(cands, ledger)


def test_one_player_with_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(matching, "FEW", 0)
    cands, ledger = frames(spark, 7)
    heavy = ledger.withColumn("player_id", F.when(F.col("transfer_id") % 3 == 0, 1).otherwise(F.col("player_id")).cast("long"))
    got = {r.candidate_id: (r.best_score, r.ledger_id, tuple(r.best_reasons)) for r in matching.best_match(cands, heavy).collect() if r.ledger_id is not None}
    assert got == compared(cands, heavy)


@pytest.mark.parametrize("wide", [0, 30, 10_000])
def test_players_with_many_rows_are_looked_up_others_compared(spark, monkeypatch, wide):
    monkeypatch.setattr(matching, "WIDE", wide)
    monkeypatch.setattr(matching, "FEW", 0)
    cands, ledger = frames(spark, 8)
    nobody = cands.limit(40).withColumns({"candidate_id": F.col("candidate_id") + 1000, "player_id": F.lit(None).cast("long")})
    got = matching.best_match(cands.unionByName(nobody), ledger.filter("player_id <> 2 OR transfer_id < 20")).collect()
    assert sorted(r.candidate_id for r in got) == [*range(80), *range(1000, 1040)]
    found = {r.candidate_id: (r.best_score, r.ledger_id, tuple(r.best_reasons)) for r in got if r.ledger_id is not None}
    assert found == compared(cands, ledger.filter("player_id <> 2 OR transfer_id < 20"))


def test_matching_shuffles_each_side_once(spark):
    """No keys are exploded: the plan deals candidates and ledger rows by blocks of players, and nothing after that."""
    rng = random.Random(12)
    ledger = spark.createDataFrame([(i, None, *r) for i, r in enumerate(some(rng, 50))], "transfer_id long, source_id string, " + SCHEMA)
    plan = matching.scored(ledger.withColumnRenamed("transfer_id", "candidate_id"), ledger)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_") == 2 and plan.count("Exchange") == 2 and "Generate" not in plan


def test_waves_look_up_few_keys(spark, monkeypatch):
    """Most candidates are found by the first wave, which looks up one key for each kind of ledger row."""
    monkeypatch.setattr(matching, "FEW", 0)
    rng = random.Random(11)
    moves = [(i, None, rng.randrange(40), rng.randrange(1, 30), rng.randrange(1, 30), "FC A", "b", date(2001, 5, 5), "2000-2001", 2e5)
             for i in range(400)]
    ledger = spark.createDataFrame(moves, "transfer_id long, source_id string, " + SCHEMA)
    cands = ledger.withColumnRenamed("transfer_id", "candidate_id").withColumn(
        "transfer_fee", F.when(F.col("candidate_id") % 5 == 0, 9e7).otherwise(F.col("transfer_fee")))
    cands = cands.withColumn("to_club_id", F.when(F.col("candidate_id") % 50 == 0, 77).otherwise(F.col("to_club_id")).cast("long"))
    got = {r.candidate_id: (r.best_score, r.ledger_id, tuple(r.best_reasons)) for r in matching.best_match(cands, ledger).collect()}
    assert got == compared(cands, ledger)
    prints = matching._collapsed(ledger).withColumn("held", matching._held())
    left = matching.fingerprints(cands, derive_season=True).withColumn("held", matching._held())
    asked = 0
    for plan in matching.wave_plans(left, prints):
        asked += matching.look_ups(left, plan).count()
        left = left.join(matching._wave(left, prints, plan), "candidate_id", "left_anti")
    assert asked < 6 * len(moves)


def test_agreements_score_as_the_evidence_does():
    full = sum(matching.HELD.values())
    scores = {tuple(kinds): score for *kinds, score in matching.agreements(full, full)}
    assert scores[1, 1, 1, 1] == 1.0 and scores[1, 1, 0, 1] == 0.85 and scores[0, 0, 0, 0] == 0.0 and len(scores) == 16
    names = {tuple(kinds): score for *kinds, score in matching.agreements(full, full & ~5)}
    assert names[2, 2, 1, 0] == 65 / 80 and (1, 1, 1, 1) not in names
    assert matching.agreements(0, full) == [(0, 0, 0, 0, 0.0), (0, 0, 0, 1, 1.0)]


def test_same_source_id_is_the_same_transfer(spark):
    stored = one(spark, source_id="77").withColumnRenamed("candidate_id", "transfer_id")
    other = one(spark, candidate_id=5, source_id="77", from_club_id=9, to_club_id=8, from_club_name="X", to_club_name="Y",
                transfer_season="1990-1991", transfer_fee=9e7)
    row = matching.scored(other, stored).first()
    assert (row.best_score, row.decision) == (1.0, "reject") and row.reasons[1] == "exact_transfermarkt_id"
    elsewhere = matching.scored(other.withColumn("player_id", F.lit(2).cast("long")), stored).first()
    assert (elsewhere.best_score, elsewhere.decision) == (0.0, "safe")


def one(spark, **change):
    row = dict(candidate_id=1, source_id=None, player_id=1, from_club_id=1, to_club_id=2, from_club_name="A", to_club_name="B",
               transfer_date=date(2001, 5, 5), transfer_season="2000-2001", transfer_fee=2e5)
    row.update(change)
    return spark.createDataFrame([tuple(row.values())], "candidate_id long, source_id string, " + SCHEMA)


def test_golden_scores(spark):
    stored = one(spark).drop("source_id").withColumnRenamed("candidate_id", "transfer_id")
    empty = stored.filter("false")
    first = matching.scored(one(spark), empty).first()
    assert (first.score, first.decision) == (0.9, "safe")
    assert "no_contextual_matches" in first.reasons
    same = matching.scored(one(spark), stored).first()
    assert (same.best_score, same.score, same.decision) == (1.0, 0.0, "reject")
    assert same.reasons[0] == "duplicate: matched DB record with score 1.0"
    season = matching.scored(one(spark, transfer_season="2001-2002"), stored).first()
    assert (season.best_score, season.decision) == (0.85, "reject")
    own = matching.scored(one(spark, source_id="77", from_club_id=9, to_club_id=8), stored).first()
    assert (own.score, own.decision) == (1.0, "safe")
    academy = spark.createDataFrame([(1,)], "player_id long")
    assert matching.scored(one(spark), empty, academy).first().score == 0.63


def test_inserts_keep_one_row_per_fingerprint(spark):
    players = spark.createDataFrame([(1, "P", date(1980, 1, 1))], "player_id long, name string, date_of_birth date")
    twice = one(spark).unionByName(one(spark, candidate_id=2)).unionByName(one(spark, candidate_id=3, to_club_id=7))
    empty = one(spark).drop("source_id").withColumnRenamed("candidate_id", "transfer_id").filter("false")
    got = matching.to_insert(matching.scored(twice, empty), players)
    assert rows(got, "candidate_id") == [(1,), (3,)]
    valued = matching.to_insert(matching.scored(twice.withColumn("market_value_in_eur", F.lit(7.0)), empty), players)
    assert [r.market_value_in_eur for r in valued.collect()] == [7.0, 7.0]


def test_club_name_prefixes(spark):
    names = spark.createDataFrame([(" FC Club Brugge ",), ("F.C. Sc X",), ("",), (None,), ("fcabc",)], "n string")
    got = [r[0] for r in names.select(identity.normal_club_name(F.col("n"))).collect()]
    assert got == ["brugge", "x", None, None, "fcabc"]


def test_rescored_equals_scored_on_the_grown_ledger(spark, monkeypatch):
    """Only the added rows are compared; earlier scores stand."""
    schema = ("transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, transfer_fee double, "
              "from_club_name string, to_club_name string, transfer_season string, source_id string")

    def move(i, club, day):
        return (i, i % 3, club, club + 1, date(2001, 8, day), 2e5, f"Club {club}", f"Club {club + 1}", "2001-2002", None)

    ledger = spark.createDataFrame([move(i, i % 4, 1) for i in range(12)], schema)
    added = spark.createDataFrame([move(100 + i, 5 + i % 2, 2) for i in range(4)], schema)
    offers = spark.createDataFrame([move(200 + i, i % 9, 3) for i in range(30)], schema).withColumnRenamed("transfer_id", "candidate_id")
    seen, best = [], matching.best_match
    monkeypatch.setattr(matching, "best_match", lambda c, rows: seen.append(rows.count()) or best(c, rows))
    first = matching.scored(offers, ledger)
    again = matching.rescored(first.filter(~matching.settled()), added, offers.columns).unionByName(first.filter(matching.settled()))
    whole = matching.scored(offers, ledger.unionByName(added))
    shown = ["candidate_id", "best_score", "score", "decision", "fingerprint_hash"]
    assert rows(again, *shown) == rows(whole, *shown) and seen == [12, 4, 16]
    assert 0 < first.filter(matching.settled()).count() < whole.filter(matching.settled()).count() < 30
