import random
from datetime import date, timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.functions import returns
from ledgerloom.operators import chains, metrics, pairs, quality

DAY = date(2005, 1, 1)
SCHEMA = ("transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, transfer_fee double, "
          "from_club_name string, to_club_name string")


def random_moves(seed, n=260, players=6, clubs=4, span=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        player = 1 if rng.random() < 0.34 else rng.randrange(2, players)
        out.append((i, player, rng.choice([None, 0, *range(1, clubs)]), rng.choice([None, 0, *range(1, clubs)]),
                    None if rng.random() < 0.05 else DAY + timedelta(days=rng.randrange(span)),
                    rng.choice([None, 0.0, 0.0, 5e4, 2e5, 3e5, float(rng.randrange(1, 10)) * 1e5]), "a", "b"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pairing_equals_brute_force(spark, seed):
    moves = random_moves(seed)
    got = pairs.match_buy_sell(pairs.fee_bearing(spark.createDataFrame(moves, SCHEMA)))
    want = []
    paid = [m for m in moves if m[5] and m[5] > 0]
    for b in paid:
        sales = [s for s in paid if s[1] == b[1] and b[3] is not None and s[2] == b[3] and s[4] and b[4] and s[4] > b[4]]
        if sales:
            want.append((b[0], max(sales, key=lambda s: (s[4], s[0]))[0]))
    assert rows(got, "buy_transfer_id", "sell_transfer_id") == sorted(want, key=str)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_loans_equal_brute_force(spark, seed):
    moves = random_moves(seed)
    want = set()
    for t in moves:
        if not t[2] or not t[3] or not t[4] or (t[5] or 0) > 0:
            continue
        if any(o[0] != t[0] and o[1] == t[1] and o[2] == t[3] and o[3] == t[2] and o[4] and not o[5]
               and abs((t[4] - o[4]).days) <= 100 for o in moves):
            want.add(t[0])
    got = {r.transfer_id for r in chains.swapped_loans(spark.createDataFrame(moves, SCHEMA), 100).collect()}
    assert got == want


def test_loan_boundary_days(spark):
    moves = [(1, 1, 5, 6, DAY, None, "a", "b"), (2, 1, 6, 5, DAY + timedelta(days=730), 0.0, "b", "a"),
             (3, 2, 5, 6, DAY, None, "a", "b"), (4, 2, 6, 5, DAY + timedelta(days=731), 0.0, "b", "a")]
    assert rows(chains.swapped_loans(spark.createDataFrame(moves, SCHEMA)), "transfer_id") == [(1,), (2,)]


@pytest.mark.parametrize("seed", [6, 7])
def test_impossible_pairs_equal_brute_force(spark, seed):
    moves = random_moves(seed)
    df = spark.createDataFrame(moves, SCHEMA)
    players = spark.createDataFrame([(p, f"p{p}") for p in range(1, 6)], "player_id long, name string")
    clubs = spark.createDataFrame([(1, "one")], "club_id long, name string")
    found = []
    for s in moves:
        for b in moves:
            if (s[1] == b[1] and s[2] is not None and s[2] == b[3] and s[4] and b[4] and s[4] < b[4]
                    and ((s[5] or 0) > 1e5 or (b[5] or 0) > 1e5)):
                total = -1.0 if s[5] is None or b[5] is None else s[5] + b[5]
                found.append((-total, s[0], b[0], s[1]))
    got = chains.sold_before_bought(df, players, clubs, top=20)
    assert rows(got, "sell_transfer_id", "buy_transfer_id") == sorted([f[1:3] for f in sorted(found)[:20]], key=str)
    people = rows(chains.sold_before_bought_players(df), "player_id")
    assert people == sorted({(f[3],) for f in found}, key=str)


def test_breaks_and_gaps_with_hot_player(spark):
    moves = random_moves(8)
    df = spark.createDataFrame(moves, SCHEMA)
    dated = df.filter("transfer_date IS NOT NULL")
    assert rows(chains.lag_breaks(dated, hot_rows=5)) == rows(chains.lag_breaks(dated))
    assert rows(chains.career_gaps(dated, hot_rows=5)) == rows(chains.career_gaps(dated))
    summary = {r.player_id: r for r in chains.career_summary(dated).collect()}
    assert sum(r.gaps for r in summary.values()) == chains.career_gaps(dated).count()


def test_returns_golden(spark):
    from ledgerloom.functions import returns
    data = [(1e6, 16e6, DAY, DAY + timedelta(days=1461)), (1e6, 1e9, DAY, DAY + timedelta(days=1))]
    df = spark.createDataFrame(data, "buy_fee double, sell_fee double, buy_date date, sell_date date")
    got = pairs.with_returns(df).select(F.round("annualized_roi_pct", 6)).collect()
    assert [r[0] for r in got] == [100.0, 500.0]
    assert df.select(returns.value_creation_pct(F.col("buy_fee"), F.lit(None).cast("double"))).first()[0] == -100.0


def test_constant_metric_scores_half(spark):
    data = [(c, 10, 5.0, 100.0 * c, 50.0, 1.0, None, 2.0, None) for c in (1, 2, 3)]
    df = spark.createDataFrame(data, "club_id long, total_transfers long, median_roi double, total_profit double, hit_rate double, "
                                     "value_creation double, annualized_roi double, profit_per_deal double, buying_club_premium double")
    got = {r.club_id: round(r.composite_score, 9) for r in metrics.composite(df).collect()}
    assert got == {1: 0.4, 2: 0.5, 3: 0.6}


def test_health_without_issues_is_one(spark):
    counts = spark.createDataFrame([(5.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "total_players double, total_edges double, "
                                   "timeline_violations double, disconnected_segments double, orphan_players double, "
                                   "duplicate_edges double, missing_continuity double")
    assert quality.health(counts).first()["graph_health_score"] == 1.0


def test_duplicates_and_severity(spark):
    moves = [(1, 1, 2, 3, DAY, 1.0, "a", "b"), (2, 1, 2, 3, DAY, 5.0, "a", "b"), (3, 1, None, 3, DAY, None, "a", "b")]
    assert rows(quality.duplicate_transfers(spark.createDataFrame(moves, SCHEMA)), "player_id", "cnt") == [(1, 2)]


def test_negative_fee_counts_as_free_on_one_side(spark):
    moves = spark.createDataFrame([
        (1, 1, 5, 6, date(2010, 1, 1), -3.0), (2, 1, 6, 5, date(2010, 6, 1), None),
        (3, 2, 5, 6, date(2010, 1, 1), -3.0), (4, 2, 6, 5, date(2010, 6, 1), -1.0),
        (5, 3, 7, 7, date(2010, 1, 1), 0.0), (6, 4, 7, 7, date(2010, 1, 1), 0.0), (7, 4, 7, 7, date(2010, 1, 1), -1.0),
        (8, 5, None, 6, date(2010, 1, 1), 0.0), (9, 5, 6, 0, date(2010, 1, 1), 0.0)],
        "transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, transfer_fee double")
    assert rows(chains.swapped_loans(moves), "transfer_id") == [(1,), (2,), (6,), (7,)]
    assert chains.with_loans(moves).count() == 9


def test_paired_transfers_equal_the_join_by_id_with_one_shuffle_less(spark):
    schema = "transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, transfer_fee double"
    moves = [(i, None if i % 19 == 0 else i % 7, None if i % 5 == 0 else i % 4, None if i % 11 == 0 else (i * 7) % 4,
              None if i % 13 == 0 else date(2000 + i % 9, 1 + i % 12, 1), [None, 0.0, 5e4, 2e5, 3e6][i % 5 if i % 2 else 4]) for i in range(1, 150)]
    ledger = spark.createDataFrame(moves, schema)
    players = spark.createDataFrame([(p, f"P{p}", "Defender", date(1980, 1, 1 + p)) for p in range(5)],
                                    "player_id long, name string, position string, date_of_birth date")
    values = spark.createDataFrame([(p, 1e6 * p) for p in range(1, 7)], "player_id long, market_value_in_eur double")
    found = pairs.with_returns(pairs.min_buy_fee(pairs.match_buy_sell(pairs.fee_bearing(ledger))))
    found = pairs.with_player_info(pairs.with_peak_value(found, values), players)
    named = ledger.join(players.select("player_id", F.col("name").alias("player_name"), "date_of_birth"), "player_id", "left")
    want = pairs.on_transfers(named.withColumn("age_at_transfer", returns.age_years(F.col("date_of_birth"), F.col("transfer_date"))).drop("date_of_birth"), found)
    got = pairs.paired_transfers(ledger, values, players)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, *want.columns) == rows(want) and 0 < want.filter("roi_pct is not null").count() < 149


def test_shuffles_start_with_partitions_in_proportion_to_the_lines(spark, monkeypatch):
    from ledgerloom import session
    from ledgerloom.sources.driver_tables import DriverTables
    before = spark.conf.get(session.START_PARTITIONS, None)
    monkeypatch.setattr(session, "ROWS_PER_PARTITION", 100)
    try:
        lines = DriverTables(spark, "/root/testdata/sf0.001").raw("lineitem").count()
        assert spark.conf.get(session.START_PARTITIONS, None) == str(-(-lines // 100)) and lines > 1000
        session.size_shuffles(spark, 10)
        assert spark.conf.get(session.START_PARTITIONS) == str(-(-lines // 100))
    finally:
        spark.conf.unset(session.START_PARTITIONS) if before is None else spark.conf.set(session.START_PARTITIONS, before)


def odd_ledger(spark, seed):
    rng = random.Random(seed)
    moves = [(i, rng.choice([None, 1, 1, 2, 3]), rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1, 2]),
              None if rng.random() < 0.1 else DAY + timedelta(days=rng.randrange(60)), rng.choice([None, 0.0, 2e5, 3e6])) for i in range(200)]
    return spark.createDataFrame(moves + moves[:20], "transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, transfer_fee double")


def odd_people(spark):
    players = spark.createDataFrame([(p, f"P{p}", "Defender", date(1980, 1, 1 + p)) for p in (1, 2, 2)],
                                    "player_id long, name string, position string, date_of_birth date")
    return players, spark.createDataFrame([(None, 9e6), (1, 1e6), (3, 5e6), (3, None)], "player_id long, market_value_in_eur double")


def shuffles(spark, df):
    """What the plan's shuffles are clustered by, where nothing is broadcast."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return sorted(" ".join(c.split("#")[0] for c in line.split("hashpartitioning(")[1].split(")")[0].split(", ")[:-1])
                  for line in plan.splitlines() if "Exchange hashpartitioning(" in line)


def test_paired_ledger_moves_once_by_player(spark):
    ledger, (players, values) = odd_ledger(spark, 21), odd_people(spark)
    sales = {}
    moves = [tuple(r) for r in ledger.collect()]
    for i, player, club, _, on, fee in moves:
        if None not in (player, club, on) and (fee or 0) > 0:
            sales[player, club] = max(sales.get((player, club), (on, i, fee)), (on, i, fee))
    want = []
    for i, player, _, club, on, fee in moves:
        sale = sales.get((player, club), (None, None, None))
        pair = on is not None and (fee or 0) >= 1e5 and sale[0] is not None and sale[0] > on
        want += [(i, sale[2] - fee if pair else None, {1: 1e6, 3: 5e6}.get(player) if pair else None)] * (2 if player == 2 else 1)
    got = pairs.paired_transfers(ledger, values, players)
    assert rows(got, "transfer_id", "profit", "peak_value") == sorted(want, key=str) and any(w[2] for w in want)
    # the ledger, the players and the peaks, each once by player
    assert shuffles(spark, got) == ["player_id"] * 3


def test_asof_profit_shuffles_asking_sales_only(spark):
    ledger, (players, values) = odd_ledger(spark, 22), odd_people(spark)
    ledger = pairs.paired_transfers(ledger, values, players).distinct().localCheckpoint()
    moves = [r.asDict() for r in ledger.collect()]
    want = []
    for m in moves:
        gives = [b for b in moves if m["profit"] is None and (m["transfer_fee"] or 0) > 0 and m["player_id"] is not None and m["from_club_id"] and m["transfer_date"]
                 and (b["player_id"], b["to_club_id"]) == (m["player_id"], m["from_club_id"]) and b["profit"] is not None and b["transfer_fee"] > 0
                 and b["transfer_date"] < m["transfer_date"]]
        best = max(gives, key=lambda b: (b["transfer_date"], b["transfer_id"]), default=m)
        want.append((m["transfer_id"], m["player_name"], best["buy_fee"], best["sell_fee"], best["profit"], best["roi_pct"]))
    got = pairs.propagate_profit_asof(ledger)
    assert sorted(got.columns) == sorted(ledger.columns)
    assert rows(got, "transfer_id", "player_name", "buy_fee", "sell_fee", "profit", "roi_pct") == sorted(want, key=str)
    assert sum(w[4] is not None for w in want) > sum(m["profit"] is not None for m in moves) > 0
    # points and asking sales by day, the same by key, and the join of what was found with the asking sales
    assert len(shuffles(spark, got)) == 4


def test_paired_ledger_is_stored_without_names_and_without_the_bare_ledger(spark):
    from ledgerloom.sources import driver_tables
    folder = "/root/testdata/sf0.001"
    kept, hot = dict(driver_tables.STORED), driver_tables.DriverTables(spark, folder, hot_rows=20)
    try:
        driver_tables.STORED.clear()
        plain = driver_tables.DriverTables(spark, folder)
        found = plain.paired
        assert [k[-1] for k in driver_tables.STORED] == ["paired"]
        assert "from_club_name" in found.columns and "from_club_name" not in driver_tables.STORED[plain.stored_key("paired")][1].names
        again = rows(found)
        driver_tables.STORED.clear()
        plain.transfers
        assert rows(driver_tables.DriverTables(spark, folder).paired, *found.columns) == again
        # hot players by chunks
        assert not hot.build_moves()[1] and rows(hot.build_transfers()) == rows(plain.build_transfers())
    finally:
        driver_tables.STORED.clear()
        driver_tables.STORED.update(kept)
