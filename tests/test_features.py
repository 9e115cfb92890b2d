import random
from datetime import date, timedelta

from ledgerloom.operators import features

DAY = date(2010, 1, 1)


def base_rows(spark, rng, n=60):
    data = [(i, rng.randrange(3), rng.choice([None, 0, 1]), DAY + timedelta(days=rng.randrange(1500)), 1e6) for i in range(n)]
    return data, spark.createDataFrame(data, "pair_id long, player_id long, selling_club_id long, transfer_date date, buy_fee double")


def test_appearance_window_equals_brute_force(spark):
    rng = random.Random(1)
    pairs, base = base_rows(spark, rng)
    games = [(rng.randrange(25), rng.randrange(3), rng.randrange(2), DAY + timedelta(days=rng.randrange(-700, 1500)),
              rng.randrange(3), rng.randrange(2), rng.randrange(2), rng.randrange(2), rng.choice([0, 30, 90])) for _ in range(400)]
    app = spark.createDataFrame(games, "game_id long, player_id long, player_club_id long, date date, goals long, assists long, "
                                       "yellow_cards long, red_cards long, minutes_played long")
    got = {r.pair_id: r for r in features.with_appearances(base, app).collect()}
    for pair, player, club, on, _fee in pairs:
        inside = [g for g in games if g[1] == player and g[2] == club and g[8] > 0 and on - timedelta(days=730) <= g[3] < on]
        r = got[pair]
        assert (r.minutes, r.goals, r.assists) == tuple(sum(g[i] for g in inside) for i in (8, 4, 5))
        assert (r.yellow, r.red, r.games) == (sum(g[6] for g in inside), sum(g[7] for g in inside), len({g[0] for g in inside}))
        recent = sum(g[8] for g in inside if g[3] >= on - timedelta(days=365))
        assert (r.last, r.prev) == (recent, r.minutes - recent)


def test_valuation_points_equal_brute_force(spark):
    rng = random.Random(2)
    pairs, base = base_rows(spark, rng)
    facts = [(rng.randrange(3), DAY + timedelta(days=rng.randrange(-900, 1500)), float(rng.randrange(1, 50))) for _ in range(150)]
    got = {r.pair_id: r for r in features.with_valuations(
        base, spark.createDataFrame(facts, "player_id long, date date, market_value_in_eur double")).collect()}
    for pair, player, _club, on, _fee in pairs:
        known = [f for f in facts if f[0] == player and f[1] <= on - timedelta(days=30)]
        goal = on - timedelta(days=365)
        near = min(known, key=lambda f: (abs((f[1] - goal).days), f[1], f[2]), default=None)
        assert got[pair].peak == max((f[2] for f in known), default=None)
        assert got[pair].nearest == (near and near[2])


def exchanges(df):
    """Shuffles of a plan: what each is clustered by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1].split(")")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def odd_tables(spark, rng):
    """Buys, players and facts with missing keys and rows that come twice."""
    some = lambda n: rng.choice([None, *range(n)])
    day = lambda: rng.choice([None, *[DAY + timedelta(days=rng.randrange(1500)) for _ in range(9)]])
    buys = [(i, some(4), some(3), some(3), day(), float(1 + i), 2.0, rng.choice([None, 50.0, 150.0]), 0, 0, 20.0, 1.0, 1.0, rng.choice([0, 1, 1])) for i in range(60)]
    paired = spark.createDataFrame(buys + buys[:9], "transfer_id long, player_id long, from_club_id long, to_club_id long, transfer_date date, buy_fee double, "
                                   "sell_fee double, roi_pct double, is_gem int, gem_tier int, age_at_transfer double, tenure_years double, profit double, "
                                   "is_training_eligible int")
    people = [(p, f"P{p}", "Defender", "Defender", "Brazil", "South America", "A", "Solo", 180.0, "left", DAY) for p in (0, 1, 2, 2)]
    players = spark.createDataFrame(people, "player_id long, name string, position string, position_bucket string, citizenship string, citizenship_region string, "
                                            "agent_name string, agent_cluster string, height_in_cm double, foot string, date_of_birth date")
    clubs = spark.createDataFrame([(0, "c0", "L0", 2), (1, "c1", None, None), (1, "c1", "L1", 3)],
                                  "club_id long, name string, domestic_competition_id string, league_tier int")
    games = [(some(25), some(4), some(3), day(), some(3), some(2), some(2), some(2), rng.choice([None, 0, 30, 90])) for _ in range(300)]
    played = spark.createDataFrame(games + games[:40], "game_id long, player_id long, player_club_id long, date date, goals long, assists long, "
                                                       "yellow_cards long, red_cards long, minutes_played long")
    worth = [(some(4), day(), rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for _ in range(120)]
    values = spark.createDataFrame(worth + worth[:20], "player_id long, date date, market_value_in_eur double")
    seasons = [(some(4), rng.choice([None, *[f"{y}/{y + 1}" for y in range(2009, 2015)]]), rng.choice([None, "F", "O"]), rng.choice([0, 90, 900]),
                rng.choice([None, 1.5]), 0.5, some(9)) for _ in range(60)]
    xg = spark.createDataFrame(list(dict.fromkeys(seasons)), "player_id long, season string, competition_id string, minutes long, xg double, xa double, goals long")
    return paired, players, clubs, played, values, xg


def test_facts_of_odd_buys_equal_brute_force(spark):
    paired, players, clubs, played, values, xg = odd_tables(spark, random.Random(3))
    rows = features.training_rows(paired)
    got = features.with_facts(rows, played, values, xg).collect()
    assert sorted(r.pair_id for r in got) == sorted(r.pair_id for r in rows.collect())
    games, worth, seasons = ([r.asDict() for r in t.collect()] for t in (played, values, xg))
    for r in got:
        on, club, player = r.transfer_date, r.selling_club_id, r.player_id
        known = None not in (on, player)
        inside = [g for g in games if known and club is not None and (g["player_id"], g["player_club_id"]) == (player, club) and (g["minutes_played"] or 0) > 0
                  and g["date"] and on - timedelta(days=730) <= g["date"] < on]
        assert (r.minutes, r.goals) == (sum(g["minutes_played"] for g in inside), sum(g["goals"] or 0 for g in inside))
        assert r.games == len({g["game_id"] for g in inside})
        past = [(v["date"], v["market_value_in_eur"]) for v in worth if known and v["player_id"] == player and v["date"] and v["market_value_in_eur"] is not None
                and v["date"] <= on - timedelta(days=30)]
        near = min(past, key=lambda f: (abs((f[0] - on).days + 365), f[0], f[1]), default=(None, None))
        assert (r.peak, r.nearest) == (max((f[1] for f in past), default=None), near[1])
        own = [s for s in seasons if known and s["player_id"] == player and s["season"] == f"{on.year - 1}/{on.year}" and s["minutes"] > 0]
        assert r._xg_minutes == max((s["minutes"] for s in own), default=None)


def test_feature_table_keeps_all_rows_and_shuffles_buys_twice(spark):
    from ledgerloom.plans import analytics
    paired, players, clubs, played, values, xg = odd_tables(spark, random.Random(4))
    want = features.feature_matrix(features.training_base(paired, players, clubs), played, values, xg)
    got = analytics.feature_table(paired, players, clubs, played, values, xg)
    norm = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    assert got.columns == want.columns and norm(got) == norm(want) and got.count() > 20
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = [" ".join(c.split("#")[0] for c in x.split(", ")) for x in exchanges(analytics.feature_table(paired, players, clubs, played, values, xg))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # facts with buys by player and club; then buys, values, xG and players by player
    assert sorted(keys) == ["player_id 4", "player_id 4", "player_id 4", "player_id 4", "player_id selling_club_id 4"], keys
