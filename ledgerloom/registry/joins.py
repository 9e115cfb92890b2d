"""Joins."""

from pyspark.sql import functions as F

from ledgerloom.operators import chains, features, fuzzy, gems, matching, metrics, pairs, quality, views
from ledgerloom.plans import analytics
from ledgerloom.registry.base import query, rounded
from ledgerloom.registry.filters import CHAINS, COLS
from ledgerloom.sources.driver_tables import MIN_DEALS, TIER_CUTS, WINDOWS

FILL = "buy_fee, sell_fee, profit, roi_pct, annualized_roi_pct, player_position".split(", ")


@query("join_buy_sell", """
    SELECT player_id, club_id, buy_transfer_id, sell_transfer_id, buy_date, sell_date, buy_fee, sell_fee
    FROM all_matches WHERE rn = 1""")
def _(t):
    rows = pairs.match_buy_sell(pairs.fee_bearing(t.transfers))
    return rows.select("player_id", "club_id", "buy_transfer_id", "sell_transfer_id", "buy_date", "sell_date",
                       "buy_fee", "sell_fee")


@query("join_asof_club_profit", """
    SELECT l.transfer_id,
           CASE WHEN f.transfer_id IS NULL THEN l.buy_fee ELSE f.buy_fee END AS buy_fee,
           CASE WHEN f.transfer_id IS NULL THEN l.sell_fee ELSE f.sell_fee END AS sell_fee,
           CASE WHEN f.transfer_id IS NULL THEN l.profit ELSE f.profit END AS profit,
           round(CASE WHEN f.transfer_id IS NULL THEN l.roi_pct ELSE f.roi_pct END, 6) AS roi_pct,
           round(CASE WHEN f.transfer_id IS NULL THEN l.annualized_roi_pct ELSE f.annualized_roi_pct END, 6) AS annualized_roi_pct,
           CASE WHEN f.transfer_id IS NULL THEN l.player_position ELSE f.player_position END AS player_position
    FROM paired l LEFT JOIN (
        SELECT s.transfer_id, b.buy_fee, b.sell_fee, b.profit, b.roi_pct, b.annualized_roi_pct, b.player_position,
               row_number() OVER (PARTITION BY s.transfer_id ORDER BY b.transfer_date DESC, b.transfer_id DESC) AS rn
        FROM paired s JOIN paired b ON b.player_id = s.player_id AND b.to_club_id = s.from_club_id
         AND b.transfer_date < s.transfer_date
        WHERE s.profit IS NULL AND s.transfer_fee > 0 AND b.transfer_fee > 0 AND b.profit IS NOT NULL AND b.to_club_id <> 0
    ) f ON f.transfer_id = l.transfer_id AND f.rn = 1""")
def _(t):
    rows = pairs.propagate_profit_asof(t.paired)
    return rounded(rows, "roi_pct", "annualized_roi_pct").select("transfer_id", *FILL)


LAST_BUY = "l.profit IS NULL AND l.transfer_fee > 0 AND l.transfer_date > b.transfer_date"


@query("join_lastbuy_player_profit", f"""
    SELECT l.transfer_id, {", ".join(f"CASE WHEN {LAST_BUY} THEN b.{c} ELSE l.{c} END AS {c}" for c in ("buy_fee", "sell_fee", "profit", "player_position"))},
           {", ".join(f"round(CASE WHEN {LAST_BUY} THEN b.{c} ELSE l.{c} END, 6) AS {c}" for c in ("roi_pct", "annualized_roi_pct"))}
    FROM paired l LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY player_id, to_club_id ORDER BY transfer_date DESC, transfer_id DESC) AS rn
        FROM paired WHERE transfer_fee > 0 AND roi_pct IS NOT NULL AND to_club_id <> 0
    ) b ON b.player_id = l.player_id AND b.to_club_id = l.from_club_id AND b.rn = 1""")
def _(t):
    rows = pairs.propagate_profit_last_buy(t.paired)
    return rounded(rows, "roi_pct", "annualized_roi_pct").select("transfer_id", *FILL)


@query("join_peak_value", "SELECT buy_transfer_id, peak_value, round(value_creation_pct, 6) AS value_creation_pct FROM pairs")
def _(t):
    return rounded(pairs.with_peak_value(t.matched, t.valuations), "value_creation_pct").select(
        "buy_transfer_id", "peak_value", "value_creation_pct")


@query("join_player_info", "SELECT buy_transfer_id, player_name, player_position FROM pairs")
def _(t):
    return pairs.with_player_info(t.matched, t.players).select("buy_transfer_id", "player_name", "player_position")


@query("join_window_club", """
    SELECT w.club_id, c.name, c.club_code, c.domestic_competition_id, total_transfers, round(composite_score, 6) AS composite_score
    FROM window_scores w JOIN clubs c ON c.club_id = w.club_id WHERE window_key = '1998'""")
def _(t):
    scores = analytics.window_scores(t.pairs, WINDOWS, MIN_DEALS)
    rows = metrics.window_onto_clubs(scores, t.clubs, "1998")
    return rounded(rows, "composite_score").select(
        "club_id", "name", "club_code", "domestic_competition_id", "total_transfers", "composite_score")


def training_base(t):
    return features.training_base(t.paired, t.derived_players, t.tiered_clubs)


@query("join_training_base", """
    SELECT pair_id, player_id, player_name, selling_club_id, selling_club_name, selling_league, selling_league_tier,
           buying_club_id, buying_club_name, buying_league, buying_league_tier, transfer_date, buy_fee, sell_fee,
           round(roi_pct, 6) AS roi_pct, is_gem, gem_tier, round(age_at_buy, 6) AS age_at_buy, transfer_window,
           position, position_bucket, citizenship, citizenship_region, agent_name, agent_cluster, height_in_cm, foot
    FROM base""")
def _(t):
    rows = rounded(training_base(t), "roi_pct", "age_at_buy")
    return rows.drop("tenure_years", "profit", "date_of_birth")


@query("join_range_appearances", "SELECT pair_id, minutes, goals, assists, yellow, red, games FROM app_sums")
def _(t):
    base = training_base(t)
    keys = ["player_id", "selling_club_id", "transfer_date"]
    rows = base.select("pair_id", *keys).join(features.appearance_window(base, t.appearances), keys, "left")
    return rows.fillna(0).select("pair_id", *features.STATS, "games")


@query("join_nearest_valuation", "SELECT pair_id, nearest AS mv_12mo_before FROM mv_points")
def _(t):
    return features.market_value_features(training_base(t), t.valuations).select("pair_id", "mv_12mo_before")


@query("join_season_xg", """
    SELECT b.pair_id, x.minutes, x.xg, x.xa, x.goals FROM base b LEFT JOIN xg_one x ON x.player_id = b.player_id
     AND x.season = (year(b.transfer_date) - 1) || '/' || year(b.transfer_date)""")
def _(t):
    from ledgerloom.functions import labels
    rows = training_base(t).select("pair_id", "player_id", labels.xg_season(F.col("transfer_date")).alias("season"))
    return rows.join(features.season_xg(t.player_xg), ["player_id", "season"], "left").select(
        "pair_id", "minutes", "xg", "xa", "goals")


@query("join_anti_unpaired", f"SELECT {COLS} FROM unpaired")
def _(t):
    return chains.unpaired_sales(t.transfers, t.clubs).select(*CHAINS)


@query("join_anti_orphans", """
    SELECT 'transfers' AS source, count(*) AS orphans FROM transfers0 WHERE to_club_id NOT IN (SELECT club_id FROM clubs)
    UNION ALL SELECT 'valuations', count(*) FROM valuations v
        WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.player_id = v.player_id AND p.agent_name IS NOT NULL)
    UNION ALL SELECT 'player_clubs', count(DISTINCT current_club_id) FROM players
        WHERE current_club_id IS NOT NULL AND current_club_id NOT IN (SELECT club_id FROM clubs)""")
def _(t):
    count = F.count(F.lit(1)).alias("orphans")
    known = t.players.filter(F.col("agent_name").isNotNull())
    parts = {
        "transfers": quality.missing_keys(t.transfers, "to_club_id", t.clubs, "club_id").agg(count),
        "valuations": quality.missing_keys(t.valuations, "player_id", known, "player_id").agg(count),
        "player_clubs": quality.missing_keys(t.players, "current_club_id", t.clubs, "club_id").agg(
            F.count_distinct("current_club_id").alias("orphans")),
    }
    frames = [df.select(F.lit(name).alias("source"), "orphans") for name, df in parts.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("join_notin_clubs", """
    SELECT t.player_id, p.name AS player_name, first(from_club_id ORDER BY transfer_fee DESC NULLS LAST, transfer_id DESC) AS from_club_id,
           first(from_club_name ORDER BY transfer_fee DESC NULLS LAST, transfer_id DESC) AS from_club_name,
           count(*) AS occurrences, round(max(transfer_fee), 0) AS max_fee
    FROM transfers t JOIN players p ON p.player_id = t.player_id
    WHERE from_club_id IS NOT NULL AND from_club_id NOT IN (SELECT club_id FROM clubs)
    GROUP BY 1, 2""")
def _(t):
    return quality.orphan_edge_players(t.transfers, t.players, t.clubs, top=None)


@query("join_semi_league", f"""
    SELECT DISTINCT {COLS} FROM transfers t JOIN clubs c ON (c.club_id = t.from_club_id OR c.club_id = t.to_club_id)
    WHERE c.domestic_competition_id = 'NATION_7'""")
def _(t):
    return views.in_league(t.transfers, t.clubs, "NATION_7").select(*CHAINS)


@query("join_self_swapped_loans", f"SELECT {COLS} FROM transfers WHERE transfer_id IN (SELECT transfer_id FROM loans)")
def _(t):
    return chains.swapped_loans(t.transfers).select(*CHAINS)


@query("join_self_sell_before_buy", """
    SELECT i.player_id, p.name AS player_name, i.club_id AS sell_club_id, c.name AS sell_club_name, sell_transfer_id, buy_transfer_id,
           sell_date, buy_date, round(sell_fee, 0) AS sell_fee
    FROM impossible i JOIN players p ON p.player_id = i.player_id LEFT JOIN clubs c ON c.club_id = i.club_id
    ORDER BY i.sell_fee + i.buy_fee DESC NULLS LAST, sell_transfer_id, buy_transfer_id LIMIT 20""")
def _(t):
    return chains.sold_before_bought(t.transfers, t.players, t.clubs)


@query("join_silent_gaps", """
    SELECT p.player_id, p.name, round(max(f.transfer_fee), 0) AS max_fee, count(a.transfer_id) AS transfer_count
    FROM (SELECT player_id, min(transfer_date) AS first FROM transfers0 WHERE transfer_fee > 100000 GROUP BY 1) m
    JOIN players p ON p.player_id = m.player_id
    JOIN transfers0 f ON f.player_id = m.player_id AND f.transfer_date = m.first AND f.transfer_fee > 100000
    JOIN transfers0 a ON a.player_id = m.player_id
    WHERE f.from_club_id IS NULL OR f.from_club_id NOT IN (SELECT club_id FROM clubs)
    GROUP BY 1, 2""")
def _(t):
    return chains.silent_gaps(t.transfers, t.players, t.clubs)


@query("join_missing_origin", "SELECT missing FROM missing_first")
def _(t):
    return chains.missing_first_origin(t.transfers)


@query("join_underage", """
    SELECT t.transfer_id, t.player_id, t.transfer_date FROM transfers0 t JOIN players p ON p.player_id = t.player_id
    WHERE t.transfer_date < p.date_of_birth + INTERVAL 14 YEAR""")
def _(t):
    return quality.underage(t.transfers, t.players).select("transfer_id", "player_id", "transfer_date")


def external_names(t):
    """Outside spellings of the players: turned around, one letter short, or shouted."""
    p, s = F.col("p_partkey"), F.col("l_suppkey")
    parts = F.split("p_name", " ")
    turned = F.concat_ws(" ", F.element_at(parts, -1), F.element_at(parts, 1))
    short = F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5, 100)"))
    name = F.when(p % 3 == 0, turned).when(p % 3 == 1, short).otherwise(F.upper("p_name"))
    team = F.when(s % 2 == 0, F.concat(F.lit("Supplier "), F.lpad(s.cast("string"), 9, "0"))).otherwise(F.lit(""))
    lines = t.raw("lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_shipdate", "l_quantity",
                                     "l_discount", "l_orderkey", "l_linestatus", "l_linenumber")
    return lines.join(t.raw("part").select("p_partkey", "p_name"), "p_partkey").select(
        name.alias("name"), team.alias("team"), "l_shipdate", "l_quantity", "l_discount", "l_orderkey", "l_linestatus",
        "l_linenumber")


@query("join_fuzzy_player", "SELECT name, team, player_id, round(match_score, 6) AS match_score FROM links")
def _(t):
    return rounded(fuzzy.link_players(external_names(t), t.players), "match_score")


def club_searches(t):
    """Each customer's name searched among the suppliers of their orders."""
    lines = t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("target_id"))
    hits = lines.join(orders, "o_orderkey").select("target_id", "s_suppkey").distinct()
    results = hits.join(t.raw("supplier"), "s_suppkey").select(
        "target_id", F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("name"))
    targets = t.raw("customer").select(
        F.col("c_custkey").alias("target_id"), F.regexp_replace("c_name", "Customer", "Suplier").alias("name"))
    return targets, results


@query("join_fuzzy_club")
def _(t):
    return rounded(fuzzy.best_club(*club_searches(t)), "score")


@query("join_fingerprint", """
    SELECT candidate_id, player_id, best_score::DOUBLE AS best_score, array_to_string(best_reasons, '|') AS best_reasons, ledger_id FROM graded""")
def _(t):
    rows = matching.best_match(t.candidates, t.sourced)
    return rows.select("candidate_id", "player_id", "best_score", F.array_join("best_reasons", "|").alias("best_reasons"),
                       "ledger_id")


@query("join_tier_to_club", "SELECT club_id, name, domestic_competition_id, league_tier FROM tiered_clubs")
def _(t):
    rates = gems.league_gem_rate(t.paired, t.clubs)
    return gems.tier_to_clubs(t.clubs, gems.league_tiers(rates, TIER_CUTS)).select(
        "club_id", "name", "domestic_competition_id", "league_tier")
