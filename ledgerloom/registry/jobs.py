"""Composed jobs."""

from pyspark.sql import functions as F

from ledgerloom.operators import matching, quality
from ledgerloom.plans import analytics
from ledgerloom.registry.aggregates import METRIC_SQL, shown, stored_pairs
from ledgerloom.registry.base import query, rounded
from ledgerloom.registry.joins import external_names
from ledgerloom.registry.scalars import HOT
from ledgerloom.sources.driver_tables import MIN_DEALS, TIER_CUTS, WINDOWS

PAIR_VALUES = ["roi_pct", "annualized_roi_pct", "tenure_years", "value_creation_pct"]


@query("pipe_pairs", "SELECT player_id, club_id, buy_transfer_id, sell_transfer_id, buy_date, sell_date, buy_fee, sell_fee, profit, tenure_days, "
       "peak_value, player_name, player_position, " + ", ".join(f"round({c}, 6) AS {c}" for c in PAIR_VALUES) + " FROM pairs")
def _(t):
    return rounded(analytics.all_pairs(t.transfers, t.valuations, t.players), *PAIR_VALUES)


@query("pipe_pairs_table", """
    SELECT player_id, buy_transfer_id, sell_transfer_id, buy_fee, sell_fee, round(roi_pct, 6) AS roi_pct, club_id AS holding_club_id,
           round(tenure_years, 6) AS tenure_years, round(age_at_buy, 6) AS age_at_buy, is_gem, gem_tier, 1.0::DOUBLE AS confidence_score,
           is_training_eligible FROM pair_rows""")
def _(t):
    return rounded(stored_pairs(t), "roi_pct", "tenure_years", "age_at_buy")


@query("pipe_club_scores", f"SELECT club_id, {METRIC_SQL}, round(composite_score, 6) AS composite_score FROM club_scores")
def _(t):
    return shown(analytics.club_scores(t.pairs, MIN_DEALS), "composite_score")


@query("pipe_full_analytics", f"""
    SELECT 'all' AS window_key, club_id, {METRIC_SQL}, round(composite_score, 6) AS composite_score FROM club_scores
    UNION ALL BY NAME SELECT window_key, club_id, {METRIC_SQL}, round(composite_score, 6) AS composite_score FROM window_scores""")
def _(t):
    return shown(analytics.scores_by_period(t.pairs, WINDOWS, MIN_DEALS), "composite_score")


@query("pipe_league_tiers", "SELECT club_id, domestic_competition_id, league_tier FROM tiered_clubs")
def _(t):
    return analytics.league_tiers(t.paired, t.clubs, TIER_CUTS).select("club_id", "domestic_competition_id", "league_tier")


APP = ["goals_per_90", "assists_per_90", "g_plus_a_per_90", "minutes_trend", "cards_per_90"]
MV = ["mv_trend", "fee_vs_mv", "peak_mv_to_fee"]
XG = ["xg_per_90", "xa_per_90", "goals_vs_xg"]


def sql_round(alias, columns):
    return ", ".join(f"round({alias}.{c}, 6) AS {c}" for c in columns)


@query("pipe_features", f"""
    SELECT base.pair_id, base.player_id, player_name, transfer_date, is_gem, gem_tier, round(roi_pct, 6) AS roi_pct, base.buy_fee, sell_fee,
           selling_club_name, buying_club_name, selling_league, buying_league, agent_name AS agent_name_raw, position AS position_raw,
           {sql_round('a', APP)}, a.minutes_last_season, a.minutes_prev_season, a.games_played, a.has_appearance_data,
           m.mv_at_transfer, m.mv_12mo_before, {sql_round('m', MV)},
           round(age_at_buy, 6) AS age_at_buy, height_in_cm, 0 AS is_international,
           CASE WHEN position_bucket IS NULL OR position_bucket = 'Other' THEN 1 ELSE 0 END AS is_other_position, {HOT},
           selling_league_tier, buying_league_tier, round(ln(base.buy_fee + 1), 6) AS log_buy_fee,
           buying_league_tier - selling_league_tier AS league_jump, (transfer_window = 'winter')::INT AS is_january_window,
           NULL::DOUBLE AS contract_years_remaining, {sql_round('x', XG)}, x.has_xg_data
    FROM base JOIN app_features a ON a.pair_id = base.pair_id JOIN mv_features m ON m.pair_id = base.pair_id
    JOIN xg_rates x ON x.pair_id = base.pair_id""")
def _(t):
    rows = analytics.feature_table(t.paired, t.derived_players, t.tiered_clubs, t.appearances, t.valuations, t.player_xg)
    return rounded(rows, "roi_pct", "age_at_buy", "log_buy_fee", *APP, *MV, *XG)


CHECKS = [
    ("Referential", "orphaned_transfers", "SELECT count(*) AS n FROM transfers0 WHERE player_id NOT IN (SELECT player_id FROM players)"),
    ("Referential", "orphaned_valuations", "SELECT count(*) FROM valuations WHERE player_id NOT IN (SELECT player_id FROM players)"),
    ("Referential", "missing_player_clubs",
     "SELECT count(DISTINCT current_club_id) FROM players WHERE current_club_id NOT IN (SELECT club_id FROM clubs)"),
    ("Temporal", "future_transfers", "SELECT count(*) FROM transfers0 WHERE transfer_date > DATE '2001-01-01'"),
    ("Temporal", "underage_transfers", "SELECT count(*) FROM transfers0 t JOIN players p ON p.player_id = t.player_id "
     "WHERE transfer_date < p.date_of_birth + INTERVAL 14 YEAR"),
    ("Numerical", "fees_above_cap", "SELECT count(*) FROM transfers0 WHERE transfer_fee > 500000000"),
    ("Numerical", "market_values_above_cap", "SELECT count(*) FROM players WHERE market_value_in_eur > 300000000"),
    ("Numerical", "roi_above_cap", "SELECT count(*) FROM matched WHERE abs(roi_pct) > 10000"),
    ("Dedup", "duplicate_transfers", "SELECT count(*) FROM dup_transfers"),
    ("Dedup", "duplicate_valuations", "SELECT count(*) FROM dup_valuations"),
]
CHECK_ROWS = " UNION ALL ".join(f"SELECT '{c}' AS category, '{n}' AS name, ({q}) AS cnt" for c, n, q in CHECKS)


@query("pipe_consistency", f"""
    SELECT category, name AS "check", cnt AS count, CASE WHEN cnt = 0 THEN 'info' WHEN name = 'duplicate_transfers' THEN 'error' ELSE 'warning' END AS severity
    FROM ({CHECK_ROWS})""")
def _(t):
    today = F.lit("2001-01-01").cast("date")
    return quality.consistency_counts(t.transfers, t.players, t.clubs, t.valuations, t.paired, today)


@query("pipe_graph_report", """
    UNPIVOT (SELECT * FROM health) ON total_players, total_edges, timeline_violations, disconnected_segments, orphan_players,
        duplicate_edges, missing_continuity, graph_health_score INTO NAME metric VALUE value""")
def _(t):
    return quality.graph_report(t.transfers, t.players, t.clubs)


@query("pipe_reconcile_once", """
    SELECT candidate_id, s.player_id, p.name AS player_name, from_id AS from_club_id, to_id AS to_club_id, raw_from_name AS from_club_name,
           raw_to_name AS to_club_name, on_date AS transfer_date, season AS transfer_season, fee AS transfer_fee, s.market_value_in_eur,
           source_id, array_to_string(reasons[:5], '|') AS confidence_reasons, round((on_date - p.date_of_birth) / 365.25::DOUBLE, 6) AS age_at_transfer,
           score AS confidence_score, fingerprint_hash
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, fingerprint_hash ORDER BY candidate_id) AS rn FROM scored
          WHERE (decision = 'safe' OR (decision = 'review' AND score >= 0.85)) AND year(on_date) >= 1996) s
    LEFT JOIN players p ON p.player_id = s.player_id WHERE rn = 1""")
def _(t):
    rows = analytics.reconcile_once(t.candidates, t.sourced, t.players, min_year=1996)
    return rounded(rows, "age_at_transfer").withColumn("confidence_reasons", F.array_join("confidence_reasons", "|"))


@query("pipe_shot_report", """
    SELECT CAST(l_linenumber AS INTEGER) AS competition_id, count(*) AS total, count(player_id) AS matched,
           round(count(player_id) / count(*)::DOUBLE * 100, 1) AS match_rate
    FROM outside_rows r JOIN links l ON l.name = r.name AND l.team = r.team GROUP BY 1""")
def _(t):
    """Shots found and matched per competition."""
    from ledgerloom.operators import fuzzy, sets
    shots = external_names(t).withColumn("competition_id", F.col("l_linenumber").cast("int"))
    links = fuzzy.link_players(shots, t.players)
    rows = shots.join(links, sets.same_key(shots, links, ["name", "team"]), "left").drop(links["name"], links["team"])
    return fuzzy.match_report(rows, "competition_id")


@query("pipe_scored_candidates", """
    SELECT candidate_id, best_score::DOUBLE AS best_score, score, decision FROM scored""")
def _(t):
    return matching.scored(t.candidates, t.sourced).select("candidate_id", "best_score", "score", "decision")


@query("pipe_shots", """
    SELECT CAST(l_linenumber AS INTEGER) AS competition_id, count(*) AS shots, count(DISTINCT player_id) AS players, round(sum(l_discount), 6) AS xg
    FROM outside_rows r JOIN links l ON l.name = r.name AND l.team = r.team WHERE player_id IS NOT NULL GROUP BY 1""")
def _(t):
    """Every line as a shot by an outside player name, linked and written per competition."""
    from ledgerloom.session import new_folder
    from ledgerloom.sources.sinks import replace_partitions
    shots = external_names(t).select(
        F.col("name").alias("source_player_name"), F.col("team").alias("team_name"),
        F.col("l_linenumber").alias("competition_id"), F.col("l_orderkey").alias("match_id"),
        F.col("l_discount").alias("xg"))
    path = new_folder(t.spark, "shots")
    replace_partitions(analytics.linked_shots(shots, t.players), path, "competition_id")
    return rounded(t.spark.read.parquet(path).groupBy("competition_id").agg(
        F.count(F.lit(1)).alias("shots"), F.count_distinct("player_id").alias("players"), F.sum("xg").alias("xg")), "xg")


def xg_rows(t):
    rows = external_names(t)
    number = {c: F.col("l_discount").cast("string") for c in analytics.XG_NUMBERS}
    return rows.select(
        "name", "team", F.year("l_shipdate").alias("season_start"), F.col("l_linestatus").alias("competition_id"),
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", "l_quantity", "l_discount",
                    "l_shipdate").alias("source_id"),
        (F.col("l_quantity") * 4).cast("string").alias("minutes"), *[v.alias(c) for c, v in number.items()])


XG_SQL = ", ".join("round(l_discount, 6) AS " + c if kind == "double" else f"CAST(trunc(l_discount) AS BIGINT) AS {c}"
                   for c, kind in analytics.XG_NUMBERS.items())


@query("pipe_xg", f"""
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY player_id, season, competition_id ORDER BY source_id DESC) AS rn FROM (
            SELECT player_id, year(l_shipdate) || '/' || (year(l_shipdate) + 1) AS season, l_linestatus AS competition_id, {XG_SQL},
                   CAST(l_quantity * 4 AS BIGINT) AS minutes, round(match_score, 6) AS match_score,
                   lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' || l_quantity || '-' || l_discount || '-' || l_shipdate AS source_id
            FROM outside_rows r JOIN links l ON l.name = r.name AND l.team = r.team WHERE player_id IS NOT NULL AND l_quantity * 4 >= 90))
    WHERE rn = 1""")
def _(t):
    return rounded(analytics.linked_xg(xg_rows(t), t.players), "match_score", "xg", "xa", "npxg", "xg_chain", "xg_buildup")
