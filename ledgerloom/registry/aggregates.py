"""Aggregations and window functions."""

from pyspark.sql import functions as F

from ledgerloom.operators import chains, features, gems, matching, metrics, pairs, quality, views
from ledgerloom.plans import analytics
from ledgerloom.registry.base import query, rounded
from ledgerloom.registry.filters import scored_clubs
from ledgerloom.registry.joins import external_names, training_base
from ledgerloom.sources.documents import season_performance
from ledgerloom.sources.driver_tables import MIN_DEALS, WINDOWS

MEDIANS = ["median_roi", "hit_rate", "value_creation", "annualized_roi", "profit_per_deal", "buying_club_premium"]
METRIC_SQL = "total_transfers, total_profit, " + ", ".join(f"round({m}, 4) AS {m}" for m in MEDIANS)


def shown(df, *more):
    return rounded(rounded(df, *MEDIANS, digits=4), *more)


@query("agg_club_metrics", f"SELECT club_id, {METRIC_SQL} FROM club_groups")
def _(t):
    return shown(metrics.club_metrics(t.pairs))


@query("agg_buying_premium", "SELECT club_id, round(buying_club_premium, 4) AS buying_club_premium FROM club_groups")
def _(t):
    return rounded(metrics.club_metrics(t.pairs).select("club_id", "buying_club_premium"), "buying_club_premium", digits=4)


@query("agg_having_min_deals", "SELECT club_id, total_transfers FROM club_groups WHERE total_transfers >= 200")
def _(t):
    return metrics.having_min_deals(metrics.club_metrics(t.pairs), 200).select("club_id", "total_transfers")


@query("agg_window_metrics", f"SELECT window_key, club_id, {METRIC_SQL} FROM window_groups")
def _(t):
    rows = metrics.in_windows(t.pairs, WINDOWS)
    return shown(metrics.club_metrics(rows, ("window_key", "club_id"), MIN_DEALS))


@query("agg_minmax_composite", "SELECT club_id, round(composite_score, 6) AS composite_score FROM club_scores")
def _(t):
    return rounded(analytics.club_scores(t.pairs, MIN_DEALS).select("club_id", "composite_score"), "composite_score")


@query("agg_league_spending", """
    SELECT domestic_competition_id AS id, domestic_competition_id AS name, count(club_id) AS total_clubs,
           CAST(coalesce(sum(total_transfers), 0) AS BIGINT) AS total_transfers, round(sum(total_profit), 0) AS total_profit,
           round(sum(total_profit) / count(club_id), 0) AS avg_profit_per_club
    FROM scored_clubs WHERE domestic_competition_id IS NOT NULL AND total_profit IS NOT NULL
    GROUP BY 1 HAVING sum(total_transfers) >= 3""")
def _(t):
    return metrics.league_spending(scored_clubs(t), MIN_DEALS)


@query("agg_dashboard", """
    SELECT (SELECT count(transfer_id) FROM transfers0) AS total_transfers, (SELECT count(club_id) FROM clubs) AS total_clubs,
           (SELECT coalesce(sum(total_profit), 0) FROM scored_clubs) AS total_profit, buy_transfer_id AS biggest_profit_transfer_id,
           profit AS biggest_profit
    FROM matched ORDER BY profit DESC, buy_transfer_id LIMIT 1""")
def _(t):
    return metrics.dashboard(t.transfers, scored_clubs(t), t.matched)


GEM = "roi_pct >= 100 AND age_at_transfer <= 23"


@query("agg_gem_leagues", f"""
    SELECT c.domestic_competition_id AS origin_league, count(DISTINCT t.transfer_id) AS total_deals,
           count(DISTINCT CASE WHEN {GEM} THEN t.transfer_id END) AS gems,
           round(avg(CASE WHEN {GEM} THEN roi_pct END), 1) AS avg_gem_roi, round(sum(CASE WHEN {GEM} THEN profit END), 0) AS gem_profit,
           round(avg(CASE WHEN {GEM} THEN buy_fee END), 0) AS avg_buy_fee, round(avg(CASE WHEN {GEM} THEN sell_fee END), 0) AS avg_sell_fee,
           round(count(DISTINCT CASE WHEN {GEM} THEN t.transfer_id END) * 100.0::DOUBLE / count(DISTINCT t.transfer_id), 1) AS gem_rate_pct
    FROM paired t JOIN clubs c ON c.club_id = t.from_club_id
    WHERE roi_pct IS NOT NULL AND c.domestic_competition_id IS NOT NULL
    GROUP BY 1 HAVING count(DISTINCT t.transfer_id) >= 10 ORDER BY gems DESC, 1 LIMIT 30""")
def _(t):
    return gems.gem_leagues(t.paired, t.clubs)


@query("agg_gem_clubs", f"""
    SELECT c.club_id AS from_club_id, c.name AS club, c.domestic_competition_id AS league, count(DISTINCT t.transfer_id) AS sold,
           count(DISTINCT CASE WHEN {GEM} THEN t.transfer_id END) AS gems, round(sum(CASE WHEN {GEM} THEN profit END), 0) AS gem_profit,
           round(count(DISTINCT CASE WHEN {GEM} THEN t.transfer_id END) * 100.0::DOUBLE / count(DISTINCT t.transfer_id), 1) AS gem_pct
    FROM paired t JOIN clubs c ON c.club_id = t.from_club_id
    WHERE roi_pct IS NOT NULL AND c.domestic_competition_id IS NOT NULL
    GROUP BY 1, 2, 3 HAVING count(DISTINCT t.transfer_id) >= 5 ORDER BY gems DESC, 1 LIMIT 30""")
def _(t):
    return gems.gem_clubs(t.paired, t.clubs)


@query("agg_gem_signature", f"""
    SELECT coalesce(player_position, 'Unknown') AS position, count(*) AS cnt, round(avg(age_at_transfer), 1) AS avg_age,
           round(avg(buy_fee), 0) AS avg_buy, round(avg(sell_fee), 0) AS avg_sell, round(avg(roi_pct), 1) AS avg_roi,
           round(avg(tenure_years), 1) AS avg_tenure
    FROM paired WHERE {GEM} AND buy_fee IS NOT NULL AND sell_fee IS NOT NULL GROUP BY 1""")
def _(t):
    return gems.gem_signature(t.paired)


@query("agg_gem_agents", f"""
    SELECT p.agent_name AS agent, count(DISTINCT t.transfer_id) AS deals,
           count(DISTINCT CASE WHEN {GEM} THEN t.transfer_id END) AS gems,
           round(avg(CASE WHEN {GEM} THEN roi_pct END), 1) AS avg_gem_roi, round(sum(CASE WHEN {GEM} THEN profit END), 0) AS gem_profit
    FROM paired t JOIN players p ON p.player_id = t.player_id WHERE roi_pct IS NOT NULL AND p.agent_name IS NOT NULL
    GROUP BY 1 HAVING gems >= 3 ORDER BY gems DESC, 1 LIMIT 20""")
def _(t):
    return gems.gem_agents(t.paired, t.players)


@query("agg_league_gem_rate", "SELECT league_id, total_deals, gems, gem_rate FROM gem_rates")
def _(t):
    return gems.league_gem_rate(t.paired, t.clubs)


@query("agg_tier_summary", """
    SELECT league_tier, count(*) AS cnt, round(avg(roi_pct), 1) AS avg_roi, round(sum(profit), 0) AS total_profit
    FROM tiered_clubs c JOIN paired t ON t.from_club_id = c.club_id WHERE roi_pct IS NOT NULL AND league_tier IS NOT NULL GROUP BY 1""")
def _(t):
    return gems.tier_summary(t.tiered_clubs, t.paired)


@query("agg_agent_size", "SELECT agent_name, players FROM agent_sizes")
def _(t):
    return gems.agent_sizes(t.players)


PER90 = ["goals_per_90", "assists_per_90", "g_plus_a_per_90", "cards_per_90"]


@query("agg_per90", "SELECT pair_id, games_played, has_appearance_data, " + ", ".join(f"round({c}, 6) AS {c}" for c in PER90)
       + " FROM app_features")
def _(t):
    rows = features.appearance_features(training_base(t), t.appearances)
    return rounded(rows, *PER90).select("pair_id", "games_played", "has_appearance_data", *PER90)


@query("agg_minutes_split", "SELECT pair_id, minutes_last_season, minutes_prev_season, round(minutes_trend, 6) AS minutes_trend FROM app_features")
def _(t):
    rows = features.appearance_features(training_base(t), t.appearances)
    return rounded(rows, "minutes_trend").select("pair_id", "minutes_last_season", "minutes_prev_season", "minutes_trend")


MV = ["mv_trend", "fee_vs_mv", "peak_mv_to_fee"]


@query("agg_mv_features", "SELECT pair_id, mv_at_transfer, mv_12mo_before, " + ", ".join(f"round({c}, 6) AS {c}" for c in MV)
       + " FROM mv_features")
def _(t):
    return rounded(features.market_value_features(training_base(t), t.valuations), *MV)


@query("agg_season_performance", """
    SELECT l_partkey AS player_id, year(l_shipdate)::VARCHAR AS season, 'C' || l_linenumber AS competition_id,
           first(l_suppkey ORDER BY l_shipdate DESC, l_suppkey DESC) AS club_id,
           count(*) FILTER (WHERE m > 0) AS appearances, count(*) FILTER (WHERE l_returnflag = 'A') AS starts,
           CAST(sum(m) AS BIGINT) AS minutes_played, CAST(sum(l_linenumber % 3) AS BIGINT) AS goals, CAST(sum(l_linenumber % 2) AS BIGINT) AS assists,
           CAST(sum((l_linenumber = 7)::INT) AS BIGINT) AS yellow_cards, CAST(sum((l_tax = 0)::INT) AS BIGINT) AS red_cards, count(*) AS games_count
    FROM (SELECT *, CASE WHEN l_discount < 0.03 THEN 0 ELSE CAST(l_quantity * 2 AS BIGINT) END AS m FROM lineitem)
    WHERE m > 0 OR l_returnflag = 'A' GROUP BY 1, 2, 3""")
def _(t):
    line = F.col("l_linenumber")
    games = t.raw("lineitem").select(
        F.col("l_partkey").alias("player_id"), F.year("l_shipdate").cast("string").alias("season"),
        F.concat(F.lit("C"), line.cast("string")).alias("competition_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_suppkey").alias("club_id"),
        F.when(F.col("l_discount") < 0.03, 0).otherwise((F.col("l_quantity") * 2).cast("bigint")).alias("minutes"),
        (F.col("l_returnflag") == "A").alias("is_starting"), (line % 3).cast("bigint").alias("goals"),
        (line % 2).cast("bigint").alias("assists"), F.when(line == 7, 1).otherwise(0).alias("yellow"),
        F.when(F.col("l_tax") == 0, 1).otherwise(0).alias("red"))
    return season_performance(games)


@query("agg_dup_transfers", "SELECT * FROM (SELECT player_id, to_club_id, year(transfer_date)::INTEGER AS year, count(*) AS cnt "
       "FROM transfers0 GROUP BY 1, 2, 3 HAVING count(*) > 1) UNION ALL SELECT player_id, to_club_id, -1, cnt FROM dup_transfers")
def _(t):
    by_year = t.transfers.withColumn("year", F.year("transfer_date"))
    loose = quality.duplicates(by_year, ["player_id", "to_club_id", "year"], ["player_id"])
    exact = quality.duplicate_transfers(t.transfers).select("player_id", "to_club_id", F.lit(-1).alias("year"), "cnt")
    return loose.unionByName(exact)


@query("agg_dup_valuations", "SELECT * FROM dup_valuations")
def _(t):
    return quality.duplicate_valuations(t.valuations)


@query("agg_broken_chains", """
    SELECT u.player_id, p.name, round(sum(transfer_fee), 0) AS total_fee, count(*) AS sell_count
    FROM unpaired u JOIN players p ON p.player_id = u.player_id GROUP BY 1, 2""")
def _(t):
    return chains.broken_chains(t.transfers, t.players, t.clubs)


@query("agg_unpaired_total", "SELECT count(*) AS count, round(coalesce(sum(transfer_fee), 0), 0) AS total_value FROM unpaired")
def _(t):
    return chains.unpaired_total(t.transfers, t.clubs)


@query("agg_broken_player_count", """
    SELECT count(DISTINCT player_id) AS players, round(sum(transfer_fee), 0) AS total_value FROM transfers0 t
    WHERE transfer_fee > 100000 AND from_club_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM transfers0 a WHERE a.player_id = t.player_id AND a.to_club_id = t.from_club_id)""")
def _(t):
    return chains.broken_player_count(t.transfers)


@query("agg_missing_origin_players", """
    SELECT count(DISTINCT t.player_id) AS players FROM transfers0 t JOIN players p ON p.player_id = t.player_id
    WHERE transfer_fee > 100000 AND (from_club_id IS NULL OR from_club_id NOT IN (SELECT club_id FROM clubs))""")
def _(t):
    return chains.missing_origin_players(t.transfers, t.players, t.clubs)


@query("agg_confidence_bands", """
    SELECT count(*) FILTER (WHERE score >= 0.9) AS high, count(*) FILTER (WHERE score >= 0.7 AND score < 0.9) AS medium,
           count(*) FILTER (WHERE score < 0.7) AS low FROM scored""")
def _(t):
    return gems.confidence_bands(matching.scored(t.candidates, t.sourced))


def stored_pairs(t):
    ages = t.ledger.withColumnRenamed("age_at_transfer", "age_at_buy")
    paid = pairs.fee_bearing(ages)
    rows = pairs.with_returns(pairs.min_buy_fee(pairs.match_buy_sell(paid, ("age_at_buy",))))
    return pairs.pair_table(rows, training_cutoff="1999-01-01")


@query("agg_gem_distribution", """
    SELECT 'gem_tier' AS category, gem_tier::VARCHAR AS key, count(*) AS rows FROM pair_rows GROUP BY 1, 2
    UNION ALL SELECT 'training_eligible', is_training_eligible::VARCHAR, count(*) FROM pair_rows GROUP BY 1, 2
    UNION ALL SELECT 'training_class', (gem_tier >= 1)::INT::VARCHAR, count(*) FROM pair_rows WHERE is_training_eligible = 1 GROUP BY 1, 2
    UNION ALL SELECT 'confidence', 'high', count(*) FROM pair_rows GROUP BY 1, 2
    UNION ALL SELECT 'roi_above_5000', 'yes', count(*) FROM pair_rows WHERE roi_pct > 5000 GROUP BY 1, 2""")
def _(t):
    return gems.distribution(stored_pairs(t))


@query("agg_feature_coverage", """
    SELECT section, count(*) AS rows, CAST(sum(hit) AS BIGINT) AS covered, round(avg(hit) * 100, 1) AS percent FROM (
        SELECT 'appearances' AS section, has_appearance_data AS hit FROM app_features
        UNION ALL SELECT 'market_value', (mv_at_transfer IS NOT NULL)::INT FROM mv_features
        UNION ALL SELECT 'age', (age_at_buy IS NOT NULL)::INT FROM base
        UNION ALL SELECT 'height', (height_in_cm IS NOT NULL)::INT FROM base
        UNION ALL SELECT 'xg', has_xg_data FROM xg_rates
        UNION ALL SELECT 'gems', is_gem FROM base) GROUP BY 1""")
def _(t):
    return features.coverage(features.feature_matrix(training_base(t), t.appearances, t.valuations, t.player_xg))


@query("agg_health_score", "SELECT * FROM health")
def _(t):
    return quality.health_report(t.transfers, t.players, t.clubs)


@query("agg_orphan_clubs", "SELECT cid, name, total_cnt FROM orphans")
def _(t):
    return quality.orphan_clubs(t.transfers, t.clubs)


@query("agg_match_report", """
    SELECT l_linestatus AS league, count(*) AS found, count(*) FILTER (WHERE player_id IS NOT NULL AND l_quantity >= 10) AS matched,
           count(*) FILTER (WHERE player_id IS NOT NULL AND l_quantity < 10) AS short, count(*) FILTER (WHERE player_id IS NULL) AS unmatched
    FROM outside_rows r JOIN links l ON l.name = r.name AND l.team = r.team GROUP BY 1""")
def _(t):
    from ledgerloom.operators import fuzzy
    names = external_names(t)
    rows = names.withColumns({"minutes": F.col("l_quantity").cast("string"), "league": F.col("l_linestatus")})
    return analytics.xg_report(rows, fuzzy.link_players(names, t.players), "league", min_minutes=10)


#: Rows of a player above which the stitched twins cut them into chunks.
STITCHED = 20


# --- window functions --------------------------------------------------------------------


@query("win_lag_breaks", "SELECT player_id, breaks FROM breaks")
def _(t):
    return chains.lag_breaks(t.transfers)


@query("win_lag_breaks_stitched", "SELECT player_id, breaks FROM breaks")
def _(t):
    """The same with most players cut into chunks by day."""
    return chains.lag_breaks(t.transfers, hot_rows=STITCHED)


@query("win_career_gaps", """
    SELECT player_id, transfer_id, from_club_name AS "from", to_club_name AS "to", transfer_date AS date,
           prev_to AS expected_from_club_id, from_club_id AS actual_from_club_id
    FROM lagged WHERE n > 1 AND prev_to IS DISTINCT FROM from_club_id""")
def _(t):
    return chains.career_gaps(t.transfers)


@query("win_career_gaps_stitched", """
    SELECT player_id, transfer_id, transfer_date AS date, prev_to AS expected_from_club_id, from_club_id AS actual_from_club_id
    FROM lagged WHERE n > 1 AND prev_to IS DISTINCT FROM from_club_id""")
def _(t):
    return chains.career_gaps(t.transfers, hot_rows=STITCHED).drop("from", "to")


@query("win_ledger_stitched", "SELECT * FROM transfers")
def _(t):
    """The ledger mapping with most players cut into chunks by day."""
    from ledgerloom.sources.driver_tables import DriverTables
    return DriverTables(t.spark, t.folder, hot_rows=STITCHED).build_transfers()


@query("win_career_summary", """
    SELECT player_id, count(*) AS total_transfers, count(*) FILTER (WHERE n > 1 AND prev_to IS DISTINCT FROM from_club_id) AS gaps,
           count(*) FILTER (WHERE n > 1 AND prev_to IS DISTINCT FROM from_club_id) = 0 AS is_continuous FROM lagged GROUP BY 1""")
def _(t):
    return chains.career_summary(t.transfers)


@query("win_latest_sale", """
    SELECT player_id, from_club_id AS club_id, transfer_date AS sell_date, transfer_id AS sell_transfer_id, transfer_fee AS sell_fee
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id, from_club_id ORDER BY transfer_date DESC, transfer_id DESC) AS rn
          FROM transfers0 WHERE from_club_id IS NOT NULL AND transfer_fee > 0) WHERE rn = 1""")
def _(t):
    return pairs.latest_sales(pairs.fee_bearing(t.transfers))


@query("win_rank_clubs", """
    SELECT row_number() OVER (ORDER BY composite_score DESC, club_id) AS rank, club_id, name, round(composite_score, 6) AS composite_score
    FROM scored_clubs WHERE composite_score IS NOT NULL AND domestic_competition_id IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4',
        'NATION_5', 'NATION_6', 'NATION_7', 'NATION_8') ORDER BY composite_score DESC, club_id LIMIT 10""")
def _(t):
    leagues = tuple(f"NATION_{i}" for i in range(1, 9))
    rows = views.top_clubs(scored_clubs(t), leagues, MIN_DEALS)
    return rounded(rows, "composite_score").select(F.col("rank").cast("bigint").alias("rank"), "club_id", "name", "composite_score")


@query("win_agent_rank", "SELECT agent_name, players, rn AS rank FROM agent_ranks WHERE rn <= 10")
def _(t):
    from pyspark.sql import Window
    top = gems.largest_agents(gems.agent_sizes(t.players))
    order = Window.orderBy(F.col("players").desc(), "agent_name")
    return top.withColumn("rank", F.row_number().over(order).cast("bigint"))


@query("win_nearest", "SELECT DISTINCT b.player_id, b.transfer_date, p.nearest FROM base b JOIN mv_points p ON p.pair_id = b.pair_id")
def _(t):
    base = training_base(t)
    points = features.valuation_points(base, t.valuations)
    return points.select("player_id", "transfer_date", "nearest")


@query("win_profit_scale", """
    SELECT id, round((p - least(min(p) OVER (), 0)) / (greatest(max(p) OVER (), 0) - least(min(p) OVER (), 0)), 6) AS ratio
    FROM (SELECT domestic_competition_id AS id, round(sum(total_profit), 0) AS p FROM scored_clubs WHERE total_profit IS NOT NULL GROUP BY 1)""")
def _(t):
    scaled = metrics.profit_scale(metrics.league_spending(scored_clubs(t), 0))
    return rounded(scaled.select("id", "ratio"), "ratio")
