"""Projections, filters and predicates."""

from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.operators import chains, pairs, quality, sets, views
from ledgerloom.registry.base import listing, query, quoted

CHAINS = ["transfer_id", "player_id", "from_club_id", "to_club_id", "transfer_date", "transfer_fee"]
COLS = ", ".join(CHAINS)


@query("filt_year_range", f"SELECT {COLS} FROM transfers WHERE transfer_date IS NULL OR year(transfer_date) BETWEEN 1996 AND 2000")
def _(t):
    return pairs.year_range(t.transfers, "transfer_date", 1996, 2000).select(*CHAINS)


@query("filt_fee_bearing", f"SELECT {COLS} FROM transfers WHERE transfer_fee IS NOT NULL AND transfer_fee > 0")
def _(t):
    return pairs.fee_bearing(t.transfers).select(*CHAINS)


@query("filt_min_buy_fee", "SELECT buy_transfer_id, sell_transfer_id, buy_fee FROM all_matches WHERE rn = 1 AND buy_fee >= 100000")
def _(t):
    rows = pairs.min_buy_fee(pairs.match_buy_sell(pairs.fee_bearing(t.transfers)))
    return rows.select("buy_transfer_id", "sell_transfer_id", "buy_fee")


@query("filt_buy_year_window", "SELECT buy_transfer_id, buy_date, profit FROM matched WHERE year(buy_date) >= 1998")
def _(t):
    return pairs.buy_year_window(t.matched, 1998).select("buy_transfer_id", "buy_date", "profit")


@query("filt_transfers", f"""
    SELECT {COLS}, player_name, player_position, round(roi_pct, 6) AS roi_pct FROM paired t
    WHERE player_name ILIKE '%ring%' AND roi_pct >= -50
      AND year(transfer_date) >= 1996 AND year(transfer_date) <= 2000
      AND EXISTS (SELECT 1 FROM clubs c WHERE (c.club_id = t.from_club_id OR c.club_id = t.to_club_id)
                  AND c.domestic_competition_id = 'NATION_3')""")
def _(t):
    rows = views.explore_transfers(t.paired, t.clubs, q="ring", league="NATION_3", min_roi=-50, year_from=1996, year_to=2000)
    return rows.select(*CHAINS, "player_name", "player_position", F.round("roi_pct", 6).alias("roi_pct"))


@query("filt_players", """
    SELECT player_id, p.name, position, market_value_in_eur FROM players p
    WHERE p.name ILIKE '%ed%' AND position = 'Midfield'
      AND current_club_id IN (SELECT club_id FROM clubs WHERE domestic_competition_id < 'NATION_5')""")
def _(t):
    scope = t.clubs.filter(F.col("domestic_competition_id") < "NATION_5")
    rows = views.list_players(t.players, q="ed", position="Midfield")
    at = scope.select(F.col("club_id").alias("current_club_id"))
    return rows.join(at, "current_club_id", "left_semi").select("player_id", "name", "position", "market_value_in_eur")


@query("filt_clubs", """
    SELECT club_id, name, domestic_competition_id, total_transfers FROM scored_clubs
    WHERE domestic_competition_id IN ('NATION_1', 'NATION_3', 'NATION_7', 'NATION_12', 'NATION_20') AND total_transfers >= 3""")
def _(t):
    rows = views.filter_clubs(scored_clubs(t), leagues="NATION_1, NATION_3,NATION_7,NATION_12,NATION_20,", min_transfers=3)
    return rows.select("club_id", "name", "domestic_competition_id", "total_transfers")


def scored_clubs(t):
    from ledgerloom.operators.metrics import onto_clubs
    from ledgerloom.plans.analytics import club_scores
    from ledgerloom.sources.driver_tables import MIN_DEALS
    return onto_clubs(t.clubs, club_scores(t.pairs, MIN_DEALS))


@query("filt_type_chips", "SELECT transfer_id, transfer_type FROM typed WHERE transfer_type IN ('loan', 'youth_promotion', 'retired')")
def _(t):
    rows = views.of_types(chains.typed(t.transfers), ("loan", "youth_promotion", "retired"))
    return rows.select("transfer_id", "transfer_type")


@query("filt_scatter", """
    SELECT transfer_fee AS x, round(roi_pct, 6) AS y, coalesce(player_name, 'Unknown') AS name,
           coalesce(to_club_name, from_club_name, '') AS club, profit, transfer_date AS date, transfer_id AS id, player_id
    FROM paired WHERE transfer_fee > 0 AND roi_pct IS NOT NULL""")
def _(t):
    return views.scatter(t.paired).withColumn("y", F.round("y", 6))


@query("filt_incomplete_profiles", """
    SELECT player_id, name, 'image_url, agent_name, citizenship' AS missing_field, market_value_in_eur FROM players
    WHERE image_url IS NULL OR agent_name IS NULL OR citizenship IS NULL""")
def _(t):
    return views.incomplete_profiles(t.players, ("image_url", "agent_name", "shoe_size", "citizenship"))


@query("filt_non_clubs", f"""
    SELECT DISTINCT to_club_id, to_club_name FROM transfers
    WHERE lower(trim(to_club_name)) NOT IN ({listing(C.NON_CLUB_NAMES)})
      AND NOT regexp_matches(to_club_name, {quoted('(?i)' + '|'.join(C.ORPHAN_RESERVE_PATTERNS))})""")
def _(t):
    return quality.drop_non_clubs(t.transfers.select("to_club_id", "to_club_name").distinct(), "to_club_name")


@query("filt_start_from", """
    SELECT player_id, name FROM players WHERE player_id >= 100
      AND player_id NOT IN (SELECT player_id FROM transfers0 WHERE transfer_date < DATE '1995-07-01')
    ORDER BY market_value_in_eur DESC, player_id LIMIT 200""")
def _(t):
    early = t.transfers.filter(F.col("transfer_date") < F.lit("1995-07-01").cast("date"))
    return sets.start_from(t.players, early, 100, True, 200).select("player_id", "name")


@query("proj_club_detail", """
    SELECT club_id, name, club_code, domestic_competition_id,
           CASE code WHEN 'GB1' THEN 'English Premier League' WHEN 'ES1' THEN 'LaLiga' WHEN 'IT1' THEN 'Serie A' END AS league_name,
           CASE WHEN code IN ('GB1', 'ES1', 'IT1') THEN 'https://tmssl.akamaized.net/images/logo/medium/' || lower(code) || '.png' END
               AS league_logo_url
    FROM (SELECT club_id, name, club_code, code AS domestic_competition_id, code FROM
          (SELECT *, CASE club_id % 4 WHEN 0 THEN 'GB1' WHEN 1 THEN 'ES1' WHEN 2 THEN 'IT1' ELSE domestic_competition_id END AS code FROM clubs))""")
def _(t):
    kind = F.col("club_id") % 4
    code = F.when(kind == 0, "GB1").when(kind == 1, "ES1").when(kind == 2, "IT1").otherwise(F.col("domestic_competition_id"))
    return views.club_detail(t.clubs.withColumn("domestic_competition_id", code))


@query("filt_club_transfers", f"SELECT {COLS} FROM transfers WHERE from_club_id = 7 OR to_club_id = 7")
def _(t):
    return views.club_transfers(t.transfers, 7).select(*CHAINS)


@query("proj_by_id", "SELECT * FROM players WHERE player_id = 42")
def _(t):
    return views.by_id(t.players, "player_id", 42)


@query("chk_future_dated", f"SELECT {COLS} FROM transfers WHERE transfer_date > DATE '2001-06-01'")
def _(t):
    return quality.future_dated(t.transfers, F.lit("2001-06-01").cast("date")).select(*CHAINS)


@query("chk_fee_cap", "SELECT transfer_id, transfer_fee FROM transfers WHERE transfer_fee > 10000000")
def _(t):
    return quality.above(t.transfers, "transfer_fee", 10_000_000).select("transfer_id", "transfer_fee")


@query("chk_mv_cap", "SELECT player_id, market_value_in_eur FROM players WHERE market_value_in_eur > 10000000")
def _(t):
    return quality.above(t.players, "market_value_in_eur", 10_000_000).select("player_id", "market_value_in_eur")


@query("chk_roi_cap", "SELECT transfer_id, round(roi_pct, 6) AS roi_pct FROM paired WHERE roi_pct IS NOT NULL AND abs(roi_pct) > 1000")
def _(t):
    return quality.extreme_roi(t.paired, 1000).select("transfer_id", F.round("roi_pct", 6).alias("roi_pct"))


@query("proj_sanitised_sort", "SELECT player_id, name, market_value_in_eur FROM players ORDER BY market_value_in_eur DESC NULLS LAST, player_id")
def _(t):
    rows = views.list_players(t.players, sort_by="1; drop table players", order="desc")
    return rows.select("player_id", "name", "market_value_in_eur")
