"""Set operations, de-duplication and upserts."""

from pyspark.sql import functions as F

from ledgerloom.operators import quality, sets
from ledgerloom.registry.base import query
from ledgerloom.registry.filters import CHAINS


@query("set_union_search", """
    SELECT * FROM (SELECT 'club' AS type, club_id AS id, name, domestic_competition_id AS subtitle FROM clubs
                   WHERE name ILIKE '%00000002%' ORDER BY club_id LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'player', player_id, name, position FROM players WHERE name ILIKE '%00000002%' ORDER BY player_id LIMIT 30)
    LIMIT 30""")
def _(t):
    return sets.search(t.clubs, t.players, "00000002", 30)


@query("set_search_players", """
    SELECT 'player' AS type, player_id AS id, name, position AS subtitle FROM players WHERE name ILIKE '%ring%' ORDER BY player_id LIMIT 15""")
def _(t):
    return sets.search(t.clubs, t.players, "RING", 15)


@query("set_union_edges", "SELECT cid, name, cnt FROM edges")
def _(t):
    return quality.club_edges(t.transfers)


SCOPE = "SELECT club_id FROM clubs WHERE domestic_competition_id IN ('NATION_3')"


@query("set_players_by_scope", f"""
    SELECT player_id, name, current_club_id, coalesce(market_value_in_eur, 0) AS market_value_in_eur FROM players p
    WHERE current_club_name <> 'Retired' AND (
        EXISTS (SELECT 1 FROM transfers0 t WHERE t.player_id = p.player_id AND (from_club_id IN ({SCOPE}) OR to_club_id IN ({SCOPE})))
        OR (current_club_id IN ({SCOPE}) AND market_value_in_eur > 0))""")
def _(t):
    return sets.players_in_scope(t.players, t.transfers, sets.clubs_in(t.clubs, ["NATION_3"]))


def earlier_and_later(t):
    """Two deliveries of the ledger that overlap in 1998."""
    year = F.year("transfer_date")
    return t.transfers.filter(year <= 1998).select(*CHAINS), t.transfers.filter(year >= 1998).select(*CHAINS)


@query("set_incremental_transfers", """
    SELECT player_id, from_club_id, to_club_id, transfer_date FROM transfers0 WHERE year(transfer_date) >= 1998
    EXCEPT SELECT player_id, from_club_id, to_club_id, transfer_date FROM transfers0 WHERE year(transfer_date) <= 1998""")
def _(t):
    loaded, incoming = earlier_and_later(t)
    fresh = sets.new_rows(incoming, loaded, quality.TRANSFER_KEY, F.col("transfer_id"))
    return fresh.select(*quality.TRANSFER_KEY)


@query("set_incremental_valuations", """
    SELECT player_id, date, market_value_in_eur FROM valuations WHERE year(date) >= 1997
    EXCEPT SELECT player_id, date, market_value_in_eur FROM valuations WHERE year(date) <= 1997""")
def _(t):
    year = F.year("date")
    return sets.new_rows(t.valuations.filter(year >= 1997), t.valuations.filter(year <= 1997), quality.VALUATION_KEY)


@query("set_upsert_partial", """
    SELECT coalesce(o.player_id, n.player_id) AS player_id,
           CASE WHEN n.player_id IS NOT NULL THEN n.name ELSE o.name END AS name,
           CASE WHEN n.player_id IS NOT NULL THEN n.position ELSE o.position END AS position,
           CASE WHEN o.player_id IS NOT NULL THEN o.foot ELSE n.foot END AS foot,
           CASE WHEN n.player_id IS NOT NULL THEN n.market_value_in_eur ELSE o.market_value_in_eur END AS market_value_in_eur
    FROM (SELECT * FROM players WHERE foot IS DISTINCT FROM 'both') o
    FULL OUTER JOIN (SELECT player_id, upper(name) AS name, 'Goalkeeper' AS position, 'new' AS foot, market_value_in_eur * 2 AS market_value_in_eur
                     FROM players WHERE current_club_id > 25) n ON n.player_id = o.player_id""")
def _(t):
    columns = ["player_id", "name", "position", "foot", "market_value_in_eur"]
    stored = t.players.filter(~F.col("foot").eqNullSafe(F.lit("both"))).select(*columns)
    incoming = t.players.filter(F.col("current_club_id") > 25).select(
        "player_id", F.upper("name").alias("name"), F.lit("Goalkeeper").alias("position"), F.lit("new").alias("foot"),
        (F.col("market_value_in_eur") * 2).alias("market_value_in_eur"))
    return sets.upsert_partial(stored, incoming, "player_id", ["name", "position", "market_value_in_eur"])


@query("set_upsert_latest", """
    SELECT player_id, season, competition_id, transfer_id, transfer_fee FROM (
        SELECT player_id, transfer_season AS season, to_club_id % 3 AS competition_id, transfer_id, transfer_fee,
               row_number() OVER (PARTITION BY player_id, transfer_season, to_club_id % 3 ORDER BY transfer_id DESC) AS rn FROM transfers)
    WHERE rn = 1""")
def _(t):
    rows = t.transfers.select("player_id", F.col("transfer_season").alias("season"),
                              (F.col("to_club_id") % 3).alias("competition_id"), "transfer_id", "transfer_fee")
    return sets.latest_per_key(rows, ["player_id", "season", "competition_id"], F.col("transfer_id"))


@query("set_players_current_club", f"SELECT player_id, name, current_club_id FROM players WHERE current_club_id IN ({SCOPE})")
def _(t):
    return sets.players_at_clubs(t.players, sets.clubs_in(t.clubs, ["NATION_3"]))


@query("set_profile_merge", """
    SELECT p.player_id, CASE WHEN trim(u.foot) <> '' THEN trim(u.foot) ELSE p.foot END AS foot,
           coalesce(u.height_in_cm, p.height_in_cm) AS height_in_cm, p.name
    FROM players p LEFT JOIN (
        SELECT player_id, CASE player_id % 3 WHEN 0 THEN ' left ' WHEN 1 THEN '  ' END AS foot,
               CASE WHEN player_id % 2 = 0 THEN 199.0::DOUBLE END AS height_in_cm FROM players WHERE current_club_id < 40) u
    ON u.player_id = p.player_id""")
def _(t):
    p = F.col("player_id")
    updates = t.players.filter(F.col("current_club_id") < 40).select(
        "player_id", F.when(p % 3 == 0, " left ").when(p % 3 == 1, "  ").alias("foot"),
        F.when(p % 2 == 0, 199.0).alias("height_in_cm"))
    stored = t.players.select("player_id", "foot", "height_in_cm", "name")
    return sets.merge_non_empty(stored, updates, "player_id", ["foot", "height_in_cm"])


@query("set_repair_clubs", """
    SELECT club_id, name, club_code, domestic_competition_id FROM clubs
    UNION ALL SELECT cid, substr(first(name ORDER BY total_cnt DESC, name DESC), 1, 100), NULL, NULL FROM orphans GROUP BY cid""")
def _(t):
    return quality.repaired_clubs(t.transfers, t.clubs)


@query("set_resume_diff", """
    SELECT player_id, name FROM players p WHERE (
        SELECT count(*) FROM transfers0 t WHERE t.player_id = p.player_id AND t.transfer_fee > 5000000) < 9""")
def _(t):
    loaded = t.transfers.filter(F.col("transfer_fee") > 5_000_000)
    return sets.remaining_targets(t.players.select("player_id", "name"), loaded, ["player_id"], min_rows=9)


@query("set_distinct_targets", """
    SELECT DISTINCT t.player_id, p.name AS player_name FROM paired t JOIN players p ON p.player_id = t.player_id
    JOIN tiered_clubs c ON c.club_id = t.from_club_id
    WHERE t.is_training_eligible = 1 AND c.league_tier IN (3, 4) AND c.domestic_competition_id IS NOT NULL""")
def _(t):
    return sets.scouting_targets(t.paired, t.players, t.tiered_clubs)


@query("set_upsert_windows", """
    SELECT window_key, count(*) AS clubs, round(max(composite_score), 6) AS best FROM window_scores
    WHERE window_key IN ('1996', '2000') GROUP BY 1
    UNION ALL SELECT window_key, count(*), round(max(composite_score), 6) FROM window_scores WHERE window_key = '1998' GROUP BY 1""")
def _(t):
    """Window scores written, one window reloaded alone, all read back."""
    from ledgerloom.plans.analytics import window_scores
    from ledgerloom.session import new_folder
    from ledgerloom.sources.driver_tables import MIN_DEALS, WINDOWS
    from ledgerloom.sources.sinks import replace_partitions
    path = new_folder(t.spark, "windows")
    replace_partitions(window_scores(t.pairs, WINDOWS, MIN_DEALS), path, "window_key")
    replace_partitions(window_scores(t.pairs, (1998,), MIN_DEALS), path, "window_key")
    stored = t.spark.read.parquet(path).withColumn("window_key", F.col("window_key").cast("string"))
    return stored.groupBy("window_key").agg(F.count(F.lit(1)).alias("clubs"),
                                            F.round(F.max("composite_score"), 6).alias("best"))
