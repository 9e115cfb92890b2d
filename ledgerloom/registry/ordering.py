"""Sorted views, paging and top-k reports."""

from functools import reduce

from pyspark.sql import functions as F

from ledgerloom.operators import chains, pairs, quality, views
from ledgerloom.registry.base import query, rounded
from ledgerloom.registry.filters import scored_clubs
from ledgerloom.sources.driver_tables import MIN_DEALS

PAGE = "club_id, name, total_transfers"


@query("sort_leaderboard", f"""
    SELECT {PAGE}, round(hit_rate, 4) AS hit_rate FROM scored_clubs WHERE total_transfers >= 3
    ORDER BY round(hit_rate, 4) ASC NULLS LAST, club_id""")
def _(t):
    rows = views.leaderboard(rounded(scored_clubs(t), "hit_rate", digits=4), "hit_rate", "asc", min_transfers=MIN_DEALS)
    return rows.select("club_id", "name", "total_transfers", "hit_rate")


@query("sort_sell_leaders", f"SELECT {PAGE}, total_profit FROM scored_clubs WHERE total_profit IS NOT NULL AND total_transfers >= 3 "
       "ORDER BY total_profit DESC, club_id")
def _(t):
    return views.sell_leaders(scored_clubs(t)).select("club_id", "name", "total_transfers", "total_profit")


@query("sort_academy_leaders", f"""
    SELECT {PAGE}, round(value_creation, 4) AS value_creation FROM scored_clubs
    WHERE value_creation IS NOT NULL AND total_transfers >= 3 AND domestic_competition_id IN ('NATION_1', 'NATION_3', 'NATION_5')""")
def _(t):
    rows = views.academy_leaders(scored_clubs(t), leagues="NATION_1,NATION_3,NATION_5")
    return rounded(rows, "value_creation", digits=4).select("club_id", "name", "total_transfers", "value_creation")


@query("sort_null_as_zero", "SELECT club_id, total_profit FROM scored_clubs ORDER BY coalesce(total_profit, 0) DESC, club_id")
def _(t):
    return views.null_as_zero(scored_clubs(t), "total_profit").select("club_id", "total_profit")


@query("sort_club_transfers", """
    SELECT transfer_id, transfer_type, transfer_fee FROM typed WHERE from_club_id = 12 OR to_club_id = 12
    ORDER BY coalesce(transfer_fee, 0) DESC, transfer_id""")
def _(t):
    rows = chains.typed(views.club_transfers(t.transfers, 12))
    return views.sort_club_transfers(rows, "fee_desc").select("transfer_id", "transfer_type", "transfer_fee")


@query("sort_player_history", """
    SELECT 'transfer' AS kind, transfer_date AS date, transfer_fee AS amount FROM transfers0 WHERE player_id = 77
    UNION ALL SELECT 'valuation', date, market_value_in_eur FROM valuations WHERE player_id = 77""")
def _(t):
    moves = views.player_transfers(t.transfers, 77).select(
        F.lit("transfer").alias("kind"), F.col("transfer_date").alias("date"), F.col("transfer_fee").alias("amount"))
    values = views.player_valuations(t.valuations, 77).select(
        F.lit("valuation").alias("kind"), "date", F.col("market_value_in_eur").alias("amount"))
    return moves.unionByName(values)


@query("page_offset", "SELECT transfer_id, transfer_date FROM transfers0 ORDER BY transfer_date DESC NULLS LAST, transfer_id LIMIT 50 OFFSET 100")
def _(t):
    order = [F.col("transfer_date").desc_nulls_last(), F.col("transfer_id").asc()]
    return views.page(t.transfers.select("transfer_id", "transfer_date"), order, 3, 50)


@query("page_deep", """
    SELECT transfer_id, transfer_date FROM (
        SELECT transfer_id, transfer_date, row_number() OVER (ORDER BY transfer_date DESC NULLS LAST, transfer_id) AS place, count(*) OVER () AS n FROM transfers0)
    WHERE (place - 1) // 50 = (9 * n) // 500""")
def _(t):
    """The page at nine tenths of the table, sought by range."""
    rows = t.transfers.select("transfer_id", "transfer_date")
    number = 9 * views.total(rows).first()["total"] // 500 + 1
    return views.page(rows, [F.col("transfer_date").desc_nulls_last(), F.col("transfer_id").asc()], number, 50, shallow=0)


@query("page_total", "SELECT count(*) AS total FROM transfers0 WHERE transfer_fee > 0")
def _(t):
    return views.total(pairs.fee_bearing(t.transfers))


@query("topk_biggest_profit", "SELECT buy_transfer_id, profit FROM matched ORDER BY profit DESC, buy_transfer_id LIMIT 1")
def _(t):
    return views.biggest_profit(t.matched).select("buy_transfer_id", "profit")


@query("topk_samples", """
    SELECT * FROM (SELECT 'orphan_edges' AS check, player_id, count(*)::DOUBLE AS amount FROM transfers0
        WHERE from_club_id IS NOT NULL AND from_club_id NOT IN (SELECT club_id FROM clubs)
        GROUP BY 2 ORDER BY max(transfer_fee) DESC NULLS LAST, player_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'disconnected', player_id, breaks::DOUBLE FROM breaks ORDER BY breaks DESC, player_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'timeline_violations', i.player_id, round(sell_fee, 0)::DOUBLE FROM impossible i JOIN players p ON p.player_id = i.player_id
        ORDER BY coalesce(sell_fee + buy_fee, -1) DESC, sell_transfer_id, buy_transfer_id LIMIT 20)
    UNION ALL SELECT * FROM (SELECT 'duplicate_edges', player_id, cnt::DOUBLE FROM dup_transfers
        ORDER BY cnt DESC, player_id, transfer_date, to_club_id, from_club_id NULLS FIRST LIMIT 20)
    UNION ALL SELECT 'missing_continuity', NULL, missing::DOUBLE FROM missing_first""")
def _(t):
    orphans = quality.orphan_edge_players(t.transfers, t.players, t.clubs, 20).select(
        F.lit("orphan_edges").alias("check"), "player_id", F.col("occurrences").cast("double").alias("amount"))
    broken = chains.lag_breaks(t.transfers).orderBy(F.col("breaks").desc(), "player_id").limit(20).select(
        F.lit("disconnected").alias("check"), "player_id", F.col("breaks").cast("double").alias("amount"))
    impossible = chains.sold_before_bought(t.transfers, t.players, t.clubs).select(
        F.lit("timeline_violations").alias("check"), "player_id", F.col("sell_fee").cast("double").alias("amount"))
    twice = quality.duplicate_transfers(t.transfers).orderBy(
        F.col("cnt").desc(), "player_id", "transfer_date", "to_club_id", F.col("from_club_id").asc_nulls_first()).limit(20).select(
        F.lit("duplicate_edges").alias("check"), "player_id", F.col("cnt").cast("double").alias("amount"))
    first = chains.missing_first_origin(t.transfers).select(
        F.lit("missing_continuity").alias("check"), F.lit(None).cast("bigint").alias("player_id"), F.col("missing").cast("double").alias("amount"))
    return reduce(lambda a, b: a.unionByName(b), [orphans, broken, impossible, twice, first])


@query("topk_club_best", """
    SELECT * FROM (SELECT 'profit' AS list, transfer_id, profit AS amount FROM paired WHERE (from_club_id = 9 OR to_club_id = 9)
        AND profit IS NOT NULL ORDER BY profit DESC, transfer_id LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'fee', transfer_id, transfer_fee FROM paired WHERE (from_club_id = 9 OR to_club_id = 9)
        AND transfer_fee IS NOT NULL ORDER BY transfer_fee DESC, transfer_id LIMIT 5)""")
def _(t):
    return views.club_best(t.paired, 9)


@query("view_club_history", "SELECT transfer_id, transfer_type, transfer_date FROM typed WHERE from_club_id = 20 OR to_club_id = 20")
def _(t):
    return views.club_history(t.transfers, 20).select("transfer_id", "transfer_type", "transfer_date")


PAGE_ROW = ["transfer_id", "player_id", "player_name", "from_club_id", "to_club_id", "from_club_name", "to_club_name", "transfer_date",
            "transfer_season", "transfer_fee", "transfer_type", "buy_fee", "sell_fee", "profit", "roi_pct", "annualized_roi_pct", "player_position"]


def page_sql(rows: str, hit: str) -> str:
    """Ledger rows ``l`` with types, their own pair columns or those of buy ``b`` where ``hit`` holds."""
    own = ", ".join(f"l.{c}" for c in PAGE_ROW[:10])
    carried = ", ".join(f"CASE WHEN {hit} THEN b.{c} ELSE l.{c} END AS {c}" for c in ("buy_fee", "sell_fee", "profit", "player_position"))
    rates = ", ".join(f"round(CASE WHEN {hit} THEN b.{c} ELSE l.{c} END, 6) AS {c}" for c in ("roi_pct", "annualized_roi_pct"))
    return f"SELECT {own}, y.transfer_type, {carried}, {rates} FROM paired l JOIN typed y ON y.transfer_id = l.transfer_id LEFT JOIN {rows}"


WANTS = "l.profit IS NULL AND l.transfer_fee > 0 AND b.transfer_id IS NOT NULL"


@query("view_club_page", page_sql("""(
        SELECT s.transfer_id AS sale_id, b.*, row_number() OVER (PARTITION BY s.transfer_id ORDER BY b.transfer_date DESC, b.transfer_id DESC) AS rn
        FROM paired s JOIN paired b ON b.player_id = s.player_id AND b.to_club_id = s.from_club_id AND b.transfer_date < s.transfer_date
        WHERE s.from_club_id = 20 AND b.transfer_fee > 0 AND b.profit IS NOT NULL) b ON b.sale_id = l.transfer_id AND b.rn = 1
    WHERE l.from_club_id = 20 OR l.to_club_id = 20""", WANTS))
def _(t):
    return rounded(views.club_page(t.paired, 20), "roi_pct", "annualized_roi_pct").select(*PAGE_ROW)


@query("view_player_page", page_sql("""(
        SELECT *, row_number() OVER (PARTITION BY to_club_id ORDER BY transfer_date DESC, transfer_id DESC) AS rn
        FROM paired WHERE player_id = 77 AND transfer_fee > 0 AND roi_pct IS NOT NULL AND to_club_id <> 0) b
      ON b.to_club_id = l.from_club_id AND b.rn = 1
    WHERE l.player_id = 77""", WANTS + " AND l.transfer_date > b.transfer_date"))
def _(t):
    return rounded(views.player_page(t.paired, 77), "roi_pct", "annualized_roi_pct").select(*PAGE_ROW)
