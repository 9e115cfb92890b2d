"""Consistency checks, graph checks and the health score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels
from ledgerloom.operators import chains
from ledgerloom.operators.metrics import one_row, stack_totals


def missing_keys(rows: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose non-NULL ``column`` has no parent row."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return rows.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def future_dated(transfers: DataFrame, day: Column) -> DataFrame:
    return transfers.filter(F.col("transfer_date") > day)


def above(rows: DataFrame, column: str, limit: float) -> DataFrame:
    return rows.filter(F.col(column) > limit)


def extreme_roi(paired: DataFrame, limit: float = C.MAX_ROI_PCT) -> DataFrame:
    return paired.filter(F.abs("roi_pct") > limit)


def underage(transfers: DataFrame, players: DataFrame, min_age: int = C.MIN_AGE_FOR_TRANSFER) -> DataFrame:
    births = players.select("player_id", "date_of_birth")
    return transfers.join(births, "player_id").filter(
        F.col("transfer_date") < F.add_months("date_of_birth", 12 * min_age))


def duplicates(rows: DataFrame, keys: list[str], not_null: list[str]) -> DataFrame:
    kept = reduce(lambda df, c: df.filter(F.col(c).isNotNull()), not_null, rows)
    return kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1")


TRANSFER_KEY = ["player_id", "from_club_id", "to_club_id", "transfer_date"]
VALUATION_KEY = ["player_id", "date", "market_value_in_eur"]


def duplicate_transfers(transfers: DataFrame) -> DataFrame:
    return duplicates(transfers, TRANSFER_KEY, ["player_id"])


def duplicate_valuations(valuations: DataFrame) -> DataFrame:
    return duplicates(valuations, VALUATION_KEY, ["player_id", "date"])


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("value"))


def _known(rows: DataFrame, column: str, parent: DataFrame, key: str, *more: str) -> DataFrame:
    """Adds ``_known``: ``column`` has a parent row; and the parent's columns ``more``. Keys are unique in ``parent``."""
    found = parent.select(F.col(key).alias(column), F.lit(True).alias("_known"), *more)
    return rows.join(found, column, "left").withColumn("_known", F.coalesce("_known", F.lit(False)))


def _unpivoted(totals: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """One row of totals as (category, check, count) rows."""
    entries = [F.struct(F.lit(category).alias("category"), F.lit(check).alias("check"), F.col(c).cast("bigint").alias("count"))
               for c, (category, check) in names.items()]
    return totals.select(F.inline(F.array(*entries)))


def consistency_counts(transfers: DataFrame, players: DataFrame, clubs: DataFrame, valuations: DataFrame,
                       paired: DataFrame, today: Column) -> DataFrame:
    """Ten checks as (category, check, severity, count): one pass over each table, and one each for duplicates."""
    people = players.groupBy("player_id").agg(F.min("date_of_birth").alias("date_of_birth"))
    no_player = F.col("player_id").isNotNull() & ~F.col("_known")
    moves = _known(transfers.select("player_id", "transfer_date", "transfer_fee"), "player_id", people, "player_id", "date_of_birth").agg(
        F.count_if(no_player).alias("orphaned"), F.count_if(F.col("transfer_date") > today).alias("future"),
        F.count_if(F.col("transfer_date") < F.add_months("date_of_birth", 12 * C.MIN_AGE_FOR_TRANSFER)).alias("underage"),
        F.count_if(F.col("transfer_fee") > C.MAX_FEE_EUR).alias("fees"))
    values = _known(valuations.select("player_id"), "player_id", people, "player_id").agg(F.count_if(no_player).alias("orphaned"))
    members = _known(players.select("current_club_id", "market_value_in_eur"), "current_club_id",
                     clubs.select("club_id").distinct(), "club_id").agg(
        F.count_distinct(F.when(~F.col("_known"), F.col("current_club_id"))).alias("clubs"),
        F.count_if(F.col("market_value_in_eur") > C.MAX_MARKET_VALUE_EUR).alias("values"))
    rows = [
        _unpivoted(moves, {"orphaned": ("Referential", "orphaned_transfers"), "future": ("Temporal", "future_transfers"),
                           "underage": ("Temporal", "underage_transfers"), "fees": ("Numerical", "fees_above_cap")}),
        _unpivoted(values, {"orphaned": ("Referential", "orphaned_valuations")}),
        _unpivoted(members, {"clubs": ("Referential", "missing_player_clubs"), "values": ("Numerical", "market_values_above_cap")}),
        _unpivoted(_count(extreme_roi(paired)), {"value": ("Numerical", "roi_above_cap")}),
        _unpivoted(_count(duplicate_transfers(transfers)), {"value": ("Dedup", "duplicate_transfers")}),
        _unpivoted(_count(duplicate_valuations(valuations)), {"value": ("Dedup", "duplicate_valuations")}),
    ]
    severity = (
        F.when(F.col("count") == 0, "info").when(F.col("check") == "duplicate_transfers", "error").otherwise("warning")
    )
    return reduce(DataFrame.unionByName, rows).withColumn("severity", severity)


def passed(counts: DataFrame) -> DataFrame:
    return counts.agg((F.count_if(F.col("severity") == "error") == 0).alias("passed"))


def orphan_edges(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Moves out of a club that is not registered."""
    return missing_keys(transfers, "from_club_id", clubs, "club_id")


def orphan_edge_players(transfers: DataFrame, players: DataFrame, clubs: DataFrame, top: int | None = 20) -> DataFrame:
    """Per player the orphan moves; club columns come from the row with the highest fee."""
    best = F.struct(F.col("transfer_fee").isNotNull(), "transfer_fee", "transfer_id")
    per_player = orphan_edges(transfers, clubs).groupBy("player_id").agg(
        F.max_by(F.struct("from_club_id", "from_club_name"), best).alias("_top"),
        F.count(F.lit(1)).alias("occurrences"), F.round(F.max("transfer_fee"), 0).alias("max_fee"))
    out = per_player.join(players.select("player_id", F.col("name").alias("player_name")), "player_id").select(
        "player_id", "player_name", "_top.from_club_id", "_top.from_club_name", "occurrences", "max_fee")
    ordered = out.orderBy(F.col("max_fee").desc_nulls_last(), "player_id")
    return ordered if top is None else ordered.limit(top)


def graph_counts(transfers: DataFrame, players: DataFrame, clubs: DataFrame) -> dict[str, DataFrame]:
    """The health score's totals, each as a one-row frame; moves and orphans come from one pass."""
    moves = _known(transfers.select("player_id", "from_club_id"), "from_club_id", clubs.select("club_id").distinct(), "club_id").agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_distinct(F.when(F.col("from_club_id").isNotNull() & ~F.col("_known"), F.col("player_id"))).alias("orphans"))
    return {
        "total_players": _count(players),
        "total_edges, orphan_players": moves,
        "timeline_violations": _count(chains.sold_before_bought_players(transfers)),
        "disconnected_segments": _count(chains.lag_breaks(transfers)),
        "duplicate_edges": _count(duplicate_transfers(transfers)),
        "missing_continuity": chains.missing_first_origin(transfers),
    }


def health(counts: DataFrame) -> DataFrame:
    """Graph health in [0, 1] from a one-row frame of the totals above."""
    c = F.col
    score = (
        F.lit(1.0)
        - F.coalesce(F.try_divide(c("timeline_violations"), c("total_edges")), F.lit(0.0)) * 8
        - F.least(c("disconnected_segments") * 0.002, F.lit(0.15))
        - F.least(c("orphan_players") * 0.001, F.lit(0.10))
        - F.least(c("duplicate_edges") * 0.03, F.lit(0.20))
        - F.least(c("missing_continuity") / 10000, F.lit(0.10))
    )
    return counts.withColumn(
        "graph_health_score", F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3))


#: What ``player_state`` counts, and the total of the health score that each sum over players gives.
STATE = {"edges": "total_edges", "orphans": "orphan_players", "violations": "timeline_violations", "broken": "disconnected_segments",
         "duplicates": "duplicate_edges", "missing": "missing_continuity", "unpaired": "unpaired"}


def player_state(transfers: DataFrame, clubs: DataFrame, min_fee: float = 100_000) -> DataFrame:
    """Per player (NULL is one) what the health score and the repair loop count.

    Every count depends on the rows of one player only, and all totals are sums over players. So when some players get
    rows, the totals change by their new state less their old one, and no other player's rows are read.
    """
    parts = [_club_state(transfers, clubs, min_fee), chains.lag_breaks(transfers).select("player_id", F.lit(1).alias("broken")), _day_state(transfers)]
    same = [part.select("player_id", *[(F.col(c) if c in part.columns else F.lit(0)).cast("long").alias(c) for c in STATE]) for part in parts]
    return reduce(DataFrame.unionByName, same).groupBy("player_id").agg(*[F.sum(c).alias(c) for c in STATE])


def _club_state(transfers: DataFrame, clubs: DataFrame, min_fee: float) -> DataFrame:
    """What follows from the two ends of each move: both are reduced to one row per player and club, once."""
    paid, on, sale = F.col("transfer_fee") > min_fee, F.col("transfer_date"), F.col("sale")
    ends = F.array(F.struct(F.col("from_club_id").cast("long").alias("club_id"), F.lit(True).alias("sale")),
                   F.struct(F.col("to_club_id").cast("long").alias("club_id"), F.lit(False).alias("sale")))
    at_club = transfers.select("player_id", on, F.coalesce(paid, F.lit(False)).alias("paid"), F.inline(ends)).groupBy("player_id", "club_id").agg(
        F.count_if(~sale).alias("buys"), F.count_if(sale).alias("sales"), F.count_if(sale & F.col("paid")).alias("paid_sales"),
        F.min(F.when(sale & F.col("paid"), on)).alias("paid_sale"), F.min(F.when(sale, on)).alias("any_sale"),
        F.max(F.when(~sale & F.col("paid"), on)).alias("paid_buy"), F.max(F.when(~sale, on)).alias("any_buy"))
    rows = _known(at_club, "club_id", clubs.select("club_id").distinct(), "club_id")
    club, player = F.col("club_id").isNotNull(), F.col("player_id").isNotNull()
    lost = player & club & ~F.col("_known") & (F.col("sales") > 0)
    # sales of rows without a player have no purchases
    open_sales = club & F.col("_known") & ~F.col("club_id").isin(*C.NON_REAL_CLUBS) & (~player | (F.col("buys") == 0))
    return rows.groupBy("player_id").agg(
        F.sum("buys").alias("edges"), F.max(F.when(lost, 1).otherwise(0)).alias("orphans"),
        F.max(F.when(club & F.expr("paid_sale < any_buy OR any_sale < paid_buy"), 1).otherwise(0)).alias("violations"),
        F.sum(F.when(open_sales, F.col("paid_sales")).otherwise(0)).alias("unpaired"))


def _day_state(transfers: DataFrame) -> DataFrame:
    """Repeated moves, and rows of the first date without an origin."""
    days = transfers.groupBy(*TRANSFER_KEY).agg(F.count(F.lit(1)).alias("n")).groupBy("player_id", "transfer_date").agg(
        F.sum(F.when(F.col("from_club_id").isNull(), F.col("n")).otherwise(0)).alias("lost"), F.count_if(F.col("n") > 1).alias("repeated"))
    first = F.min(F.when(F.col("transfer_date").isNotNull(), F.struct("transfer_date", "lost")))
    return days.groupBy("player_id").agg(
        F.sum(F.when(F.col("player_id").isNotNull(), F.col("repeated")).otherwise(0)).alias("duplicates"), F.coalesce(first["lost"], F.lit(0)).alias("missing"))


def state_totals(state: DataFrame) -> dict[str, int]:
    """Sums over players, under the names of the health score's totals."""
    row = state.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in STATE.items()]).first()
    return row.asDict()


def health_report(transfers: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    return health(one_row(graph_counts(transfers, players, clubs)))


def graph_report(transfers: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """The totals and the score as (metric, value) rows."""
    wide = health_report(transfers, players, clubs)
    return wide.unpivot([], wide.columns, "metric", "value")


def convergence(unpaired: Column, inserted: Column, previous_inserted: Column, health_score: Column,
                candidates: Column) -> Column:
    """zero_candidates, triple_signal_convergence, or open."""
    stable = (unpaired <= 10) & (inserted == 0) & (previous_inserted == 0) & (health_score >= 0.95)
    return F.when(candidates == 0, "zero_candidates").when(stable, "triple_signal_convergence").otherwise("open")


def club_edges(transfers: DataFrame) -> DataFrame:
    """Both ends of every move, aggregated per side: (cid, name, cnt)."""
    def side(club: str, name: str) -> DataFrame:
        named = transfers.filter(F.col(club).isNotNull() & (F.col(name) != ""))
        return named.groupBy(F.col(club).alias("cid")).agg(F.min(name).alias("name"), F.count(F.lit(1)).alias("cnt"))

    return side("from_club_id", "from_club_name").unionByName(side("to_club_id", "to_club_name"))


def orphan_clubs(transfers: DataFrame, clubs: DataFrame, exclude_markers: bool = True,
                 exclude_reserves: bool = True, min_transfers: int = 1) -> DataFrame:
    """Club ids on either end of a move that are not registered, with their move counts."""
    totals = missing_keys(club_edges(transfers), "cid", clubs, "club_id") \
        .groupBy("cid", "name").agg(F.sum("cnt").alias("total_cnt")).filter(F.col("total_cnt") >= min_transfers)
    return drop_non_clubs(totals, "name", exclude_markers, exclude_reserves) \
        .orderBy(F.col("total_cnt").desc(), "cid", "name")


def drop_non_clubs(rows: DataFrame, name: str, markers: bool = True, reserves: bool = True) -> DataFrame:
    if markers:
        rows = rows.filter(~labels.is_status_marker(F.col(name)))
    if reserves:
        rows = rows.filter(~labels.is_reserve_name(F.col(name)))
    return rows


def repaired_clubs(transfers: DataFrame, clubs: DataFrame, name_length: int | None = 100, **limits) -> DataFrame:
    """The club table with a minimal row (id, name) for every orphan."""
    orphans = orphan_clubs(transfers, clubs, **limits)
    minimal = orphans.groupBy(F.col("cid").alias("club_id")).agg(
        F.max_by("name", F.struct("total_cnt", "name")).alias("name"))
    if name_length is not None:
        minimal = minimal.withColumn("name", F.substring("name", 1, name_length))
    return clubs.unionByName(minimal, allowMissingColumns=True)


def table_counts(tables: dict[str, DataFrame], paired: DataFrame, scored: DataFrame) -> DataFrame:
    parts = {name: _count(df) for name, df in tables.items()}
    parts["buy_sell_pairs"] = paired.agg(F.count("roi_pct").alias("value"))
    parts["reconstructed_transfers"] = scored.agg(F.count("confidence_score").alias("value"))
    return stack_totals(parts).withColumn("value", F.col("value").cast("bigint"))
