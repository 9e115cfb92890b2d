"""Ownership chains: loans, breaks, gaps, and sales without a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels
from ledgerloom.operators.skew import HOT_ROWS, chain

PLAYER_CHAIN = ["transfer_date", "transfer_id"]


def with_previous(transfers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds seq and the previous destination per player, in (date, id) order."""
    return chain(transfers, "player_id", PLAYER_CHAIN, {"prev_to_club": "to_club_id"},
                 F.col("transfer_date"), hot_rows)


def lag_breaks(transfers: DataFrame, min_transfers: int = 3, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Breaks per player: the origin differs from the previous destination (NULLs pass)."""
    broken = F.col("prev_to_club") != F.col("from_club_id")
    return (
        with_previous(transfers, hot_rows).groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(broken).alias("breaks"))
        .filter((F.col("_n") >= min_transfers) & (F.col("breaks") >= 1))
        .select("player_id", "breaks")
    )


def career_gaps(transfers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per gap; a known club next to a NULL is a gap too."""
    gap = (F.col("seq") > 1) & ~F.col("prev_to_club").eqNullSafe(F.col("from_club_id"))
    return with_previous(transfers, hot_rows).filter(gap).select(
        "player_id", "transfer_id", F.col("from_club_name").alias("from"), F.col("to_club_name").alias("to"),
        F.col("transfer_date").alias("date"), F.col("prev_to_club").alias("expected_from_club_id"),
        F.col("from_club_id").alias("actual_from_club_id"))


def career_summary(transfers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    gap = (F.col("seq") > 1) & ~F.col("prev_to_club").eqNullSafe(F.col("from_club_id"))
    return (
        with_previous(transfers, hot_rows).groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("total_transfers"), F.count_if(gap).alias("gaps"))
        .withColumn("is_continuous", F.col("gaps") == 0)
    )


def unpaired_sales(transfers: DataFrame, clubs: DataFrame | None = None, min_fee: float = 100_000,
                   exclude: tuple[int, ...] = C.NON_REAL_CLUBS) -> DataFrame:
    """Paid sales whose player never arrived at the selling club."""
    sales = transfers.filter((F.col("transfer_fee") > min_fee) & F.col("from_club_id").isNotNull())
    if exclude:
        sales = sales.filter(~F.col("from_club_id").isin(*exclude))
    if clubs is not None:
        sales = sales.join(clubs.select(F.col("club_id").alias("from_club_id")), "from_club_id", "left_semi")
    arrivals = transfers.select("player_id", F.col("to_club_id").alias("from_club_id")).distinct()
    return sales.join(arrivals, ["player_id", "from_club_id"], "left_anti")


def broken_chains(transfers: DataFrame, players: DataFrame, clubs: DataFrame, min_fee: float = 100_000) -> DataFrame:
    sales = unpaired_sales(transfers, clubs, min_fee)
    per_player = sales.groupBy("player_id").agg(
        F.round(F.sum("transfer_fee"), 0).alias("total_fee"), F.count(F.lit(1)).alias("sell_count"))
    return per_player.join(players.select("player_id", "name"), "player_id") \
        .orderBy(F.col("total_fee").desc(), "player_id")


def unpaired_total(transfers: DataFrame, clubs: DataFrame | None, min_fee: float = 100_000) -> DataFrame:
    return unpaired_sales(transfers, clubs, min_fee).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.coalesce(F.sum("transfer_fee"), F.lit(0.0)), 0).alias("total_value"))


def broken_player_count(transfers: DataFrame, min_fee: float = 100_000) -> DataFrame:
    sales = unpaired_sales(transfers, None, min_fee, exclude=())
    return sales.agg(F.count_distinct("player_id").alias("players"),
                     F.round(F.sum("transfer_fee"), 0).alias("total_value"))


def _unknown_origin(transfers: DataFrame, clubs: DataFrame) -> DataFrame:
    """Adds ``_unknown``: the origin is NULL or not a registered club."""
    known = clubs.select(F.col("club_id").alias("from_club_id"), F.lit(True).alias("_known"))
    return transfers.join(known, "from_club_id", "left").withColumn("_unknown", F.col("_known").isNull()).drop("_known")


def missing_origin_players(transfers: DataFrame, players: DataFrame, clubs: DataFrame,
                           min_fee: float = 100_000) -> DataFrame:
    paid = transfers.filter(F.col("transfer_fee") > min_fee).select("player_id", "from_club_id")
    rows = _unknown_origin(paid, clubs).filter("_unknown")
    return rows.join(players.select("player_id"), "player_id", "left_semi") \
        .agg(F.count_distinct("player_id").alias("players"))


def silent_gaps(transfers: DataFrame, players: DataFrame, clubs: DataFrame, min_fee: float = 100_000) -> DataFrame:
    """Players whose first paid move starts nowhere known.

    Rows collapse per (player, date), then per player: no self-join. ``transfer_count``
    counts every move once per matching first move.
    """
    paid = F.col("transfer_fee") > min_fee
    lost = paid & F.col("_unknown")
    daily = _unknown_origin(transfers, clubs).groupBy("player_id", "transfer_date").agg(
        F.count("transfer_id").alias("moves"), F.count_if(paid).alias("paid"),
        F.count_if(lost).alias("lost"), F.max(F.when(lost, F.col("transfer_fee"))).alias("fee"))
    first = F.min(F.when((F.col("paid") > 0) & F.col("transfer_date").isNotNull(),
                         F.struct("transfer_date", "lost", "fee"))).alias("first")
    return (
        daily.groupBy("player_id").agg(first, F.sum("moves").alias("moves"))
        .filter(F.col("first.lost") > 0)
        .select("player_id", F.round(F.coalesce("first.fee", F.lit(0.0)), 0).alias("max_fee"),
                (F.col("moves") * F.col("first.lost")).alias("transfer_count"))
        .join(players.select("player_id", "name"), "player_id")
        .orderBy(F.col("max_fee").desc(), "player_id")
    )


def first_day_gaps(transfers: DataFrame) -> DataFrame:
    """Per player how many rows on the first date have no origin, as ``missing``."""
    daily = transfers.filter(F.col("transfer_date").isNotNull()).groupBy("player_id", "transfer_date").agg(
        F.count_if(F.col("from_club_id").isNull()).alias("lost"))
    return daily.groupBy("player_id").agg(F.min(F.struct("transfer_date", "lost")).alias("first")).select(
        "player_id", F.col("first.lost").alias("missing"))


def missing_first_origin(transfers: DataFrame) -> DataFrame:
    """How many rows on a player's first date have no origin."""
    return first_day_gaps(transfers).agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))


def with_loans(transfers: DataFrame, max_days: int = 730) -> DataFrame:
    """Adds ``is_loan``: a fee-free move with a fee-free counter-move (clubs swapped) within ``max_days``.

    A negative fee counts as free, but not on both sides. Moves collapse to distinct days per
    (player, club pair, direction); the nearest opposite day before and after decides, so no
    two moves are ever paired up and the ledger is joined once, with those days.
    """
    low, high = F.least("from_club_id", "to_club_id"), F.greatest("from_club_id", "to_club_id")
    free = ((F.col("from_club_id") != 0) & (F.col("to_club_id") != 0) & F.col("transfer_date").isNotNull()
            & F.coalesce(F.col("transfer_fee") <= 0, F.lit(True)))
    keyed = transfers.withColumns({"_free": F.coalesce(free, F.lit(False)), "_lo": low, "_hi": high, "_out": F.col("from_club_id") == low})
    day = F.col("transfer_date")
    days = keyed.filter("_free").groupBy("player_id", "_lo", "_hi", "transfer_date").agg(
        F.count_if("_out").alias("_n_out"), F.count_if(~F.col("_out")).alias("_n_back"),
        F.count_if(F.col("_out") & _zero_fee()).alias("_z_out"),
        F.count_if(~F.col("_out") & _zero_fee()).alias("_z_back"))
    group = Window.partitionBy("player_id", "_lo", "_hi").orderBy("transfer_date")
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("player_id", "_lo", "_hi").orderBy(day.desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)

    def near(partner: str) -> Column:
        seen = F.when(F.col(partner) > 0, day)
        gap_before = F.datediff(day, F.last(seen, True).over(before))
        gap_after = F.datediff(F.last(seen, True).over(after), day)
        return F.coalesce(F.least(gap_before, gap_after) <= max_days, F.lit(False))

    flagged = days.withColumns({f"_near{c}": near(c) for c in ("_n_out", "_n_back", "_z_out", "_z_back")})
    joined = keyed.join(flagged, ["player_id", "_lo", "_hi", "transfer_date"], "left")

    def partner(kind: str) -> Column:
        # a move between a club and itself is its own opposite, so it needs a second such move
        out, back, own = F.col(f"{kind}_out"), F.col(f"{kind}_back"), F.when(_zero_fee() | (F.lit(kind) == "_n"), 1).otherwise(0)
        return (F.when(F.col("_lo") == F.col("_hi"), (out > own) | F.col(f"_near{kind}_out"))
                .when(F.col("_out"), (back > 0) | F.col(f"_near{kind}_back")).otherwise((out > 0) | F.col(f"_near{kind}_out")))

    loan = F.col("_free") & F.when(_zero_fee(), partner("_n")).otherwise(partner("_z"))
    return joined.select(*[keyed[c] for c in transfers.columns], F.coalesce(loan, F.lit(False)).alias("is_loan"))


def swapped_loans(transfers: DataFrame, max_days: int = 730) -> DataFrame:
    return with_loans(transfers, max_days).filter("is_loan").drop("is_loan")


def _zero_fee() -> Column:
    return F.coalesce(F.col("transfer_fee") == 0, F.lit(True))


def loan_with_option(transfers: DataFrame, max_days: int = 548) -> DataFrame:
    """Loans followed by a paid move to the same club within ``max_days``."""
    loans = swapped_loans(transfers)
    paid_days = transfers.filter((F.col("transfer_fee") > 0) & F.col("transfer_date").isNotNull()) \
        .select("player_id", "to_club_id", "transfer_date").distinct().withColumn("_paid", F.lit(True))
    loan_days = loans.select("player_id", "to_club_id", "transfer_date").distinct().withColumn("_paid", F.lit(False))
    timeline = paid_days.unionByName(loan_days).groupBy("player_id", "to_club_id", "transfer_date") \
        .agg(F.max("_paid").alias("_paid"), F.max(~F.col("_paid")).alias("_loan"))
    later = Window.partitionBy("player_id", "to_club_id").orderBy(F.col("transfer_date").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    upcoming = F.last(F.when(F.col("_paid"), F.col("transfer_date")), True).over(later)
    hit = timeline.withColumn("_next", upcoming).filter("_loan") \
        .filter(F.datediff("_next", "transfer_date") <= max_days) \
        .select("player_id", "to_club_id", "transfer_date")
    return loans.join(hit, ["player_id", "to_club_id", "transfer_date"], "left_semi").select(*transfers.columns)


def typed(transfers: DataFrame) -> DataFrame:
    """Adds transfer_type. A swap touches the same two clubs and one player, so the rows of a
    club or of a player may be picked before."""
    base = labels.movement_type(F.col("transfer_fee"), F.col("from_club_name"), F.col("to_club_name"))
    return with_loans(transfers).withColumn("transfer_type", labels.with_loan_override(base, F.col("is_loan"))).drop("is_loan")


def _club_days(transfers: DataFrame) -> DataFrame:
    """Sales (from a club) and buys (to a club) as (player, club, day) rows."""
    dated = transfers.filter(F.col("transfer_date").isNotNull())
    sales = dated.filter(F.col("from_club_id").isNotNull()).select(
        "player_id", F.col("from_club_id").alias("club_id"), "transfer_date", "transfer_fee", F.lit(True).alias("sale"))
    buys = dated.filter(F.col("to_club_id").isNotNull()).select(
        "player_id", F.col("to_club_id").alias("club_id"), "transfer_date", "transfer_fee", F.lit(False).alias("sale"))
    return sales.unionByName(buys)


def sold_before_bought_players(transfers: DataFrame, min_fee: float = 100_000) -> DataFrame:
    """Players with a sale dated before a purchase by the same club, either one paid.

    Such a pair exists exactly when the first paid sale precedes the last purchase, or the
    first sale precedes the last paid purchase: four aggregates, no join.
    """
    paid = F.col("transfer_fee") > min_fee
    on = F.col("transfer_date")
    ends = _club_days(transfers).groupBy("player_id", "club_id").agg(
        F.min(F.when(F.col("sale") & paid, on)).alias("paid_sale"), F.min(F.when(F.col("sale"), on)).alias("any_sale"),
        F.max(F.when(~F.col("sale") & paid, on)).alias("paid_buy"), F.max(F.when(~F.col("sale"), on)).alias("any_buy"))
    return ends.filter("paid_sale < any_buy OR any_sale < paid_buy").select("player_id").distinct()


def sold_before_bought(transfers: DataFrame, players: DataFrame, clubs: DataFrame, min_fee: float = 100_000,
                       top: int = 20) -> DataFrame:
    """The ``top`` (a report's length) impossible sale/purchase pairs by summed fee.

    A pair among the best ``top`` has a sale among the ``top`` sales ranked by their best
    partner, and that rank needs only the greatest later purchase fee per sale day. Those
    few sales then meet their purchases: linear work, exact answer.
    """
    rows = _club_days(transfers.join(players.select("player_id"), "player_id", "left_semi"))
    days = rows.groupBy("player_id", "club_id", "transfer_date").agg(
        F.max(F.when(~F.col("sale"), F.col("transfer_fee"))).alias("buy_fee"),
        F.max(~F.col("sale")).alias("has_buy"), F.max("sale").alias("has_sale"))
    later = Window.partitionBy("player_id", "club_id").orderBy(F.col("transfer_date").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    ahead = days.withColumns({"best_buy": F.max("buy_fee").over(later), "any_buy": F.max("has_buy").over(later)}) \
        .filter("has_sale AND any_buy").select("player_id", F.col("club_id").alias("from_club_id"), "transfer_date", "best_buy")
    sales = transfers.join(ahead, ["player_id", "from_club_id", "transfer_date"])
    fee = F.col("transfer_fee")
    qualifies = (fee > min_fee) | (F.col("best_buy") > min_fee)
    # sums with a missing fee rank after every known sum
    best = F.coalesce(fee + F.col("best_buy"), F.lit(-1.0))
    seeds = (
        sales.filter(qualifies).withColumn("_best", best).orderBy(F.col("_best").desc(), "transfer_id").limit(top)
        .select("player_id", "from_club_id", F.col("transfer_id").alias("sell_transfer_id"),
                F.col("transfer_date").alias("sell_date"), F.col("transfer_fee").alias("sell_fee"))
    )
    buys = transfers.select("player_id", F.col("to_club_id").alias("from_club_id"),
                            F.col("transfer_id").alias("buy_transfer_id"), F.col("transfer_date").alias("buy_date"),
                            F.col("transfer_fee").alias("buy_fee"))
    hits = buys.join(F.broadcast(seeds), ["player_id", "from_club_id"]).filter(
        (F.col("sell_date") < F.col("buy_date")) & ((F.col("sell_fee") > min_fee) | (F.col("buy_fee") > min_fee)))
    ranked = hits.withColumn("_sum", F.coalesce(F.col("sell_fee") + F.col("buy_fee"), F.lit(-1.0))) \
        .orderBy(F.col("_sum").desc(), "sell_transfer_id", "buy_transfer_id").limit(top)
    named = ranked.join(players.select("player_id", F.col("name").alias("player_name")), "player_id") \
        .join(clubs.select(F.col("club_id").alias("from_club_id"), F.col("name").alias("sell_club_name")),
              "from_club_id", "left")
    return named.select("player_id", "player_name", F.col("from_club_id").alias("sell_club_id"), "sell_club_name",
                        "sell_transfer_id", "buy_transfer_id", "sell_date", "buy_date",
                        F.round("sell_fee", 0).alias("sell_fee"))
