"""Buy-sell pairing and everything hung on a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels, returns
from ledgerloom.operators.skew import asof_by_day

PAIR_COLUMNS = ["buy_fee", "sell_fee", "profit", "roi_pct", "annualized_roi_pct", "player_position"]


def year_range(df: DataFrame, date: str, min_year: int = C.MIN_YEAR, max_year: int = C.MAX_YEAR) -> DataFrame:
    """Rows dated inside the years; undated rows stay. Plain date bounds reach the scan."""
    on = F.col(date)
    return df.filter(on.isNull() | on.between(F.make_date(F.lit(min_year), F.lit(1), F.lit(1)),
                                              F.make_date(F.lit(max_year), F.lit(12), F.lit(31))))


def fee_bearing(transfers: DataFrame) -> DataFrame:
    return transfers.filter(F.col("transfer_fee") > 0)


def latest_sales(transfers: DataFrame) -> DataFrame:
    """The last sale per (player, club): by date, then by transfer id."""
    sale = F.struct("transfer_date", "transfer_id", "transfer_fee")
    dated = transfers.filter(F.col("from_club_id").isNotNull() & F.col("transfer_date").isNotNull())
    return (
        dated.groupBy("player_id", F.col("from_club_id").alias("club_id")).agg(F.max(sale).alias("sale"))
        .select("player_id", "club_id",
                F.col("sale.transfer_date").alias("sell_date"),
                F.col("sale.transfer_id").alias("sell_transfer_id"),
                F.col("sale.transfer_fee").alias("sell_fee"))
    )


def match_buy_sell(transfers: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Each buy with the last sale of that player by the buying club, if it came later.

    The last sale after a buy is the key's last sale overall whenever that is after the
    buy, so one row per key joins the buys: no many-to-many step.
    """
    buys = transfers.filter(F.col("to_club_id").isNotNull()).select(
        F.col("transfer_id").alias("buy_transfer_id"), "player_id",
        F.col("to_club_id").alias("club_id"), F.col("transfer_date").alias("buy_date"),
        F.col("transfer_fee").alias("buy_fee"), *extra,
    )
    matched = buys.join(latest_sales(transfers), ["player_id", "club_id"])
    return matched.filter(F.col("sell_date") > F.col("buy_date"))


def min_buy_fee(pairs: DataFrame, limit: float = C.MIN_BUY_FEE) -> DataFrame:
    return pairs.filter(F.col("buy_fee") >= limit)


def with_returns(pairs: DataFrame) -> DataFrame:
    buy, sell = F.col("buy_fee"), F.col("sell_fee")
    return pairs.withColumns({
        "profit": returns.profit(buy, sell),
        "roi_pct": returns.roi_pct(buy, sell),
        "tenure_days": returns.tenure_days(F.col("buy_date"), F.col("sell_date")),
        "tenure_years": returns.tenure_years(F.col("buy_date"), F.col("sell_date")),
    }).withColumn("annualized_roi_pct", returns.annualized_roi_pct(buy, sell, F.col("tenure_years")))


def peak_values(valuations: DataFrame) -> DataFrame:
    return valuations.groupBy("player_id").agg(F.max("market_value_in_eur").alias("peak_value"))


def with_peak_value(pairs: DataFrame, valuations: DataFrame) -> DataFrame:
    joined = pairs.join(peak_values(valuations), "player_id", "left")
    return joined.withColumn("value_creation_pct", returns.value_creation_pct(F.col("buy_fee"), F.col("peak_value")))


def with_player_info(pairs: DataFrame, players: DataFrame) -> DataFrame:
    info = players.select("player_id", F.col("name").alias("player_name"), F.col("position").alias("player_position"))
    return pairs.join(info, "player_id", "left")


def on_transfers(transfers: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ledger with pair columns on the buy rows."""
    columns = ["buy_fee", "sell_fee", "profit", "roi_pct", "annualized_roi_pct", "tenure_days",
               "tenure_years", "peak_value", "value_creation_pct", "player_position"]
    kept = [c for c in columns if c in pairs.columns]
    return transfers.join(pairs.select(F.col("buy_transfer_id").alias("transfer_id"), *kept), "transfer_id", "left")


def with_last_sale(transfers: DataFrame) -> DataFrame:
    """The ledger with date and fee of the ``latest_sales`` row of each row's player and buying club (``sell_date``, ``_sell_fee``).

    ``transfers`` is clustered by player, so nothing is shuffled: a paid sale stands once more, at the club that sold, and
    the rows of a player and club are looked through together.
    """
    is_sale = (F.col("transfer_fee") > 0) & F.col("player_id").isNotNull() & F.col("from_club_id").isNotNull() & F.col("transfer_date").isNotNull()
    sale = F.when(is_sale, F.struct("transfer_date", "transfer_id", "transfer_fee"))
    as_buy = F.struct(F.col("to_club_id").alias("_club"), F.when(F.lit(False), sale).alias("_sale"))
    as_sale = F.when(is_sale, F.struct(F.col("from_club_id").alias("_club"), sale.alias("_sale")))
    last = F.max("_sale").over(Window.partitionBy("player_id", "_club"))
    seen = transfers.select("*", F.inline(F.array_compact(F.array(as_buy, as_sale)))).withColumn("_last", last)
    return seen.filter(F.col("_sale").isNull()).withColumns({
        "sell_date": F.col("_last.transfer_date"), "_sell_fee": F.col("_last.transfer_fee")}).drop("_club", "_sale", "_last")


def paired_transfers(transfers: DataFrame, valuations: DataFrame, players: DataFrame, min_fee: float = C.MIN_BUY_FEE,
                     clustered: bool = False) -> DataFrame:
    """The ledger with player name and age, and the columns of ``on_transfers`` for all pairs of the ledger.

    The ledger is shuffled once, by player, or not at all if its rows are ``clustered`` by player already. There it meets its
    last sales, its player's row and peak value; it is never joined with its own pairs by id.
    """
    info = players.select("player_id", F.col("name").alias("player_name"), F.col("position").alias("_position"), "date_of_birth")
    peaks = peak_values(valuations).withColumnRenamed("peak_value", "_peak")
    rows = with_last_sale(transfers if clustered else transfers.repartition("player_id"))
    rows = rows.join(info, "player_id", "left").join(peaks, "player_id", "left")
    fee, day = F.col("transfer_fee"), F.col("transfer_date")
    is_pair = (fee > 0) & (fee >= min_fee) & (F.col("sell_date") > day)

    def of_pair(value: Column) -> Column:
        return F.when(is_pair, value)

    buy, sell, years = F.col("buy_fee"), F.col("sell_fee"), F.col("tenure_years")
    return (
        rows.withColumns({
            "age_at_transfer": returns.age_years(F.col("date_of_birth"), day), "buy_fee": of_pair(fee), "sell_fee": of_pair(F.col("_sell_fee")),
            "tenure_days": of_pair(returns.tenure_days(day, F.col("sell_date"))), "tenure_years": of_pair(returns.tenure_years(day, F.col("sell_date"))),
            "peak_value": of_pair(F.col("_peak")), "player_position": of_pair(F.col("_position"))})
        .withColumns({
            "profit": of_pair(returns.profit(buy, sell)), "roi_pct": of_pair(returns.roi_pct(buy, sell)),
            "annualized_roi_pct": of_pair(returns.annualized_roi_pct(buy, sell, years)),
            "value_creation_pct": of_pair(returns.value_creation_pct(buy, F.col("peak_value")))})
        .drop("sell_date", "_sell_fee", "_position", "_peak", "date_of_birth")
    )


def buy_year_window(pairs: DataFrame, year: int) -> DataFrame:
    return pairs.filter(F.col("buy_date") >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))


def _filled(sales: DataFrame, wants: Column, source: str, columns: list[str]) -> DataFrame:
    return sales.withColumns({
        c: F.when(wants & F.col(source).isNotNull(), F.col(f"{source}.{c}")).otherwise(F.col(c)) for c in columns
    })


def propagate_profit_asof(ledger: DataFrame, columns: list[str] = PAIR_COLUMNS) -> DataFrame:
    """Paid sales without a profit of their own take the pair columns of the club's latest
    earlier buy of that player that has a profit. Club id 0 means no club.

    Only sales that may take some, and buys that may give some, are shuffled; all other rows come through as they are.
    """
    wants = F.col("profit").isNull() & (F.col("transfer_fee") > 0)
    known = F.col("player_id").isNotNull() & (F.col("from_club_id") != 0) & F.col("transfer_date").isNotNull()
    asks = F.coalesce(wants & known, F.lit(False))
    buys = ledger.filter((F.col("transfer_fee") > 0) & F.col("profit").isNotNull() & (F.col("to_club_id") != 0))
    points = buys.select("player_id", F.col("to_club_id").alias("from_club_id"),
                         F.col("transfer_date").alias("buy_day"), "transfer_id", *columns)
    found = asof_by_day(ledger.filter(asks), points, ["player_id", "from_club_id"], "transfer_date", "buy_day",
                        columns, ["transfer_id"])
    filled = _filled(found, wants, "_asof", columns).select(*ledger.columns)
    return filled.union(ledger.filter(~asks))


def propagate_profit_last_buy(ledger: DataFrame, columns: list[str] = PAIR_COLUMNS) -> DataFrame:
    """As above, but only the club's very last buy with a return counts, and only if it is
    earlier than the sale. Club id 0 means no club."""
    buys = ledger.filter((F.col("transfer_fee") > 0) & F.col("roi_pct").isNotNull() & (F.col("to_club_id") != 0))
    last = buys.groupBy("player_id", F.col("to_club_id").alias("from_club_id")).agg(
        F.max_by(F.struct("transfer_date", *columns),
                 F.struct(F.col("transfer_date").isNull(), "transfer_date", "transfer_id")).alias("_buy")
    )
    joined = ledger.join(last, ["player_id", "from_club_id"], "left")
    wants = (F.col("profit").isNull() & (F.col("transfer_fee") > 0)
             & (F.col("transfer_date") > F.col("_buy.transfer_date")))
    return _filled(joined, wants, "_buy", columns).drop("_buy")


def pair_table(pairs: DataFrame, age: str = "age_at_buy", training_cutoff: str = "2021-01-01",
               max_age: float = 23, confidence: float = 1.0, min_confidence: float = C.INSERT_THRESHOLD) -> DataFrame:
    """The stored pair table: gem columns, confidence and training eligibility."""
    roi = F.col("roi_pct")
    return (
        pairs.withColumns({
            "gem_tier": labels.gem_tier(roi),
            "is_gem": labels.is_gem(roi),
            "confidence_score": F.lit(confidence),
            "is_training_eligible": labels.is_training_eligible(roi, F.col("buy_date"), F.col(age),
                                                                training_cutoff, max_age),
        })
        .filter(F.col("confidence_score") >= min_confidence)
        .withColumnRenamed("club_id", "holding_club_id")
        .select("player_id", "buy_transfer_id", "sell_transfer_id", "buy_fee", "sell_fee", "roi_pct",
                "holding_club_id", "tenure_years", age, "is_gem", "gem_tier", "confidence_score",
                "is_training_eligible")
    )
