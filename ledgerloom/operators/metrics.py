"""Owner metrics, composite score and league roll-ups."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels, returns
from ledgerloom.operators.skew import exact_medians
from ledgerloom.session import checkpointed

METRICS = ["total_transfers", "median_roi", "total_profit", "hit_rate", "value_creation",
           "annualized_roi", "profit_per_deal", "buying_club_premium"]


def club_metrics(pairs: DataFrame, keys: tuple[str, ...] = ("club_id",), min_deals: int | None = None) -> DataFrame:
    """Deals, median returns, total profit and hit rate per key; NULL returns do not count."""
    profit = F.col("profit")
    totals = [
        F.count("roi_pct").alias("total_transfers"),
        F.sum("profit").alias("total_profit"),
        (F.avg(F.when(profit > 0, 1.0).otherwise(0.0)) * 100).alias("hit_rate"),
        F.avg("profit").alias("profit_per_deal"),
    ]
    medians = {
        "median_roi": F.col("roi_pct"),
        "value_creation": F.col("value_creation_pct"),
        "annualized_roi": F.col("annualized_roi_pct"),
        "buying_club_premium": returns.buying_premium_pct(F.col("sell_fee"), F.col("peak_value")),
    }
    # the medians read their rows three times: the few columns they need are stored once
    rows = checkpointed(pairs.select(*keys, "profit", "roi_pct", "value_creation_pct", "annualized_roi_pct", "sell_fee", "peak_value"), "pair-metrics")
    out = exact_medians(rows, list(keys), medians, totals).select(*keys, *METRICS)
    return out if min_deals is None else having_min_deals(out, min_deals)


def having_min_deals(metrics: DataFrame, min_deals: int = C.MIN_TRANSFERS) -> DataFrame:
    return metrics.filter(F.col("total_transfers") >= max(min_deals, 2))


def in_windows(pairs: DataFrame, windows: tuple[int, ...] = C.ANALYTICS_WINDOWS) -> DataFrame:
    """Each pair once per window that covers its buy year: one pass serves all windows."""
    year = F.year("buy_date")
    keys = F.array_compact(F.array(*[F.when(year >= w, F.lit(str(w))) for w in windows]))
    return pairs.withColumn("window_key", F.explode(keys))


def composite(metrics: DataFrame, partition: str | None = None,
              weights: dict[str, float] = C.COMPOSITE_WEIGHTS) -> DataFrame:
    """Weighted sum of min-max scaled metrics; a constant metric scores 0.5 everywhere.

    The bounds are one row per window, joined on the window key; without windows they are
    a scalar subquery, so nothing is cross-joined.
    """
    values = {m: F.coalesce(m, F.lit(0.0)) if m == "annualized_roi" else F.col(m) for m in weights}
    ends = [f(v).alias(f"_{side}_{m}") for m, v in values.items() for side, f in (("lo", F.min), ("hi", F.max))]
    if partition:
        rows = metrics.join(metrics.groupBy(partition).agg(*ends), partition)
        bound = F.col
    else:
        rows = metrics
        bounds = metrics.agg(*ends).select(F.struct("*").alias("bounds")).scalar()
        bound = bounds.getField

    def scaled(m: str, v: Column) -> Column:
        lo, hi = bound(f"_lo_{m}"), bound(f"_hi_{m}")
        return F.when(hi == lo, 0.5).otherwise(F.try_divide(v - lo, hi - lo))

    score = reduce(add, [F.lit(w) * scaled(m, values[m]) for m, w in weights.items()])
    return rows.select(*metrics.columns, score.alias("composite_score"))


def onto_clubs(clubs: DataFrame, scores: DataFrame) -> DataFrame:
    """Registered clubs with their metrics; clubs without a score keep NULLs."""
    return clubs.join(scores, "club_id", "left")


def window_onto_clubs(windows: DataFrame, clubs: DataFrame, window: str) -> DataFrame:
    return windows.filter(F.col("window_key") == window).join(clubs, "club_id")


def league_spending(clubs: DataFrame, min_transfers: int = C.MIN_TRANSFERS,
                    names: dict[str, str] = C.SPENDING_LEAGUE_NAMES) -> DataFrame:
    league = F.col("domestic_competition_id")
    return (
        clubs.filter(league.isNotNull() & F.col("total_profit").isNotNull())
        .groupBy(league.alias("id"))
        .agg(F.count("club_id").alias("total_clubs"),
             F.coalesce(F.sum("total_transfers"), F.lit(0)).alias("total_transfers"),
             F.sum("total_profit").alias("_profit"))
        .filter(F.col("total_transfers") >= min_transfers)
        .select("id", F.coalesce(labels.league_name(F.col("id"), names), F.col("id")).alias("name"),
                "total_clubs", "total_transfers",
                F.round("_profit", 0).alias("total_profit"),
                F.round(F.col("_profit") / F.col("total_clubs"), 0).alias("avg_profit_per_club"))
        .orderBy(F.col("total_profit").asc(), "id")
    )


def profit_scale(leagues: DataFrame) -> DataFrame:
    """Profit placed in [0, 1] between the smallest and largest, zero always inside."""
    ends = leagues.agg(F.struct(
        F.least(F.min("total_profit"), F.lit(0.0)).alias("lo"),
        F.greatest(F.max("total_profit"), F.lit(0.0)).alias("hi")).alias("ends")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    return leagues.withColumn("ratio", (F.col("total_profit") - lo) / span)


def stack_totals(parts: dict[str, DataFrame]) -> DataFrame:
    """One row (metric, value) per total of the named one-row aggregates, in one job.

    A frame of several totals has their names joined by ", ", in the order of its columns.
    """
    rows = []
    for names, df in parts.items():
        entries = [F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in zip(names.split(", "), df.columns)]
        rows.append(df.select(F.inline(F.array(*entries))))
    return reduce(DataFrame.unionByName, rows)


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """The same totals as columns of a single row."""
    return stack_totals(parts).groupBy().agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for names in parts for m in names.split(", ")]
    )


def dashboard(transfers: DataFrame, clubs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Transfer and club counts, total club profit, and the most profitable single buy."""
    best = F.struct("profit", (-F.col("buy_transfer_id")).alias("neg_id"))
    parts = {
        "total_transfers": transfers.agg(F.count("transfer_id").alias("v")),
        "total_clubs": clubs.agg(F.count("club_id").alias("v")),
        "total_profit": clubs.agg(F.coalesce(F.sum("total_profit"), F.lit(0.0)).alias("v")),
    }
    top = pairs.agg(F.max(best).alias("b"))
    parts["biggest_profit"] = top.select("b.profit")
    row = stack_totals(parts).withColumn("id", F.lit(None).cast("bigint")).unionByName(
        top.select(F.lit("biggest_id").alias("metric"), F.lit(None).cast("double").alias("value"),
                   (-F.col("b.neg_id")).alias("id"))
    )
    return row.groupBy().agg(
        F.max(F.when(F.col("metric") == "total_transfers", F.col("value"))).cast("bigint").alias("total_transfers"),
        F.max(F.when(F.col("metric") == "total_clubs", F.col("value"))).cast("bigint").alias("total_clubs"),
        F.max(F.when(F.col("metric") == "total_profit", F.col("value"))).alias("total_profit"),
        F.max("id").alias("biggest_profit_transfer_id"),
        F.max(F.when(F.col("metric") == "biggest_profit", F.col("value"))).alias("biggest_profit"),
    )
