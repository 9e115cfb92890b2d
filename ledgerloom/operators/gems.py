"""High-return youth buys by origin, and the league tiers built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels


def gem(min_roi: float = 100, max_age: float = 23) -> Column:
    return (F.col("roi_pct") >= min_roi) & (F.col("age_at_transfer") <= max_age)


def _percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.try_divide(part * 100.0, whole), digits)


def _from_known_league(paired: DataFrame, clubs: DataFrame) -> DataFrame:
    """Paired buys joined to the club they were bought from (club ids are unique)."""
    sellers = clubs.filter(F.col("domestic_competition_id").isNotNull()).select(
        F.col("club_id").alias("from_club_id"), F.col("name").alias("club"),
        F.col("domestic_competition_id").alias("league"))
    return paired.filter(F.col("roi_pct").isNotNull()).join(sellers, "from_club_id")


def _deals() -> Column:
    return F.count("transfer_id")


def _gems() -> Column:
    return F.count(F.when(gem(), F.col("transfer_id")))


def gem_leagues(paired: DataFrame, clubs: DataFrame, min_deals: int = 10, limit: int | None = 30) -> DataFrame:
    out = (
        _from_known_league(paired, clubs).groupBy(F.col("league").alias("origin_league"))
        .agg(_deals().alias("total_deals"), _gems().alias("gems"),
             F.round(F.avg(F.when(gem(), F.col("roi_pct"))), 1).alias("avg_gem_roi"),
             F.round(F.sum(F.when(gem(), F.col("profit"))), 0).alias("gem_profit"),
             F.round(F.avg(F.when(gem(), F.col("buy_fee"))), 0).alias("avg_buy_fee"),
             F.round(F.avg(F.when(gem(), F.col("sell_fee"))), 0).alias("avg_sell_fee"))
        .filter(F.col("total_deals") >= min_deals)
        .withColumn("gem_rate_pct", _percent(F.col("gems"), F.col("total_deals")))
        .orderBy(F.col("gems").desc(), "origin_league")
    )
    return out if limit is None else out.limit(limit)


def gem_clubs(paired: DataFrame, clubs: DataFrame, min_deals: int = 5, limit: int | None = 30) -> DataFrame:
    out = (
        _from_known_league(paired, clubs).groupBy("from_club_id")
        .agg(F.min("club").alias("club"), F.min("league").alias("league"),
             _deals().alias("sold"), _gems().alias("gems"),
             F.round(F.sum(F.when(gem(), F.col("profit"))), 0).alias("gem_profit"))
        .filter(F.col("sold") >= min_deals)
        .withColumn("gem_pct", _percent(F.col("gems"), F.col("sold")))
        .orderBy(F.col("gems").desc(), "from_club_id")
    )
    return out if limit is None else out.limit(limit)


def gem_signature(paired: DataFrame) -> DataFrame:
    kept = paired.filter(gem() & F.col("buy_fee").isNotNull() & F.col("sell_fee").isNotNull())
    return (
        kept.groupBy(F.coalesce("player_position", F.lit("Unknown")).alias("position"))
        .agg(F.count(F.lit(1)).alias("cnt"),
             F.round(F.avg("age_at_transfer"), 1).alias("avg_age"),
             F.round(F.avg("buy_fee"), 0).alias("avg_buy"),
             F.round(F.avg("sell_fee"), 0).alias("avg_sell"),
             F.round(F.avg("roi_pct"), 1).alias("avg_roi"),
             F.round(F.avg("tenure_years"), 1).alias("avg_tenure"))
        .orderBy(F.col("cnt").desc(), "position")
    )


def gem_agents(paired: DataFrame, players: DataFrame, min_gems: int = 3, limit: int | None = 20) -> DataFrame:
    agents = players.filter(F.col("agent_name").isNotNull()).select("player_id", F.col("agent_name").alias("agent"))
    out = (
        paired.filter(F.col("roi_pct").isNotNull()).join(agents, "player_id").groupBy("agent")
        .agg(_deals().alias("deals"), _gems().alias("gems"),
             F.round(F.avg(F.when(gem(), F.col("roi_pct"))), 1).alias("avg_gem_roi"),
             F.round(F.sum(F.when(gem(), F.col("profit"))), 0).alias("gem_profit"))
        .filter(F.col("gems") >= min_gems)
        .orderBy(F.col("gems").desc(), "agent")
    )
    return out if limit is None else out.limit(limit)


def league_gem_rate(paired: DataFrame, clubs: DataFrame, min_deals: int = 5, before: str = "2030-01-01") -> DataFrame:
    """Counted by selling club before the clubs are joined, so that no buys are shuffled."""
    dated = paired.filter((F.col("transfer_date") < F.lit(before).cast("date")) & F.col("roi_pct").isNotNull())
    by_club = dated.groupBy("from_club_id").agg(_deals().alias("_deals"), _gems().alias("_gems"))
    leagues = clubs.filter(F.col("domestic_competition_id").isNotNull()).select(
        F.col("club_id").alias("from_club_id"), F.col("domestic_competition_id").alias("league_id"))
    return (
        by_club.join(leagues, "from_club_id").groupBy("league_id")
        .agg(F.sum("_deals").alias("total_deals"), F.sum("_gems").alias("gems"))
        .filter(F.col("total_deals") >= min_deals)
        .withColumn("gem_rate", _percent(F.col("gems"), F.col("total_deals")))
    )


def league_tiers(rates: DataFrame, cuts: tuple[float, float, float] = (3.0, 6.0, 10.0)) -> DataFrame:
    """The rate is already rounded to 0.1 when it meets the cut-offs."""
    return rates.withColumn("tier", labels.league_tier(F.coalesce("gem_rate", F.lit(0.0)), cuts))


def tier_to_clubs(clubs: DataFrame, tiers: DataFrame) -> DataFrame:
    """Leagues without a tier fall to 4; clubs without a league stay NULL."""
    table = tiers.select(F.col("league_id").alias("domestic_competition_id"), "tier")
    joined = clubs.join(table, "domestic_competition_id", "left")
    tier = F.when(F.col("domestic_competition_id").isNotNull(), F.coalesce("tier", F.lit(4)))
    return joined.withColumn("league_tier", tier).drop("tier")


def tier_summary(tiered_clubs: DataFrame, paired: DataFrame) -> DataFrame:
    sellers = tiered_clubs.select(F.col("club_id").alias("from_club_id"), "league_tier")
    return (
        paired.filter(F.col("roi_pct").isNotNull()).join(sellers, "from_club_id")
        .filter(F.col("league_tier").isNotNull()).groupBy("league_tier")
        .agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg("roi_pct"), 1).alias("avg_roi"),
             F.round(F.sum("profit"), 0).alias("total_profit"))
    )


def agent_sizes(players: DataFrame) -> DataFrame:
    real = players.filter(F.col("agent_name").isNotNull() & ~F.col("agent_name").isin("no agent", ""))
    return real.groupBy("agent_name").agg(F.count(F.lit(1)).alias("players"))


def largest_agents(sizes: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` agents by size (ties by name); never more than ``top`` rows."""
    return sizes.orderBy(F.col("players").desc(), "agent_name").limit(top)


def agent_clusters(players: DataFrame, top: int = 10) -> DataFrame:
    """Adds agent_cluster: Mega, Active, Small, Solo or Unknown."""
    sizes = agent_sizes(players)
    mega = F.broadcast(largest_agents(sizes, top).select("agent_name", F.lit(True).alias("_mega")))
    ranked = sizes.join(mega, "agent_name", "left")
    label = (
        F.when(F.col("agent_name").isin("no agent", ""), "Solo")
        .when(F.col("_mega"), "Mega").when(F.col("players") >= 5, "Active")
        .when(F.col("players") >= 2, "Small").when(F.col("players") >= 1, "Solo").otherwise("Unknown")
    )
    joined = players.join(ranked, "agent_name", "left")
    return joined.withColumn("agent_cluster", label).drop("_mega", "players")


def distribution(pair_rows: DataFrame) -> DataFrame:
    """Row counts by gem tier, eligibility and confidence, as (category, key, rows)."""
    eligible = F.col("is_training_eligible")
    band = F.when(F.col("confidence_score") >= 0.99, "high").when(F.col("confidence_score") >= 0.90, "medium").otherwise("low")
    keys = {
        "gem_tier": F.col("gem_tier").cast("string"),
        "training_eligible": eligible.cast("string"),
        "training_class": F.when(eligible == 1, F.col("is_gem").cast("string")),
        "confidence": band,
        "roi_above_5000": F.when(F.col("roi_pct") > 5000, "yes"),
    }
    flags = F.array(*[F.struct(F.lit(c).alias("category"), k.alias("key")) for c, k in keys.items()])
    return (
        pair_rows.select(F.inline(flags)).filter(F.col("key").isNotNull())
        .groupBy("category", "key").agg(F.count(F.lit(1)).alias("rows"))
    )


def confidence_bands(scored: DataFrame, column: str = "score") -> DataFrame:
    score = F.col(column)
    return scored.agg(
        F.count_if(score >= C.HIGH_CONFIDENCE).alias("high"),
        F.count_if((score >= C.MEDIUM_CONFIDENCE) & (score < C.HIGH_CONFIDENCE)).alias("medium"),
        F.count_if(score < C.MEDIUM_CONFIDENCE).alias("low"),
    )
