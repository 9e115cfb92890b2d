"""The composed jobs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels
from ledgerloom.operators import features, fuzzy, gems, matching, metrics, pairs, sets
from ledgerloom.session import checkpointed


#: Clubs that are sent to all tasks at most.
MAX_SENT_CLUBS = 500_000


def all_pairs(transfers: DataFrame, valuations: DataFrame, players: DataFrame,
              min_fee: float = C.MIN_BUY_FEE) -> DataFrame:
    """Ledger to pairs with returns, peak value and player info, as one lazy plan."""
    matched = pairs.min_buy_fee(pairs.match_buy_sell(pairs.fee_bearing(transfers)), min_fee)
    return pairs.with_player_info(pairs.with_peak_value(pairs.with_returns(matched), valuations), players)


def club_scores(pair_rows: DataFrame, min_deals: int = C.MIN_TRANSFERS) -> DataFrame:
    """The metrics (one row per club) are stored before scaling, which reads them twice."""
    return metrics.composite(checkpointed(metrics.club_metrics(pair_rows, min_deals=min_deals), "club-metrics"))


def window_scores(pair_rows: DataFrame, windows: tuple[int, ...] = C.ANALYTICS_WINDOWS,
                  min_deals: int = C.MIN_TRANSFERS) -> DataFrame:
    return _scored_windows(metrics.in_windows(pair_rows, windows), min_deals)


def _scored_windows(rows: DataFrame, min_deals: int) -> DataFrame:
    stored = checkpointed(metrics.club_metrics(rows, ("window_key", "club_id"), min_deals), "window-metrics")
    return metrics.composite(stored, "window_key")


def full_analytics(transfers: DataFrame, valuations: DataFrame, players: DataFrame,
                   windows: tuple[int, ...] = C.ANALYTICS_WINDOWS, min_deals: int = C.MIN_TRANSFERS,
                   min_fee: float = C.MIN_BUY_FEE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs, all-time scores and window scores. Pairs are kept once for both consumers;
    the caller may unpersist them."""
    pair_rows = all_pairs(transfers, valuations, players, min_fee).persist(StorageLevel.DISK_ONLY)
    return pair_rows, club_scores(pair_rows, min_deals), window_scores(pair_rows, windows, min_deals)


def scores_by_period(pair_rows: DataFrame, windows: tuple[int, ...] = C.ANALYTICS_WINDOWS,
                     min_deals: int = C.MIN_TRANSFERS) -> DataFrame:
    """All-time and window scores in one pass: all-time is one more window, key ``all``."""
    year = F.year("buy_date")
    keys: list[Column] = [F.lit("all"), *[F.when(year >= w, F.lit(str(w))) for w in windows]]
    rows = pair_rows.withColumn("window_key", F.explode(F.array_compact(F.array(*keys))))
    return _scored_windows(rows, min_deals)


def league_tiers(paired: DataFrame, clubs: DataFrame, cuts: tuple[float, float, float] = (3.0, 6.0, 10.0)) -> DataFrame:
    return gems.tier_to_clubs(clubs, gems.league_tiers(gems.league_gem_rate(paired, clubs), cuts))


def feature_table(paired: DataFrame, players: DataFrame, tiered_clubs: DataFrame, appearances: DataFrame,
                  valuations: DataFrame, player_xg: DataFrame) -> DataFrame:
    """Facts are looked up for buys without names, which so stay narrow in the shuffles; players and clubs are joined last.

    Clubs are stored and counted; up to ``MAX_SENT_CLUBS`` are sent to all tasks, more are joined by shuffles.
    """
    rows = features.with_facts(features.training_rows(paired), appearances, valuations, player_xg)
    clubs = checkpointed(tiered_clubs, "tiered-clubs")
    return features.matrix(features.with_profiles(rows, players, F.broadcast(clubs) if clubs.count() <= MAX_SENT_CLUBS else clubs))


def reconcile_once(candidates: DataFrame, ledger: DataFrame, players: DataFrame,
                   threshold: float = C.INSERT_THRESHOLD, min_year: int = C.MIN_YEAR,
                   academy: DataFrame | None = None) -> DataFrame:
    """Candidates to ledger inserts: fingerprint, best match, confidence, insert rule."""
    return matching.to_insert(matching.scored(candidates, ledger, academy), players, threshold, min_year)


def linked_shots(shots: DataFrame, players: DataFrame) -> DataFrame:
    """Shots with the linked player; shots without one drop."""
    named = shots.withColumnsRenamed({"source_player_name": "name", "team_name": "team"})
    links = fuzzy.link_players(named, players).filter(F.col("player_id").isNotNull())
    joined = named.join(links, sets.same_key(named, links, ["name", "team"])).drop(links["name"], links["team"])
    return joined.withColumnsRenamed({"name": "source_player_name", "team": "team_name"})


XG_NUMBERS = {"xg": "double", "xa": "double", "npxg": "double", "shots": "bigint", "key_passes": "bigint",
              "games": "bigint", "goals": "bigint", "assists": "bigint", "xg_chain": "double", "xg_buildup": "double"}


def xg_competition(league: Column) -> Column:
    """Competition id of an xG source league; unknown leagues keep their name."""
    return F.coalesce(labels.lookup(league, C.XG_LEAGUES), league)


def linked_xg(rows: DataFrame, players: DataFrame, min_minutes: int = 90) -> DataFrame:
    """Season xG rows (text numbers) with the linked player, one per (player, season, competition).

    ``rows`` has name, team, season_start, competition_id, source_id, minutes and the
    numbers above. The last source row wins, as with insert-or-replace.
    """
    numbers = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).try_cast(kind) for c, kind in XG_NUMBERS.items()}
    minutes = F.coalesce(F.col("minutes").try_cast("double"), F.lit(0.0)).try_cast("bigint")
    season = F.concat(F.col("season_start").cast("string"), F.lit("/"), (F.col("season_start") + 1).cast("string"))
    named = rows.withColumns({**numbers, "minutes": minutes, "season": season})
    links = fuzzy.link_players(named, players)
    joined = named.join(links, sets.same_key(named, links, ["name", "team"]), "left").drop(links["name"], links["team"])
    kept = joined.filter(F.col("player_id").isNotNull() & (F.col("minutes") >= min_minutes)).select(
        "player_id", "season", "competition_id", *XG_NUMBERS, "minutes", "source_id", "match_score")
    return sets.latest_per_key(kept, ["player_id", "season", "competition_id"], F.col("source_id"))


def xg_report(rows: DataFrame, links: DataFrame, by: str, min_minutes: int = 90) -> DataFrame:
    """Rows found, matched and matched-but-too-short per group."""
    joined = rows.join(links, sets.same_key(rows, links, ["name", "team"]), "left").drop(links["name"], links["team"])
    linked = F.col("player_id").isNotNull()
    minutes = F.col("minutes").try_cast("double")
    return joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("found"), F.count_if(linked & (minutes >= min_minutes)).alias("matched"),
        F.count_if(linked & (minutes < min_minutes)).alias("short"), F.count_if(~linked).alias("unmatched"))


