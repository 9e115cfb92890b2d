"""Set operations, de-duplication and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import parsing


def search(clubs: DataFrame, players: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Clubs first, then players, whose name contains ``text``; at most ``limit`` rows."""
    pattern = parsing.like_pattern(text)

    def found(rows: DataFrame, kind: str, rank: int, key: str, subtitle: str) -> DataFrame:
        hits = rows.filter(F.col("name").ilike(pattern)).select(
            F.lit(kind).alias("type"), F.lit(rank).alias("_rank"), F.col(key).alias("id"), "name",
            F.col(subtitle).alias("subtitle"))
        return hits.orderBy("id").limit(limit)

    both = found(clubs, "club", 0, "club_id", "domestic_competition_id").unionByName(
        found(players, "player", 1, "player_id", "position"))
    return both.orderBy("_rank", "id").limit(limit).drop("_rank")


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of all keys."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def first_per_key(rows: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row per key: the smallest by ``order``, or by the remaining columns."""
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    rank = F.struct(*rest) if order is None else order
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(*keys, "_row.*") \
        .select(*rows.columns)


def latest_per_key(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Insert-or-replace: the last row per key by ``order`` wins."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*") \
        .select(*rows.columns)


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows whose key is in neither the target nor an earlier incoming row (NULL = NULL)."""
    unique = first_per_key(incoming, keys, order)
    known = existing.select(*keys).distinct()
    return unique.join(known, same_key(unique, known, keys), "left_anti")


def upsert_partial(existing: DataFrame, incoming: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Known keys change only the ``update`` columns; unknown keys are added whole."""
    old, new = existing.alias("old"), incoming.withColumn("_new", F.lit(True)).alias("new")
    joined = old.withColumn("_old", F.lit(True)).alias("old").join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")

    def merged(c: str) -> Column:
        if c == key:
            return F.coalesce(f"old.{c}", f"new.{c}")
        if c in update:
            return F.when(F.col("new._new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
        return F.when(F.col("old._old"), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))

    return joined.select(*[merged(c).alias(c) for c in existing.columns])


def merge_non_empty(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A column changes only where the update has a non-empty value."""
    renamed = updates.select(key, *[F.col(c).alias(f"_u_{c}") for c in columns])

    def value(c: str) -> Column:
        new = F.col(f"_u_{c}")
        if dict(updates.dtypes)[c] == "string":
            trimmed = F.trim(new)
            new = F.when(trimmed != "", trimmed)
        return F.coalesce(new, F.col(c)).alias(c)

    joined = rows.join(renamed, key, "left")
    return joined.select(*[value(c) if c in columns else F.col(c) for c in rows.columns])


def clubs_in(clubs: DataFrame, leagues: list[str] | None = None, club_ids: list[int] | None = None) -> DataFrame:
    if club_ids is not None:
        return clubs.filter(F.col("club_id").isin(*club_ids)).select("club_id")
    return clubs.filter(F.col("domestic_competition_id").isin(*leagues)).select("club_id")


def players_in_scope(players: DataFrame, transfers: DataFrame, scope: DataFrame) -> DataFrame:
    """Active players who moved through a club in scope, or who play there with a value.

    A NULL current club name does not count as active.
    """
    active = players.filter(F.col("current_club_name") != "Retired")
    ids = scope.select("club_id").distinct()
    ends = transfers.select("player_id", F.explode(F.array("from_club_id", "to_club_id")).alias("club_id"))
    movers = ends.join(ids, "club_id", "left_semi").select("player_id").distinct().withColumn("_moved", F.lit(True))
    current = ids.select(F.col("club_id").alias("current_club_id"), F.lit(True).alias("_current"))
    kept = (
        active.join(movers, "player_id", "left").join(current, "current_club_id", "left")
        .filter(F.col("_moved") | (F.col("_current") & (F.col("market_value_in_eur") > 0)))
    )
    return kept.select("player_id", "name", "current_club_id",
                       F.coalesce("market_value_in_eur", F.lit(0.0)).alias("market_value_in_eur")) \
        .orderBy(F.col("market_value_in_eur").desc(), "player_id")


def players_at_clubs(players: DataFrame, scope: DataFrame) -> DataFrame:
    at = scope.select(F.col("club_id").alias("current_club_id"))
    return players.join(at, "current_club_id", "left_semi").select("player_id", "name", "current_club_id")


def start_from(players: DataFrame, transfers: DataFrame, first_id: int | None = None, skip_existing: bool = False,
               batch_size: int | None = None) -> DataFrame:
    """The enrichment queue: ids from ``first_id``, without players that already moved."""
    kept = players if first_id is None else players.filter(F.col("player_id") >= first_id)
    if skip_existing:
        kept = kept.join(transfers.select("player_id").distinct(), "player_id", "left_anti")
    ordered = kept.orderBy(F.col("market_value_in_eur").desc_nulls_last(), "player_id")
    return ordered if batch_size is None else ordered.limit(batch_size)


def remaining_targets(targets: DataFrame, loaded: DataFrame, keys: list[str], min_rows: int | None = None) -> DataFrame:
    """Targets not loaded yet; with ``min_rows``, also those loaded with fewer rows."""
    done = loaded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if min_rows is not None:
        done = done.filter(F.col("_n") >= min_rows)
    return targets.join(done.select(*keys), keys, "left_anti")


def scouting_targets(paired: DataFrame, players: DataFrame, tiered_clubs: DataFrame,
                     tiers: tuple[int, ...] = (3, 4)) -> DataFrame:
    """Distinct players of training-eligible buys from clubs in the given league tiers."""
    sellers = tiered_clubs.filter(
        F.col("league_tier").isin(*tiers) & F.col("domestic_competition_id").isNotNull()
    ).select(F.col("club_id").alias("from_club_id"))
    ids = paired.filter(F.col("is_training_eligible") == 1).join(sellers, "from_club_id", "left_semi") \
        .select("player_id").distinct()
    return players.join(ids, "player_id", "left_semi").select("player_id", F.col("name").alias("player_name"))
