"""Point-in-time features of a buy.

A look-back window of fixed length is a running sum: a fact dated d enters the window on
day d+1 and leaves it on day d+length+1, so no fact is paired with a buy. Facts and buys are
shuffled once, together, by the key they share; what is looked up by player comes as one row
per player, so the buys themselves move once by (player, club) and once by player.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels, returns

DAY = "_day"


def training_rows(paired: DataFrame) -> DataFrame:
    """Training-eligible buys, without names."""
    return paired.filter((F.col("is_training_eligible") == 1) & F.col("roi_pct").isNotNull()).select(
        F.col("transfer_id").alias("pair_id"), "player_id", F.col("from_club_id").alias("selling_club_id"),
        F.col("to_club_id").alias("buying_club_id"), "transfer_date",
        "buy_fee", "sell_fee", "roi_pct", "is_gem", "gem_tier", F.col("age_at_transfer").alias("age_at_buy"),
        labels.transfer_window(F.col("transfer_date")).alias("transfer_window"), "tenure_years", "profit")


def with_profiles(rows: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Buys with player, selling club and buying club; buys of unknown players drop."""
    seller = clubs.select(F.col("club_id").alias("selling_club_id"), F.col("name").alias("selling_club_name"),
                          F.col("domestic_competition_id").alias("_s_league"), F.col("league_tier").alias("_s_tier"))
    buyer = clubs.select(F.col("club_id").alias("buying_club_id"), F.col("name").alias("buying_club_name"),
                         F.col("domestic_competition_id").alias("_b_league"), F.col("league_tier").alias("_b_tier"))
    people = players.select(
        "player_id", F.col("name").alias("player_name"), "position", "position_bucket", "citizenship",
        "citizenship_region", "agent_name", "agent_cluster", "height_in_cm", "foot", "date_of_birth")
    joined = rows.join(people, "player_id").join(seller, "selling_club_id", "left").join(buyer, "buying_club_id", "left")
    return joined.withColumns({
        "selling_league": F.coalesce("_s_league", F.lit("UNKNOWN")),
        "selling_league_tier": F.coalesce("_s_tier", F.lit(0)),
        "buying_league": F.coalesce("_b_league", F.lit("UNKNOWN")),
        "buying_league_tier": F.coalesce("_b_tier", F.lit(0)),
    }).drop("_s_league", "_s_tier", "_b_league", "_b_tier")


def training_base(paired: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    """Training-eligible buys with player, selling club and buying club."""
    return with_profiles(training_rows(paired), players, clubs)


STATS = ["minutes", "goals", "assists", "yellow", "red"]
SUMS = [*STATS, "last", "prev", "games"]
APPEARANCE_KEYS = ["player_id", "selling_club_id", "transfer_date"]


def with_window_sums(buys: DataFrame, appearances: DataFrame, days: int = 730, recent: int = 365) -> DataFrame:
    """Buys (``APPEARANCE_KEYS`` and any other columns) with the sums over [buy - days, buy) at the selling club.

    Facts and buys of a (player, club) lie in one order, where each fact stands for its changes. A game seen on several
    dates counts once: its dates merge into stretches with gaps of at most ``days``, each adding one game at its start and
    removing one after its end.
    """
    keys = ["player_id", "selling_club_id"]
    ends = buys.filter(F.col("selling_club_id").isNotNull()).agg(
        F.struct(F.date_sub(F.min("transfer_date"), days).alias("first"), F.max("transfer_date").alias("last")).alias("ends")).scalar()
    facts = appearances.filter(
        (F.col("minutes_played") > 0) & (F.col("date") >= ends.getField("first")) & (F.col("date") < ends.getField("last"))
        & F.col("player_id").isNotNull() & F.col("player_club_id").isNotNull()).select(
        "player_id", F.col("player_club_id").alias("selling_club_id"), "game_id", F.col("date").alias(DAY),
        F.col("minutes_played").alias("minutes"), F.coalesce("goals", F.lit(0)).alias("goals"),
        F.coalesce("assists", F.lit(0)).alias("assists"), F.coalesce("yellow_cards", F.lit(0)).alias("yellow"),
        F.coalesce("red_cards", F.lit(0)).alias("red"))
    asked = buys.select(*keys, F.struct("transfer_date", *[c for c in buys.columns if c not in APPEARANCE_KEYS]).alias("_buy"))
    is_buy = F.col("_buy").isNotNull()
    both = facts.unionByName(asked, allowMissingColumns=True).repartition(*keys)
    # facts of players and clubs without buys go first
    met = both.withColumn("_met", F.max(is_buy).over(Window.partitionBy(*keys))).filter("_met")
    seen = Window.partitionBy(*keys, is_buy, "game_id").orderBy(DAY)
    before, after = F.lag(DAY).over(seen), F.lead(DAY).over(seen)
    edges = met.withColumns({"_starts": before.isNull() | (F.datediff(F.col(DAY), before) > days),
                             "_ends": after.isNull() | (F.datediff(after, F.col(DAY)) > days)})

    def change(at: Column, buy: Column, **sums: Column) -> Column:
        return F.struct(at.alias("_at"), buy.alias("_buy"), *[sums.get(c, F.lit(0)).cast("bigint").alias(c) for c in SUMS])

    minutes, none, stats = F.col("minutes"), F.when(F.lit(False), F.col("_buy")), {c: F.col(c) for c in STATS}
    changes = F.when(is_buy, F.array(change(F.col("_buy.transfer_date"), F.col("_buy")))).otherwise(F.array(
        change(F.date_add(DAY, 1), none, **stats, last=minutes, games=F.col("_starts").cast("int")),
        change(F.date_add(DAY, recent + 1), none, last=-minutes, prev=minutes),
        change(F.date_add(DAY, days + 1), none, **{c: -v for c, v in stats.items()}, prev=-minutes, games=-F.col("_ends").cast("int"))))
    upto = Window.partitionBy(*keys).orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    running = edges.select(*keys, F.inline(changes)).withColumns({c: F.sum(c).over(upto) for c in SUMS})
    return running.filter(is_buy).select(*keys, "_buy.*", *SUMS)


def appearance_window(base: DataFrame, appearances: DataFrame, days: int = 730, recent: int = 365) -> DataFrame:
    """Sums over [buy - days, buy) at the selling club, per (player, club, buy day)."""
    buys = base.filter(F.col("selling_club_id").isNotNull() & F.col("transfer_date").isNotNull()).select(*APPEARANCE_KEYS).distinct()
    return with_window_sums(buys, appearances, days, recent).select(*APPEARANCE_KEYS, *SUMS)


def with_appearances(base: DataFrame, appearances: DataFrame) -> DataFrame:
    """Buys without a club or day find nothing: all sums are 0."""
    return with_window_sums(base, appearances).select(*base.columns, *SUMS)


def appearance_columns(full_season: int = 900) -> list[Column]:
    minutes = F.col("minutes")
    return [
        returns.per_90(F.col("goals"), minutes).alias("goals_per_90"),
        returns.per_90(F.col("assists"), minutes).alias("assists_per_90"),
        returns.per_90(F.col("goals") + F.col("assists"), minutes).alias("g_plus_a_per_90"),
        F.col("last").alias("minutes_last_season"), F.col("prev").alias("minutes_prev_season"),
        F.when(F.col("prev") > 0, F.try_divide("last", "prev")).alias("minutes_trend"),
        F.col("games").alias("games_played"),
        returns.per_90(F.col("yellow") + F.col("red") * 2, minutes).alias("cards_per_90"),
        F.when(minutes >= full_season, 1).otherwise(0).alias("has_appearance_data"),
    ]


def appearance_features(base: DataFrame, appearances: DataFrame) -> DataFrame:
    return with_appearances(base, appearances).select("pair_id", *appearance_columns())


def valuation_points(base: DataFrame, valuations: DataFrame, buffer: int = 30, target: int = 365) -> DataFrame:
    """Per (player, buy day): peak value up to buy-buffer, and the value nearest buy-target.

    The nearest value is the last one up to the target or the first one after it (and not
    past the buffer); equal distances go to the earlier date, equal dates to the lower value.
    """
    probe = F.array(F.struct(F.date_sub("transfer_date", buffer).alias("at"), F.lit(True).alias("_buffer"), F.lit(False).alias("_target")),
                    F.struct(F.date_sub("transfer_date", target).alias("at"), F.lit(False).alias("_buffer"), F.lit(True).alias("_target")))
    probes = base.filter(F.col("player_id").isNotNull() & F.col("transfer_date").isNotNull()).select("player_id", F.inline(probe))
    facts = valuations.filter(F.col("player_id").isNotNull() & F.col("market_value_in_eur").isNotNull() & F.col("date").isNotNull()).select(
        "player_id", F.col("date").alias("at"), F.col("market_value_in_eur").alias("value"))
    timeline = facts.unionByName(probes, allowMissingColumns=True).repartition("player_id").groupBy("player_id", "at").agg(
        F.max("value").alias("peak"), F.min("value").alias("value"), F.max("_buffer").alias("_buffer"), F.max("_target").alias("_target")) \
        .withColumn("_fact", F.when(F.col("value").isNotNull(), F.struct(F.col("at").alias("on"), "value")))
    whole = Window.partitionBy("player_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past = Window.partitionBy("player_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    future = Window.partitionBy("player_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    known = timeline.select(
        "player_id", "at", "_buffer", "_target", "_fact", F.max("peak").over(past).alias("peak"),
        F.last("_fact", True).over(past).alias("before"), F.max("_buffer").over(whole).alias("_met")
    ).filter("_met").withColumn("after", F.last("_fact", True).over(future))
    # what is known at the buffer and at the target of a buy day comes together in one row
    day, none = F.lit(None).cast("date"), F.lit(None).cast(valuations.schema["market_value_in_eur"].dataType)
    found = F.array_compact(F.array(
        F.when(F.col("_buffer"), F.struct(F.date_add("at", buffer).alias("transfer_date"), "peak", day.alias("b_on"), none.alias("b_value"),
                                          day.alias("a_on"), none.alias("a_value"))),
        F.when(F.col("_target"), F.struct(F.date_add("at", target).alias("transfer_date"), none.alias("peak"), F.col("before.on").alias("b_on"),
                                          F.col("before.value").alias("b_value"), F.col("after.on").alias("a_on"), F.col("after.value").alias("a_value")))))
    both = known.select("player_id", F.inline(found)).groupBy("player_id", "transfer_date").agg(
        *[F.max(c).alias(c) for c in ("peak", "b_on", "b_value", "a_on", "a_value")])
    goal = F.date_sub("transfer_date", target)
    usable = F.col("a_on") <= F.date_sub("transfer_date", buffer)
    later = usable & (F.col("b_on").isNull() | (F.datediff("a_on", goal) < F.datediff(goal, "b_on")))
    return both.select("player_id", "transfer_date", "peak", F.when(later, F.col("a_value")).otherwise(F.col("b_value")).alias("nearest"))


def by_player(rows: DataFrame, key: str, name: str) -> DataFrame:
    """One row per player with a map from ``key`` to the other columns; as long as a player has buy days or seasons."""
    values = F.struct(*[c for c in rows.columns if c not in ("player_id", key)])
    return rows.filter(F.col(key).isNotNull()).groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), values))).alias(name))


def with_valuations(base: DataFrame, valuations: DataFrame, buys: DataFrame | None = None) -> DataFrame:
    """``buys`` has the players and buy days of ``base``, if they come cheaper from elsewhere."""
    points = by_player(valuation_points(base if buys is None else buys, valuations), "transfer_date", "_points")
    point = F.try_element_at("_points", F.col("transfer_date"))
    return base.join(points, "player_id", "left").withColumns({"peak": point["peak"], "nearest": point["nearest"]}).drop("_points")


def market_value_columns() -> list[Column]:
    """``mv_at_transfer`` and the peak are the same quantity by definition."""
    at, year_ago, fee = F.col("peak"), F.col("nearest"), F.col("buy_fee")
    return [
        at.alias("mv_at_transfer"), year_ago.alias("mv_12mo_before"),
        F.when(year_ago > 0, F.try_divide(at - year_ago, year_ago)).alias("mv_trend"),
        F.when((at > 0) & (fee > 0), F.try_divide(fee, at)).alias("fee_vs_mv"),
        F.when((at > 0) & (fee > 0), F.try_divide(at, fee)).alias("peak_mv_to_fee"),
    ]


def market_value_features(base: DataFrame, valuations: DataFrame) -> DataFrame:
    return with_valuations(base, valuations).select("pair_id", *market_value_columns())


def one_hot(value: Column, prefix: str, vocabulary: tuple[str, ...], other: str) -> list[Column]:
    """A 0/1 column per word; anything else, NULL included, is ``other``."""
    known = F.coalesce(F.when(value.isin(*vocabulary), value), F.lit(other))
    words = vocabulary if other in vocabulary else (*vocabulary, other)
    return [F.when(known == w, 1).otherwise(0).alias(f"{prefix}_{w}") for w in words]


def profile_columns() -> list[Column]:
    bucket = F.col("position_bucket")
    is_other = F.when(bucket.isin(*[p for p in C.POSITION_VOCAB if p != "Other"]), 0).otherwise(1)
    return [
        F.col("age_at_buy"), F.col("height_in_cm"), F.lit(0).alias("is_international"),
        is_other.alias("is_other_position"),
        *one_hot(bucket, "pos", C.POSITION_VOCAB, "Other"),
        *one_hot(F.initcap("foot"), "foot", C.FOOT_VOCAB, "Unknown"),
        *one_hot(F.col("citizenship_region"), "region", C.REGION_VOCAB, "Unknown"),
        *one_hot(F.col("agent_cluster"), "agent", C.AGENT_VOCAB, "Unknown"),
    ]


def profile_features(base: DataFrame) -> DataFrame:
    return base.select("pair_id", *profile_columns())


def context_columns() -> list[Column]:
    seller, buyer = F.coalesce("selling_league_tier", F.lit(0)), F.coalesce("buying_league_tier", F.lit(0))
    return [
        seller.alias("selling_league_tier"), buyer.alias("buying_league_tier"),
        returns.log_fee(F.col("buy_fee")).alias("log_buy_fee"), (buyer - seller).alias("league_jump"),
        F.when(F.lower("transfer_window") == "winter", 1).otherwise(0).alias("is_january_window"),
        F.lit(None).cast("double").alias("contract_years_remaining"),
    ]


def context_features(base: DataFrame) -> DataFrame:
    return base.select("pair_id", *context_columns())


def season_xg(player_xg: DataFrame) -> DataFrame:
    """One row per (player, season): most minutes, then the lower competition id."""
    played = player_xg.filter(F.col("minutes") > 0)
    ranked = F.min_by(F.struct("xg", "xa", "minutes", "goals"), F.struct(-F.col("minutes"), "competition_id"))
    return played.groupBy("player_id", "season").agg(ranked.alias("x")).select("player_id", "season", "x.*")


def with_xg(base: DataFrame, player_xg: DataFrame) -> DataFrame:
    rows = base.withColumn("_season", labels.xg_season(F.col("transfer_date")))
    seasons = by_player(season_xg(player_xg.repartition("player_id")), "season", "_seasons")
    one = F.try_element_at("_seasons", F.col("_season"))
    return rows.join(seasons, "player_id", "left").withColumns({
        "_xg": one["xg"], "_xa": one["xa"], "_xg_minutes": one["minutes"], "_xg_goals": one["goals"]}).drop("_seasons")


def xg_columns() -> list[Column]:
    minutes = F.col("_xg_minutes")
    xg = returns.per_90(F.coalesce("_xg", F.lit(0.0)), minutes)
    return [
        xg.alias("xg_per_90"), returns.per_90(F.coalesce("_xa", F.lit(0.0)), minutes).alias("xa_per_90"),
        (returns.per_90(F.coalesce("_xg_goals", F.lit(0)), minutes) - xg).alias("goals_vs_xg"),
        F.when(minutes > 0, 1).otherwise(0).alias("has_xg_data"),
    ]


def xg_features(base: DataFrame, player_xg: DataFrame) -> DataFrame:
    return with_xg(base, player_xg).select("pair_id", *xg_columns())


TARGETS = ["pair_id", "player_id", "player_name", "transfer_date", "is_gem", "gem_tier", "roi_pct", "buy_fee", "sell_fee"]


def with_facts(base: DataFrame, appearances: DataFrame, valuations: DataFrame, player_xg: DataFrame) -> DataFrame:
    """Buys with what appearances, valuations and season xG say of them; buys of one player lie together after it."""
    return with_xg(with_valuations(with_appearances(base, appearances), valuations, base), player_xg)


def matrix(rows: DataFrame) -> DataFrame:
    """Targets first, then every feature."""
    return rows.select(
        *TARGETS, "selling_club_name", "buying_club_name", "selling_league", "buying_league",
        F.col("agent_name").alias("agent_name_raw"), F.col("position").alias("position_raw"),
        *appearance_columns(), *market_value_columns(), *profile_columns(), *context_columns(), *xg_columns())


def feature_matrix(base: DataFrame, appearances: DataFrame, valuations: DataFrame, player_xg: DataFrame) -> DataFrame:
    return matrix(with_facts(base, appearances, valuations, player_xg))


def coverage(features: DataFrame) -> DataFrame:
    """Share of rows covered per feature section, and the gem balance."""
    flags = {
        "appearances": F.col("has_appearance_data") == 1,
        "market_value": F.col("mv_at_transfer").isNotNull(),
        "age": F.col("age_at_buy").isNotNull(),
        "height": F.col("height_in_cm").isNotNull(),
        "xg": F.col("has_xg_data") == 1,
        "gems": F.col("is_gem") == 1,
    }
    rows = F.array(*[F.struct(F.lit(n).alias("section"), F.when(f, 1).otherwise(0).alias("hit"))
                     for n, f in flags.items()])
    return features.select(F.inline(rows)).groupBy("section").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("hit").alias("covered"),
        F.round(F.avg("hit") * 100, 1).alias("percent"))
