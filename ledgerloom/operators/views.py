"""Leaderboards, explorers, search and detail queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels, parsing
from ledgerloom.operators import chains, pairs
from ledgerloom.session import checkpointed

CLUB_SORTS = {"composite_score", "name", "total_transfers", "median_roi", "annualized_roi", "total_profit",
              "hit_rate", "value_creation", "profit_per_deal", "buying_club_premium"}
PLAYER_SORTS = {"market_value_in_eur", "name", "position", "date_of_birth", "current_club_name"}


def ordering(sort_by: str, allowed: set[str], default: str, order: str, unique: str) -> list[Column]:
    """Unknown names fall back to the default; NULLs last; a unique column breaks ties."""
    column = F.col(sort_by if sort_by in allowed else default)
    return [column.asc_nulls_last() if order == "asc" else column.desc_nulls_last(), F.col(unique).asc()]


def page(rows: DataFrame, order: list[Column], number: int = 1, per_page: int = 50, shallow: int = 10_000) -> DataFrame:
    """One page of the ordered rows.

    Up to ``shallow`` rows from the start a top-k finds it. A deeper page is sought by range.
    """
    if number < 1 or not 1 <= per_page <= 200:
        raise ValueError("page starts at 1 and per_page lies between 1 and 200")
    first = (number - 1) * per_page
    if first + per_page <= shallow:
        return rows.orderBy(*order).offset(first).limit(per_page)
    return sought(rows, order, first, per_page)


def sought(rows: DataFrame, order: list[Column], first: int, size: int) -> DataFrame:
    """``size`` rows from the ``first`` (0-based) on, for an order without ties.

    The rows are cut into ordered ranges and stored; the ranges' counts, one row for each task,
    say which of them hold the page, and only these are read and sorted. So no task and no driver
    holds more than a range, however deep the page is.
    """
    ranges = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "page-ranges")
    before, wanted, skip = 0, [], 0
    for part, n in sorted(ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):
        if before < first + size and before + n > first:
            skip = first - before if not wanted else skip
            wanted.append(part)
        before += n
    return ranges.filter(F.col("_range").isin(wanted)).drop("_range").orderBy(*order).offset(skip).limit(size)


def total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def filter_clubs(clubs: DataFrame, league: str | None = None, leagues: str | None = None,
                 min_transfers: int = C.MIN_TRANSFERS) -> DataFrame:
    """One league, or a comma list; clubs without a deal count drop out."""
    if league:
        clubs = clubs.filter(F.col("domestic_competition_id") == league)
    elif leagues:
        wanted = [code.strip() for code in leagues.split(",") if code.strip()]
        clubs = clubs.filter(F.col("domestic_competition_id").isin(*wanted))
    return clubs.filter(F.col("total_transfers") >= min_transfers)


def leaderboard(clubs: DataFrame, sort_by: str = "composite_score", order: str = "desc", **filters) -> DataFrame:
    return filter_clubs(clubs, **filters).orderBy(
        *ordering(sort_by, CLUB_SORTS, "composite_score", order, "club_id"))


def sell_leaders(clubs: DataFrame, min_transfers: int = 3, **filters) -> DataFrame:
    rows = filter_clubs(clubs.filter(F.col("total_profit").isNotNull()), min_transfers=min_transfers, **filters)
    return rows.orderBy(F.col("total_profit").desc(), "club_id")


def academy_leaders(clubs: DataFrame, min_transfers: int = 3, **filters) -> DataFrame:
    rows = filter_clubs(clubs.filter(F.col("value_creation").isNotNull()), min_transfers=min_transfers, **filters)
    return rows.orderBy(F.col("value_creation").desc(), "club_id")


def null_as_zero(clubs: DataFrame, sort_by: str) -> DataFrame:
    return clubs.orderBy(F.coalesce(F.col(sort_by), F.lit(0)).desc(), "club_id")


def top_clubs(clubs: DataFrame, leagues: tuple[str, ...] = C.DASHBOARD_LEAGUES,
              min_transfers: int = C.MIN_TRANSFERS, top: int = 10) -> DataFrame:
    """Ranked best clubs; the rank runs over the ``top`` rows only."""
    kept = clubs.filter(F.col("composite_score").isNotNull() & (F.col("total_transfers") >= min_transfers)
                        & F.col("domestic_competition_id").isin(*leagues))
    best = kept.orderBy(F.col("composite_score").desc(), "club_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("composite_score").desc(), "club_id")))


def club_detail(clubs: DataFrame, names: dict[str, str] = C.LEAGUE_NAMES, logo_base: str = C.LEAGUE_LOGO_BASE) -> DataFrame:
    """Adds the league's display name and, for named leagues, its logo address."""
    code = F.col("domestic_competition_id")
    name = labels.league_name(code, names)
    logo = F.when(name.isNotNull(), F.concat(F.lit(logo_base), F.lower(code), F.lit(".png")))
    return clubs.withColumns({"league_name": name, "league_logo_url": logo})


def by_id(rows: DataFrame, key: str, value: int) -> DataFrame:
    return rows.filter(F.col(key) == value)


def club_transfers(transfers: DataFrame, club_id: int) -> DataFrame:
    return transfers.filter((F.col("from_club_id") == club_id) | (F.col("to_club_id") == club_id))


def in_league(transfers: DataFrame, clubs: DataFrame, league: str) -> DataFrame:
    """Transfers with either club in the league, each once.

    Two outer joins against distinct club ids replace an OR join.
    """
    ids = clubs.filter(F.col("domestic_competition_id") == league).select("club_id").distinct()
    origin = ids.select(F.col("club_id").alias("from_club_id"), F.lit(True).alias("_from"))
    target = ids.select(F.col("club_id").alias("to_club_id"), F.lit(True).alias("_to"))
    joined = transfers.join(origin, "from_club_id", "left").join(target, "to_club_id", "left")
    return joined.filter(F.col("_from") | F.col("_to")).select(*transfers.columns)


def explore_transfers(transfers: DataFrame, clubs: DataFrame | None = None, q: str | None = None,
                      club_id: int | None = None, position: str | None = None, league: str | None = None,
                      min_roi: float | None = None, year_from: int | None = None,
                      year_to: int | None = None) -> DataFrame:
    rows = transfers
    if q:
        rows = rows.filter(F.col("player_name").ilike(parsing.like_pattern(q)))
    if club_id:
        rows = club_transfers(rows, club_id)
    if position:
        rows = rows.filter(F.col("player_position") == position)
    if min_roi is not None:
        rows = rows.filter(F.col("roi_pct") >= min_roi)
    if year_from:
        rows = rows.filter(F.col("transfer_date") >= F.make_date(F.lit(year_from), F.lit(1), F.lit(1)))
    if year_to:
        rows = rows.filter(F.col("transfer_date") <= F.make_date(F.lit(year_to), F.lit(12), F.lit(31)))
    return in_league(rows, clubs, league) if league else rows


def newest_first(transfers: DataFrame) -> DataFrame:
    return transfers.orderBy(F.col("transfer_date").desc_nulls_last(), "transfer_id")


def list_players(players: DataFrame, clubs: DataFrame | None = None, q: str | None = None,
                 position: str | None = None, club_id: int | None = None, league: str | None = None,
                 sort_by: str = "market_value_in_eur", order: str = "desc") -> DataFrame:
    rows = players
    if q:
        rows = rows.filter(F.col("name").ilike(parsing.like_pattern(q)))
    if position:
        rows = rows.filter(F.col("position") == position)
    if club_id:
        rows = rows.filter(F.col("current_club_id") == club_id)
    if league:
        at = clubs.filter(F.col("domestic_competition_id") == league).select(F.col("club_id").alias("current_club_id"))
        rows = rows.join(at, "current_club_id", "left_semi")
    return rows.orderBy(*ordering(sort_by, PLAYER_SORTS, "market_value_in_eur", order, "player_id"))


def of_types(typed: DataFrame, types: tuple[str, ...] = ()) -> DataFrame:
    """Movement types to keep; none selected keeps all."""
    return typed.filter(F.col("transfer_type").isin(*types)) if types else typed


def sort_club_transfers(typed: DataFrame, by: str = "date") -> DataFrame:
    fee = F.coalesce("transfer_fee", F.lit(0.0))
    order = {"fee_desc": fee.desc(), "fee_asc": fee.asc()}.get(by, F.col("transfer_date").desc_nulls_last())
    return typed.orderBy(order, "transfer_id")


def scatter(ledger: DataFrame) -> DataFrame:
    """Fee against return for the explorer, over the whole ledger."""
    kept = ledger.filter((F.col("transfer_fee") > 0) & F.col("roi_pct").isNotNull())
    return kept.select(
        F.col("transfer_fee").alias("x"), F.col("roi_pct").alias("y"),
        F.coalesce("player_name", F.lit("Unknown")).alias("name"),
        F.coalesce("to_club_name", "from_club_name", F.lit("")).alias("club"),
        "profit", F.col("transfer_date").alias("date"), F.col("transfer_id").alias("id"), "player_id")


PROFILE_FIELDS = ("image_url", "citizenship", "agent_name", "contract_expiry_date", "position")


def incomplete_profiles(players: DataFrame, fields: tuple[str, ...] = ("image_url",), limit: int | None = None) -> DataFrame:
    """Players missing any of the allowed fields, most valuable first."""
    wanted = [f for f in fields if f in PROFILE_FIELDS]
    missing = F.lit(False)
    for f in wanted:
        missing = missing | F.col(f).isNull()
    rows = players.filter(missing).select(
        "player_id", "name", F.lit(", ".join(wanted)).alias("missing_field"), "market_value_in_eur")
    ordered = rows.orderBy(F.col("market_value_in_eur").desc_nulls_last(), "player_id")
    return ordered if limit is None else ordered.limit(limit)


def player_transfers(ledger: DataFrame, player_id: int) -> DataFrame:
    return newest_first(by_id(ledger, "player_id", player_id))


def player_valuations(valuations: DataFrame, player_id: int) -> DataFrame:
    return by_id(valuations, "player_id", player_id).orderBy(F.col("date").asc_nulls_last(), "market_value_in_eur")


def biggest_profit(matched: DataFrame, top: int = 1) -> DataFrame:
    return matched.filter(F.col("profit").isNotNull()).orderBy(F.col("profit").desc(), "buy_transfer_id").limit(top)


def club_best(ledger: DataFrame, club_id: int, top: int = 5) -> DataFrame:
    """A club's best deals by profit, and its highest fees, as two ranked lists."""
    rows = club_transfers(ledger, club_id)

    def best(column: str, name: str) -> DataFrame:
        return rows.filter(F.col(column).isNotNull()).orderBy(F.col(column).desc(), "transfer_id").limit(top) \
            .select(F.lit(name).alias("list"), "transfer_id", F.col(column).alias("amount"))

    return best("profit", "profit").unionByName(best("transfer_fee", "fee"))


RADAR = {"Median ROI": "median_roi", "Hit Rate": "hit_rate", "Composite": "composite_score", "Value Creation": "value_creation"}


def compare_radar(clubs: DataFrame, first: int, second: int) -> DataFrame:
    """Two clubs as (metric, club, value) rows; the composite is shown out of 100."""
    two = clubs.filter(F.col("club_id").isin(first, second))
    values = [F.coalesce(F.col(c), F.lit(0.0)) * (100 if c == "composite_score" else 1) for c in RADAR.values()]
    wide = two.select("club_id", F.col("name").alias("club"), *[v.alias(m) for m, v in zip(RADAR, values)])
    return wide.unpivot(["club_id", "club"], list(RADAR), "metric", "value")


def fuzzy_search(clubs: DataFrame, text: str, threshold: float = 0.4) -> DataFrame:
    """Clubs by weighted edit distance to the text (name 0.7, league 0.3), best first.

    A field that contains the text scores 0; otherwise the distance over the longer length.
    """
    query = text.strip().lower()

    def distance(column: str) -> Column:
        value = F.lower(F.coalesce(F.col(column), F.lit("")))
        edits = F.levenshtein(value, F.lit(query)) / F.greatest(F.length(value), F.lit(len(query)))
        return F.when(value.contains(query), 0.0).otherwise(edits)

    name, league = distance("name"), distance("domestic_competition_id")
    scored = clubs.withColumn("score", F.round(F.lit(0.7) * name + F.lit(0.3) * league, 6))
    return scored.filter(F.least(name, league) <= threshold).orderBy("score", "club_id")


def club_history(ledger: DataFrame, club_id: int) -> DataFrame:
    """A club's moves with movement types, newest first."""
    return newest_first(chains.typed(club_transfers(ledger, club_id)))


def club_page(ledger: DataFrame, club_id: int) -> DataFrame:
    """A club's moves as ``club_history``, its paid sales with the profit of its latest earlier buy."""
    rows = chains.typed(club_transfers(ledger, club_id))
    own = (F.col("from_club_id") == club_id) | ((F.col("to_club_id") == club_id) & (F.col("transfer_fee") > 0))
    sales = pairs.propagate_profit_asof(rows.filter(own)).filter(F.col("from_club_id") == club_id).select(*rows.columns)
    others = rows.filter((F.col("from_club_id") != club_id) | F.col("from_club_id").isNull())
    return newest_first(sales.unionByName(others))


def player_page(ledger: DataFrame, player_id: int) -> DataFrame:
    """A player's moves with movement types, paid sales with the profit of the club's last buy, newest first."""
    rows = chains.typed(by_id(ledger, "player_id", player_id))
    return newest_first(pairs.propagate_profit_last_buy(rows).select(*rows.columns))
