"""Nested JSON payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import parsing

PROFILE = """
    position STRUCT<main: STRING, other: ARRAY<STRING>>, dateOfBirth STRING,
    club STRUCT<id: STRING, name: STRING, contract_expires: STRING>,
    foot STRING, height STRING, marketValue STRING, citizenship ARRAY<STRING>,
    agent STRUCT<name: STRING>, imageUrl STRING, image_url STRING
"""
CLUB_PROFILE = "name STRING, url STRING, league STRUCT<id: STRING>"
TRANSFERS = """
    transfers ARRAY<STRUCT<id: STRING, clubFrom: STRUCT<id: STRING, name: STRING>,
    clubTo: STRUCT<id: STRING, name: STRING>, date: STRING, season: STRING, fee: STRING, marketValue: STRING>>
"""
VALUES = "marketValueHistory ARRAY<STRUCT<date: STRING, marketValue: STRING, clubId: STRING, clubName: STRING>>"
PERFORMANCE = """
    success BOOLEAN,
    data STRUCT<performance: ARRAY<STRUCT<
        statistics: STRUCT<
            playingTimeStatistics: STRUCT<playedMinutes: BIGINT, isStarting: BOOLEAN>,
            goalStatistics: STRUCT<goalsScoredTotal: BIGINT, assists: BIGINT>,
            cardStatistics: STRUCT<yellowCardNet: BIGINT, redCard: BIGINT, yellowRedCard: BIGINT>>,
        gameInformation: STRUCT<competitionId: STRING, season: STRUCT<id: BIGINT, display: STRING>,
            date: STRUCT<dateTimeUTC: STRING>>,
        clubsInformation: STRUCT<club: STRUCT<clubId: STRING>>>>>
"""


def _filled(text: Column) -> Column:
    trimmed = F.trim(text)
    return F.when(trimmed != "", trimmed)


def parse_profiles(payloads: DataFrame) -> DataFrame:
    """(player_id, json) to one column per profile field; empty values are NULL."""
    p = payloads.withColumn("p", F.from_json("json", PROFILE))
    others = F.filter(F.transform("p.position.other", lambda x: F.trim(x)), lambda x: x != "")
    return p.select(
        "player_id", _filled(F.col("p.position.main")).alias("position"),
        F.when(F.size(others) > 0, F.array_join(others, ", ")).alias("sub_position"),
        parsing.parse_date(F.col("p.dateOfBirth")).alias("date_of_birth"),
        F.nullif(parsing.parse_int(F.col("p.club.id")), F.lit(0)).alias("current_club_id"),
        F.when(F.col("p.club.name") != "", F.col("p.club.name")).alias("current_club_name"),
        F.lower(_filled(F.col("p.foot"))).alias("foot"),
        parsing.parse_height_cm(F.col("p.height")).alias("height_in_cm"),
        parsing.parse_money(F.col("p.marketValue")).alias("market_value_in_eur"),
        parsing.join_citizenship(F.col("p.citizenship")).alias("citizenship"),
        _filled(F.col("p.agent.name")).alias("agent_name"),
        parsing.parse_date(F.col("p.club.contract_expires")).alias("contract_expiry_date"),
        _filled(F.coalesce(F.when(F.col("p.imageUrl") != "", F.col("p.imageUrl")), F.col("p.image_url"))).alias("image_url"))


def parse_club_profiles(payloads: DataFrame) -> DataFrame:
    p = payloads.withColumn("p", F.from_json("json", CLUB_PROFILE))
    return p.select("club_id", _filled(F.col("p.name")).alias("name"),
                    parsing.club_code_from_url(F.col("p.url")).alias("club_code"),
                    F.when(F.col("p.league.id") != "", F.col("p.league.id")).alias("domestic_competition_id"))


def parse_transfers(payloads: DataFrame) -> DataFrame:
    """(player_id, json) to candidate transfers."""
    rows = payloads.select("player_id", F.explode(F.from_json("json", TRANSFERS)["transfers"]).alias("t"))
    return rows.select(
        "player_id", F.when(F.col("t.id") != "", F.col("t.id")).alias("source_id"),
        parsing.parse_int(F.col("t.clubFrom.id")).alias("from_club_id"),
        parsing.parse_int(F.col("t.clubTo.id")).alias("to_club_id"),
        F.col("t.clubFrom.name").alias("from_club_name"), F.col("t.clubTo.name").alias("to_club_name"),
        parsing.parse_date(F.col("t.date")).alias("transfer_date"), F.col("t.season").alias("transfer_season"),
        parsing.parse_fee(F.col("t.fee")).alias("transfer_fee"),
        parsing.parse_money(F.col("t.marketValue")).alias("market_value_in_eur"))


def parse_valuations(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("player_id", F.explode(F.from_json("json", VALUES)["marketValueHistory"]).alias("v"))
    typed = rows.select(
        "player_id", parsing.parse_date(F.col("v.date")).alias("date"),
        parsing.parse_money(F.col("v.marketValue")).alias("market_value_in_eur"),
        parsing.parse_int(F.col("v.clubId")).alias("current_club_id"), F.col("v.clubName").alias("current_club_name"))
    return typed.filter("date IS NOT NULL AND market_value_in_eur IS NOT NULL")


def parse_performance(payloads: DataFrame) -> DataFrame:
    """(player_id, json) to game rows; unsuccessful payloads and games without statistics drop."""
    p = payloads.withColumn("p", F.from_json("json", PERFORMANCE)).filter("p.success")
    games = p.select("player_id", F.explode("p.data.performance").alias("g")).filter("g.statistics IS NOT NULL")

    def number(path: str) -> Column:
        return F.coalesce(F.col(f"g.statistics.{path}"), F.lit(0))

    red, second_yellow = number("cardStatistics.redCard"), number("cardStatistics.yellowRedCard")
    return games.select(
        "player_id", F.coalesce("g.gameInformation.competitionId", F.lit("")).alias("competition_id"),
        F.coalesce("g.gameInformation.season.display", F.lit("")).alias("season"),
        F.coalesce("g.gameInformation.date.dateTimeUTC", F.lit("")).alias("date"),
        F.nullif(parsing.parse_int(F.col("g.clubsInformation.club.clubId")), F.lit(0)).alias("club_id"),
        number("playingTimeStatistics.playedMinutes").alias("minutes"),
        F.coalesce("g.statistics.playingTimeStatistics.isStarting", F.lit(False)).alias("is_starting"),
        number("goalStatistics.goalsScoredTotal").alias("goals"), number("goalStatistics.assists").alias("assists"),
        number("cardStatistics.yellowCardNet").alias("yellow"),
        F.when(red == 0, second_yellow).otherwise(red).alias("red"))


def season_performance(games: DataFrame) -> DataFrame:
    """Games per (player, season, competition); an unused substitute does not count.

    The club is the one of the latest game.
    """
    used = games.filter((F.col("minutes") > 0) | F.col("is_starting"))
    return used.groupBy("player_id", "season", "competition_id").agg(
        F.max_by("club_id", F.struct("date", "club_id")).alias("club_id"),
        F.count_if(F.col("minutes") > 0).alias("appearances"), F.count_if("is_starting").alias("starts"),
        F.sum("minutes").alias("minutes_played"), F.sum("goals").alias("goals"), F.sum("assists").alias("assists"),
        F.sum("yellow").alias("yellow_cards"), F.sum("red").alias("red_cards"), F.count(F.lit(1)).alias("games_count"))


# --- shot events ---------------------------------------------------------------------------

COMPETITION = "competition_id BIGINT, competition_name STRING, season_id BIGINT, season_name STRING"
MATCH = """match_id BIGINT, match_date STRING, home_team STRUCT<home_team_name: STRING>,
    away_team STRUCT<away_team_name: STRING>"""
EVENT = """
    type STRUCT<name: STRING>, player STRUCT<id: BIGINT, name: STRING>, team STRUCT<name: STRING>,
    minute BIGINT, second BIGINT, location ARRAY<DOUBLE>,
    shot STRUCT<statsbomb_xg: DOUBLE, outcome: STRUCT<name: STRING>, type: STRUCT<name: STRING>,
        body_part: STRUCT<name: STRING>, technique: STRUCT<name: STRING>, end_location: ARRAY<DOUBLE>>
"""


def shot_competitions(priority: str = "high") -> tuple[int, ...]:
    """Competition ids to load: high, medium, low or all."""
    if priority == "all":
        return tuple(i for ids in C.SHOT_COMPETITIONS.values() for i in ids)
    return C.SHOT_COMPETITIONS[priority]


def _numbers_in_path(pattern: str) -> Column:
    return F.regexp_extract(F.input_file_name(), pattern, 1).cast("bigint")


def read_shot_events(spark: SparkSession, root: str, competitions: tuple[int, ...] | None = None,
                     arrays: bool = True) -> DataFrame:
    """competitions.json, matches/<competition>/<season>.json and events/<match>.json.

    Ids come from the paths; partition folders (``match=12``) work as well. With ``arrays``
    each file holds one JSON array and files are the unit of parallelism; otherwise files
    hold JSON lines and split freely. Lines of events may carry their own ``match_id``, so
    that a file holds many matches and the files do not grow in number with them.
    """
    def read(path: str, schema: str) -> DataFrame:
        reader = spark.read.schema(schema).option("multiLine", arrays).option("recursiveFileLookup", True)
        return reader.json(f"{root}/{path}")

    seasons = read("competitions.json", COMPETITION)
    if competitions:
        seasons = seasons.filter(F.col("competition_id").isin(*competitions))
    matches = read("matches", MATCH).withColumns({
        "competition_id": _numbers_in_path(r"matches/(?:competition=)?(\d+)/"),
        "season_id": _numbers_in_path(r"matches/[^/]+/(?:season=)?(\d+)")})
    of_file = _numbers_in_path(r"events/(?:match=)?(\d+)")
    if arrays:
        events = read("events", EVENT).withColumn("match_id", of_file)
    else:
        events = read("events", f"match_id BIGINT, {EVENT}").withColumn("match_id", F.coalesce("match_id", of_file))
    return events.join(matches, "match_id").join(seasons, ["competition_id", "season_id"])


def opponent(team: Column, home: Column, away: Column) -> Column:
    return F.when(team == home, away).otherwise(home)


def shots(events: DataFrame) -> DataFrame:
    """Shot events as flat rows."""
    team = F.coalesce("team.name", F.lit(""))
    home, away = F.coalesce("home_team.home_team_name", F.lit("")), F.coalesce("away_team.away_team_name", F.lit(""))
    return events.filter(F.col("type.name") == "Shot").select(
        F.col("player.id").alias("source_player_id"), F.coalesce("player.name", F.lit("")).alias("source_player_name"),
        "match_id", "competition_id", "competition_name", "season_id", "season_name", "match_date",
        team.alias("team_name"), opponent(team, home, away).alias("opponent_name"),
        F.coalesce("minute", F.lit(0)).alias("minute"), F.coalesce("second", F.lit(0)).alias("second"),
        F.col("shot.statsbomb_xg").alias("xg"), F.col("shot.outcome.name").alias("shot_outcome"),
        F.col("shot.type.name").alias("shot_type"), F.col("shot.body_part.name").alias("body_part"),
        F.col("shot.technique.name").alias("technique"),
        F.get("location", F.lit(0)).alias("location_x"), F.get("location", F.lit(1)).alias("location_y"),
        F.get("shot.end_location", F.lit(0)).alias("end_location_x"),
        F.get("shot.end_location", F.lit(1)).alias("end_location_y"))
