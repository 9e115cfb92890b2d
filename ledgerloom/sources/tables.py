"""Schemas and typed CSV readers of the raw files.

Files are read all-text and then coerced, so a bad value becomes NULL instead of failing
the load. Plain and gzip files are both read; a folder or glob reads many files at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom import constants as C
from ledgerloom.functions import parsing
from ledgerloom.operators.pairs import year_range
from ledgerloom.operators.sets import first_per_key

SCHEMAS = {
    "clubs": {"club_id": "id", "name": "string", "club_code": "string", "domestic_competition_id": "string"},
    "players": {
        "player_id": "id", "name": "string", "first_name": "string", "last_name": "string", "position": "string",
        "sub_position": "string", "date_of_birth": "date", "current_club_id": "long", "current_club_name": "string",
        "foot": "string", "height_in_cm": "double", "market_value_in_eur": "double",
        "highest_market_value_in_eur": "double",
    },
    "transfers": {
        "player_id": "id", "player_name": "string", "from_club_id": "long", "to_club_id": "long",
        "from_club_name": "string", "to_club_name": "string", "transfer_date": "date", "transfer_season": "string",
        "transfer_fee": "double", "market_value_in_eur": "double",
    },
    "player_valuations": {
        "player_id": "id", "date": "date", "market_value_in_eur": "double", "current_club_id": "long",
        "current_club_name": "string", "player_club_domestic_competition_id": "string",
    },
    "appearances": {
        "appearance_id": "string", "game_id": "long", "player_id": "long", "player_club_id": "long",
        "player_current_club_id": "long", "date": "date", "player_name": "string", "competition_id": "string",
        "yellow_cards": "long", "red_cards": "long", "goals": "long", "assists": "long", "minutes_played": "long",
    },
    "competitions": {
        "competition_id": "string", "competition_code": "string", "name": "string", "sub_type": "string",
        "type": "string", "country_id": "long", "country_name": "string", "domestic_league_code": "string",
        "confederation": "string", "total_clubs": "long",
    },
}

TRANSFER_KEY = ["player_id", "from_club_id", "to_club_id", "transfer_date"]
VALUATION_KEY = ["player_id", "date", "market_value_in_eur"]


def coerce(text: Column, kind: str) -> Column:
    value = parsing.missing_to_null(text)
    if kind == "id":
        return F.coalesce(parsing.parse_int(value), F.lit(0))
    if kind == "long":
        return parsing.parse_int(value)
    if kind == "double":
        return parsing.parse_float(value)
    if kind == "date":
        day = F.when(value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"), F.regexp_extract(value, r"^[0-9-]+", 0).try_cast("date"))
        return F.coalesce(day, parsing.parse_date(value))
    return value


#: Rows whose number of fields isn't the header's keep their text here.
BROKEN = "_broken"


def read_text(spark: SparkSession, path: str, spanning: bool = False) -> DataFrame:
    """All-text CSV with a header; the schema comes from the header, no type inference.

    Files are split among tasks by line. ``spanning`` reads records whose quoted fields hold line
    breaks instead: a file is then one task's, so many files of moderate size are wanted. It adds
    ``_broken``, the text of rows that don't have the header's fields.
    """
    reader = spark.read.option("header", True).option("inferSchema", False).option("quote", '"').option("escape", '"')
    if not spanning:
        return reader.option("multiLine", False).csv(path)
    reader = reader.option("multiLine", True)
    schema = reader.csv(path).schema.add(BROKEN, "string")
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path)


def broken_rows(raw: DataFrame) -> DataFrame:
    """How many rows a ``spanning`` read found, how many have their first field, and how many are broken."""
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count(raw.columns[0]).alias("keyed"), F.count(BROKEN).alias("broken"))


def typed(raw: DataFrame, table: str) -> DataFrame:
    """Columns missing from the file are NULL, except names, which are empty."""
    def column(name: str, kind: str) -> Column:
        if name in raw.columns:
            return coerce(F.col(name), kind)
        empty = F.lit("") if name == "name" else F.lit(None).cast("string")
        return coerce(empty, kind) if name != "name" else empty

    return raw.select(*[column(n, k).alias(n) for n, k in SCHEMAS[table].items()])


def load_clubs(spark: SparkSession, path: str, spanning: bool = False) -> DataFrame:
    return typed(read_text(spark, path, spanning), "clubs")


def load_players(spark: SparkSession, path: str, spanning: bool = False) -> DataFrame:
    return typed(read_text(spark, path, spanning), "players")


def load_transfers(spark: SparkSession, path: str, min_year: int = C.MIN_YEAR, max_year: int = C.MAX_YEAR,
                   spanning: bool = False) -> DataFrame:
    rows = year_range(typed(read_text(spark, path, spanning), "transfers"), "transfer_date", min_year, max_year)
    return first_per_key(rows, TRANSFER_KEY)


def load_player_valuations(spark: SparkSession, path: str, min_year: int = C.MIN_YEAR,
                           max_year: int = C.MAX_YEAR, spanning: bool = False) -> DataFrame:
    rows = year_range(typed(read_text(spark, path, spanning), "player_valuations"), "date", min_year, max_year)
    return first_per_key(rows, VALUATION_KEY)


def load_appearances(spark: SparkSession, path: str, spanning: bool = False) -> DataFrame:
    return first_per_key(typed(read_text(spark, path, spanning), "appearances"), ["appearance_id"])


def load_competitions(spark: SparkSession, path: str, spanning: bool = False) -> DataFrame:
    return typed(read_text(spark, path, spanning), "competitions")
