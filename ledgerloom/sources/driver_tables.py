"""The ledger model on top of the driver's Parquet tables (mapping in FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import labels, returns
from ledgerloom.operators import gems, pairs
from ledgerloom.operators.skew import HOT_ROWS, chain, hot_keys, plain_chain
from ledgerloom.session import checkpointed, new_folder, shared_folder, size_shuffles

POSITIONS = [
    "Centre-Forward", "Second Striker", "Attack", "Left Winger", "Left Midfield", "Right Winger",
    "Right Midfield", "Attacking Midfield", "Central Midfield", "Midfield", "Defensive Midfield",
    "Left-Back", "Right-Back", "Centre-Back", "Defender", "Goalkeeper", "Sweeper",
]
CITIZENSHIPS = ["Brazil", "France, Senegal", "Japan", "England", "Atlantis", None, "Nigeria", " Argentina,Italy"]
FEET = ["left", "Right", "both", None]
ID_SPAN = 100_000_000
SCHEMAS: dict[str, StructType] = {}
LINES: dict[str, int] = {}
STORED: dict[tuple[str, str, str, str], tuple[str, StructType]] = {}
WINDOWS = (1996, 1998, 2000)
MIN_DEALS = 3
TRAINING_CUTOFF = "1999-01-01"
TIER_CUTS = (18.0, 20.0, 22.0)


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def club_name(club_id: Column) -> Column:
    base = F.concat(F.lit("Supplier#"), F.lpad(club_id.cast("string"), 9, "0"))
    kind = club_id % 25
    return (
        F.when(kind == 3, F.concat(base, F.lit(" B"))).when(kind == 4, F.concat(F.lit("Jong "), base))
        .when(kind == 5, "Without Club").when(kind == 6, "Retired")
        .when(kind == 7, F.concat(base, F.lit(" U19"))).otherwise(base)
    )


def ledger_fee(flag: Column, status: Column, price: Column) -> Column:
    unknown = (flag == "N") & (status == "O")
    return F.when(unknown, None).when(flag == "N", 0.0).otherwise(F.round(price * 100))


class DriverTables:
    """Lazy DataFrames of the ledger model for one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str, hot_rows: int = HOT_ROWS):
        self.spark, self.folder, self.hot_rows = spark, folder, hot_rows

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def stored_key(self, name: str) -> tuple[str, str, str, str]:
        return self.spark.sparkContext.applicationId, shared_folder(self.spark), self.folder, name

    def raw(self, name: str) -> DataFrame:
        """One driver table; its schema is read from the file footer once per process."""
        path = self.path(name)
        if path not in SCHEMAS:
            SCHEMAS[path] = self.spark.read.parquet(path).schema
        rows = self.spark.read.schema(SCHEMAS[path]).parquet(path)
        if name == "lineitem":  # the largest table; its rows are counted from the file footers, once per process
            if path not in LINES:
                LINES[path] = rows.count()
            size_shuffles(self.spark, LINES[path])
        return rows

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written to the shared folder once per application and folder.

        Queries then scan it like any stored ledger: pruned columns, pushed filters, short
        plans.
        """
        key = self.stored_key(name)
        if key not in STORED:
            path, rows = new_folder(self.spark, name), build()
            rows.write.parquet(path)
            STORED[key] = path, rows.schema
        path, schema = STORED[key]
        return self.spark.read.schema(schema).parquet(path)

    @cached_property
    def transfers(self) -> DataFrame:
        # club names and season follow from the other columns, so they are not stored
        return self.named(self.stored("transfers", lambda: self.build_moves()[0]))

    def build_transfers(self) -> DataFrame:
        return self.named(self.build_moves()[0])

    def build_moves(self) -> tuple[DataFrame, bool]:
        """The ledger without names, and whether its rows are clustered by player (they are, unless a player is hot)."""
        # what the flags and the tax say is worked out before the shuffle, and the fee from it and the price after it
        priced = ledger_fee(F.col("l_returnflag"), F.col("l_linestatus"), F.lit(1.0)) > 0
        lines = self.raw("lineitem").select(
            "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_tax") == 0).alias("broken"),
            priced.alias("priced"), F.col("l_shipdate").cast("date").alias("l_shipdate"))
        order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
        hot = checkpointed(hot_keys(lines, ["l_partkey"], self.hot_rows, LINES[self.path("lineitem")]), "hot-players")
        clustered = hot.isEmpty()
        if clustered:
            moves = plain_chain(lines, "l_partkey", order, {"prev": "l_suppkey"})
        else:
            moves = chain(lines, "l_partkey", order, {"prev": "l_suppkey"}, F.col("l_shipdate"), self.hot_rows, hot)
        origin = (F.when(F.col("seq") == 1, None).when(F.col("broken"), F.col("l_linenumber").cast("bigint"))
                  .otherwise(F.col("prev")))
        fee = F.when(F.col("priced"), F.round(F.col("l_extendedprice") * 100)).when(~F.col("priced"), 0.0)
        rows = moves.select(
            (F.col("l_partkey") * ID_SPAN + F.col("seq")).alias("transfer_id"),
            F.col("l_partkey").alias("player_id"), origin.alias("from_club_id"), F.col("l_suppkey").alias("to_club_id"),
            F.col("l_shipdate").alias("transfer_date"), fee.alias("transfer_fee"))
        return rows, clustered

    @staticmethod
    def named(moves: DataFrame) -> DataFrame:
        return moves.withColumns({
            "from_club_name": club_name(F.col("from_club_id")), "to_club_name": club_name(F.col("to_club_id")),
            "transfer_season": labels.season(F.col("transfer_date"))})

    @cached_property
    def players(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.raw("part").select(
            p.alias("player_id"), F.col("p_name").alias("name"), F.col("p_type").alias("sub_position"),
            pick(POSITIONS, p % 17).alias("position"),
            F.date_add(F.lit("1973-01-01").cast("date"), F.col("p_size") * 100).alias("date_of_birth"),
            F.col("p_size").cast("bigint").alias("current_club_id"),
            F.when(F.col("p_size") != 13, club_name(F.col("p_size"))).alias("current_club_name"),
            pick(FEET, p % 4).alias("foot"), (F.col("p_size") + 150).cast("double").alias("height_in_cm"),
            F.round(F.col("p_retailprice") * 10000).alias("market_value_in_eur"),
            pick(CITIZENSHIPS, p % 8).alias("citizenship"),
            F.when(p % 7 == 0, None).when(p % 11 == 0, "no agent").otherwise(F.col("p_brand")).alias("agent_name"),
            F.when(p % 5 != 0, F.lit("2001-06-30").cast("date")).alias("contract_expiry_date"),
            F.when(F.col("p_size") > 10, F.concat(F.lit("/img/"), p.cast("string"))).alias("image_url"))

    @cached_property
    def clubs(self) -> DataFrame:
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        registered = self.raw("supplier").filter(F.col("s_acctbal") >= 1500)
        return registered.join(nations, "s_nationkey").select(
            F.col("s_suppkey").alias("club_id"), F.col("s_name").alias("name"),
            F.concat(F.lit("club-"), F.col("s_suppkey").cast("string")).alias("club_code"),
            F.col("n_name").alias("domestic_competition_id"))

    @cached_property
    def valuations(self) -> DataFrame:
        lines = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
        orders = self.raw("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
        return lines.join(orders, "o_orderkey").select(
            F.col("l_partkey").alias("player_id"), F.col("o_orderdate").cast("date").alias("date"),
            F.round(F.col("o_totalprice") * 50).alias("market_value_in_eur"))

    @cached_property
    def appearances(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey",
                        F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("appearance_id"),
            F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("player_id"),
            F.col("l_suppkey").alias("player_club_id"),
            F.date_add(F.col("l_shipdate").cast("date"), line * 30).alias("date"),
            F.concat(F.lit("C"), line.cast("string")).alias("competition_id"),
            F.when(line == 7, 1).otherwise(0).cast("bigint").alias("yellow_cards"),
            F.when((line == 6) & (F.col("l_returnflag") == "R"), 1).otherwise(0).cast("bigint").alias("red_cards"),
            (line % 3).cast("bigint").alias("goals"), (line % 2).cast("bigint").alias("assists"),
            (F.col("l_quantity") * 2).cast("bigint").alias("minutes_played"))

    @cached_property
    def player_xg(self) -> DataFrame:
        year = F.col("_year")
        rows = self.raw("lineitem").groupBy(
            F.col("l_partkey").alias("player_id"), F.year("l_shipdate").alias("_year"), F.col("l_linestatus").alias("competition_id"),
        ).agg(F.sum((F.col("l_quantity") * 2).cast("bigint")).alias("minutes"),
              F.round(F.sum("l_discount") * 10, 2).alias("xg"), F.round(F.sum("l_tax") * 10, 2).alias("xa"),
              F.sum((F.col("l_linenumber") % 3).cast("bigint")).alias("goals"))
        season = F.concat(year.cast("string"), F.lit("/"), (year + 1).cast("string"))
        return rows.select("player_id", season.alias("season"), "competition_id", "minutes", "xg", "xa", "goals")

    @cached_property
    def ledger(self) -> DataFrame:
        """Transfers with the player's name and age."""
        info = self.players.select("player_id", F.col("name").alias("player_name"), "date_of_birth")
        joined = self.transfers.join(info, "player_id", "left")
        age = returns.age_years(F.col("date_of_birth"), F.col("transfer_date"))
        return joined.withColumn("age_at_transfer", age).drop("date_of_birth")

    @cached_property
    def matched(self) -> DataFrame:
        """Pairs above the fee floor with their returns."""
        paid = pairs.fee_bearing(self.transfers)
        return pairs.with_returns(pairs.min_buy_fee(pairs.match_buy_sell(paid)))

    @cached_property
    def pairs(self) -> DataFrame:
        return pairs.with_player_info(pairs.with_peak_value(self.matched, self.valuations), self.players)

    @cached_property
    def paired(self) -> DataFrame:
        return self.named(self.stored("paired", self.build_paired))

    def build_paired(self) -> DataFrame:
        """The ledger without names, with pair columns, gem columns and training eligibility.

        A ledger that is stored already is read; else it is worked out here, where its rows are clustered by player.
        """
        if self.stored_key("transfers") in STORED:
            moves, clustered = self.stored("transfers", lambda: self.build_moves()[0]), False
        else:
            moves, clustered = self.build_moves()
        rows = pairs.paired_transfers(moves, self.valuations, self.players, clustered=clustered)
        roi = F.col("roi_pct")
        return rows.withColumns({
            "is_gem": F.when(roi.isNotNull(), labels.is_gem(roi)),
            "gem_tier": F.when(roi.isNotNull(), labels.gem_tier(roi)),
            "is_training_eligible": labels.is_training_eligible(
                roi, F.col("transfer_date"), F.col("age_at_transfer"), TRAINING_CUTOFF)})

    @cached_property
    def derived_players(self) -> DataFrame:
        """Players with position bucket, citizenship region and agent cluster."""
        return gems.agent_clusters(self.players).withColumns({
            "position_bucket": labels.position_bucket(F.col("position")),
            "citizenship_region": labels.citizenship_region(F.col("citizenship"))})

    @cached_property
    def tiered_clubs(self) -> DataFrame:
        rates = gems.league_gem_rate(self.paired, self.clubs)
        return gems.tier_to_clubs(self.clubs, gems.league_tiers(rates, TIER_CUTS))

    @cached_property
    def sourced(self) -> DataFrame:
        """Transfers of which every tenth carries the id of its outside record."""
        own = F.concat(F.lit("x"), F.col("transfer_id").cast("string"))
        return self.transfers.withColumn("source_id", F.when(F.col("transfer_id") % 10 == 0, own))

    @cached_property
    def candidates(self) -> DataFrame:
        """Every transfer as an outside record: paid ones unchanged, the rest altered.

        Altered rows are dated 400 days later with another destination; some lose the
        origin id, a few carry an id of their own.
        """
        t = self.transfers
        changed = F.coalesce(F.col("transfer_fee") == 0, F.lit(True))
        on = F.when(changed, F.date_add("transfer_date", 400)).otherwise(F.col("transfer_date"))
        to = F.when(changed, F.col("to_club_id") + 1).otherwise(F.col("to_club_id"))
        origin = F.when(~(changed & F.col("transfer_fee").isNull()), F.col("from_club_id"))
        own_id = F.when(changed & (F.col("to_club_id") % 10 == 0), F.concat(F.lit("x"), F.col("transfer_id").cast("string")))
        return t.select(
            F.col("transfer_id").alias("candidate_id"), "player_id", own_id.alias("source_id"),
            origin.alias("from_club_id"), to.alias("to_club_id"), "from_club_name", club_name(to).alias("to_club_name"),
            on.alias("transfer_date"), F.lit(None).cast("string").alias("transfer_season"),
            F.when(changed & F.col("transfer_fee").isNull(), None).otherwise(F.col("transfer_fee")).alias("transfer_fee"),
            (F.col("transfer_fee") * 2).alias("market_value_in_eur"))
