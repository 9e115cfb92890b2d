"""Readers and writers, exercised on files that Spark derives from the driver tables."""

from pyspark.sql import functions as F

from ledgerloom.operators import features, quality
from ledgerloom.registry.aggregates import stored_pairs
from ledgerloom.registry.base import query
from ledgerloom.registry.joins import training_base
from ledgerloom.session import new_folder
from ledgerloom.sources import documents, sinks, tables


def as_csv(t, rows, name, compression="none"):
    path = new_folder(t.spark, name)
    rows.write.option("header", True).option("compression", compression).csv(path)
    return path


def as_text(column):
    """An id the way a data frame export writes it."""
    return F.when(F.col(column).isNotNull(), F.concat(F.col(column).cast("string"), F.lit(".0")))


@query("src_csv_clubs", "SELECT club_id, name, club_code, domestic_competition_id FROM clubs")
def _(t):
    return tables.load_clubs(t.spark, as_csv(t, t.clubs.withColumn("club_id", as_text("club_id")), "clubs"))


@query("src_csv_spanning", "SELECT club_id, name, club_code || chr(10) || name AS club_code, domestic_competition_id FROM clubs")
def _(t):
    """Quoted fields that span lines read back as one row each."""
    rows = t.clubs.withColumn("club_code", F.concat_ws("\n", "club_code", "name")).filter("club_code IS NOT NULL")
    return tables.load_clubs(t.spark, as_csv(t, rows, "clubs"), spanning=True)


@query("src_csv_players", """
    SELECT player_id, name, NULL::VARCHAR AS first_name, NULL::VARCHAR AS last_name, position, sub_position, date_of_birth, current_club_id,
           current_club_name, foot, height_in_cm, market_value_in_eur, NULL::DOUBLE AS highest_market_value_in_eur FROM players""")
def _(t):
    rows = t.players.select("player_id", "name", "position", "sub_position", "date_of_birth", as_text("current_club_id").alias("current_club_id"),
                            "current_club_name", "foot", "height_in_cm", "market_value_in_eur")
    return tables.load_players(t.spark, as_csv(t, rows, "players"))


@query("src_csv_transfers", """
    SELECT player_id, from_club_id, to_club_id, transfer_date, any_value(player_name) AS player_name, any_value(from_club_name) AS from_club_name,
           any_value(to_club_name) AS to_club_name, any_value(transfer_season) AS transfer_season
    FROM ledger WHERE year(transfer_date) BETWEEN 1996 AND 2000 GROUP BY 1, 2, 3, 4""")
def _(t):
    once = t.ledger.select("player_id", "player_name", as_text("from_club_id").alias("from_club_id"), "to_club_id", "from_club_name",
                           "to_club_name", "transfer_date", "transfer_season", "transfer_fee")
    path = as_csv(t, once.unionByName(once), "transfers")
    # moves with one key may differ in their fee, of which any may be kept
    return tables.load_transfers(t.spark, path, 1996, 2000).select(
        *tables.TRANSFER_KEY, "player_name", "from_club_name", "to_club_name", "transfer_season")


@query("src_csv_valuations", "SELECT DISTINCT player_id, date, market_value_in_eur FROM valuations WHERE year(date) BETWEEN 1996 AND 2000")
def _(t):
    return tables.load_player_valuations(t.spark, as_csv(t, t.valuations, "valuations"), 1996, 2000).select(*tables.VALUATION_KEY)


@query("src_csv_appearances", """
    SELECT appearance_id, any_value(game_id) AS game_id, any_value(player_id) AS player_id, any_value(player_club_id) AS player_club_id,
           min(date) AS date, any_value(competition_id) AS competition_id, any_value(yellow_cards) AS yellow_cards,
           any_value(red_cards) AS red_cards, any_value(goals) AS goals, any_value(assists) AS assists,
           any_value(minutes_played) AS minutes_played FROM appearances GROUP BY 1""")
def _(t):
    path = as_csv(t, t.appearances, "appearances")
    return tables.load_appearances(t.spark, path).select(
        "appearance_id", "game_id", "player_id", "player_club_id", "date", "competition_id", "yellow_cards", "red_cards",
        "goals", "assists", "minutes_played")


@query("src_csv_competitions", "SELECT n_name AS competition_id, 'league' AS type, CAST(n_regionkey AS BIGINT) AS country_id, r_name AS confederation "
       "FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    rows = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("competition_id"), F.lit("league").alias("type"),
        F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")).alias("country_id"), F.col("r_name").alias("confederation"))
    stored = new_folder(t.spark, "competitions")
    sinks.rewrite(tables.load_competitions(t.spark, as_csv(t, rows, "competitions-csv")), stored)
    return t.spark.read.parquet(stored).select("competition_id", "type", "country_id", "confederation")


@query("src_gz_listing", "SELECT club_id, name FROM clubs")
def _(t):
    """A folder of gzip files reads like plain ones."""
    return tables.load_clubs(t.spark, as_csv(t, t.clubs, "clubs-gz", "gzip") + "/*.csv*").select("club_id", "name")


@query("src_json_profile", """
    SELECT player_id, position, sub_position, date_of_birth, current_club_id, current_club_name, lower(foot) AS foot, height_in_cm, market_value_in_eur,
           citizenship, CASE WHEN agent_name <> '' THEN agent_name END AS agent_name, contract_expiry_date, image_url
    FROM (SELECT * REPLACE (CASE WHEN player_id % 8 = 7 THEN 'Argentina, Italy' ELSE citizenship END AS citizenship,
                            CASE WHEN current_club_id <> 0 THEN current_club_id END AS current_club_id) FROM players)""")
def _(t):
    c = F.col
    payload = F.struct(
        F.struct(c("position").alias("main"), F.array(c("sub_position")).alias("other")).alias("position"),
        F.date_format("date_of_birth", "MMM d, yyyy").alias("dateOfBirth"),
        F.struct(c("current_club_id").cast("string").alias("id"), c("current_club_name").alias("name"),
                 F.date_format("contract_expiry_date", "dd/MM/yyyy").alias("contract_expires")).alias("club"),
        F.concat(F.lit(" "), c("foot")).alias("foot"),
        F.concat(F.format_string("%.2f", c("height_in_cm") / 100), F.lit(" m")).alias("height"),
        F.concat(F.lit("€"), (c("market_value_in_eur") / 1000).cast("decimal(20,3)").cast("string"), F.lit("k")).alias("marketValue"),
        F.split("citizenship", ",").alias("citizenship"), F.struct(c("agent_name").alias("name")).alias("agent"),
        c("image_url").alias("imageUrl"))
    parsed = documents.parse_profiles(t.players.select("player_id", F.to_json(payload).alias("json")))
    return parsed.withColumn("market_value_in_eur", F.round("market_value_in_eur"))


@query("src_json_transfers", """
    SELECT player_id, CAST(transfer_id AS VARCHAR) AS source_id, from_club_id, to_club_id, from_club_name, to_club_name, transfer_date,
           transfer_season, transfer_fee, transfer_fee * 2 AS market_value_in_eur FROM transfers""")
def _(t):
    """Payloads of one transfer each, parsed back."""
    c = F.col
    one = F.struct(
        c("transfer_id").cast("string").alias("id"),
        F.struct(c("from_club_id").cast("string").alias("id"), c("from_club_name").alias("name")).alias("clubFrom"),
        F.struct(c("to_club_id").cast("string").alias("id"), c("to_club_name").alias("name")).alias("clubTo"),
        F.date_format("transfer_date", "dd MMM yyyy").alias("date"), c("transfer_season").alias("season"),
        F.coalesce(c("transfer_fee").cast("decimal(20,0)").cast("string"), F.lit("loan")).alias("fee"),
        (c("transfer_fee") * 2).cast("decimal(20,0)").cast("string").alias("marketValue"))
    rows = t.transfers.select("player_id", F.to_json(F.struct(F.array(one).alias("transfers"))).alias("json"))
    return documents.parse_transfers(rows).select(
        "player_id", "source_id", "from_club_id", "to_club_id", "from_club_name", "to_club_name", "transfer_date", "transfer_season",
        "transfer_fee", "market_value_in_eur")


@query("src_json_valuations", "SELECT player_id, date, market_value_in_eur FROM valuations")
def _(t):
    one = F.struct(F.date_format("date", "yyyy/MM/dd").alias("date"),
                   F.concat(F.lit("€"), (F.col("market_value_in_eur") / 1000).cast("decimal(20,3)").cast("string"),
                            F.lit("Th.")).alias("marketValue"))
    rows = t.valuations.select("player_id", F.to_json(F.struct(F.array(one).alias("marketValueHistory"))).alias("json"))
    return documents.parse_valuations(rows).select("player_id", "date", F.round("market_value_in_eur").alias("market_value_in_eur"))


@query("src_json_performance", """
    SELECT l_partkey AS player_id, 'C' || l_linenumber AS competition_id, year(l_shipdate)::VARCHAR AS season,
           CASE WHEN l_suppkey <> 0 THEN l_suppkey END AS club_id, CAST(l_quantity * 2 AS BIGINT) AS minutes, l_returnflag = 'A' AS is_starting,
           CAST(l_linenumber % 3 AS BIGINT) AS goals, CAST(l_linenumber % 2 AS BIGINT) AS assists,
           CAST(CASE WHEN l_linenumber = 6 THEN 1 WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS BIGINT) AS red
    FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'O'""")
def _(t):
    line = F.col("l_linenumber")
    stats = F.struct(
        F.struct((F.col("l_quantity") * 2).cast("bigint").alias("playedMinutes"), (F.col("l_returnflag") == "A").alias("isStarting"))
        .alias("playingTimeStatistics"),
        F.struct((line % 3).alias("goalsScoredTotal"), (line % 2).alias("assists")).alias("goalStatistics"),
        F.struct(F.when(line == 6, 1).alias("redCard"), F.when(line == 5, 1).alias("yellowRedCard")).alias("cardStatistics"))
    game = F.struct(
        F.when(F.col("l_returnflag") != "N", stats).alias("statistics"),
        F.struct(F.concat(F.lit("C"), line.cast("string")).alias("competitionId"),
                 F.struct(F.year("l_shipdate").cast("string").alias("display")).alias("season")).alias("gameInformation"),
        F.struct(F.struct(F.col("l_suppkey").cast("string").alias("clubId")).alias("club")).alias("clubsInformation"))
    payload = F.struct((F.col("l_linestatus") == "O").alias("success"), F.struct(F.array(game).alias("performance")).alias("data"))
    rows = t.raw("lineitem").select(F.col("l_partkey").alias("player_id"), F.to_json(payload).alias("json"))
    return documents.parse_performance(rows).drop("date", "yellow")


def event_rows(t):
    """Lines as match events; one line in seven is not a shot."""
    line, half = F.col("l_linenumber"), F.col("l_quantity")
    named = F.struct(F.concat(F.lit("outcome "), F.col("l_returnflag")).alias("name"))
    return t.raw("lineitem").select(
        F.struct(F.when(line == 7, "Pass").otherwise("Shot").alias("name")).alias("type"),
        F.struct(F.col("l_partkey").alias("id"), F.concat(F.lit("Player "), F.col("l_partkey").cast("string")).alias("name")).alias("player"),
        F.struct(F.concat(F.lit("Team "), (F.col("l_suppkey") % 2).cast("string")).alias("name")).alias("team"),
        F.struct(F.lit("Team 0").alias("home_team_name")).alias("home_team"), F.struct(F.lit("Team 1").alias("away_team_name")).alias("away_team"),
        line.cast("bigint").alias("minute"), F.lit(None).cast("bigint").alias("second"),
        F.when(line != 2, F.array(half, half * 2)).alias("location"),
        F.struct(F.col("l_discount").alias("statsbomb_xg"), named.alias("outcome"), named.alias("type"), named.alias("body_part"),
                 named.alias("technique"), F.array(half).alias("end_location")).alias("shot"),
        F.col("l_suppkey").alias("team_number"), F.col("l_orderkey").alias("match_id"), F.lit(16).cast("bigint").alias("competition_id"), F.lit("Cup").alias("competition_name"),
        F.lit(1).cast("bigint").alias("season_id"), F.lit("1998").alias("season_name"), F.lit("1998-01-01").alias("match_date"))


@query("fn_shot_fields", """
    SELECT l_orderkey AS match_id, l_partkey AS source_player_id, 'Team ' || l_suppkey % 2 AS team_name, 'Team ' || (1 - l_suppkey % 2) AS opponent_name,
           CAST(l_linenumber AS BIGINT) AS minute, 0::BIGINT AS second, l_discount AS xg, 'outcome ' || l_returnflag AS shot_outcome,
           CASE WHEN l_linenumber <> 2 THEN l_quantity END AS location_x, CASE WHEN l_linenumber <> 2 THEN l_quantity * 2 END AS location_y,
           l_quantity AS end_location_x, NULL::DOUBLE AS end_location_y
    FROM lineitem WHERE l_linenumber <> 7""")
def _(t):
    return documents.shots(event_rows(t)).select(
        "match_id", "source_player_id", "team_name", "opponent_name", "minute", "second", "xg", "shot_outcome", "location_x", "location_y",
        "end_location_x", "end_location_y")


@query("src_json_events", """
    SELECT l_suppkey AS match_id, l_suppkey % 3 AS competition_id, 'Season ' || l_suppkey % 2 AS season_name, l_partkey AS source_player_id,
           'Team ' || l_suppkey % 2 AS team_name, 'Team ' || (1 - l_suppkey % 2) AS opponent_name, CAST(l_linenumber AS BIGINT) AS minute, l_discount AS xg
    FROM lineitem WHERE l_linenumber <> 7""")
def _(t):
    """Competitions, matches and events written as JSON folders, one match per supplier, and read back.

    Event lines carry their match: a folder for each match would be as many files as suppliers, times the tasks that write.
    Compressed files do not split, so their rows are bounded.
    """
    root = new_folder(t.spark, "events")
    match = F.col("s_suppkey")
    matches = t.raw("supplier").select(
        match.alias("match_id"), F.lit("1998-01-01").alias("match_date"), (match % 3).alias("competition"), (match % 2).alias("season"),
        F.struct(F.lit("Team 0").alias("home_team_name")).alias("home_team"), F.struct(F.lit("Team 1").alias("away_team_name")).alias("away_team"))
    seasons = matches.select(
        F.col("competition").alias("competition_id"), F.lit("Cup").alias("competition_name"), F.col("season").alias("season_id"),
        F.concat(F.lit("Season "), F.col("season").cast("string")).alias("season_name")).distinct()
    events = event_rows(t).select(F.col("team_number").alias("match_id"), "type", "player", "team", "minute", "location", "shot")
    seasons.write.json(f"{root}/competitions.json")
    matches.write.partitionBy("competition", "season").json(f"{root}/matches")
    events.write.option("compression", "gzip").option("maxRecordsPerFile", 200_000).json(f"{root}/events")
    shots = documents.shots(documents.read_shot_events(t.spark, root, arrays=False))
    return shots.select("match_id", "competition_id", "season_name", "source_player_id", "team_name", "opponent_name", "minute", "xg")


@query("sink_replace_partition", """
    SELECT part, count(*) AS moves, sum(CASE WHEN part = 2 THEN 1 ELSE fee END) AS fees
    FROM (SELECT CAST(transfer_id % 5 AS INTEGER) AS part, coalesce(transfer_fee, 0) AS fee FROM transfers0) GROUP BY 1""")
def _(t):
    """All partitions written, then one replaced; the others keep their rows."""
    rows = t.transfers.select((F.col("transfer_id") % 5).cast("int").alias("part"), "transfer_id",
                              F.coalesce("transfer_fee", F.lit(0.0)).alias("fee"))
    path = new_folder(t.spark, "parts")
    sinks.replace_partitions(rows, path, "part")
    sinks.replace_partitions(rows.filter("part = 2").withColumn("fee", F.lit(1.0)), path, "part")
    return t.spark.read.parquet(path).groupBy("part").agg(F.count(F.lit(1)).alias("moves"), F.sum("fee").alias("fees"))


@query("sink_upsert", """
    SELECT player_id, season, competition_id, CASE WHEN season = '1998/1999' THEN minutes + 1 ELSE minutes END AS minutes FROM player_xg""")
def _(t):
    stored = t.player_xg.select("player_id", "season", "competition_id", "minutes")
    newer = stored.filter(F.col("season") == "1998/1999").withColumn("minutes", F.col("minutes") + 1)
    path, key = new_folder(t.spark, "xg"), ["player_id", "season", "competition_id"]
    sinks.write_buckets(stored, path, key, 16)
    sinks.merge_buckets(t.spark, path, newer, key, 16)
    return t.spark.read.parquet(path).drop(sinks.BUCKET)


@query("sink_feature_csv", "SELECT pair_id, player_id, is_gem, buy_fee, height_in_cm FROM base")
def _(t):
    path = new_folder(t.spark, "features")
    base = training_base(t)
    rows = base.select("height_in_cm", *features.TARGETS)
    sinks.write_features(rows, path, features.TARGETS, as_csv=True)
    back = t.spark.read.option("header", True).csv(path)
    assert back.columns == [*features.TARGETS, "height_in_cm"]
    return back.select(F.col("pair_id").cast("bigint").alias("pair_id"), F.col("player_id").cast("bigint").alias("player_id"),
                       F.col("is_gem").cast("int").alias("is_gem"), F.col("buy_fee").cast("double").alias("buy_fee"),
                       F.col("height_in_cm").cast("double").alias("height_in_cm"))


@query("sink_pairs_rewrite", """
    SELECT holding, count(*) AS pairs, sum(buy_fee) AS buy_fee FROM (SELECT club_id AS holding, buy_fee FROM pair_rows) GROUP BY 1""")
def _(t):
    path = new_folder(t.spark, "pairs")
    sinks.rewrite(stored_pairs(t), path)
    sinks.rewrite(stored_pairs(t), path)
    return t.spark.read.parquet(path).groupBy(F.col("holding_club_id").alias("holding")).agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("buy_fee").alias("buy_fee"))


@query("state_counts", """
    SELECT 'transfers' AS metric, (SELECT count(*) FROM transfers0) AS value UNION ALL SELECT 'players', (SELECT count(*) FROM players)
    UNION ALL SELECT 'clubs', (SELECT count(*) FROM clubs) UNION ALL SELECT 'player_valuations', (SELECT count(*) FROM valuations)
    UNION ALL SELECT 'appearances', (SELECT count(*) FROM appearances) UNION ALL SELECT 'buy_sell_pairs', (SELECT count(*) FROM matched)
    UNION ALL SELECT 'reconstructed_transfers', (SELECT count(*) FROM transfers0 WHERE transfer_fee > 0)""")
def _(t):
    scored = t.transfers.withColumn("confidence_score", F.when(F.col("transfer_fee") > 0, 1.0))
    return quality.table_counts(
        {"transfers": t.transfers, "players": t.players, "clubs": t.clubs, "player_valuations": t.valuations,
         "appearances": t.appearances}, t.paired, scored)
