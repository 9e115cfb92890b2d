import gzip
import json
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom import constants as C
from ledgerloom.functions import labels, parsing
from ledgerloom.operators import sets, views
from ledgerloom.sources import documents, sinks, tables


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


@pytest.mark.parametrize("fn, values, want", [
    (parsing.parse_money, ["€100m", "€500k", "€1.2bn", "€5Th.", "x", "", None], [1e8, 5e5, 1.2e9, 5e3, None, None, None]),
    (parsing.parse_fee, ["free transfer", "End of loan", "1,500,000", "€2m", "?", "Retired"], [None, None, 1.5e6, 2e6, None, None]),
    (parsing.parse_int, ["12.0", "abc", None, "7"], [12, None, None, 7]),
    (parsing.parse_height_cm, ["1.88 m", "1,75 m", "190", "tall"], [188.0, 175.0, 190.0, None]),
    (parsing.parse_date, ["Jan 1, 2020", "2020-01-02", "13/02/2020", "02/13/2020", "3 Mar 2020", "2020/04/05", "soon"],
     [date(2020, 1, 1), date(2020, 1, 2), date(2020, 2, 13), date(2020, 2, 13), date(2020, 3, 3), date(2020, 4, 5), None]),
    (parsing.slug, ["João  Félix-Ção", "O'Neill", None], ["joao-felix-cao", "oneill", ""]),
    (parsing.club_code_from_url, ["/real/startseite/verein/1", "/startseite/verein/2", "real", None], ["real", None, None, None]),
    (labels.citizenship_region, ["Brazil", "Japan, Brazil", "Atlantis", "", None], ["South America", "Asia", "Other", None, None]),
])
def test_text_functions(spark, fn, values, want):
    assert apply(spark, fn, values) == want


def test_number_labels(spark):
    assert apply(spark, labels.fee_bucket, [None, 0.0, 99999.0, 1e5, 1e8], "double") == ["unknown", "free", "micro", "small", "elite"]
    assert apply(spark, labels.gem_tier, [-5.0, 99.9, 100.0, 500.0, 1000.0], "double") == [0, 0, 1, 2, 3]
    assert apply(spark, labels.season, [date(2023, 7, 1), date(2023, 6, 30)], "date") == ["2023-2024", "2022-2023"]
    assert apply(spark, labels.format_euro, [None, -1.25e6, 2e9, 950.0, 1000.0], "double") == ["", "-€1.3M", "€2.0B", "€950", "€1.0K"]


@pytest.mark.parametrize("origin, target, fee, want", [
    ("Ajax", "Jong Ajax", 0.0, "sent_to_reserves"), ("Ajax", " Retired", None, "retired"), ("Ajax", "x", 10.0, "paid"),
    ("Ajax U19", "Ajax B", None, "youth_promotion"), ("Ajax II", "Ajax U19", None, "sent_to_reserves"),
    (None, "Without Club", None, "contract_expired"), ("A", "C", None, "free_transfer"),
])
def test_movement_types(spark, origin, target, fee, want):
    df = spark.createDataFrame([(fee, origin, target)], "f double, o string, t string")
    assert df.select(labels.movement_type(F.col("f"), F.col("o"), F.col("t"))).first()[0] == want


def test_csv_loads_and_deduplicates(spark, tmp_path):
    (tmp_path / "t.csv").write_text("player_id,from_club_id,to_club_id,transfer_date,transfer_fee\n"
                                    "1,2.0,,2010-01-01,5\n1,2,,2010-01-01,7\nx,NaN,3,,n/a\n1,2,3,1990-01-01,1\n")
    got = tables.load_transfers(spark, str(tmp_path / "t.csv"))
    assert rows(got, "player_id", "from_club_id", "to_club_id", "transfer_fee") == [(0, None, 3, None), (1, 2, None, 5.0)]
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("club_id,name,club_code\n5.0,Ajax,ajax\nbad,,\n")
    assert rows(tables.load_clubs(spark, str(tmp_path / "c.csv*")), "club_id", "name") == [(0, None), (5, "Ajax")]


def test_performance_payload(spark):
    def game(minutes, start, red=None, second=None, stats=True):
        body = {"playingTimeStatistics": {"playedMinutes": minutes, "isStarting": start},
                "goalStatistics": {"goalsScoredTotal": 1}, "cardStatistics": {"redCard": red, "yellowRedCard": second}}
        return {"statistics": body if stats else None, "gameInformation": {"competitionId": "GB1", "season": {"display": "22/23"}},
                "clubsInformation": {"club": {"clubId": "9"}}}

    games = [game(90, True, second=1), game(0, True), game(0, False), game(5, False, stats=False), game(10, False, red=1)]
    payloads = [(1, json.dumps({"success": True, "data": {"performance": games}})), (2, json.dumps({"success": False})), (3, "{")]
    parsed = documents.parse_performance(spark.createDataFrame(payloads, "player_id long, json string"))
    assert parsed.count() == 4
    r = documents.season_performance(parsed).first()
    assert (r.appearances, r.starts, r.games_count, r.red_cards, r.minutes_played, r.club_id) == (2, 2, 3, 2, 100, 9)


def test_shot_files(spark, tmp_path):
    (tmp_path / "competitions.json").write_text(json.dumps([
        {"competition_id": 16, "competition_name": "CL", "season_id": 4, "season_name": "18/19"},
        {"competition_id": 2, "competition_name": "PL", "season_id": 4, "season_name": "18/19"}]))
    for comp, match in ((16, 71), (2, 72)):
        folder = tmp_path / "matches" / str(comp)
        folder.mkdir(parents=True)
        (folder / "4.json").write_text(json.dumps([{"match_id": match, "match_date": "2019-01-01", "home_team": {"home_team_name": "H"},
                                                    "away_team": {"away_team_name": "A"}}]))
        (tmp_path / "events").mkdir(exist_ok=True)
        (tmp_path / "events" / f"{match}.json").write_text(json.dumps([
            {"type": {"name": "Shot"}, "player": {"id": 5, "name": "Zé"}, "team": {"name": "H"}, "minute": 3, "location": [1.0, 2.0],
             "shot": {"statsbomb_xg": 0.5, "outcome": {"name": "Goal"}, "end_location": [9.0]}}, {"type": {"name": "Pass"}}]))
    got = documents.shots(documents.read_shot_events(spark, str(tmp_path), documents.shot_competitions("high")))
    assert rows(got, "match_id", "season_name", "opponent_name", "xg", "location_y", "end_location_y") == [(71, "18/19", "A", 0.5, 2.0, None)]


def test_one_file_of_event_lines_holds_many_matches(spark, tmp_path):
    def lines(path, *records):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("\n".join(json.dumps(r) for r in records))

    def shot(player, **more):
        return {**more, "type": {"name": "Shot"}, "player": {"id": player}, "team": {"name": "A"}}

    lines("competitions.json", {"competition_id": 3, "season_id": 4, "season_name": "18/19"})
    lines("matches/competition=3/season=4/part.json", *[{"match_id": i} for i in (71, 72, 73)])
    lines("events/part-0.json", shot(1, match_id=71), shot(2, match_id=72), shot(3, match_id=72), shot(4, match_id=99))
    lines("events/match=73/part.json", shot(5))
    got = documents.shots(documents.read_shot_events(spark, str(tmp_path), arrays=False))
    assert rows(got, "match_id", "source_player_id") == [(71, 1), (72, 2), (72, 3), (73, 5)]


def test_partition_replace_and_upsert(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, p string")
    sinks.replace_partitions(df, path, "p")
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "k long, p string"), path, "p")
    assert rows(spark.read.parquet(path), "k", "p") == [(1, "a"), (9, "b")]
    old = spark.createDataFrame([(1, 5), (2, 6)], "k long, v long")
    assert rows(sinks.upsert(old, spark.createDataFrame([(2, 1), (3, 1)], "k long, v long"), ["k"])) == [(1, 5), (2, 1), (3, 1)]


def test_search_escapes_wildcards(spark):
    clubs = spark.createDataFrame([(1, "50% FC", "X"), (2, "500 FC", "X")], "club_id long, name string, domestic_competition_id string")
    players = spark.createDataFrame([(7, "a_b 0%", None), (8, "acb", None)], "player_id long, name string, position string")
    assert rows(sets.search(clubs, players, "0%"), "type", "id") == [("club", 1), ("player", 7)]


def test_league_names(spark):
    from ledgerloom import constants as C
    from ledgerloom.plans.analytics import xg_competition
    assert len(C.DOMESTIC_LEAGUE_NAMES) == 31
    assert apply(spark, labels.league_name, ["GB1", "DFB", "NATION_1"]) == ["English Premier League", "DFB-Pokal", None]
    assert C.SPENDING_LEAGUE_NAMES["GB1"] == "Premier League" and "DFB" not in C.SPENDING_LEAGUE_NAMES
    assert apply(spark, xg_competition, ["EPL", "Elsewhere"]) == ["GB1", "Elsewhere"]
    assert len(documents.shot_competitions("all")) == 11


def test_page_bounds(spark):
    df = spark.range(10)
    assert rows(views.page(df, [F.col("id").asc()], 2, 3)) == [(3,), (4,), (5,)]
    with pytest.raises(ValueError):
        views.page(df, [F.col("id").asc()], 0)


def test_dates_are_tried_by_fitting_formats_only(spark):
    """The same dates as by trying all formats, but a text meets three of the six at most."""
    odd = ["Jan 1, 2020", "jan 01, 2020", " JAN 1, 2020 ", "Jan 1,2020", "2020-1-2", "2020-01-02", "20-01-02", "+12020-01-02", "12020-01-02", "0013/02/2020",
           "13/02/2020", "02/13/2020", "1/2/2020", "1/2/20", "1/2/12020", "3 Mar 2020", "03 mar 2020", "3 Mar 20", "2020/04/05", "2020/4/5", "2020/13/05",
           "20/4/5", "2020/04/2020", "Sept 1, 2020", "1 2 2020", "2020-02-30", "31/02/2020", "", " ", "-", "//", "soon", None]
    text = F.initcap(F.trim("s"))
    every = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in C.DATE_FORMATS])
    tried = sum((F.coalesce(text.rlike(shape).cast("int"), F.lit(0)) for shape in C.DATE_SHAPES), F.lit(0))
    got = spark.createDataFrame([(x,) for x in odd], "s string").select("s", parsing.parse_date(F.col("s")).cast("string").alias("got"), every.cast("string").alias("want"), tried.alias("n")).collect()
    assert [(r.s, r.got) for r in got] == [(r.s, r.want) for r in got]
    assert {r.s: r.n for r in got}["2020/04/05"] == 1 and max(r.n for r in got) <= 3 and sum(r.got is not None for r in got) > 12
