import random
import statistics
from datetime import date, timedelta

from conftest import rows
from pyspark.sql import Window, functions as F

from ledgerloom.operators.skew import asof_by_day, chain, exact_medians, hot_keys, select_ranks

START = date(2000, 1, 1)


def ledger(spark, n=600, seed=1):
    """A third of the rows belong to player 1."""
    rng = random.Random(seed)
    data = [(i, 1 if rng.random() < 0.34 else rng.randrange(2, 40), rng.choice([None, 1, 2, 3]),
             START + timedelta(days=rng.randrange(40))) for i in range(n)]
    return spark.createDataFrame(data, "transfer_id long, player_id long, club long, day date")


def test_chain_with_hot_key_equals_plain_window(spark):
    df = ledger(spark)
    window = Window.partitionBy("player_id").orderBy("day", "transfer_id")
    want = rows(df.select("transfer_id", F.row_number().over(window), F.lag("club").over(window)))
    for hot_rows in (10, 1_000_000):
        got = chain(df, "player_id", ["day", "transfer_id"], {"prev": "club"}, F.col("day"), hot_rows)
        assert rows(got, "transfer_id", "seq", "prev") == want


def test_asof_takes_latest_strictly_earlier_day(spark):
    df = ledger(spark, 300)
    points = ledger(spark, 200, seed=2).withColumnsRenamed({"day": "on", "transfer_id": "pid", "club": "value"})
    got = asof_by_day(df, points, ["player_id"], "day", "on", ["pid", "value"], ["pid"])
    facts = [tuple(r) for r in points.select("player_id", "on", "pid", "value").collect()]
    for r in got.collect():
        earlier = [(on, pid, value) for player, on, pid, value in facts if player == r.player_id and on < r.day]
        best = max(earlier, key=lambda x: (x[0], x[1]), default=None)
        assert (r._asof and (r._asof.pid, r._asof.value)) == (best and best[1:])


def test_exact_medians(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.5 else rng.randrange(2, 6),
             None if rng.random() < 0.1 else rng.choice([rng.gauss(0, 1e6), 5.0, 5.0])) for _ in range(6000)]
    data += [(99, None), (98, 7.0), (97, 1.0), (97, 2.0)]
    df = spark.createDataFrame(data, "g long, v double")
    got = exact_medians(df, ["g"], {"m": F.col("v"), "twice": F.col("v") * 2}, [F.count("v").alias("n")])
    for r in got.collect():
        values = [v for g, v in data if g == r.g and v is not None]
        assert r.n == len(values)
        assert r.m == (statistics.median(values) if values else None)
        assert r.twice == (statistics.median([2 * v for v in values]) if values else None)


def test_medians_of_a_large_group(spark):
    df = spark.range(300_001).select(F.lit(1).alias("g"), (F.hash("id") % 1_000_003).cast("double").alias("v"))
    got = exact_medians(df, ["g"], {"m": F.col("v")}).first().m
    assert got == df.agg(F.expr("median(v)")).first()[0]


def test_medians_whose_bracket_misses(spark):
    """A sketch that is exact for few values only and a bracket without width: the ranks are selected again."""
    rng = random.Random(8)
    data = [(g, rng.gauss(0, 100)) for g, n in ((1, 4001), (2, 4000), (3, 7)) for _ in range(n)] + [(4, 5.0)] * 50 + [(5, None)]
    df = spark.createDataFrame(data, "g long, v double")
    want = {g: statistics.median(v) if v else None for g in range(1, 6) for v in [[v for k, v in data if k == g and v is not None]]}
    for limits in ({"margin": 0.0, "accuracy": 3}, {"max_ranked": 2}):
        assert {r.g: r.m for r in exact_medians(df, ["g"], {"m": F.col("v")}, **limits).collect()} == want


def test_ranks_by_repeated_selection(spark):
    rng = random.Random(9)
    data = [(1, float(rng.randrange(300))) for _ in range(3000)] + [(2, 1.0), (2, 2.0)]
    df = spark.createDataFrame(data, "g long, v double")
    targets = spark.createDataFrame([(1, 1), (1, 77), (1, 3000), (2, 2)], "g long, k long")
    for accuracy in (10_000, 4):
        got = {(r.g, r.k): r.value for r in select_ranks(df, targets, ["g"], max_ranked=50, accuracy=accuracy).collect()}
        assert got == {(g, k): sorted(v for o, v in data if o == g)[k - 1] for g, k in ((1, 1), (1, 77), (1, 3000), (2, 2))}


def test_hot_keys_are_few(spark):
    df = ledger(spark)
    assert hot_keys(df, ["player_id"], 10).count() >= 1
    assert [r.player_id for r in hot_keys(df, ["player_id"], 100).collect()] == [1]
    given = chain(df, "player_id", ["day", "transfer_id"], {"prev": "club"}, F.col("day"), hot=hot_keys(df, ["player_id"], 5))
    plain = chain(df, "player_id", ["day", "transfer_id"], {"prev": "club"}, F.col("day"))
    assert rows(given, "transfer_id", "seq", "prev") == rows(plain, "transfer_id", "seq", "prev")


def test_asof_on_missing_keys_finds_nothing(spark):
    probes = spark.createDataFrame([(1, None, START)], "p long, c long, day date")
    points = spark.createDataFrame([(1, None, START - timedelta(days=1), 5)], "p long, c long, on date, v long")
    assert asof_by_day(probes, points, ["p", "c"], "day", "on", ["v"], ["v"]).first()["_asof"] is None
