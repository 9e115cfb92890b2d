import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerloom.operators import views
from ledgerloom.sources import sinks, tables


@pytest.mark.parametrize("number,per_page", [(1, 50), (3, 50), (17, 7), (180, 5), (181, 5), (9, 111), (10, 111)])
def test_sought_pages_equal_sorted_slices(spark, number, per_page):
    draw = random.Random(1)
    data = [(k, draw.choice([None, *range(40)])) for k in range(900)]
    order = [F.col("day").desc_nulls_last(), F.col("id").asc()]
    want = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[(number - 1) * per_page:number * per_page]
    frame = spark.createDataFrame(data, "id long, day int").repartition(5)
    assert [tuple(r) for r in views.page(frame, order, number, per_page, shallow=0).collect()] == want


def test_a_deep_page_reads_its_ranges_only(spark):
    page = views.page(spark.range(20_000), [F.col("id").asc()], 300, 50, shallow=0)
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and [r.id for r in page.collect()] == list(range(14_950, 15_000))
    assert views.page(spark.range(10), [F.col("id").asc()], 2, 50, shallow=0).count() == 0


def files(path):
    return {str(p.relative_to(path)) for p in path.rglob("*.parquet")}


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    path, key = tmp_path / "table", ["k"]
    old = spark.createDataFrame([(k, f"old{k}") for k in range(400)], "k long, v string")
    sinks.write_buckets(old, str(path), key, 32)
    before = files(path)
    sinks.merge_buckets(spark, str(path), spark.createDataFrame([(5, "new"), (400, "more")], "k long, v string"), key, 32)
    kept = {name.split("/")[0] for name in files(path) & before}
    touched = {name.split("/")[0] for name in files(path) - before}
    assert 1 <= len(touched) <= 2 and not kept & touched and len(kept | touched) == len({n.split("/")[0] for n in before} | touched)
    want = {**{k: f"old{k}" for k in range(400)}, 5: "new", 400: "more"}
    assert {r.k: r.v for r in spark.read.parquet(str(path)).collect()} == want
    sinks.merge_buckets(spark, str(path), old.limit(0), key, 32)
    assert spark.read.parquet(str(path)).count() == 401


def test_records_that_span_lines(spark, tmp_path):
    file = tmp_path / "clubs.csv"
    file.write_text('club_id,name,club_code,domestic_competition_id\n1,"Two\nlines, ""quoted""",c1,GB1\n2,short\n3,plain,c3,ES1\n4,a,b,c,d\n')
    got = tables.load_clubs(spark, str(file), spanning=True)
    assert rows(got.filter("club_id IN (1, 3)"), "club_id", "name", "domestic_competition_id") == [(1, 'Two\nlines, "quoted"', "GB1"), (3, "plain", "ES1")]
    raw = tables.read_text(spark, str(file), spanning=True)
    assert tuple(tables.broken_rows(raw).first()) == (4, 4, 2)


@pytest.mark.parametrize("text,day", [("2020-01-02", "2020-01-02"), ("2020-01-02 10:00:00", "2020-01-02"), ("2020-01-02T10:00", "2020-01-02"),
                                      ("2020-01-01garbage", None), ("2020-13-01", None), ("", None)])
def test_dates_with_garbage_are_missing(spark, text, day):
    got = spark.createDataFrame([(text,)], "t string").select(tables.coerce(F.col("t"), "date").cast("string")).first()[0]
    assert got == day
