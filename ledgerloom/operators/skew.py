"""Order-dependent operators that stay balanced when one key holds a third of the rows.

* ``chain``: row number and previous row per key. Keys above ``hot_rows`` are cut into
  ordered chunks that run as separate tasks; only one summary row per chunk is stitched.
* ``plain_chain``: the same by one window, for tables without hot keys.
* ``asof_by_day``: latest earlier fact per key. Facts and probes collapse to one row per
  (key, day) first, so a key never holds more rows than there are calendar days.
* ``exact_medians``: a mergeable sketch brackets each median, then only the few values
  inside the bracket are counted and ranked.
* ``select_ranks``: values of given ranks by repeated selection, for brackets that miss the
  median or hold too many values for one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import checkpointed, drop_table

HOT_ROWS = 1_000_000
#: Values of a bracket that one task ranks at most; a larger bracket is narrowed first.
MAX_RANKED = 1_000_000
#: Parts into which a pass of ``select_ranks`` cuts what is left of a group.
GRID = 1_000
MAX_HOT_KEYS = 100_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Keys with more than ``hot_rows`` rows and at least 1 / ``MAX_HOT_KEYS`` of all rows.

    So there are never more than ``MAX_HOT_KEYS`` of them, whatever the table holds. ``rows`` is the number
    of all rows, if it is known; else the counts are added up in a second pass.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    every = counts.agg(F.sum("_n").alias("n")).scalar() if rows is None else F.lit(rows)
    return counts.filter((F.col("_n") > hot_rows) & (F.col("_n") * MAX_HOT_KEYS >= every)) \
        .select(*keys, F.lit(True).alias("_hot"))


def chain(df: DataFrame, key: str, order: list[str], previous: dict[str, str], chunk: Column,
          hot_rows: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Adds ``seq`` (1-based per ``key``) and, per ``previous`` item, the prior row's value.

    ``chunk`` must grow with ``order``. It is used for hot keys only; other keys keep a
    NULL chunk and need no stitching. Which keys are hot never changes the answer: they are
    ``hot`` (``key``, ``_hot``; at most ``MAX_HOT_KEYS`` rows) if it is given, else counted here.
    """
    hot = F.broadcast(hot_keys(df, [key], hot_rows) if hot is None else hot)  # at most MAX_HOT_KEYS rows
    marked = df.join(hot, key, "left").withColumn("_chunk", F.when(F.col("_hot"), chunk)).drop("_hot")
    spread = marked.repartition(key, "_chunk")
    within = Window.partitionBy(key, "_chunk").orderBy(*order)
    numbered = spread.withColumn("_rn", F.row_number().over(within)).withColumns(
        {out: F.lag(col).over(within) for out, col in previous.items()}
    )
    # one row per hot chunk: its size and its last values; an inner join, so that the
    # adaptive planner drops this branch unread when no key is hot
    tails = (
        df.join(hot, key).withColumn("_chunk", chunk).groupBy(key, "_chunk")
        .agg(F.count(F.lit(1)).alias("_size"),
             F.max_by(F.struct(*previous.values()), F.struct(*order)).alias("_last"))
    )
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    carried = tails.select(
        key, "_chunk",
        F.sum("_size").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(by_chunk).alias("_carry"),
    )
    joined = numbered.join(carried, [key, "_chunk"], "left")
    stitched = {
        out: F.when(F.col("_rn") == 1, F.col(f"_carry.{col}")).otherwise(F.col(out))
        for out, col in previous.items()
    }
    return (
        joined.withColumn("seq", F.col("_rn") + F.coalesce("_before", F.lit(0)))
        .withColumns(stitched)
        .drop("_chunk", "_rn", "_before", "_carry")
    )


def plain_chain(df: DataFrame, key: str, order: list[str], previous: dict[str, str]) -> DataFrame:
    """As ``chain``, where no key is hot: one shuffle by ``key``, by which the rows stay clustered."""
    within = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("seq", F.row_number().over(within).cast("bigint")).withColumns(
        {out: F.lag(col).over(within) for out, col in previous.items()})


def asof_by_day(probes: DataFrame, points: DataFrame, keys: list[str], probe_day: str, point_day: str,
                values: list[str], tie: list[str]) -> DataFrame:
    """Per probe the ``values`` of the latest point strictly before its day, in ``_asof``.

    Points of one day are reduced to the greatest by ``tie``, and probes of one day to one row, before one shuffle of both.
    """
    dated = points.filter(F.col(point_day).isNotNull()).select(
        *keys, F.col(point_day).alias("_day"), F.struct(*values).alias("_point"), F.struct(*tie).alias("_tie"), F.lit(False).alias("_probe"))
    wanted = probes.select(*keys, F.col(probe_day).alias("_day"), F.lit(True).alias("_probe"))
    timeline = (
        dated.unionByName(wanted, allowMissingColumns=True).groupBy(*keys, "_day")
        .agg(F.max_by("_point", "_tie").alias("_point"), F.max("_probe").alias("_probe"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        timeline.withColumn("_asof", F.last("_point", ignorenulls=True).over(earlier))
        .filter("_probe").select(*keys, F.col("_day").alias(probe_day), "_asof")
    )
    return probes.join(found, [*keys, probe_day], "left")


def select_ranks(values: DataFrame, targets: DataFrame, keys: list[str], max_ranked: int = MAX_RANKED, accuracy: int = 10_000) -> DataFrame:
    """``keys, k, value``: the ``k``-th smallest ``v`` (1-based, not above the number of values) of each key, exactly.

    Each pass cuts what is left of a group by a sketch's quantiles, counts below and inside the part that should hold
    the rank, and keeps that part, or what lies below or above it if the sketch was wrong. A part leaves out at least
    one value that the group had, so this ends; with a sketch's error of 1 / ``accuracy`` a pass leaves about a
    three-hundredth. Parts of at most ``max_ranked`` values are ranked.
    """
    columns = [*keys, "k", "skipped", "lo", "hi", "inside"]
    left = checkpointed(targets.select(*keys, F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("skipped"), F.lit(None).cast("double").alias("lo"),
                                       F.lit(None).cast("double").alias("hi"), F.lit(None).cast("long").alias("inside")), "ranks")
    rows = values.select(*keys, F.col("v").cast("double").alias("v")).filter("v is not null")
    within = ((F.col("lo").isNull() | (F.col("v") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("v") <= F.col("hi"))))
    small, done = [], []
    while not left.isEmpty():
        grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], accuracy).alias("grid")
        cut = rows.join(left, keys).filter(within).groupBy(*columns).agg(grid, F.count(F.lit(1)).alias("n"))
        part = (F.col("k") - F.col("skipped")) / F.col("n") * GRID
        cut = cut.withColumns({"a": F.element_at("grid", F.greatest(F.floor(part), F.lit(1)).cast("int")),
                               "b": F.element_at("grid", F.least(F.ceil(part) + 2, F.lit(GRID + 1)).cast("int"))}).drop("grid", "n")
        v, a, b = F.col("v"), F.col("a"), F.col("b")
        counted = rows.join(cut, keys).filter(within).groupBy(*columns, "a", "b").agg(
            F.count_if(v < a).alias("below"), F.count_if(v <= b).alias("upto"), F.count(F.lit(1)).alias("n"),
            F.min("v").alias("least"), F.max("v").alias("most"), F.max(F.when(v < a, v)).alias("before"), F.min(F.when(v > b, v)).alias("after"))
        rank = F.col("k") - F.col("skipped")
        under, over = rank <= F.col("below"), rank > F.col("upto")
        narrowed = counted.select(
            *keys, "k", (F.col("skipped") + F.when(under, 0).when(over, F.col("upto")).otherwise(F.col("below"))).alias("skipped"),
            F.when(under, F.col("least")).when(over, F.col("after")).otherwise(a).alias("lo"),
            F.when(under, F.col("before")).when(over, F.col("most")).otherwise(b).alias("hi"),
            F.when(under, F.col("below")).when(over, F.col("n") - F.col("upto")).otherwise(F.col("upto") - F.col("below")).alias("inside"))
        narrowed = checkpointed(narrowed, "ranks")
        drop_table(left)
        one = F.col("lo") == F.col("hi")
        done.append(narrowed.filter(one).select(*keys, "k", F.col("lo").alias("value")))
        small.append(narrowed.filter(~one & (F.col("inside") <= max_ranked)))
        left = checkpointed(narrowed.filter(~one & (F.col("inside") > max_ranked)), "ranks")
    if not small:
        return left.select(*keys, "k", F.col("lo").alias("value"))
    parts = reduce(DataFrame.unionByName, small)
    counted = rows.join(parts, keys).filter(within).groupBy(*columns, "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*keys, "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.col("skipped") + F.sum("n").over(upto)).filter("upto >= k").groupBy(*keys, "k").agg(F.min("v").alias("value"))
    return reduce(DataFrame.unionByName, [ranked, *done])


def exact_medians(df: DataFrame, keys: list[str], metrics: dict[str, Column], totals: list[Column] = (),
                  margin: float = 0.0005, accuracy: int = 10_000, max_ranked: int = MAX_RANKED) -> DataFrame:
    """Exact medians (NULLs ignored, middle two averaged) and ``totals`` per ``keys``.

    The sketch has rank error 1/accuracy, a fifth of ``margin``, and is exact on small groups,
    so only a thousandth of a group is ranked. Groups whose bracket misses, or would hold more than
    ``max_ranked`` values, go to ``select_ranks``. The result is stored, to learn whether there are any.
    """
    def _wide(total: Column) -> Column:
        return total * (2 * margin) > max_ranked

    names = list(metrics)
    rows = df.withColumns({f"_v_{m}": metrics[m] for m in names})
    sketches = []
    for m in names:
        sketches.append(F.count(metrics[m]).alias(f"_n_{m}"))
        sketches.append(F.percentile_approx(metrics[m], [0.5 - margin, 0.5 + margin], accuracy).alias(f"_b_{m}"))
    base = df.groupBy(*keys).agg(*totals, *sketches)

    bounds = base.select(*keys, *[f"{p}{m}" for p in ("_n_", "_b_") for m in names])
    entries = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"_v_{m}").alias("v"), F.col(f"_n_{m}").alias("total"),
                 F.col(f"_b_{m}")[0].alias("lo"), F.col(f"_b_{m}")[1].alias("hi"))
        for m in names
    ])
    long = rows.select(*keys, *[f"_v_{m}" for m in names]).join(bounds, keys).select(*keys, F.inline(entries))
    # values below the bracket collapse into one NULL row, values above it are not needed
    counted = (
        long.filter((F.col("v") <= F.col("hi")) & ~_wide(F.col("total")))
        .select(*keys, "metric", "total", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v"))
        .groupBy(*keys, "metric", "v").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    )
    upto = Window.partitionBy(*keys, "metric").orderBy(F.col("v").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("n").over(upto))
    picks = []
    for m in names:
        mine = F.col("metric") == m
        low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
        picks += [
            F.max(F.when(mine & F.col("v").isNull(), F.col("n"))).alias(f"_below_{m}"),
            F.min(F.when(mine & (F.col("upto") >= low), F.col("v"))).alias(f"_low_{m}"),
            F.min(F.when(mine & (F.col("upto") >= high), F.col("v"))).alias(f"_high_{m}"),
        ]
    middle = ranked.groupBy(*keys).agg(*picks)
    out = base.join(middle, keys, "left")
    medians, open_ranks = {}, []
    for m in names:
        n = F.col(f"_n_{m}")
        missed = (n > 0) & (_wide(n) | F.col(f"_high_{m}").isNull()
                            | (F.coalesce(f"_below_{m}", F.lit(0)) >= F.floor((n + 1) / 2)))
        medians[m] = F.when(~missed, (F.col(f"_low_{m}") + F.col(f"_high_{m}")) / 2)
        halves = F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor((n + 2) / 2)))
        open_ranks.append(F.struct(F.lit(m).alias("metric"), F.when(missed, halves).alias("ranks")))
    out = checkpointed(out.withColumns({**medians, "_open": F.filter(F.array(*open_ranks), lambda x: x["ranks"].isNotNull())}).drop(
        *[f"{p}{m}" for m in names for p in ("_n_", "_b_", "_below_", "_low_", "_high_")]), "medians")
    again = out.filter(F.size("_open") > 0)
    if again.isEmpty():
        return out.drop("_open")
    targets = again.select(*keys, F.inline("_open")).select(*keys, "metric", F.explode("ranks").alias("k"))
    values = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_v_{m}").cast("double").alias("v")) for m in names])))
    picked = select_ranks(values, targets, [*keys, "metric"], max_ranked)
    late = picked.groupBy(*keys).agg(*[F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(f"_late_{m}") for m in names])
    return out.join(late, keys, "left").withColumns({m: F.coalesce(m, f"_late_{m}") for m in names}).drop("_open", *[f"_late_{m}" for m in names])
