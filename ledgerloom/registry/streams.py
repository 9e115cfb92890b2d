"""Streaming loads."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerloom.registry.base import ROUNDS, iteration_sql, query
from ledgerloom.session import new_folder
from ledgerloom.streaming import ingest
from ledgerloom.streaming.reconcile import ITERATION, reconcile

MOVES = ["player_id", "from_club_id", "to_club_id", "transfer_date"]


def line_files(t, years: bool = False) -> str:
    """The lines as several files in a new folder: dealt out, or one file a year in the order of time."""
    lines = t.raw("lineitem").select(
        F.col("l_partkey").alias("player_id"), F.col("l_linenumber").cast("bigint").alias("from_club_id"),
        F.col("l_suppkey").alias("to_club_id"), F.col("l_shipdate").cast("date").alias("transfer_date"),
        F.col("l_shipdate").cast("timestamp").alias("moved_at"))
    folder = new_folder(t.spark, "line-files")
    if not years:
        lines.repartition(6).write.parquet(folder)
        return folder
    ends = lines.agg(F.year(F.min("transfer_date")).alias("first"), F.year(F.max("transfer_date")).alias("last")).first()
    for year in range(ends["first"], ends["last"] + 1):
        lines.filter(F.year("transfer_date") == year).coalesce(1).write.mode("append").parquet(folder)
    return folder


def read_lines(t, folder: str, files_per_batch: int):
    return ingest.read_files(t.spark, folder, t.spark.read.parquet(folder).schema, files_per_batch=files_per_batch)


DISTINCT_MOVES = """
    SELECT DISTINCT l_partkey AS player_id, CAST(l_linenumber AS BIGINT) AS from_club_id, l_suppkey AS to_club_id,
           CAST(l_shipdate AS DATE) AS transfer_date FROM lineitem"""


@query("stream_ingest", DISTINCT_MOVES)
def _(t):
    """Several files in several batches, delivered to two runs with separate progress: the second adds nothing."""
    target, folder = new_folder(t.spark, "ledger"), line_files(t)
    for run in ("first", "second"):
        stream = read_lines(t, folder, 2).drop("moved_at")
        load = ingest.append_new(target, MOVES, "transfer_date")
        if run == "second":
            load = shifted(load)
        query_ = (stream.writeStream.foreachBatch(load).option("checkpointLocation", new_folder(t.spark, f"progress-{run}"))
                  .trigger(availableNow=True).start())
        query_.awaitTermination()
    return t.spark.read.parquet(target).select(*MOVES)


def shifted(load, by=1_000_000):
    """A second stream numbers its batches from zero again; keep the load ids apart."""
    return lambda batch, batch_id: load(batch, batch_id + by)


@query("stream_dedup", DISTINCT_MOVES)
def _(t):
    """Moves arrive by event time, a year a batch; keys leave the state 30 days after their event."""
    target = new_folder(t.spark, "dedup")
    stream = ingest.dedup_stream(read_lines(t, line_files(t, years=True), 1), MOVES, "moved_at", "30 days")
    query_ = (stream.writeStream.format("parquet").option("path", target)
              .option("checkpointLocation", new_folder(t.spark, "progress-dedup")).trigger(availableNow=True).start())
    query_.awaitTermination()
    return t.spark.read.parquet(target).select(*MOVES)


INSERTED = ("iteration int, transfer_id long, player_id long, from_club_id long, to_club_id long, from_club_name string, to_club_name string, "
            "transfer_date date, transfer_season string, transfer_fee double, source_id string, confidence_score double, fingerprint_hash string")


def repaired(t):
    return reconcile(t.sourced, t.candidates, t.players, t.clubs, max_iterations=ROUNDS, min_year=1995)


@query("stream_reconcile", " UNION ALL ".join(f"""
    SELECT {n} AS iteration, -candidate_id AS transfer_id, player_id, from_id AS from_club_id, to_id AS to_club_id, raw_from_name AS from_club_name,
           raw_to_name AS to_club_name, on_date AS transfer_date, season AS transfer_season, fee AS transfer_fee, source_id,
           score AS confidence_score, fingerprint_hash FROM inserts_{n}""" for n in range(1, ROUNDS + 1)))
def _(t):
    """Repair the ledger from the candidates until nothing changes; the rows that each iteration appended."""
    none = t.spark.createDataFrame([], INSERTED)
    parts = [rows.withColumn("iteration", F.lit(number)).select(*none.columns) for number, rows in repaired(t).added]
    return reduce(DataFrame.unionByName, parts, none)


@query("agg_convergence", " UNION ALL ".join(iteration_sql(n) for n in range(1, ROUNDS + 1)))
def _(t):
    """The three signals after each iteration of the repair loop: unpaired sales, inserts now and before, health."""
    return t.spark.createDataFrame(repaired(t).iterations, ITERATION)
