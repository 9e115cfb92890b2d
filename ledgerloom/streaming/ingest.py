"""Incremental loading as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerloom.operators.sets import new_rows

LOAD = "load_id"


def read_target(spark: SparkSession, path: str, schema: StructType, by_month: bool = False) -> DataFrame:
    """What is loaded so far; empty before the first load."""
    months = [StructField(MONTH, StringType(), True)] if by_month else []
    stored = StructType([*schema.fields, StructField(LOAD, LongType(), True), *months])
    try:
        return spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


MONTH, UNDATED = "month", "undated"


def append_new(target: str, keys: list[str], day: str | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds only unseen keys.

    Each batch owns one ``load_id`` partition and overwrites it, and compares itself with
    the other partitions only. So a batch run again after a failure writes the same rows.
    With ``day`` (one of ``keys``), loads are split by month, and a batch reads only the months
    it holds.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        existing = read_target(batch.sparkSession, target, batch.schema, day is not None)
        if LOAD in existing.columns:
            existing = existing.filter(F.col(LOAD) != batch_id)
        if day is not None:
            batch = batch.withColumn(MONTH, F.coalesce(F.date_format(day, "yyyy-MM"), F.lit(UNDATED))).persist()
            if MONTH in existing.columns:  # at most as many months as the calendar has
                months = [r[0] for r in batch.select(MONTH).distinct().collect()]
                existing = existing.filter(F.col(MONTH).isin(months))
        fresh = new_rows(batch, existing.select(*columns), keys)
        if day is not None:  # one task, or a few for a large month, writes a month: files don't grow with tasks times months
            fresh = fresh.hint("rebalance", MONTH)
        writer = fresh.write.mode("overwrite")
        (writer.partitionBy(MONTH) if day is not None else writer).parquet(f"{target}/{LOAD}={batch_id}")
        batch.unpersist()

    return write


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], day: str | None = None) -> StreamingQuery:
    """Load everything available, adding only rows whose key is not there yet."""
    return (
        stream.writeStream.foreachBatch(append_new(target, keys, day))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_files(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
               files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "30 days") -> DataFrame:
    """The same keys with bounded state: repeats within ``delay`` drop, older state expires.

    Repeats that arrive later still meet the anti-join of ``ingest``.
    """
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
