"""Input tables, and intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.session import checkpointed as stored  # noqa: F401  written under spark.checkpoint.dir and read again


BATCH_BYTES = 8 << 20


def small_batches(rows: DataFrame) -> DataFrame:
    """The same rows; Python tasks of their session get them in Arrow batches of at most ``BATCH_BYTES``, so long texts take no more memory."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
