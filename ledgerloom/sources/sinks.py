"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators.sets import latest_per_key
from ledgerloom.session import checkpointed, drop_table

#: The partition column of tables that are merged into.
BUCKET = "_bucket"


def rewrite(rows: DataFrame, path: str) -> None:
    """Replace the whole table."""
    rows.write.mode("overwrite").parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions present in ``rows``; the others stay."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace as a new table: an incoming row replaces the stored one."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(incoming.withColumn("_load", F.lit(1)))
    rest: list[Column] = [F.col(c) for c in existing.columns if c not in keys]
    return latest_per_key(both, keys, F.struct("_load", *rest)).drop("_load")


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    """A table that ``merge_buckets`` can merge into: dealt by key into ``buckets`` folders, each of which should fit a task."""
    _bucketed(rows, keys, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def merge_buckets(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], buckets: int) -> None:
    """Insert-or-replace into a stored table, rewriting only the buckets that ``incoming`` touches.

    ``keys`` and ``buckets`` are those the table was written with. The merged buckets are complete in
    the shared folder before the table is overwritten, so a lost executor never reads half a bucket.
    """
    new = checkpointed(_bucketed(incoming, keys, buckets), "merge-incoming")
    touched = [row[0] for row in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if touched:
        old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
        merged = checkpointed(upsert(old, new.select(*old.columns), [*keys, BUCKET]), "merged-buckets")
        replace_partitions(merged.repartition(BUCKET), path, BUCKET)
        drop_table(merged)
    drop_table(new)


def write_features(features: DataFrame, path: str, targets: list[str], as_csv: bool = False) -> None:
    """Targets first, then the features."""
    ordered = features.select(*targets, *[c for c in features.columns if c not in targets])
    writer = ordered.write.mode("overwrite")
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)
