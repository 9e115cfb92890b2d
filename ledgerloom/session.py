"""Session helpers: a local session for tests, and the shared work folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Rows of the largest table for each shuffle partition that a query starts with.
ROWS_PER_PARTITION = 250_000
START_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, rows: int) -> None:
    """Start shuffles with partitions in proportion to the rows, so that a task's share, and what it holds, doesn't grow with the table.

    The number is only ever raised. The adaptive planner merges small partitions, but splits none that is joined or windowed.
    """
    wanted = -(-rows // ROWS_PER_PARTITION)
    if wanted > int(spark.conf.get(START_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(START_PARTITIONS, str(wanted))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting uses a folder under its warehouse; a cluster without
    it is an error, because no executor could read another machine's disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, so retried jobs never meet old files."""
    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df, name: str):
    """Write ``df`` under the shared folder and read it back, cutting its lineage."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df) -> None:
    """Delete the files of a frame that ``checkpointed`` gave; the caller owns it and is done with it."""
    spark = df.sparkSession
    mine = own_folder(spark).split(":", 1)[-1].lstrip("/")
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in folders:
        if mine in folder:
            _delete(spark, folder)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, when its jobs are done."""
    _delete(spark, own_folder(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
