"""Session helpers: the shared scratch folder and a fixed row layout for fits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local session without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/") if known else tempfile.mkdtemp(prefix="traitsieve-")


MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, rows_at_most: int) -> DataFrame:
    """Broadcast a side whose row count is known to be small; else let Spark choose."""
    return F.broadcast(df) if rows_at_most <= MAX_BROADCAST_ROWS else df


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def with_checkpoints(spark: SparkSession) -> None:
    """Give the session its checkpoint folder, unless it has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, whose size Spark knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Partitions of a fit's rows: of NUMBERS_PER_TASK up to so many, which then grow to NUMBERS_MOST before there are more.
FIT_TASKS = 12
NUMBERS_PER_TASK = 1_000_000
NUMBERS_MOST = 16_000_000


def fit_tasks(numbers: int) -> int:
    """Every task of a tree fit hands on statistics of all nodes at hand, which may be much more than its rows."""
    return max(2, min(-(-numbers // NUMBERS_PER_TASK), FIT_TASKS), -(-numbers // NUMBERS_MOST))


def stable_layout(df: DataFrame, rows: int, width: int, key: str = "row_id") -> DataFrame:
    """Fixed partitioning and order for seeded fits, cached for their many passes.

    Seeded tree fits draw per partition, so equal rows must meet in equal
    partitions: rows go by the hash of their key into partitions whose number
    follows the table's size, not the input files.  Tree fits cut the lineage of
    their node ids by checkpoints.
    """
    with_checkpoints(df.sparkSession)
    laid_out = df.repartition(fit_tasks(rows * width), key)
    return laid_out.sortWithinPartitions(key).persist(StorageLevel.MEMORY_AND_DISK)
