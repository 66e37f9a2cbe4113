"""Session helpers: reliable lineage cuts and bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one named by ``spark.checkpoint.dir``, or one
    below the warehouse where none is set."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    return spark.conf.get("spark.checkpoint.dir", f"{warehouse}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and read it back.

    Used where a plan must see one fixed row order (a sort boundary, a random draw) twice.
    The folder is the one named by ``spark.checkpoint.dir``; where none is set, one below the
    warehouse, which driver and executors share too.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain scan at least one partition per core. Only a small input has fewer
    splits than that; a large one is returned as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for work whose cost is not in its bytes, so that it is not coalesced."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(rows_df: DataFrame, limit: int) -> list | None:
    """Collect at most ``limit`` rows; ``None`` when the table is larger than that."""
    rows = rows_df.limit(limit + 1).collect()
    return None if len(rows) > limit else rows


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A driver-built state table; its size was checked by whoever collected ``rows``."""
    return F.broadcast(spark.createDataFrame(rows, schema))
