"""Tables that are used more than once, in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table that a broadcast may hold; callers count before they broadcast.
BROADCAST_ROWS = 100_000


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of a table, written once and read again wherever they are used.

    They go to ``spark.checkpoint.dir``; a session without that setting (a local
    shell) gets a folder in its SQL warehouse.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/plumbline-scratch")
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast for a side of few counted rows, else a join by sorting, whatever the planner estimates."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")
