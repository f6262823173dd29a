"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that carries whole texts; Spark bounds its bytes as well.
TEXT_BATCH = 1_000
#: Rows that an explicit broadcast may hold; callers count before they broadcast.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A session without that setting (a local shell) gets a folder in its SQL
    warehouse, which driver and executors share as well.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/plumbline-scratch"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a wide intermediate table to the shared folder and read it back.

    Parquet, so that later steps read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Remove the files of a table from ``stored`` once all that was made of it is written or checkpointed itself."""
    folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
    spark = table.sparkSession
    for folder in (x for x in folders if x.rsplit("/", 1)[1].startswith("plumbline-")):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_text_batches(df: DataFrame) -> DataFrame:
    """Hand whole texts to Python in small batches, for the memory of executors and their workers.

    Lowers ``spark.sql.execution.arrow.maxRecordsPerBatch`` of the session to
    ``TEXT_BATCH`` where it is higher or unbounded, and leaves a lower setting alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > TEXT_BATCH:
        df.sparkSession.conf.set(key, str(TEXT_BATCH))
    return df


def id_text(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).cast("string")


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(id_text(doc_id).cast("binary")) % F.lit(folds)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows stay under the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def labelled_ids(
    labels: DataFrame, label: str, held_out_remainder: int, folds: int, bound: int, doc_id: str = "doc_id"
) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold.

    The sample is the rows with the smallest hash of the id, so that it is the
    same in every run and however the table is partitioned. An id labelled more
    than once keeps its smallest label.
    """
    return (
        labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
        .where(fold("doc_id", folds) != held_out_remainder)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
