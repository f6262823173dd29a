"""Global order numbers and running totals without a single-partition window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over all rows up to each one in a global order.

    Rows are range-partitioned in the order; each partition sums its own rows
    and adds the totals of the partitions before it, which are one number for
    each. ``order`` should be total. For groups, aggregate first.
    """
    placed = df.select("*", value.alias("_value")).repartitionByRange(*order).select("*", F.spark_partition_id().alias("_part")).persist()
    totals = placed.groupBy("_part").agg(F.sum("_value").alias("t")).orderBy("_part").collect()
    before = dict(zip([r._part for r in totals], [0, *accumulate(r.t for r in totals)], strict=False))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("_part")) if before else F.lit(0)
    return placed.withColumn(name, F.sum("_value").over(within) + offset).drop("_part", "_value")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add 1, 2, ... in a global order."""
    return running_total(df, order, F.lit(1), name)


#: Seconds of a slice: a key's rows are ordered a slice at a time, in different tasks.
SLICE_S = 7 * 86400


def _sliced(df: DataFrame, key: str, ts: str, order: list[str], seconds: float) -> tuple[DataFrame, Window, Window]:
    rows = df.withColumn("_slice", F.floor(F.col(ts).cast("timestamp").cast("double") / seconds))
    return rows, Window.partitionBy(key, "_slice").orderBy(ts, *order), Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def _beside(rows: DataFrame, per_slice: DataFrame, key: str) -> DataFrame:
    """Rows with their slice's values; null keys and times match as well."""
    slices = per_slice.select(F.col(key).alias("_key"), F.col("_slice").alias("_at"), "_carried")
    return rows.join(slices, rows[key].eqNullSafe(slices["_key"]) & rows["_slice"].eqNullSafe(slices["_at"])).drop("_key", "_at", "_slice")


def sliced_place(df: DataFrame, key: str, ts: str, order: list[str], name: str, seconds: float = SLICE_S) -> DataFrame:
    """Add each row's place (1, 2, ...) in its key's time order; no key is ordered in one task."""
    rows, inside, before = _sliced(df, key, ts, order, seconds)
    counts = rows.groupBy(key, "_slice").agg(F.count("*").alias("_n")).select(key, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    return _beside(rows.withColumn(name, F.row_number().over(inside)), counts, key).withColumn(name, F.col(name) + F.col("_carried")).drop("_carried")


def sliced_lag(df: DataFrame, key: str, ts: str, order: list[str], name: str, seconds: float = SLICE_S, value: Column | None = None) -> DataFrame:
    """Add the time of the row before in each key's time order, or its ``value``; no key is ordered in one task."""
    value = F.col(ts) if value is None else value
    rows, inside, before = _sliced(df.withColumn("_value", F.struct(value.alias("v"))), key, ts, order, seconds)
    newest = F.max_by("_value", F.struct(ts, *order))
    ends = rows.groupBy(key, "_slice").agg(newest.alias("_end")).select(key, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    first = F.row_number().over(inside) == 1
    lagged = rows.withColumns({name: F.lag("_value").over(inside), "_first": first})
    return _beside(lagged, ends, key).withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name))["v"]).drop("_carried", "_first", "_value")
