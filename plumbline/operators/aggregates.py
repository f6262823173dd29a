"""Summary functions and grouped summaries."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _circular(angle: Column) -> Column:
    """Circular mean of angles in radians, in [0, 2 pi)."""
    mean = F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))
    return F.when(mean < 0, mean + 2 * pi).otherwise(mean)


def peak_time(c: Column) -> Column:
    """Circular mean of the time of day, as HH:mm:ss; hours are the session's, and so is the mean."""
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    at = F.round(_circular(seconds * (2 * pi / 86400)) * (86400 / (2 * pi))).cast("long") % 86400
    return F.format_string("%02d:%02d:%02d", F.floor(at / 3600), F.floor(at / 60) % 60, at % 60)


def peak_month(c: Column) -> Column:
    """Circular mean of the month, 1 to 12."""
    at = F.round(_circular((F.month(c) - 1) * (2 * pi / 12)) * (12 / (2 * pi))).cast("int") % 12
    return at + 1


def mean_vector(values: Column, size: int) -> Column:
    """Element-wise mean of arrays of a known size, as one aggregate an element."""
    return F.array(*(F.avg(values[i].cast("double")) for i in range(size)))


#: Median and mode pick an existing value where a type has no arithmetic; ties of the mode go to the smallest value.
SUMMARIES: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "mode": lambda c: F.mode(c, True),
    "percentage_true": lambda c: 100.0 * F.count_if(c) / F.count(c),
    "distinct_aggregate_to_array": lambda c: F.array_sort(F.collect_set(c)),
    "peak_time": peak_time,
    "peak_month": peak_month,
}


def counted_mode(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """The most frequent value of each group, ties to the smallest, from value counts: no group's values meet in one buffer."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_n"))
    return counts.groupBy(*groups).agg(F.min_by(column, F.struct(F.negative("_n"), column)).alias(name))


def counted_median(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """The median of numbers (mean of the two middle ones) from value counts: a group with a third of all rows is its distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups)
    reached = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy(column))).withColumn("_all", F.sum("_n").over(whole))
    lower, upper = (F.min(F.when(F.col("_upto") >= F.floor((F.col("_all") + k) / 2), F.col(column))) for k in (1, 2))
    return reached.groupBy(*groups).agg(((lower.cast("double") + upper.cast("double")) / 2).alias(name))


def ordinal_median(df: DataFrame, groups: list[str], column: str, name: str) -> DataFrame:
    """Lower median of any ordered type: the value where half of the group's rows are reached, from value counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*groups, column).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*groups).orderBy(column)
    reached = counts.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*groups)))
    return reached.where(2 * F.col("_upto") >= F.col("_all")).groupBy(*groups).agg(F.min(column).alias(name))


def summarize(df: DataFrame, groups: list[str], aggregations: list[dict[str, str]]) -> DataFrame:
    """``aggregations``: function, column, alias. Without any, each group's row count as ``count``."""
    made = [SUMMARIES[a["function"]](F.col(a["column"])).alias(a["alias"]) for a in aggregations]
    return df.groupBy(*groups).agg(*(made or [F.count("*").alias("count")]))


def share_percent(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """column, n (or ``name``), percent of all rows with a value, rounded half up."""
    counts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(column, F.col("_n").alias(name), F.floor(100 * F.col("_n") / F.col("_all") + 0.5).cast("long").alias("percent"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def outcome(success: Column, unknown: Column) -> Column:
    """Roll-up of three states: any success, else any unknown, else failure."""
    return F.when(success > 0, "success").when(unknown > 0, "in progress").otherwise("failed")
