"""Nested documents: unwinding, conditional counts, flags and cross tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unwind(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row for each element of an array; rows without any stay only if asked."""
    f = F.explode_outer if keep_empty else F.explode
    return df.withColumn(column, f(column))


def counts_by_value(df: DataFrame, groups: list[str], column: str, values: list) -> DataFrame:
    """How many rows of each group have each value, as a column a value."""
    return df.groupBy(*groups).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}".lower()) for v in values))


def flag(test: Column, *preconditions: Column) -> Column:
    """A flag of three values: null unless every precondition holds."""
    return F.when(reduce(and_, preconditions, F.lit(True)), test)


def cross_table(df: DataFrame, given: str, flags: list[str]) -> DataFrame:
    """Of the rows with one flag, how many have each other flag: a single pass."""
    return df.where(F.col(given)).agg(*(F.count_if(F.col(f)).alias(f) for f in flags))


def flag_matrix(df: DataFrame, flags: list[str]) -> DataFrame:
    """flag, other, n for every pair of flags, in one pass."""
    made = [F.count_if(F.col(a) & F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(flags) for j, b in enumerate(flags)]
    cells = [F.struct(F.lit(a).alias("flag"), F.lit(b).alias("other"), F.col(f"{i}_{j}").alias("n")) for i, a in enumerate(flags) for j, b in enumerate(flags)]
    return df.agg(*made).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def any_pair(left: str, right: str, test) -> Column:
    """Some element of one array and some of another satisfy a test, within the row."""
    return F.exists(left, lambda a: F.exists(right, lambda b: test(a, b)))


def ordered_arrays(df: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """For each key its values in time order, an array a column."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(at, *columns))).alias("_rows"))
    return rows.select(key, *(F.col(f"_rows.{c}").alias(c) for c in [at, *columns]))
