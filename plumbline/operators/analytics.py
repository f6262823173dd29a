"""Event analytics: counts, statistics, terms, ranges and date histograms."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import epoch_ms

MOST_TERMS = 1000
#: Estimated durations of calendar units in milliseconds (a month is a twelfth of 365.2425 days).
UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_629_746_000, "year": 31_556_952_000}
#: Trailing ranges of the availability roll-up.
TRAILING = {"1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month"}


def window_filter(df: DataFrame, ts: str, start: Any = None, end: Any = None, **equal: Any) -> DataFrame:
    """Rows with a time in [start, end] and the given equalities."""
    tests = [F.col(k) == v for k, v in equal.items()]
    tests += [F.col(ts) >= start] if start is not None else []
    tests += [F.col(ts) <= end] if end is not None else []
    return df.where(reduce(and_, tests)) if tests else df


def last(n: int, unit: str, end_ms: int) -> tuple[int, int]:
    """Fixed-duration range in milliseconds that ends at an instant."""
    return end_ms - n * UNIT_MS[unit], end_ms


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def stats(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """count, min, max, avg and sum of a column in one pass."""
    c = F.col(column)
    return df.groupBy(*(groups or [])).agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sum(c).alias("sum"))


def terms(df: DataFrame, column: str, by: Column | None = None, descending: bool = True, size: int = MOST_TERMS) -> DataFrame:
    """Most frequent values, or values ordered by an aggregate of another column; ties by value."""
    made = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), *([by.alias("metric")] if by is not None else []))
    order = F.col("n" if by is None else "metric")
    return made.orderBy(order.desc() if descending else order.asc(), column).limit(size)


def range_buckets(df: DataFrame, column: str, ranges: list[tuple[float, float]], inclusive: bool = False, value: Column | None = None) -> DataFrame:
    """Rows in each [from, to) (to inclusive for whole-number codes). Ranges may overlap; empty ones are kept.

    One pass: every range is a conditional aggregate of the same scan.
    """
    c = F.col(column)
    tests = [(c >= lo) & (c < (hi + 1 if inclusive else hi)) for lo, hi in ranges]
    made = [F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)] + [F.avg(F.when(t, value)).alias(f"v{i}") for i, t in enumerate(tests) if value is not None]
    one = df.agg(*made)
    fields = [F.struct(F.lit(float(lo)).alias("from"), F.lit(float(hi)).alias("to"), F.col(f"n{i}").alias("n"), *([F.col(f"v{i}").alias("avg")] if value is not None else [])) for i, (lo, hi) in enumerate(ranges)]
    return one.select(F.explode(F.array(*fields)).alias("r")).select("r.*")


def date_histogram(df: DataFrame, ts: str, width_ms: int, aggs: list[Column] | None = None, bounds: tuple[int, int] | None = None, groups: list[str] | None = None, before: int = 0) -> DataFrame:
    """Fixed-width buckets by their start in milliseconds; empty buckets of the range count 0.

    ``bounds`` extends the range, ``before`` starts it earlier by milliseconds;
    with ``groups`` every group gets every bucket.
    """
    groups = groups or []
    at = (F.floor(epoch_ms(F.col(ts)) / width_ms) * width_ms).cast("long")
    counted = df.where(F.col(ts).isNotNull()).groupBy(at.alias("bucket"), *groups).agg(F.count("*").alias("n"), *(aggs or []))
    ends = counted.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    if bounds is not None:
        lo, hi = (b // width_ms * width_ms for b in bounds)
        ends = ends.select(F.least("lo", F.lit(lo)).alias("lo"), F.greatest("hi", F.lit(hi)).alias("hi"))
    if before:
        ends = ends.withColumn("lo", F.col("lo") - F.lit(-(-before // width_ms) * width_ms))
    ends = ends.where("lo is not null")
    every = F.explode(F.sequence("lo", "hi", F.lit(width_ms).cast("long"))).alias("bucket")
    if not groups:
        return ends.select(every).join(counted, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # one row of ends beside each group; a null group is a group
    spine = counted.select(*groups).distinct().crossJoin(F.broadcast(ends)).select(every, *(F.col(g).alias(f"_{g}") for g in groups))
    same = reduce(and_, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups), spine["bucket"] == counted["bucket"])
    joined = spine.join(counted, same, "left")
    return joined.select(spine["bucket"], *(F.col(f"_{g}").alias(g) for g in groups), *(F.coalesce("n", F.lit(0)).alias("n") if c == "n" else F.col(c) for c in counted.columns if c not in ("bucket", *groups)))


def series_by(df: DataFrame, ts: str, width_ms: int, group: str, values: list[Any], remainder: str = "remainder") -> DataFrame:
    """group, bucket, n: a series for each of the given values of a key and one for all other rows, nulls included."""
    name = F.when(F.col(group).isin(*values), F.col(group).cast("string")).otherwise(remainder)
    return date_histogram(df.select(F.col(ts), name.alias("group")), ts, width_ms, groups=["group"])


def date_groups(df: DataFrame, ts: str) -> DataFrame:
    """day, n in order of days, rows without a time last."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n")).orderBy(F.col("day").asc_nulls_last())


def ratio(df: DataFrame, groups: list[str], part: Column, whole: Column) -> DataFrame:
    """groups, value, value2, ratio: rows of a filter, of another, and the second over the first (null for none)."""
    counts = df.groupBy(*groups).agg(F.count_if(whole).alias("value"), F.count_if(part).alias("value2"))
    return counts.withColumn("ratio", F.try_divide("value2", "value"))


def daily_counts(df: DataFrame, ts: str, failed: Column) -> DataFrame:
    """day, runs, failures."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count_if(~failed).alias("runs"), F.count_if(failed).alias("failures"))


def peak(df: DataFrame, groups: list[str], ts: str, value: str) -> DataFrame:
    """groups, peak_at, peak, last: the largest value, the first time it is reached, and the last time."""
    first = F.max_by(ts, F.struct(value, F.negative(F.unix_micros(F.col(ts).cast("timestamp")))))
    return df.groupBy(*groups).agg(first.alias("peak_at"), F.max(value).alias("peak"), F.max(ts).alias("last"))


def yearly(df: DataFrame, ts: str, value: str) -> DataFrame:
    """year, n and the mean of a number."""
    return df.groupBy(F.year(ts).cast("long").alias("year")).agg(F.count("*").alias("n"), F.avg(value).alias(value))


def in_months(df: DataFrame, ts: str, years: list[int], months: list[int]) -> DataFrame:
    """Rows of some months of some years; the range that encloses them is a filter of its own, which scans take."""
    if not years or not months:
        return df.limit(0)
    start, end = datetime(min(years), min(months), 1), datetime(max(years) + max(months) // 12, max(months) % 12 + 1, 1)
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)) & F.year(ts).isin(*years) & F.month(ts).isin(*months))


def rated(df: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """key, n, mean, last in order of the mean, the count and the last time, largest first."""
    rows = df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(ts).alias("last"))
    return rows.orderBy(F.desc("mean"), F.desc("n"), F.desc("last"), key)


def trailing_ranges(df: DataFrame, ts: str, now_ms: int | None, groups: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates of each group over trailing ranges up to an instant (default: the last time); a row joins every range that holds it."""
    if now_ms is None:
        df = df.crossJoin(F.broadcast(df.agg(F.max(epoch_ms(F.col(ts))).alias("_now"))))
    age = (F.col("_now") if now_ms is None else F.lit(now_ms)) - epoch_ms(F.col(ts))
    held = F.array_compact(F.array(*(F.when((age >= 0) & (age <= UNIT_MS[u]), F.lit(k)) for k, u in TRAILING.items())))
    return df.where(age <= max(UNIT_MS[u] for u in TRAILING.values())).withColumn("range", F.explode(held)).groupBy(*groups, "range").agg(*aggs)


def month_counts(df: DataFrame, column: str) -> DataFrame:
    """month (year-month, month not padded) and n, with empty months between the first and the last."""
    months = df.where(F.col(column).isNotNull()).groupBy(F.trunc(column, "month").alias("m")).agg(F.count("*").alias("n"))
    ends = months.agg(F.min("m").alias("lo"), F.max("m").alias("hi")).where("lo is not null")
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m"))
    return spine.join(months, "m", "left").select(F.concat_ws("-", F.year("m"), F.month("m")).alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def rollup_counts(df: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of each level of a hierarchy; deeper levels are null in a roll-up row, ``depth`` says how many are set."""
    full = 2 ** len(levels) - 1
    depth = F.lit(len(levels)) - F.bit_count(F.grouping_id().bitwiseAND(F.lit(full)))
    return df.rollup(*levels).agg(F.count("*").alias("n"), depth.cast("int").alias("depth"))


def word_counts(df: DataFrame, column: str, size: int) -> DataFrame:
    """Most frequent lower-cased words and the natural logarithm of their counts."""
    word = df.select(F.explode(F.split(F.lower(column), r"\s+")).alias("word")).where("word <> ''")
    return word.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(size).withColumn("ln", F.log("n"))
