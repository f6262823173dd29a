"""Message sampling, rate windows and dead-letter routing, for tables and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.scalars import epoch_ms
from plumbline.plans.ranking import sliced_lag, sliced_place

#: Defaults and bounds of the samplers.
COUNT_DEFAULT, COUNT_LEAST = 100, 10
PERIOD_DEFAULT_MS, PERIOD_LEAST_MS = 10_000, 1_000
SHARE_DEFAULT, SHARE_MOST = 0.01, 0.5


def sample_every(df: DataFrame, key: str, ts: str, n: int = COUNT_DEFAULT, error: Column | None = None) -> DataFrame:
    """The first and then every n-th message of each key; errors always. A key is ordered in slices of time."""
    n = max(n, COUNT_LEAST)
    keep = F.col("_place") % n == 1
    placed = sliced_place(df, key, ts, [c for c in df.columns if c not in (key, ts)], "_place")
    return placed.where(keep if error is None else keep | error).drop("_place")


def sample_periods(df: DataFrame, key: str, ts: str, period_ms: int = PERIOD_DEFAULT_MS) -> DataFrame:
    """The first message of each key and those that come at least a period after the message seen before, in slices of time."""
    period_ms = max(period_ms, PERIOD_LEAST_MS)
    at = epoch_ms(F.col(ts))
    seen = sliced_lag(df, key, ts, [c for c in df.columns if c not in (key, ts)], "_seen_at")
    before = epoch_ms(F.col("_seen_at"))
    return seen.where(before.isNull() | (at - before >= period_ms)).drop("_seen_at")


def sample_share(df: DataFrame, id_column: str, share: float = SHARE_DEFAULT, key: str | None = None, ts: str | None = None) -> DataFrame:
    """A share of the messages by a hash of the id, the same in every run; with ``key`` and ``ts`` the first message of each key always.

    The first message is an aggregate of each key, so a hot key is not sorted.
    """
    share = min(share, SHARE_MOST)
    drawn = F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(share * 1_000_000)
    if key is None or ts is None:
        return df.where(drawn)
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(id_column, F.struct(ts, id_column)).alias("_first"))
    return df.join(first, df[key].eqNullSafe(first["_key"])).where(drawn | (F.col(id_column) == F.col("_first"))).drop("_key", "_first")


def stream_sample_every(stream: DataFrame, key: str, n: int = COUNT_DEFAULT) -> DataFrame:
    """``sample_every`` on a stream, in order of arrival; the count of a key is its state."""
    n = max(n, COUNT_LEAST)

    def keep(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            places = range(seen + 1, seen + len(pdf) + 1)
            seen += len(pdf)
            yield pdf[[p % n == 1 for p in places]]
        state.update((seen,))

    return stream.groupBy(key).applyInPandasWithState(keep, stream.schema, "seen long", "append", GroupStateTimeout.NoTimeout)


def stream_histogram(stream: DataFrame, ts: str, width: str, late: str, groups: list[str]) -> DataFrame:
    """Counts of event-time windows; a window closes once the watermark passes it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *groups).agg(F.count("*").alias("n"))


def rate_windows(df: DataFrame, key: str, ts: str, width_s: int, weight: Column, limit: int) -> DataFrame:
    """Per key and fixed window: the weight used, the limit, the reset time in seconds and whether it is exceeded."""
    start = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / width_s) * width_s
    used = df.groupBy(key, start.cast("long").alias("window_start")).agg(F.sum(weight).alias("used"))
    return used.select("*", F.lit(limit).alias("limit"), (F.col("window_start") + width_s).alias("reset"), (F.col("used") > limit).alias("exceeded"))


def stream_rate_windows(stream: DataFrame, key: str, ts: str, width_s: int, weight: str, limit: int) -> DataFrame:
    """For each message of a stream, in order of arrival: the weight used in its key's window, the limit, the reset and whether it is exceeded.

    A key's first message opens a window, which ends at its reset; the next
    message opens another. The state of a key is its window's start and weight.
    """

    def count(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        for pdf in batches:
            rows = []
            for at, w in zip(pdf[ts], pdf[weight], strict=True):
                second = int(at.timestamp())
                if start is None or second >= start + width_s:
                    start, used = second, 0
                used += int(w)
                rows.append((*group, at, start, used, limit, start + width_s, used > limit))
            yield pd.DataFrame(rows, columns=[key, ts, "window_start", "used", "limit", "reset", "exceeded"])
        state.update((start, used))

    kinds = dict(stream.dtypes)
    shape = f"{key} {kinds[key]}, {ts} {kinds[ts]}, window_start long, used long, limit long, reset long, exceeded boolean"
    return stream.select(key, ts, weight).groupBy(key).applyInPandasWithState(count, shape, "start long, used long", "append", GroupStateTimeout.NoTimeout)


def route_errors(stream: DataFrame, error: Column, good, bad):
    """A streaming query that hands each micro-batch's failed rows to ``bad`` and the rest to ``good`` (functions of a DataFrame)."""

    def split(df: DataFrame, _: int) -> None:
        df = df.persist()
        bad(df.where(error))
        good(df.where(~F.coalesce(error, F.lit(False))))
        df.unpersist()

    return stream.writeStream.foreachBatch(split)


def consumer_lag(offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: total lag, and the largest with its partition (the first of equals). Columns: partition, committed, log_end."""
    lag = F.greatest(F.lit(0), F.col("log_end") - F.col("committed"))
    return offsets.withColumn("lag", lag).groupBy(*keys).agg(
        F.sum("lag").alias("total_lag"), F.max("lag").alias("max_lag"), F.max_by("partition", F.struct("lag", F.negative("partition"))).alias("max_partition")
    )


def signed_statistics(df: DataFrame, keys: list[str], value: str, sign: str) -> DataFrame:
    """Sums and counts in which retracted rows (sign -1) subtract."""
    return df.groupBy(*keys).agg(F.sum(F.col(value) * F.col(sign)).alias("sum"), F.sum(sign).alias("n")).where("n <> 0")
