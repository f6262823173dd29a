"""Samplers and statistics with keyed state: in order of event time, with timers, and with retractions.

These streams need ``spark.sql.streaming.stateStore.providerClass`` set to
RocksDB's provider (``ROCKSDB``). Offsets and state come back together from the
query's checkpoint, so a restart neither repeats nor loses a row of state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import isnan

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from plumbline.functions.scalars import epoch_ms
from plumbline.plans.storage import checkpointed
from plumbline.streaming.sampling import PERIOD_DEFAULT_MS, PERIOD_LEAST_MS, SHARE_DEFAULT, SHARE_MOST

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Entries of a block of an ordered multiset; fuller ones are split.
BLOCK = 256
#: Seconds of a slice of a key's time.
SLICE_S = 86_400


# recorded periods, on a table ---------------------------------------------


def _after(at: np.ndarray, period: int) -> np.ndarray:
    """For each of some sorted times the first that is a period later (their number if there is none)."""
    return np.searchsorted(at, at + period)


def _ends(at: np.ndarray, period: int) -> np.ndarray:
    """For each time the last one recorded if it is recorded itself: pointers doubled until none moves."""
    n = len(at)
    last, step = np.arange(n), _after(at, period)
    while (moves := np.flatnonzero(step < n)).size:
        to = step[moves]
        last[moves], step[moves] = last[to], step[to]
    return last


def _picked(at: np.ndarray, period: int, first: int) -> np.ndarray:
    """Places recorded from ``first`` on."""
    step, out = _after(at, period).tolist(), []
    while first < len(step):
        out.append(first)
        first = step[first]
    return np.array(out, np.int64)


def sample_recorded(df: DataFrame, key: str, ts: str, tie: str, period_ms: int = PERIOD_DEFAULT_MS, error: Column | None = None, slice_s: int = SLICE_S) -> DataFrame:
    """The first message of each key and then each that comes at least a period after the last recorded one; errors always.

    What is recorded depends on all messages before, yet no key is one task's. A
    key's time is cut into slices. Only messages of a slice's first period (and
    the first after it) can be the first recorded there; for each of these the
    slice tells which message is recorded last. A key's slices are chained over
    these few entries, then each slice picks its messages from its known
    beginning. Of messages at one time the one with the smallest ``tie`` comes
    first; messages without a time are only kept as errors, and errors do not
    move the period.
    """
    period = max(period_ms, PERIOD_LEAST_MS)
    slice_ms = max(slice_s * 1000, period)
    marked = df.withColumns({"_at": epoch_ms(F.col(ts)), "_error": F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)})
    marked = marked.withColumn("_slice", F.floor(F.col("_at") / slice_ms))

    @F.pandas_udf("firsts array<long>, lasts array<long>")
    def entries(times: pd.Series) -> pd.DataFrame:
        firsts, lasts = [], []
        for at in times:
            at = np.asarray(at, np.int64)
            firsts.append(at[: int(np.searchsorted(at, at[0] + period)) + 1])
            lasts.append(at[_ends(at, period)[: len(firsts[-1])]])
        return pd.DataFrame({"firsts": firsts, "lasts": lasts})

    @F.pandas_udf("array<long>")
    def chained(firsts: pd.Series, lasts: pd.Series) -> pd.Series:
        out = []
        for begins, ends in zip(firsts, lasts, strict=True):
            last, since = None, []
            for begin, end in zip(begins, ends, strict=True):
                since.append(last)
                i = 0 if last is None else int(np.searchsorted(begin, last + period))
                if i < len(begin):
                    last = int(end[i])
            out.append(since)
        return pd.Series(out)

    @F.pandas_udf("array<long>")
    def recorded(times: pd.Series, since: pd.Series) -> pd.Series:
        out = []
        for at, last in zip(times, since, strict=True):
            at = np.asarray(at, np.int64)
            out.append(at[_picked(at, period, 0 if pd.isna(last) else int(np.searchsorted(at, int(last) + period)))])
        return pd.Series(out)

    timed = marked.where(F.col("_at").isNotNull()).select(F.col(key).alias("_key"), "_slice", "_at")
    slices = timed.groupBy("_key", "_slice").agg(F.sort_array(F.collect_set("_at")).alias("_times"))
    slices = checkpointed(slices.withColumn("_heads", entries("_times")))
    line = slices.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_slice", "_heads.firsts", "_heads.lasts"))).alias("_line"))
    since = line.select(F.col("_key").alias("_of"), F.explode(F.arrays_zip(F.col("_line._slice").alias("at"), chained("_line.firsts", "_line.lasts").alias("since"))).alias("_s"))
    known = slices.join(since, slices["_key"].eqNullSafe(since["_of"]) & (slices["_slice"] == F.col("_s.at")))
    picked = known.select("_key", F.explode(recorded("_times", F.col("_s.since"))).alias("_picked"))
    # of messages at one time the first by the tie
    place = F.row_number().over(Window.partitionBy(key, "_at").orderBy(F.col(tie).asc_nulls_last()))
    rows = marked.withColumn("_place", place)
    found = rows.join(picked, rows[key].eqNullSafe(picked["_key"]) & (rows["_at"] == picked["_picked"]), "left")
    return found.where((F.col("_picked").isNotNull() & (F.col("_place") == 1)) | F.col("_error")).select(*df.columns)


# streams in order of event time -------------------------------------------


class _InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed their time, and decides on them in order of time and tie."""

    def __init__(self, schema: T.StructType, ts: str, tie: str, state: str) -> None:
        self.schema, self.ts, self.tie, self.state_schema = schema, ts, tie, state

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in pdf.itertuples(index=False, name=None)]  # by place: some names change on the way here
        place = self.schema.names.index(self.ts)
        new = [tuple(None if x is pd.NaT else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if isinstance(x, np.generic) else x for x in r) for r in new]
        new = [r for r in new if r[place] is not None]
        if new:
            self.held.appendList(new)
            self.handle.registerTimer(max(min(_millis(r[place]) for r in new), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        place, tie = self.schema.names.index(self.ts), self.schema.names.index(self.tie)
        rows = [tuple(r) for r in self.held.get()]
        due = sorted((r for r in rows if _millis(r[place]) <= now), key=lambda r: (r[place], r[tie]))
        later = [r for r in rows if _millis(r[place]) > now]
        self.held.clear()
        if later:
            self.held.put(later)
            self.handle.registerTimer(min(_millis(r[place]) for r in later))
        kept = self.decide(due, place, now, bool(later))
        if kept:
            yield pd.DataFrame(kept, columns=self.schema.names)

    def decide(self, due: list[tuple], place: int, now: int, more: bool) -> list[tuple]:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _millis(at) -> int:
    stamp = pd.Timestamp(at)
    return (stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp).value // 1_000_000


def _nearest_millis(at) -> int:
    """As ``epoch_ms`` of a table."""
    stamp = pd.Timestamp(at)
    micros = (stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp).value // 1000
    return (micros + 500) // 1000 if micros >= 0 else -((500 - micros) // 1000)


class _Periods(_InOrder):
    def __init__(self, schema: T.StructType, ts: str, tie: str, period: int, error: str | None) -> None:
        super().__init__(schema, ts, tie, "last long")
        self.period, self.error = period, schema.names.index(error) if error else None

    def decide(self, due, place, now, more):
        last = self.state.get()[0] if self.state.exists() else None
        out = []
        for r in due:
            at = _nearest_millis(r[place])
            if last is None or at - last >= self.period:
                last = at
                out.append(r)
            elif self.error is not None and r[self.error]:
                out.append(r)
        if last is not None and last + self.period <= now and not more:
            self.state.clear()  # whatever comes is recorded anyway
        elif last is not None:
            self.state.update((last,))
            self.handle.registerTimer(max(last + self.period, now + 1))
        return out


class _Share(_InOrder):
    def __init__(self, schema: T.StructType, ts: str, tie: str, drawn: str, error: str | None, ttl_ms: int | None) -> None:
        super().__init__(schema, ts, tie, "seen boolean")
        self.drawn, self.error, self.ttl_ms = schema.names.index(drawn), schema.names.index(error) if error else None, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.state = handle.getValueState("state", self.state_schema, self.ttl_ms)

    def decide(self, due, place, now, more):
        seen = self.state.exists()
        out = [r for i, r in enumerate(due) if (i == 0 and not seen) or r[self.drawn] or (self.error is not None and r[self.error])]
        if due:
            self.state.update((True,))
        return out


def _in_order(stream: DataFrame, key: str, ts: str, late: str, extra: dict[str, Column], make) -> DataFrame:
    """Run a processor over the rows with some more columns, which the result lacks."""
    rows = stream.withColumns(extra).withWatermark(ts, late)
    made = rows.groupBy(key).transformWithStateInPandas(make(rows.schema), rows.schema, "Append", "EventTime")
    return made.select(*stream.columns)


def stream_sample_recorded(stream: DataFrame, key: str, ts: str, tie: str, period_ms: int = PERIOD_DEFAULT_MS, late: str = "1 minute", error: Column | None = None) -> DataFrame:
    """``sample_recorded`` on a stream: rows wait for the watermark, so late ones take their place in time.

    Rows behind the watermark are dropped. A key's last time is its state until
    a period has passed on the watermark; after that it decides nothing.
    """
    period = max(period_ms, PERIOD_LEAST_MS)
    extra = {"_error": F.coalesce(error, F.lit(False))} if error is not None else {}
    return _in_order(stream, key, ts, late, extra, lambda schema: _Periods(schema, ts, tie, period, "_error" if extra else None))


def stream_sample_share(stream: DataFrame, key: str, ts: str, id_column: str, share: float = SHARE_DEFAULT, late: str = "1 minute", error: Column | None = None, ttl_ms: int | None = None) -> DataFrame:
    """``sample_share`` on a stream: the first message of each key in event time, then a share by a hash of the id.

    That a key was seen is its state, for ``ttl_ms`` of processing time after its
    last message if given; then its next message is a first one again.
    """
    extra = {"_drawn": F.pmod(F.xxhash64(id_column), F.lit(1_000_000)) < int(min(share, SHARE_MOST) * 1_000_000)}
    if error is not None:
        extra["_error"] = F.coalesce(error, F.lit(False))
    return _in_order(stream, key, ts, late, extra, lambda schema: _Share(schema, ts, id_column, "_drawn", "_error" if error is not None else None, ttl_ms))


# signed statistics ----------------------------------------------------------


def signed_extremes(df: DataFrame, keys: list[str], value: str, sign: str) -> DataFrame:
    """keys, n, sum, mean, min, max of what is left after retractions (sign -1); equal values cancel before anything else is computed.

    Keys of which nothing is left have no row. Null values take no part.
    """
    left = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(sign).alias("_n")).where("_n > 0")
    out = left.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.col(value) * F.col("_n")).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(*keys, "n", "sum", (F.col("sum") / F.col("n")).alias("mean"), "min", "max")


class Multiset:
    """An ordered multiset in blocks: ``firsts`` (the least value of each block) and ``names`` tell where a value is.

    ``load``, ``save`` and ``drop`` handle blocks, which are lists of values and of
    counts. Counts may be negative while a retraction is ahead of its row.
    """

    def __init__(self, firsts: list[float], names: list[int], load, save, drop) -> None:
        self.firsts, self.names, self.load, self.save, self.drop = firsts, names, load, save, drop

    def add(self, value: float, by: int) -> int:
        """Change a value's count; returns by how much the positive counts change."""
        if not self.names:
            self.firsts, self.names = [value], [0]
            self.save(0, [value], [by])
            return max(by, 0)
        i = max(bisect_right(self.firsts, value) - 1, 0)
        name = self.names[i]
        values, counts = self.load(name)
        j = bisect_left(values, value)
        before = counts[j] if j < len(values) and values[j] == value else 0
        if before:
            counts[j] += by
            if not counts[j]:
                del values[j], counts[j]
        else:
            values.insert(j, value)
            counts.insert(j, by)
        if not values:
            self.drop(name)
            del self.firsts[i], self.names[i]
        else:
            if len(values) > BLOCK:
                half, new = len(values) // 2, max(self.names) + 1
                self.save(new, values[half:], counts[half:])
                self.firsts.insert(i + 1, values[half])
                self.names.insert(i + 1, new)
                values, counts = values[:half], counts[:half]
            self.save(name, values, counts)
            self.firsts[i] = values[0]
        return max(before + by, 0) - max(before, 0)

    def end(self, last: bool) -> float | None:
        """The least or greatest value that is there."""
        for name in reversed(self.names) if last else self.names:
            values, counts = self.load(name)
            found = [v for v, n in zip(values, counts, strict=True) if n > 0]
            if found:
                return found[-1 if last else 0]
        return None


class _Signed(StatefulProcessor):
    def __init__(self, value: str, sign: str) -> None:
        self.value, self.sign = value, sign

    def init(self, handle) -> None:
        self.blocks = handle.getMapState("blocks", "name long", "vals array<double>, counts array<long>")
        self.directory = handle.getValueState("directory", "firsts array<double>, names array<long>, n long, over string, under string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        net: dict[float, int] = {}
        for pdf in rows:
            for v, s in zip(pdf[self.value].tolist(), pdf[self.sign].tolist(), strict=True):
                if v is not None and not isnan(v):
                    net[v] = net.get(v, 0) + int(s)
        firsts, names, n, over, under = self.directory.get() if self.directory.exists() else ([], [], 0, "0", "1")
        total = Fraction(int(over), int(under))
        known: dict[int, tuple[list, list]] = {}

        def load(name: int) -> tuple[list, list]:
            if name not in known:
                row = self.blocks.getValue((name,))
                known[name] = list(row[0]), list(row[1])
            return known[name]

        gone: set[int] = set()
        touched: set[int] = set()

        def save(name: int, values: list, counts: list) -> None:
            known[name] = values, counts
            touched.add(name)
            gone.discard(name)

        held = Multiset(list(firsts), list(names), load, save, gone.add)
        for v, by in sorted(net.items()):
            if by:
                change = held.add(v, by)
                n += change
                total += Fraction(v) * change
        for name in touched - gone:
            self.blocks.updateValue((name,), known[name])
        for name in gone:
            self.blocks.removeKey((name,))
        if held.names:
            self.directory.update((held.firsts, held.names, n, str(total.numerator), str(total.denominator)))
        else:
            self.directory.clear()
        sums = float(total)
        low, high = held.end(False), held.end(True)
        yield pd.DataFrame({"key": [key[0]], "n": [n], "sum": [sums if n else None], "mean": [sums / n if n else None], "min": [low], "max": [high]}).astype({c: "float64" for c in ("sum", "mean", "min", "max")})

    def close(self) -> None:
        pass


def stream_signed_extremes(stream: DataFrame, key: str, value: str, sign: str) -> DataFrame:
    """``signed_extremes`` on a stream, in update mode: key, n, sum, mean, min, max after each batch that changes a key.

    Values are doubles, summed exactly. A key of which nothing is left is
    reported once with n = 0 and nulls, and keeps no state.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), F.col(sign).cast("long").alias("sign"))
    made = rows.groupBy("key").transformWithStateInPandas(_Signed("value", "sign"), f"key {kind}, n long, sum double, mean double, min double, max double", "Update", "None")
    return made.withColumnRenamed("key", key)
