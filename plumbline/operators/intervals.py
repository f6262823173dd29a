"""Sums over rows that are valid for an interval, at each instant of a series."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import haversine_km
from plumbline.operators.joins import range_join

EARTH_M = 6_371_000.0


def length_m(line: Column) -> Column:
    """Metres along an array of points (x, y) on the sphere; 0 for fewer than two."""
    steps = F.arrays_zip(line.alias("a"), F.slice(line, F.lit(2), F.greatest(F.size(line), F.lit(0))).alias("b"))
    return 1000 * F.aggregate(steps, F.lit(0.0), lambda s, z: s + F.coalesce(haversine_km(z["a"]["y"], z["a"]["x"], z["b"]["y"], z["b"]["x"]), F.lit(0.0)))


def _closed(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def perimeter_m(rings: Column) -> Column:
    """Metres around all rings, holes included."""
    return F.aggregate(rings, F.lit(0.0), lambda s, ring: s + length_m(_closed(ring)))


def _ring_area(ring: Column) -> Column:
    closed = _closed(ring)
    steps = F.arrays_zip(closed.alias("a"), F.slice(closed, F.lit(2), F.size(closed)).alias("b"))
    part = lambda z: F.radians(z["b"]["x"] - z["a"]["x"]) * (2 + F.sin(F.radians(z["a"]["y"])) + F.sin(F.radians(z["b"]["y"])))
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, z: s + F.coalesce(part(z), F.lit(0.0)))) * (EARTH_M * EARTH_M / 2)


def area_m2(rings: Column) -> Column:
    """Square metres of the first ring on the sphere, less those of the others, its holes."""
    holes = F.aggregate(F.slice(rings, F.lit(2), F.size(rings)), F.lit(0.0), lambda s, ring: s + _ring_area(ring))
    return F.when(F.size(rings) > 0, _ring_area(F.get(rings, 0)) - holes).otherwise(F.lit(0.0))


def instants_before(times: Column, at: Column, many: int) -> Column:
    """How many of ``many`` sorted instants of an array lie before ``at``, by halving."""
    steps = max(many, 1).bit_length()
    start = F.struct(F.lit(0).alias("low"), F.lit(many).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        before = (s["low"] < s["high"]) & (F.get(times, middle) < at)
        return F.struct(F.when(before, middle + 1).otherwise(s["low"]).alias("low"), F.when(before | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["low"])


def sums_at(df: DataFrame, start: str, end: str, times: list[datetime], measures: dict[str, Column], groups: list[str] | None = None, scale: int = 3) -> DataFrame:
    """groups, at, n and the measures: sums over the rows valid at each instant, [start, end), an open end if null.

    A row adds at the first instant from its start on and subtracts at the first
    from its end on; what falls on the same instant is summed before the
    shuffle, so that carries at most one row for a group, instant and task,
    however long the intervals are. Running sums over a group's instants are the
    result; a group has all instants. Measures are summed as decimals of
    ``scale`` places, for sums of floats would not come back to zero; null ones
    count as 0. Rows without a start, or that end before they start, are never valid.
    """
    groups = groups or []
    times = sorted(set(times))
    array = F.array(*(F.lit(x) for x in times)) if times else F.array().cast("array<timestamp>")
    kind = f"decimal({28 + scale},{scale})"
    valued = {name: F.coalesce(m.cast(f"decimal(28,{scale})"), F.lit(0).cast(f"decimal(28,{scale})")) for name, m in measures.items()}
    since, until = F.col(start).cast("timestamp"), F.col(end).cast("timestamp")
    rows = df.where(since.isNotNull() & (until.isNull() | (since < until)))
    rows = rows.select(*groups, *(v.alias(n) for n, v in valued.items()), F.lit(1).cast("long").alias("n"), instants_before(array, since, len(times)).alias("_from"), F.when(until.isNull(), len(times)).otherwise(instants_before(array, until, len(times))).alias("_to"))
    both = F.array(*(F.struct(F.col(c).alias("i"), F.lit(sign).alias("sign")) for c, sign in (("_from", 1), ("_to", -1))))
    deltas = rows.select(*groups, "n", *valued, F.explode(both).alias("d")).select(*groups, F.col("d.i").alias("_i"), *((F.col(c) * F.col("d.sign")).alias(c) for c in ("n", *valued)))
    # rows between two instants keep their group in the result with sums of 0
    summed = deltas.groupBy(*groups, "_i").agg(*(F.sum(c).alias(c) for c in ("n", *valued)))
    held = summed.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_i", F.struct("n", *valued)))).alias("_by"))
    spread = held.select(*groups, "_by", F.posexplode(array).alias("_i", "at"))
    order = Window.partitionBy(*groups).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = [F.sum(F.coalesce(F.try_element_at("_by", F.col("_i"))[c], F.lit(0))).over(order) for c in ("n", *valued)]
    return spread.select(*groups, "at", *(v.cast("long" if c == "n" else kind).alias(c) for c, v in zip(("n", *valued), out, strict=True)))


def interval_statistics(df: DataFrame, ts: str, intervals: DataFrame, user: str, width: float, aggs: list[Column] | None = None) -> DataFrame:
    """from, to, n, users (and ``aggs``) of each interval [from, to) of a table, empty ones included; rows without a time count nowhere.

    Intervals may overlap; times meet them by an equi-join on cells of ``width``
    seconds, about the length of an interval.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    cells = intervals.select("from", "to", F.col("from").cast("timestamp").cast("double").alias("_lo"), F.col("to").cast("timestamp").cast("double").alias("_hi")).where("_lo < _hi")
    rows = range_join(df.withColumn("_at", seconds).where("_at is not null").drop("from", "to"), cells, "_at", "_lo", "_hi", width)
    found = rows.groupBy("_lo", "_hi").agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"), *(aggs or []))
    out = intervals.select("from", "to", F.col("from").cast("timestamp").cast("double").alias("_lo"), F.col("to").cast("timestamp").cast("double").alias("_hi")).join(found, ["_lo", "_hi"], "left")
    return out.drop("_lo", "_hi").fillna(0, ["n", "users"])


def bounding_box(rings: Column) -> Column:
    """west, south, east, north of the first ring; null without points."""
    xs, ys = F.get(rings, 0)["x"], F.get(rings, 0)["y"]
    return F.when(F.size(xs) > 0, F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north")))


def centroid(rings: Column) -> Column:
    """The centre x, y of the area of the first ring less its holes, on a plane; null for an area of nothing."""

    def moments(ring: Column) -> Column:
        closed = _closed(ring)
        steps = F.slice(F.arrays_zip(closed.alias("a"), F.slice(closed, F.lit(2), F.size(closed)).alias("b")), F.lit(1), F.size(ring))
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

        def add(s: Column, z: Column) -> Column:
            cross = z["a"]["x"] * z["b"]["y"] - z["b"]["x"] * z["a"]["y"]
            return F.struct((s["a"] + cross).alias("a"), (s["x"] + (z["a"]["x"] + z["b"]["x"]) * cross).alias("x"), (s["y"] + (z["a"]["y"] + z["b"]["y"]) * cross).alias("y"))

        return F.aggregate(steps, start, add)

    def total(s: Column, m: Column) -> Column:
        """Rings count by their size: the first adds, the others subtract, whichever way they turn."""
        sign = F.when(s["first"], 1.0).otherwise(-1.0) * F.signum(m["a"])
        return F.struct((s["a"] + sign * m["a"]).alias("a"), (s["x"] + sign * m["x"]).alias("x"), (s["y"] + sign * m["y"]).alias("y"), F.lit(False).alias("first"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("first"))
    sums = F.aggregate(F.transform(rings, moments), zero, total)
    return F.when(sums["a"] != 0, F.struct((sums["x"] / (3 * sums["a"])).alias("x"), (sums["y"] / (3 * sums["a"])).alias("y")))
