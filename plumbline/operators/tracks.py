"""Tracks of positions or values in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import geodesic_m, haversine_km
from plumbline.plans.ranking import sliced_lag

#: km/h under which and over which a user's driving is summed apart.
SLOW_KMH, FAST_KMH = 60.0, 130.0


def segments(df: DataFrame, track: str, ts: str, lat: str, lon: str, order: list[str] | None = None, carried: list[str] | None = None, ellipsoid: bool = False) -> DataFrame:
    """Each point with the kilometres, on the sphere or the ellipsoid, and the seconds since the point before it on its track.

    A track is ordered in slices of time, ``order`` ranks points at one time.
    ``carried`` columns of the point before come along as ``before_<name>``.
    """
    names = [ts, lat, lon, *(carried or [])]
    rows = sliced_lag(df, track, ts, order or [], "_before", value=F.struct(*(F.col(c).alias(f"v{i}") for i, c in enumerate(names))))
    micros = [F.unix_micros(x.cast("timestamp")) for x in (F.col("_before.v0"), F.col(ts))]
    ends = [F.col("_before.v1"), F.col("_before.v2"), F.col(lat), F.col(lon)]
    made = {"km": geodesic_m(*ends) / 1000 if ellipsoid else haversine_km(*ends), "seconds": (micros[1] - micros[0]) / 1e6}
    return rows.withColumns(made | {f"before_{c}": F.col(f"_before.v{i + 3}") for i, c in enumerate(carried or [])}).drop("_before")


def driving_statistics(df: DataFrame, user: str, ts: str, lat: str, lon: str, longest: float, speed: str | None = None, order: list[str] | None = None) -> DataFrame:
    """user, tracks, km on the ellipsoid, seconds, and both for slow, fast and unknown speed, in one pass over segments.

    A pause of more than ``longest`` seconds ends a track; what lies in it counts
    nowhere. A segment's speed is the mean of its ends' ``speed`` in km/h, or its
    length by its time without such a column; it is unknown if an end has none
    or no time passes. Users with a single point have one track of length 0.
    """
    rows = segments(df, user, ts, lat, lon, order, [speed] if speed else None, ellipsoid=True)
    known: Column = (F.col(speed) + F.col(f"before_{speed}")) / 2 if speed else F.try_divide(F.col("km") * 3600, F.nullif(F.col("seconds"), F.lit(0.0)))
    rows = rows.select(user, "km", "seconds", F.nanvl(known.cast("double"), F.lit(None)).alias("kmh"), (F.col("seconds").isNull() | (F.col("seconds") > longest)).alias("opens"))
    within = ~F.col("opens")
    bands = {"": F.lit(True), "_slow": F.col("kmh") < SLOW_KMH, "_fast": F.col("kmh") > FAST_KMH, "_unknown": F.col("kmh").isNull()}
    sums = [F.coalesce(F.sum(F.when(within & test, F.col(c))), F.lit(0.0)).alias(c + band) for band, test in bands.items() for c in ("km", "seconds")]
    return rows.groupBy(user).agg(F.count_if("opens").alias("tracks"), *sums)


def gaps(df: DataFrame, key: str, ts: str, longest: float) -> DataFrame:
    """Per key: events, whole-second gaps up to ``longest`` summed, and longer ones counted. A key is ordered in slices of time."""
    rows = sliced_lag(df.select(key, ts), key, ts, [], "_before")
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("_before").cast("timestamp"))
    rows = rows.select(key, gap.alias("gap"))
    near = F.coalesce(F.sum(F.when(F.col("gap") <= longest, F.col("gap"))), F.lit(0))
    return rows.groupBy(key).agg(F.count("*").alias("n"), near.cast("long").alias("active_seconds"), F.count_if(F.col("gap") > longest).alias("breaks"))
