"""Time parameters: instants, lists, intervals and interval series in UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

_PERIOD = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$")


def instant(text: str) -> datetime:
    """An ISO instant; missing parts are the first month, day and midnight, always UTC."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d))?Z?)?)?)?", text.strip())
    if not m:
        raise ValueError(f"not an instant: {text!r}")
    year, month, day, hour, minute, second = (int(x) if x else None for x in m.groups())
    return datetime(year, month or 1, day or 1, hour or 0, minute or 0, second or 0, tzinfo=UTC)


def period(text: str) -> tuple[int, int]:
    """An ISO period as (calendar months, seconds)."""
    m = _PERIOD.match(text)
    if not m or not any(m.groups()):
        raise ValueError(f"not a period: {text!r}")
    y, mo, w, d, h, mi, s = (int(x or 0) for x in m.groups())
    return 12 * y + mo, 604800 * w + 86400 * d + 3600 * h + 60 * mi + s


def _step(start: datetime, months: int, seconds: int, k: int) -> datetime:
    at = start.year * 12 + start.month - 1 + months * k
    year, month = divmod(at, 12)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - datetime(year, month + 1, 1)).days
    moved = start.replace(year=year, month=month + 1, day=min(start.day, last))
    return datetime.fromtimestamp(moved.timestamp() + seconds * k, UTC)


def instants(text: str, first: datetime | None = None, last: datetime | None = None) -> list[datetime]:
    """``a,b,c``, ``start/end`` or ``start/end/period``; ``#`` is the first or last known instant.

    A series ends at the last whole step within the interval.
    """
    parts = text.split("/")
    if len(parts) == 1:
        return [instant(x) for x in text.split(",")]
    start = first if parts[0] in ("", "#") else instant(parts[0])
    end = last if parts[1] in ("", "#") else instant(parts[1])
    if start is None or end is None or start > end:
        raise ValueError(f"not an interval: {text!r}")
    if len(parts) == 2:
        return [start, end]
    months, seconds = period(parts[2])
    out, k = [start], 1
    while (at := _step(start, months, seconds, k)) <= end:
        out.append(at)
        k += 1
    return out


def spine(spark, times: list[datetime]):
    """The instants as a one-column table ``at``."""
    return spark.createDataFrame([(x,) for x in times], "at timestamp")


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """A validity interval [start, end) holds an instant; a null end is open."""
    return (start <= at) & (end.isNull() | (at < end))


def active(flag: Column, expires: Column, now: Column) -> Column:
    """Active and not expired."""
    return flag & F.coalesce(expires >= now, F.lit(True))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (west, south, east, north), borders included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])
