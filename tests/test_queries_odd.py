"""Registered queries on odd tables, against their SQL."""

import collections
from datetime import datetime, timedelta

import duckdb
import pytest

from plumbline import more_queries  # noqa: F401  registers its queries
from plumbline.operators import boundaries
from plumbline.queries import QUERIES, SQL

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def compared(spark, folder, name, tables):
    """Rows of a query and of its SQL over some tables, as sorted tuples by the SQL's columns."""
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(folder)).select(*(f"`{c}`" for c in columns)).collect()
    return collections.Counter(tuple(r) for r in got), collections.Counter(want.fetchall())


def fine_events(many=400):
    """Times in microseconds, some half a millisecond or less before an hour, a day and a recorded period's end."""
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(many):
        hours, micros = i * 7 % 61, (0, -400, -500, -501, 400, 499, 500, -1)[i % 8]
        rows.append((i, start + timedelta(hours=hours, microseconds=micros), i % 5, "error" if i % 23 == 0 else "view", float(i % 17), "{}"))
    return rows


@pytest.mark.parametrize("name", ["date_histogram_zero_fill", "histogram_with_terms", "sampling_temporal", "trailing_ranges_rollup"])
def test_times_within_a_millisecond(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, {"events": spark.createDataFrame(fine_events(), EVENTS)})
    assert got == want


def test_times_before_1970(spark, tmp_path):
    rows = [(i, datetime(1970, 1, 1) + timedelta(hours=-i // 9, microseconds=(-500, -400, -600, 0, -1)[i % 5]), 1, "view", 1.0, "{}") for i in range(90)]
    got, want = compared(spark, tmp_path, "date_histogram_zero_fill", {"events": spark.createDataFrame(rows, EVENTS)})
    assert got == want


def test_recorded_samples_of_odd_events(spark, tmp_path):
    """Repeated ids and rows, times within a millisecond, rows without a user, an id, a time or a type."""
    rows = fine_events()
    rows += rows[:40] + [(i, at, 7, kind, v, p) for i, at, _, kind, v, p in rows[40:80]]
    rows += [(1000 + i, at, None, kind, v, p) for i, (_, at, _, kind, v, p) in enumerate(rows[:30])]
    rows += [(None, at + timedelta(hours=300), u, kind, v, p) for _, at, u, kind, v, p in rows[:30]]
    rows += [(2000, None, 1, "view", 1.0, "{}"), (2001, None, 1, "error", 1.0, "{}"), (2002, datetime(2024, 3, 1), 1, None, 1.0, "{}")]
    got, want = compared(spark, tmp_path, "sampling_recorded", {"events": spark.createDataFrame(rows, EVENTS)})
    assert got == want


def test_points_and_polygons_that_repeat(spark, tmp_path, monkeypatch):
    """Places and polygons recur with the keys; a supplier twice or three times, keys that are null, with and without a broadcast cover."""
    customers = [(i * 7 + 61_200 * k,) for i in range(150) for k in range(3)] + [(None,)]
    suppliers = [(i + 15_300 * k,) for i in range(90) for k in range(4)] + [(3,), (4,), (4,), (None,)]
    tables = {"customer": spark.createDataFrame(customers, "c_custkey long"), "supplier": spark.createDataFrame(suppliers, "s_suppkey long")}
    for bound in (0, 10**9):
        monkeypatch.setattr(boundaries, "BROADCAST_EDGES", bound)
        got, want = compared(spark, tmp_path, "points_in_polygons", tables)
        assert got == want and sum(len(names) > 0 for _, names in want) > 50
