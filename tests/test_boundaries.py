from datetime import datetime, timedelta
from math import cos, pi, radians, sin

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.operators import boundaries as B
from plumbline.operators import intervals as I

POINTS = "id int, lon double, lat double, boundary string"


def inside(rings, x, y):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (y < y1) != (y < y2):
                hits += x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hits % 2 == 1


def polygons(rng):
    """Star-shaped rings with holes, boxes on cell borders, a triangle smaller than a cell, one far larger, one not simple."""
    out = []
    for i in range(12):
        cx, cy, n = rng.uniform(-20, 20), rng.uniform(-20, 20), int(rng.integers(3, 14))
        angles = np.sort(rng.uniform(0, 2 * pi, n))
        radius = rng.uniform(1, 9, n)
        outer = [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(angles, radius, strict=True)]
        hole = [(cx - 0.4, cy - 0.3), (cx + 0.5, cy - 0.3), (cx, cy + 0.6)]
        out.append((f"p{i}", [outer, hole] if i % 2 else [outer]))
    out += [("box", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]), ("tiny", [[(1.01, 1.01), (1.02, 1.01), (1.01, 1.03)]]), ("all", [[(-60.0, -50.0), (60.0, -50.0), (60.0, 50.0), (-60.0, 50.0)], [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0)]])]
    return out + [("bow", [[(-10.0, 10.0), (10.0, 20.0), (10.0, 10.0), (-10.0, 20.0)]]), ("line", [[(0.0, 0.0), (1.0, 1.0)]]), ("none", [])]


@pytest.mark.parametrize("cell", [0.7, 2.0, 30.0])
def test_points_in_polygons(spark, cell):
    rng = np.random.default_rng(7)
    shapes = polygons(rng)
    spots = [(float(x), float(y)) for x, y in rng.uniform(-30, 30, (700, 2))] + [(float(x), float(y)) for x in range(-1, 6) for y in range(-1, 6)] + [(1.011, 1.012), (1.015, 1.0299)]
    rows = [(i, x, y, "mine") for i, (x, y) in enumerate(spots)] + [(9000, None, 1.0, None), (9001, 1.0, None, None), (9002, 500.0, 500.0, None), (0, *spots[0], "again")]
    out = B.with_boundaries(spark.createDataFrame(rows, POINTS), spark.createDataFrame([(n, r, None) for n, r in shapes], B.SCHEMA), "lon", "lat", cell).collect()
    assert len(out) == len(rows)
    for r in out:
        want = sorted(n for n, rings in shapes if r.lon is not None and r.lat is not None and inside(rings, r.lon, r.lat))
        assert r.boundaries == want, (r, want)


def test_circles_boxes_and_names(spark):
    frame = spark.createDataFrame([(1, 8.7, 49.4, None), (2, 8.7, 49.41, None), (3, 8.72, 49.4, None), (4, 9.5, 49.4, None)], POINTS)
    circles = B.boundary_table(spark, "near:8.7,49.4,1200|8.7,49.4,70000", "bcircles")
    assert {r.id: r.boundaries for r in B.with_boundaries(frame, circles, "lon", "lat").collect()} == {1: ["boundary2", "near"], 2: ["boundary2", "near"], 3: ["boundary2"], 4: ["boundary2"]}
    boxes = B.boundary_table(spark, "8.6,49.3,8.71,49.405|east: 9,49,10,50", "bboxes")
    assert {r.id: r.boundaries for r in B.with_boundaries(frame, boxes, "lon", "lat", 0.1).collect()} == {1: ["boundary1"], 2: [], 3: [], 4: ["east"]}
    ring = B.parse_boundaries("t:0,0,2,0,1,2,0,0", "bpolys")
    assert ring == [("t", [[(0.0, 0.0), (2.0, 0.0), (1.0, 2.0), (0.0, 0.0)]], None)]
    for text, kind in (("1,2,3", "bboxes"), ("3,0,1,2", "bboxes"), ("1,2,-3", "bcircles"), ("0,0,2,0,1,2", "bpolys"), ("0,0,2,0,1,2,1,1", "bpolys"), ("a,b", "bboxes"), ("1,2,3,4", "rings"), ("a:1,2,3,4|a:1,2,3,4", "bboxes")):
        with pytest.raises(SpecError):
            B.parse_boundaries(text, kind)


def test_series_with_remainder(spark):
    rows = [(i, float(i % 4), 0.5, datetime(2024, 1, 1 + i % 2)) for i in range(40)]
    frame = spark.createDataFrame(rows, "id int, lon double, lat double, at timestamp")
    shapes = spark.createDataFrame([("a", [[(-0.5, 0.0), (1.5, 0.0), (1.5, 1.0), (-0.5, 1.0)]], None), ("b", [[(0.5, 0.0), (1.5, 0.0), (1.5, 1.0), (0.5, 1.0)]], None)], B.SCHEMA)
    got = {(r.group, r.bucket // 86_400_000 - 19723): r.n for r in B.series_by_boundary(frame, shapes, "lon", "lat", "at", 86_400_000, 0.5).collect()}
    assert got == {("a", 0): 10, ("a", 1): 10, ("b", 0): 0, ("b", 1): 10, ("remainder", 0): 10, ("remainder", 1): 10}


def test_no_cross_join_and_no_ring_in_the_plan(spark):
    shapes = spark.createDataFrame([(n, r, None) for n, r in polygons(np.random.default_rng(7))], B.SCHEMA)
    plan = B.with_boundaries(spark.createDataFrame([(1, 0.5, 0.5, None)], POINTS), shapes, "lon", "lat")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "1.03" not in plan


def test_crowded_cells_and_many_edges(spark, monkeypatch):
    """A cover that is not broadcast, cells whose points go to several tasks, rows of cells that are split into fine ones."""
    rng = np.random.default_rng(11)
    shapes = polygons(rng)
    for i, n in enumerate((80, 900)):
        angles = np.sort(rng.uniform(0, 2 * pi, n))
        shapes.append((f"many{i}", [[(float(3 * i + r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(angles, rng.uniform(6, 12, n), strict=True)]]))
    rows = [(i, float(x), float(y), "mine") for i, (x, y) in enumerate(rng.uniform(-16, 16, (600, 2)))] + [(9000, None, 1.0, None)]
    monkeypatch.setattr(B, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(B, "PART_POINTS", 7)
    found = B.with_boundaries(spark.createDataFrame(rows, POINTS), spark.createDataFrame([(n, r, None) for n, r in shapes], B.SCHEMA), "lon", "lat", 5.0)
    assert "SortMergeJoin" in found._jdf.queryExecution().toString()
    out = found.collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.boundaries == sorted(n for n, rings in shapes if r.lon is not None and inside(rings, r.lon, r.lat)), r


def test_cover_grows_with_borders(spark):
    """A boundary is in the cover once for each coarse cell, not for each fine cell of its area."""
    shapes = [(f"s{i}", [[(i + 10 * cos(k * pi / 4), 10 * sin(k * pi / 4)) for k in range(8)]], None) for i in range(20)]
    cells = B.cover(spark.createDataFrame(shapes, B.SCHEMA), 4.0)
    entries = sum(F.size(c) for c, t in cells.dtypes if t.startswith("array"))
    assert cells.agg(F.sum(entries)).first()[0] <= 20 * 7 * 7


def test_equal_rings_and_places_are_tested_once(spark, monkeypatch):
    """Boundaries with equal rings stand in the cover as one, points at one place meet it as one; every point has all names."""
    rng = np.random.default_rng(5)
    kinds = [(n, r) for n, r in polygons(rng) if n in ("p0", "p1", "p2", "box", "all", "bow")]
    shapes = [(f"{n}-{k}", r, None) for n, r in kinds for k in range(9)]
    # rows of one name are one boundary: the second lies in a hole's place, the third takes it away again
    shapes += [("two", kinds[0][1], None), ("two", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]], None), ("twice", kinds[1][1], None), ("twice", kinds[1][1], None), (None, kinds[0][1], None), ("round", None, (1.0, 1.0, 90_000.0))]
    table = spark.createDataFrame(shapes, B.SCHEMA)
    first = spark.createDataFrame([x for x in shapes if x[0] is None or "-" not in x[0] or x[0].endswith("-0")], B.SCHEMA)
    tested = [B.cover(t, 2.0).agg(F.sum(F.size("tested"))).first()[0] for t in (table, first)]
    assert tested[0] == tested[1]

    spots = [(float(x), float(y)) for x, y in rng.uniform(-20, 20, (60, 2))] + [(0.0, 0.0), (-0.0, 0.0), (0.5, 0.25), (None, 1.0)]
    rows = [(i, *spots[i % len(spots)], "mine") for i in range(9 * len(spots))]
    monkeypatch.setattr(B, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(B, "PART_POINTS", 4)
    met, dealt = [], B._dealt_join
    monkeypatch.setattr(B, "_dealt_join", lambda rows, table, keys, counts: (met.append(rows.count()), dealt(rows, table, keys, counts))[1])
    found = B.with_boundaries(spark.createDataFrame(rows, POINTS), table, "lon", "lat", 2.0)
    out, text = found.collect(), B.with_boundaries(spark.createDataFrame(rows, POINTS), table, "lon", "lat", 2.0, joined=",").collect()
    assert met[0] <= len(spots) and len(out) == len(text) == len(rows)
    whole: dict = {}
    for n, r, _ in shapes:
        if n is not None and r is not None:
            whole[n] = [*whole.get(n, []), *r]
    for r in out:
        want = [n for n, rings in whole.items() if r.lon is not None and inside(rings, r.lon, r.lat)]
        want += ["round"] if r.lon is not None and 111.195 * ((r.lon - 1) ** 2 + (r.lat - 1) ** 2) ** 0.5 <= 90 else []
        assert r.boundaries == sorted(want), r
    assert {r.id: r.boundaries for r in text} == {r.id: ",".join(r.boundaries) for r in out}


# intervals


def test_sums_at_instants(spark):
    rng = np.random.default_rng(3)
    base = datetime(2024, 1, 1)
    rows = []
    for i in range(500):
        a = base + timedelta(hours=int(rng.integers(-500, 3000)))
        b = None if i % 9 == 0 else a + timedelta(hours=int(rng.integers(-3, 900)))
        rows.append((None if i % 50 == 0 else a, b, None if i % 31 == 0 else round(float(rng.uniform(-5, 5)), 3), ["x", "y", None][i % 3], 1))
    rows += [(datetime(2030, 1, 1), None, 1.0, "late", 1), (datetime(2001, 1, 1), datetime(2002, 1, 1), 1.0, "early", 1)]
    frame = spark.createDataFrame(rows, "a timestamp, b timestamp, m double, g string, n int")
    times = [base + timedelta(days=k * k) for k in range(12)]
    got = {(r.g, r.at): (r.n, float(r.total)) for r in I.sums_at(frame, "a", "b", [*times, times[0]], {"total": F.col("m")}, ["g"]).collect()}
    want = {}
    for g in ("x", "y", None, "late", "early"):
        for at in times:
            held = [m or 0 for a, b, m, h, _ in rows if h == g and a is not None and a <= at and (b is None or at < b)]
            want[g, at] = (len(held), round(sum(held), 3))
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert [(r.n, r.at) for r in I.sums_at(frame, "a", "b", times[:1], {}).collect()] == [(sum(a is not None and a <= base and (b is None or base < b) for a, b, *_ in rows), base)]
    assert I.sums_at(frame, "a", "b", [], {}).collect() == [] and I.sums_at(frame.limit(0), "a", "b", times, {}, ["g"]).collect() == []


def test_shuffle_does_not_grow_with_instants(spark):
    """Deltas are combined before the shuffle: rows that enter it are at most two for a row, whatever the number of instants."""
    frame = spark.range(2000).select(F.timestamp_seconds(F.col("id") * 10).alias("a"), F.timestamp_seconds(F.col("id") * 10 + 10**7).alias("b"))
    times = [datetime(1970, 1, 1) + timedelta(hours=k) for k in range(2000)]
    plan = I.sums_at(frame, "a", "b", times, {})._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert I.sums_at(frame, "a", "b", times, {}).where("n = 2000").count() == 2000 - 6


def test_measures(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    hole = [(0.2, 0.2), (0.4, 0.2), (0.4, 0.4)]
    row = spark.createDataFrame([([square, hole], square)], "rings array<array<struct<x:double,y:double>>>, line array<struct<x:double,y:double>>")
    r = row.select(I.area_m2(F.col("rings")).alias("area"), I.perimeter_m(F.col("rings")).alias("around"), I.length_m(F.col("line")).alias("length"), I.length_m(F.slice("line", 1, 1)).alias("one"), I.area_m2(F.slice("rings", 1, 0)).alias("none")).first()

    def area(ring):
        return abs(sum(radians(b[0] - a[0]) * (2 + sin(radians(a[1])) + sin(radians(b[1]))) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) * 6_371_000.0**2 / 2

    assert r.area == pytest.approx(area(square) - area(hole)) and r.one == 0 and r.none == 0
    degree = 6_371_000 * pi / 180
    assert r.length == pytest.approx(degree * (2 + cos(radians(1))), rel=1e-4)
    assert r.around > r.length + degree
