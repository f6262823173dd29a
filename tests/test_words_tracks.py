from datetime import datetime, timedelta
from math import atan, atan2, cos, radians, sin, sqrt, tan

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.scalars import geodesic_m
from plumbline.operators import analytics as N
from plumbline.operators import records as C
from plumbline.operators import tracks as K
from plumbline.operators.suggestions import near_words, with_suggestion
from plumbline.sources import files as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=6), min_size=1, max_size=25), st.lists(st.text(alphabet="abé", max_size=6), min_size=1, max_size=25), st.sampled_from([(0.5, 2), (1.0, 1), (0.9, 3), (0.0, 2)]))
def test_near_words_are_all_found(spark, words, choices, how):
    ratio, edits = how
    left, right = (spark.createDataFrame([(x,) for x in [*xs, None]], "w string") for xs in (words, choices))
    got = {(r.word, r.choice, r.edits) for r in near_words(left, "w", right, "w", ratio, edits).collect()}
    assert got == {(a, b, distance(a, b)) for a in words for b in choices if distance(a, b) <= min(edits, int(len(a) * ratio))}


def test_suggestions_keep_every_row(spark):
    rows = spark.createDataFrame([(1, "recieve", "x"), (2, "zzz", "x"), (3, None, "x"), (1, "recieve", "y"), (4, "", "x"), (5, "bat", "x")], "id int, word string, choice string")
    known = spark.createDataFrame([("receive",), ("relieve",), ("cat",), ("bad",), ("bad",), (None,)], "choice string")
    out = with_suggestion(rows, "word", known, "choice", 0.5)
    assert out.columns == ["id", "word", "choice", "suggestion"]
    assert sorted((r.id, r.choice, r.suggestion) for r in out.collect()) == [(1, "x", "relieve"), (1, "y", "relieve"), (2, "x", None), (3, "x", None), (4, "x", None), (5, "x", "bad")]
    assert with_suggestion(rows, "word", known.limit(0), "choice").where("suggestion is not null").count() == 0


def vincenty(lat1, lon1, lat2, lon2):
    """The same problem by plain iteration until it settles."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2, dl = atan((1 - f) * tan(radians(lat1))), atan((1 - f) * tan(radians(lat2))), radians(lon2 - lon1)
    lam = dl
    for _ in range(2000):
        s = sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2)
        if s == 0:
            return 0.0
        c = sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam)
        sigma = atan2(s, c)
        sa = cos(u1) * cos(u2) * sin(lam) / s
        ca = 1 - sa * sa
        m = c - 2 * sin(u1) * sin(u2) / ca if ca > 1e-15 else 0.0
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        new = dl + (1 - k) * f * sa * (sigma + k * s * (m + k * c * (2 * m * m - 1)))
        if abs(new - lam) < 1e-15:
            break
        lam = new
    u = ca * (a * a - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    return b * big * (sigma - small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3))))


def test_geodesic_within_a_millimetre(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, x)) for x in np.column_stack([rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300)])]
    rows = [r for r in rows if abs(abs(r[1] - r[3]) - 180) > 3 or abs(r[0] + r[2]) > 3]
    rows += [(a, b, a + d, b + e) for a, b in ((0.0, 0.0), (50.0, 7.0), (-33.0, 151.0)) for d, e in ((0.0, 1e-5), (1e-4, 0.0), (0.0, 0.0), (1.0, 0.0), (0.0, 1.0))] + [(90.0, 0.0, -89.0, 10.0), (0.0, 0.0, 0.0, 90.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for r in frame.select("*", geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect():
        assert abs(r.m - vincenty(r.a, r.b, r.c, r.d)) < 1e-3, r
    # Flinders Peak to Buninyong, the worked example of the Australian geodetic manual, on nearly the same ellipsoid
    one = spark.sql("select -37.95103341666667 a, 144.42486788888888 b, -37.65282113888889 c, 143.92649552777777 d").select(geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).first()
    assert one.m == pytest.approx(54972.271, abs=0.005)
    odd = spark.sql("select 0.0 a, 0.0 b, 0.2 c, 179.9 d union all select null, 1.0, 1.0, 1.0").select(geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()
    assert odd[0].m == pytest.approx(2.0e7, rel=0.01) and odd[1].m is None


def test_driving_statistics_against_loops(spark):
    rng = np.random.default_rng(4)
    start = datetime(2024, 1, 1)
    rows = []
    for u in ("a", "b", None, "one"):
        at = start
        for i in range(1 if u == "one" else 60):
            at += timedelta(seconds=int(rng.choice([0, 5, 30, 4000, 900_000], p=[0.05, 0.5, 0.35, 0.05, 0.05])))
            rows.append((u, i, at, float(50 + rng.random() / 50), float(8 + rng.random() / 50), [None, 20.0, 100.0, 170.0][int(rng.integers(4))]))
    frame = spark.createDataFrame(rows, "u string, i int, at timestamp, lat double, lon double, kmh double").repartition(5)
    got = {r.u: r for r in K.driving_statistics(frame, "u", "at", "lat", "lon", 3600, "kmh", ["i"]).collect()}
    own = {r.u: r for r in K.driving_statistics(frame, "u", "at", "lat", "lon", 3600, None, ["i"]).collect()}
    for u in ("a", "b", None, "one"):
        points = sorted((r for r in rows if r[0] == u), key=lambda r: (r[2], r[1]))
        want = {k: [0.0, 0.0] for k in ("", "_slow", "_fast", "_unknown")}
        computed = {k: [0.0, 0.0] for k in want}
        tracks = 1
        for p, q in zip(points, points[1:], strict=False):
            seconds, km = (q[2] - p[2]).total_seconds(), vincenty(p[3], p[4], q[3], q[4]) / 1000
            if seconds > 3600:
                tracks += 1
                continue
            measured = None if p[5] is None or q[5] is None else (p[5] + q[5]) / 2
            for sums, v in ((want, measured), (computed, km * 3600 / seconds if seconds else None)):
                for k in ["", *(["_unknown"] if v is None else ["_slow"] if v < 60 else ["_fast"] if v > 130 else [])]:
                    sums[k][0] += km
                    sums[k][1] += seconds
        for out, sums in ((got[u], want), (own[u], computed)):
            assert out.tracks == tracks
            for k, (km, seconds) in sums.items():
                assert out["km" + k] == pytest.approx(km, abs=1e-6) and out["seconds" + k] == pytest.approx(seconds, abs=1e-6), (u, k)


def test_merged_documents_keep_fields_of_either_side(spark):
    old = spark.createDataFrame([(1, "a", ("x", 1), [("p", 1), (None, 9)], [1, 2]), (2, "b", None, None, None)], "id int, name string, info struct<t:string,n:int>, parts array<struct<k:string,v:int>>, list array<int>")
    new = spark.createDataFrame([(1, None, (5.5, None), [("p", "new", 7.0), ("q", "q", None)], [3], True), (3, "c", None, None, None, False)], "id int, name string, info struct<m:double,t:string>, parts array<struct<k:string,w:string,v:double>>, list array<int>, extra boolean")
    got = {r.id: r.asDict(True) for r in C.merge_documents(old, new, "id", {"parts": "k"}).collect()}
    assert got[1] == {"id": 1, "name": "a", "info": {"t": "x", "n": 1, "m": 5.5}, "parts": [{"k": None, "v": 9.0, "w": None}, {"k": "p", "v": 7.0, "w": "new"}, {"k": "q", "v": None, "w": "q"}], "list": [3], "extra": True}
    assert got[2] == {"id": 2, "name": "b", "info": None, "parts": [], "list": None, "extra": None}
    assert got[3]["name"] == "c" and got[3]["extra"] is False


def test_updates_of_a_repeated_key(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 3)], "id int, name string, n int")
    changes = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 1), (9, "z", 1), (None, "no", 1)], "id int, name string, version int")
    assert sorted(map(tuple, R.update_rows(rows, changes, "id", "version").collect()), key=str) == sorted([(1, "y", 1), (2, None, 2), (None, "n", 3)], key=str)
    with pytest.raises(Exception, match="more than one change for id 1"):
        R.update_rows(rows, changes.drop("version"), "id").collect()
    assert R.update_rows(rows, changes.where("id = 2").drop("version"), "id").count() == 3


def test_null_groups_of_a_histogram(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "a", None), (datetime(2024, 1, 3), None, "x"), (datetime(2024, 1, 3), None, "x"), (None, "b", "x")], "at timestamp, g string, h string")
    got = {(r.bucket // 86_400_000 - 19723, r.g, r.h): r.n for r in N.date_histogram(rows, "at", 86_400_000, groups=["g", "h"]).collect()}
    assert got == {(0, "a", None): 1, (1, "a", None): 0, (2, "a", None): 0, (0, None, "x"): 0, (1, None, "x"): 0, (2, None, "x"): 2}


def test_csv_files_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""q"" y"\n2,z\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"two\nlines"\n')
    assert [tuple(r) for r in R.read(spark, "csv", str(tmp_path / "a.csv")).collect()] == [("1", 'x "q" y'), ("2", "z")]
    assert [tuple(r) for r in R.read(spark, "csv", str(tmp_path / "b.csv"), multiLine=True).collect()] == [("1", "two\nlines")]
