import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.errors import UnknownFunction
from plumbline.functions import scalars as S
from plumbline.operators import aggregates as A
from plumbline.operators import analytics as N
from plumbline.operators import joins as J
from plumbline.operators import nested as D
from plumbline.operators import tracks as K
from plumbline.operators import transforms as T
from plumbline.plans import flow as P
from plumbline.plans.ranking import numbered


def one(df):
    return df.first()


def test_academics(spark):
    academics = spark.createDataFrame([(1, "academic1", 1, 2), (2, "academic2", 1, None), (3, "academic3", 2, None)], "id int, name string, institution int, advisor int")
    universities = spark.createDataFrame([(1, "uni1"), (2, "uni2")], "uid int, uni string")
    rows = J.fk_path_join(academics, [(universities, "uid", "institution")]).select("id", "uni")
    assert sorted(map(tuple, rows.collect())) == [(1, "uni1"), (2, "uni1"), (3, "uni2")]
    steps = [{"type": "order", "spec": [{"field": "id", "direction": "asc"}]}, {"type": "offset", "spec": 1}, {"type": "limit", "spec": 1}]
    assert [tuple(r) for r in T.apply_transforms(rows, steps).collect()] == [(2, "uni1")]


def test_limit_before_filter_differs(spark):
    rows = spark.range(10)
    order = {"type": "order", "spec": [{"field": "id"}]}
    keep = {"type": "filter", "spec": {"greater": [{"column_name": ["id"]}, {"literal": [4]}]}}
    assert T.apply_transforms(rows, [order, {"type": "limit", "spec": 5}, keep]).count() == 0
    assert T.apply_transforms(rows, [keep, order, {"type": "limit", "spec": 5}]).count() == 5


def test_magnitudes(spark):
    rows = spark.createDataFrame([(997.195962329400,), (0.0002982,), (199.0,)], "x double").select(S.magnitude(F.col("x")).alias("m"))
    assert [r.m for r in rows.collect()] == [1, -5, 1]


def test_percentage_peaks_and_lists(spark):
    rows = spark.createDataFrame([(True, datetime(2024, 12, 5, 23, 0)), (True, datetime(2024, 2, 5, 1, 0)), (True, None), (False, None)], "b boolean, t timestamp")
    made = [{"function": f, "column": c, "alias": f} for f, c in (("percentage_true", "b"), ("peak_time", "t"), ("peak_month", "t"), ("distinct_aggregate_to_array", "b"))]
    got = one(A.summarize(rows, [], made))
    assert (got.percentage_true, got.peak_time, got.peak_month, got.distinct_aggregate_to_array) == (75.0, "00:00:00", 1, [False, True])


def test_month_counts_and_word_logs(spark):
    rows = spark.createDataFrame([(datetime(2017, 8, 3),)] * 6 + [(datetime(2017, 10, 3),)] * 3, "t timestamp")
    assert sorted(map(tuple, N.month_counts(rows, "t").collect())) == [("2017-10", 3), ("2017-8", 6), ("2017-9", 0)]
    assert N.month_counts(rows.limit(0), "t").count() == 0
    words = N.word_counts(spark.createDataFrame([("a a a b A a a a",)], "w string"), "w", 5).collect()
    assert [(r.word, r.n) for r in words] == [("a", 7), ("b", 1)] and words[0].ln == math.log(7) and words[1].ln == 0.0


def test_extended_histogram_of_nothing(spark):
    empty = spark.createDataFrame([], "t timestamp")
    assert [(r.bucket, r.n) for r in N.date_histogram(empty, "t", 10, bounds=(20, 45)).orderBy("bucket").collect()] == [(20, 0), (30, 0), (40, 0)]


def test_inclusive_status_ranges(spark):
    rows = spark.createDataFrame([(200,), (299,), (300,)], "status int")
    out = N.range_buckets(rows, "status", [(200, 299), (300, 399)], inclusive=True).collect()
    assert [r.n for r in out] == [2, 1]


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 3), (None, 4)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 11), ("a", 5, 12), ("c", 1, 13)], "k string, at int, v int")
    want = [("", 4, None), ("a", 1, None), ("a", 5, 12), ("a", 9, 12), ("b", 3, None)]
    for width in (None, 1, 3, 100):
        out = J.as_of_join(left, right, "k", "t", "at", ["v"], width).collect()
        assert sorted((r.k or "", r.t, r.v) for r in out) == want


def test_numbers_follow_a_global_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = numbered(rows, [F.col("x")], "n").orderBy("x").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_due_dates_skip_weekends(spark):
    starts = [date(2024, 1, 1 + i) for i in range(7)]  # a Monday first
    rows = spark.createDataFrame([(s, n) for s in starts for n in range(12)], "s date, n int").select("s", "n", S.due_date(F.col("s"), F.col("n")).alias("due")).collect()
    for r in rows:
        day, left = r.s.toordinal(), r.n
        while date.fromordinal(day).weekday() >= 5:
            day += 1
        while left:
            day += 1
            left -= date.fromordinal(day).weekday() < 5
        assert r.due == date.fromordinal(day)


def test_geometry_maps_and_text(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    rows = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0)], "lon double, lat double")
    assert [r[0] for r in rows.select(S.in_ring(F.col("lon"), F.col("lat"), ring)).collect()] == [True, False]
    x = one(
        spark.range(1).select(
            S.log_part(F.lit("a|b| c ")).alias("part"),
            S.status_map(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in ((200, "a"), (404, "b"), (200, "c"))))).alias("map"),
            S.compacted(F.array(F.lit(0), F.lit(3), F.lit(None))).alias("some"),
            S.haversine_rounded(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"),
            S.is_email(F.lit("a@b.org")).alias("mail"),
            S.parsed_instant(F.lit("86400")).cast("long").alias("at"),
            S.discounted(F.lit(200.0), F.lit(10), F.lit(None).cast("double")).alias("price"),
        )
    )
    assert (x.part, x.map, x.some, x.mail, x["at"], x.price) == ("c", {200: "c", 404: "b"}, [3], True, 86400, 180.0)
    assert abs(x.km - 111.19) < 0.01


def test_nested_documents(spark):
    rows = spark.createDataFrame([(1, [5, 6], [6]), (2, [], [1]), (3, [9], [1])], "id int, bids array<int>, awards array<int>")
    assert D.unwind(rows, "bids").count() == 3 and D.unwind(rows, "bids", keep_empty=True).count() == 4
    assert [r.id for r in rows.where(D.any_pair("bids", "awards", lambda a, b: a == b)).collect()] == [1]
    flags = spark.createDataFrame([(True, True), (True, False), (False, True)], "a boolean, b boolean")
    assert tuple(one(D.cross_table(flags, "a", ["a", "b"]))) == (2, 1)
    series = spark.createDataFrame([("p", 2, 20), ("p", 1, 10)], "k string, t int, v int")
    assert tuple(one(D.ordered_arrays(series, "k", "t", ["v"]))) == ("p", [1, 2], [10, 20])


def test_tracks(spark):
    rows = spark.createDataFrame([("t", datetime(2024, 1, 1, 0, 0, s), 0.0, float(s)) for s in range(3)], "k string, t timestamp, lat double, lon double")
    got = K.segments(rows, "k", "t", "lat", "lon").agg(F.sum("km").alias("km"), F.sum("seconds").alias("s")).first()
    assert abs(got.km - 222.39) < 0.01 and got.s == 2.0


def test_flow(spark):
    assert P.for_each({"a": [1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    assert [tuple(r) for r in P.for_range(spark, 0, 10, slices=3).collect()] == [(0, 0, 4), (1, 4, 8), (2, 8, 10)]
    assert [r.i for r in P.loop(spark, 3).collect()] == [0, 1, 2]
    assert P.run_sql(spark, "SELECT :x + 1 AS y", x=2).first().y == 3
    assert P.last_results(spark.range(2), "all") == [{"id": 0}, {"id": 1}] and P.last_results(spark.range(2), False) is None


def test_joinable_tables(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (2, "b", "c")], "id int, source string, target string")
    assert sorted((r.target, r.path, r.depth) for r in J.joinable_tables(edges, "a").collect()) == [("b", [1], 1), ("c", [1, 2], 2)]


def test_compacted_by_type(spark):
    row = spark.sql("SELECT array('0', 'false', '', null, 'x') AS s, array(0.0D, -0.0D, 1.5D, null) AS f, array(true, false, null) AS b, array(array(), array(1)) AS a, array(0, 7, 10) AS i, array(cast(0 AS decimal(5,2)), cast(0.1 AS decimal(5,2))) AS d").first()
    frame = spark.createDataFrame([row])
    got = frame.select(*(S.compacted(F.col(c)).alias(c) for c in frame.columns)).first()
    assert (got.s, got.f, got.b, got.a, got.i, [str(x) for x in got.d]) == (["0", "false", "x"], [1.5], [True], [[1]], [7, 10], ["0.100000000000000000"])


def test_peak_time_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        rows = spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS t UNION ALL SELECT timestamp'2024-01-02 12:00:00'")
        assert rows.agg(A.peak_time(F.col("t")).alias("at")).first().at == "11:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_pairs_of_a_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ITEMS", 7)
    rows = spark.createDataFrame([("g", i) for i in range(40)] + [("h", 1), ("h", 2), ("h", 2)], "g string, i int")
    got = {(r.a, r.b): r.n for r in J.co_occurrence(rows, "g", "i").collect()}
    assert got == {(a, b): 2 if (a, b) == (1, 2) else 1 for a in range(40) for b in range(a + 1, 40)}


def test_pairs_are_made_in_counted_tasks(spark, monkeypatch):
    """Tasks follow the pairs, whatever the planner would coalesce; nulls pair with nothing."""
    monkeypatch.setattr(J, "PAIRS_A_TASK", 50, raising=False)
    rows = spark.createDataFrame([(g, i) for g in range(30) for i in range(g % 5)] + [(None, 1), (None, 2), (1, None)], "g int, i int")
    found = J.co_occurrence(rows, "g", "i")
    assert {(r.a, r.b): r.n for r in found.collect()} == {(a, b): 6 * (4 - b) for b in range(1, 4) for a in range(b)}
    plan = found._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_available_functions_and_fixed_order(spark):
    from plumbline.functions.expressions import REGISTRY, REQUIRES, supported_functions

    assert set(supported_functions(spark)) == set(REGISTRY)
    REQUIRES["noop"] = ("no_such_function",)
    try:
        assert set(supported_functions(spark)) == set(REGISTRY) - {"noop"}
    finally:
        del REQUIRES["noop"]
    with pytest.raises(UnknownFunction):
        T.in_fixed_order(spark.range(3), sort=[])
