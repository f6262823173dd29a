from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions.money import currency_text, indel_ratio, money_amount, with_currency
from plumbline.operators import intervals as I


def test_amounts_of_locales(spark):
    rows = {
        "$1,234.50": 1234.5, "1.234,50 €": 1234.5, "1 234,5": 1234.5, "CHF 1'234.50": 1234.5, "1 234 567": 1234567, "1,234,567": 1234567, "1.234.567": 1234567, "1,234": 1234, "1.234": 1234, "1,23": 1.23, "1.2345": 1.2345, "12": 12, "0,5": 0.5,
        "(5.00)": -5, "-5": -5, "5-": -5, "- $5": -5, "−7,5": -7.5, "1,234,567.891": 1234567.891, "1.234.567,8": 1234567.8, "no": None, "": None, None: None, "2 or 3": 2, "1’000.25": 1000.25,
    }
    frame = spark.createDataFrame([(k,) for k in rows], "t string").select("t", money_amount(F.col("t")).alias("v"), currency_text(F.col("t")).alias("c"))
    got = {r.t: r for r in frame.collect()}
    assert {k: None if got[k].v is None else float(got[k].v) for k in rows} == rows
    assert got["$1,234.50"].c == "$" and got["1.234,50 €"].c == "€" and got["CHF 1'234.50"].c == "CHF" and got["12"].c is None


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, new = row, [0]
        for j, y in enumerate(b, 1):
            new.append(before[j - 1] + 1 if x == y else max(new[j - 1], before[j]))
        row = new
    return row[-1]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab€", max_size=5), st.text(alphabet="ab€c", max_size=5)), min_size=1, max_size=20))
def test_ratio_is_by_the_longest_common_subsequence(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in rows:
        assert r.r == pytest.approx(200 * common(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 100)


def test_currencies_by_likeness(spark):
    known = spark.createDataFrame([("USD", "$"), ("EUR", "€"), ("AUD", "A$"), ("XXX", None)], "code string, symbol string")
    rows = spark.createDataFrame([(1, "$5"), (2, "5 A$"), (3, "eur 5"), (4, "5"), (5, "5 qqq"), (6, None), (7, "5 EURO"), (1, "$5")], "id int, t string")
    out = with_currency(rows, "t", known)
    assert out.columns == ["id", "t", "currency"]
    assert sorted((r.id, r.currency) for r in out.collect()) == [(1, "USD"), (1, "USD"), (2, "AUD"), (3, "EUR"), (4, None), (5, None), (6, None), (7, "EUR")]
    assert with_currency(rows, "t", known.limit(0)).where("currency is not null").count() == 0


def test_users_of_intervals(spark):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame([(start + timedelta(hours=h), u, 0) for h, u in ((0, "a"), (1, "a"), (23, "b"), (24, "b"), (30, None))] + [(None, "z", 0)], "at timestamp, who string, to int")
    days = spark.createDataFrame([(start, start + timedelta(days=1)), (start, start + timedelta(days=2)), (start + timedelta(days=5), start + timedelta(days=6)), (start, start)], "`from` timestamp, `to` timestamp")
    got = sorted(((r["to"] - start).total_seconds() / 86400, r.n, r.users) for r in I.interval_statistics(events, "at", days, "who", 86400.0).collect())
    assert got == [(0, 0, 0), (1, 3, 2), (2, 5, 2), (6, 0, 0)]


def test_boxes_and_centroids(spark):
    square, hole, turned = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(2.0, 1.0), (3.0, 1.0), (3.0, 3.0), (2.0, 3.0)], [(2.0, 3.0), (3.0, 3.0), (3.0, 1.0), (2.0, 1.0)]
    rows = spark.createDataFrame([(1, [square]), (2, [square, hole]), (3, [square, turned]), (4, []), (5, None), (6, [[(1.0, 1.0), (2.0, 2.0), (1.0, 1.0)]])], "id int, rings array<array<struct<x:double,y:double>>>")
    got = {r.id: (r.b and tuple(r.b), r.c and tuple(r.c)) for r in rows.select("id", I.bounding_box(F.col("rings")).alias("b"), I.centroid(F.col("rings")).alias("c")).collect()}
    assert got[1] == ((0, 0, 4, 4), (2, 2)) and got[4] == (None, None) and got[5] == (None, None) and got[6] == ((1, 1, 2, 2), None)
    assert got[2][1] == pytest.approx(((16 * 2 - 2 * 2.5) / 14, 2)) == got[3][1]
