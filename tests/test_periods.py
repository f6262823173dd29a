from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import periods as P


def d(*x):
    return datetime(*x, tzinfo=UTC)


def test_grammar():
    assert P.instants("2014,2015-06") == [d(2014, 1, 1), d(2015, 6, 1)]
    assert P.instants("2014-01-31/2014-05-15/P1M") == [d(2014, 1, 31), d(2014, 2, 28), d(2014, 3, 31), d(2014, 4, 30)]
    assert P.instants("2014-01-01T10:00/2014-01-01T12:30/PT1H") == [d(2014, 1, 1, h) for h in (10, 11, 12)]
    assert P.instants("#/2015", first=d(2010, 1, 1)) == [d(2010, 1, 1), d(2015, 1, 1)]
    for bad in ("x", "2015/2014", "2014/2015/P", "#/2015"):
        with pytest.raises(ValueError):
            P.instants(bad)


def test_intervals_and_boxes(spark):
    rows = spark.sql("SELECT timestamp'2014-01-01' a, cast(null as timestamp) b, 8.5 x, 49.4 y UNION ALL SELECT timestamp'2014-01-01', timestamp'2014-06-01', 9.5, 49.4")
    at = P.spine(spark, P.instants("2014-01-01/2015-01-01/P6M"))
    got = at.join(rows, P.valid_at(F.col("a"), F.col("b"), F.col("at"))).groupBy("at").count().orderBy("at").collect()
    assert [r["count"] for r in got] == [2, 1, 1]
    assert rows.where(P.in_box(F.col("x"), F.col("y"), (8.0, 49.0, 9.0, 50.0))).count() == 1
    assert rows.select(P.active(F.lit(True), F.col("b"), F.lit("2014-07-01").cast("timestamp")).alias("k")).where("k").count() == 1
