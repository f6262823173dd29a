from datetime import datetime

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import records as C
from plumbline.sources import files as R


def test_documents_merge(spark):
    schema = "id int, name string, parts array<struct<k:int,v:string>>"
    old = spark.createDataFrame([(1, "a", [(1, "x"), (2, "y")]), (2, "b", [])], schema)
    new = spark.createDataFrame([(1, None, [(2, "z"), (3, "w")]), (3, "c", None)], schema)
    got = {r.id: (r.name, sorted((p.k, p.v) for p in r.parts)) for r in C.merge_documents(old, new, "id", {"parts": "k"}).collect()}
    assert got == {1: ("a", [(1, "x"), (2, "z"), (3, "w")]), 2: ("b", []), 3: ("c", [])}


def test_histories_and_triage(spark):
    failures = spark.createDataFrame([("t1", "linux", "opt"), ("t1", "mac", "opt"), ("t1", "linux", "dbg"), ("t9", "linux", "opt")], "name string, platform string, config string")
    history = spark.createDataFrame([("t1", "linux", "opt")], failures.schema)
    assert sorted(r.confidence for r in C.history_confidence(failures, history, ["name", "platform", "config"]).collect()) == [0, 50, 75, 100]
    rows = spark.createDataFrame([("a", 1, 4, 20), ("b", 4, 4, 100), ("c", 3, 4, 95)], "name string, failures int, jobs int, confidence int")
    got = sorted(map(tuple, C.triage(rows, "name", "failures", "jobs", "confidence").collect()))
    assert got == [("a", "known issue", 20), ("b", "known issue", 100), ("c", "needs investigation", 90)]


def test_constraints_and_graphs(spark):
    held = spark.createDataFrame([(1, "a"), (2, "x"), (2, "y")], "config int, feature string")
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "feature string, needs string")
    assert sorted(map(tuple, C.derive_required(held, needs).collect())) == [(1, "a"), (1, "b"), (1, "c"), (2, "x"), (2, "y")]
    assert [tuple(r) for r in C.excluded_pairs(held, spark.createDataFrame([("x", "y")], "feature string, other string")).collect()] == [(2, "x", "y")]
    links = spark.createDataFrame([("p1", 1), ("p1", 2), ("p2", 2), ("p2", 3), ("p3", 3), ("p3", 4), ("p4", 5), ("p4", 6)], "photo string, person int")
    assert sorted(map(tuple, C.ego_edges(links, "photo", "person", 1).collect())) == [(1, 2), (2, 3)]


def test_counters_intervals_and_lines(spark):
    rows = spark.createDataFrame([("c", i, i in (2, 4)) for i in range(1, 6)], "k string, t int, bad boolean")
    assert [(r.message, r.error) for r in C.running_errors(rows, "k", ["t"], F.col("bad")).orderBy("t").collect()] == [(1, -1), (2, 1), (3, -1), (4, 2), (5, -1)]
    days = [datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    seen = spark.createDataFrame([(datetime(2024, 1, 1, 5),), (datetime(2024, 1, 3),)], "t timestamp")
    assert [r.n for r in C.interval_counts(seen, "t", days).collect()] == [1, 0, 1]
    lines = spark.createDataFrame([("u", 5), ("u", 50)], "unit string, line int")
    methods = spark.createDataFrame([("u", "outer", 1, 20), ("u", "inner", 4, 6)], "unit string, method string, start int, end int")
    assert [tuple(r) for r in C.method_at(lines, methods, "unit").collect()] == [("u", 5, "inner")]
    assert [r.id for r in C.shuffled(spark.range(5), "id", 1).collect()] == [r.id for r in C.shuffled(spark.range(5), "id", 1).collect()]
    assert [tuple(r) for r in spark.range(1).select(C.progress(F.lit(1), F.lit(8)), C.progress(F.lit(1), F.lit(0))).collect()] == [(13, -1)]


def test_scalar_texts(spark):
    got = spark.range(1).select(
        S.money_parts(F.lit("$1,234.50")).alias("m"),
        S.money_parts(F.lit("none")).alias("none"),
        S.escape_astral(F.lit("a\U0001f600é")).alias("astral"),
        S.folded_tokens(F.lit(" Crème  BRÛLÉE ")).alias("folded"),
        S.first_named(F.expr("array(named_struct('name', 'x', 'value', 1), named_struct('name', 'path', 'value', 2))"), ["value", "path"]).alias("named"),
    ).first()
    assert (float(got.m.value), got.m.currency, got.none, got.astral, got.folded, got.named) == (1234.5, "$", None, "a<U+01F600>é", ["creme", "brulee"], 2)
    rows = spark.sql("SELECT 1 AS a, cast(null as string) AS b").select(S.compact_json("a", "b").alias("j"))
    assert rows.first().j == '{"a":1}'


def test_more_sources(spark):
    log = spark.createDataFrame([(b"k", b'{"x": 3}')], "key binary, value binary")
    r = R.decode_records(log, "x int").first()
    assert (r.key, r.value.x, r["size"]) == ("k", 3, 9)
    assert [r.id for r in R.before_key(spark.range(10), "id", 7, 3).collect()] == [6, 5, 4]
    R.create_table_as(spark.range(3), "three")
    assert spark.table("three").count() == 3
    times = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 2, 1),), (None,)], "t timestamp")
    assert R.delete_before(times, "t", F.lit(datetime(2024, 1, 15))).count() == 2
