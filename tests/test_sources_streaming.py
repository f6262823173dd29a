from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.errors import UnsupportedFormat
from plumbline.plans.ranking import sliced_lag, sliced_place
from plumbline.sources import files as R
from plumbline.streaming import sampling as M


def test_formats_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", text'), (2, ""), (3, None), (4, "two\nlines")], "id int, s string")
    for kind in ("csv", "tsv", "jsonl", "parquet", "orc"):
        R.write(rows, kind, str(tmp_path / kind))
        back = R.read(spark, kind, str(tmp_path / kind))
        got = sorted((int(r.id), r.s) for r in back.select("id", "s").collect())
        assert got == [(1, 'a "quoted", text'), (2, ""), (3, None), (4, "two\nlines")], kind
    with pytest.raises(UnsupportedFormat):
        R.read(spark, "xlsx", "x")
    with pytest.raises(UnsupportedFormat):
        R.write(rows, "xlsx", "x")


def test_names_types_and_flattening(spark):
    assert R.clean_names([" a ", "", "id", "a", "x" * 70]) == ["a", "column_1", "id_original", "a_2", "x" * 63]
    rows = spark.createDataFrame([("1", "true", "1.5", "2024-01-01", "x"), ("22", None, "2", "2024-02-01", "1")], "a string, b string, c string, d string, e string")
    assert R.inferred_types(rows) == {"a": "bigint", "b": "boolean", "c": "decimal(38,10)", "d": "date", "e": "string"}
    assert [t for _, t in R.typed(rows, R.inferred_types(rows)).dtypes][:2] == ["bigint", "boolean"]
    nested = spark.sql("SELECT named_struct('b', named_struct('c', 1), 'd', 2) AS a, 3 AS e")
    assert R.flattened(nested).columns == ["a.b.c", "a.d", "e"] and R.flattened(nested, 1).columns == ["a.b", "a.d", "e"]


def test_row_changes(spark):
    target = spark.createDataFrame([(1, "t1", "x")], "id int, title string, author string")
    source = spark.createDataFrame([("n", "b")], "author_name string, book_title string")
    out = R.insert_select(target, source, [("author_name", "author"), ("book_title", "title")])
    assert sorted(map(str, out.collect())) == sorted(["Row(id=1, title='t1', author='x')", "Row(id=None, title='b', author='n')"])
    events = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 1, 7)), (3, None)], "id int, t timestamp")
    at = 1704085200 + 0
    assert sorted(r.id for r in R.delete_range(events, "t", at, at + 3600).collect()) == [2, 3]
    with pytest.raises(ValueError):
        R.delete_range(events, "t", 1, 3600)
    assert R.upsert(spark.createDataFrame([("k", 1), ("k", 2)], "k string, t int"), ["k"], "t").collect()[0].t == 2


def test_stream_sampling_matches_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 2}", datetime(2024, 1, 1, 0, i // 60, i % 60)) for i in range(60)], "id long, user string, t timestamp").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = M.stream_sample_every(stream, "user", 10).writeStream.format("memory").queryName("sampled").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.id for r in spark.table("sampled").collect())
    assert got == sorted(r.id for r in M.sample_every(rows, "user", "t", 10).collect()) == [0, 1, 20, 21, 40, 41]
    good, bad = [], []
    q = M.route_errors(stream, F.col("id") % 10 == 0, lambda d: good.append(d.count()), lambda d: bad.append(d.count())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(60)
    assert (sum(good), sum(bad)) == (54, 6)
    q = M.stream_histogram(stream, "t", "10 seconds", "0 seconds", ["user"]).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.n for r in spark.table("windows").collect()} == {5}


def test_lag_and_retraction(spark):
    offsets = spark.createDataFrame([("g", 0, 5, 9), ("g", 1, 5, 9), ("g", 2, 7, 6)], "g string, partition int, committed long, log_end long")
    assert tuple(M.consumer_lag(offsets, ["g"]).first()) == ("g", 8, 4, 0)
    rows = spark.createDataFrame([("p", 4.0, 1), ("p", 2.0, 1), ("p", 4.0, -1), ("q", 1.0, 1), ("q", 1.0, -1)], "k string, v double, sign int")
    assert [tuple(r) for r in M.signed_statistics(rows, ["k"], "v", "sign").collect()] == [("p", 2.0, 1)]


def test_separators_keys_xml_and_geojson(spark, tmp_path):
    for sep in R.SEPARATORS:
        path = tmp_path / f"file{R.SEPARATORS.index(sep)}.csv"
        path.write_text(f'a{sep}"b{sep}{sep}"{sep}c\n1{sep}"x,;|"{sep}3\n')
        assert R.sniffed_separator(spark, str(path)) == sep
        assert R.read(spark, "csv", str(path), sep=sep).columns == ["a", f"b{sep}{sep}", "c"]
    lines = spark.createDataFrame([('{"z": 1, "a": {"q": 2}}',), ('{"b": 1, "a": 3}',)], "value string").coalesce(1)
    assert R.first_seen_keys(lines) == ["z", "a", "b"]
    (tmp_path / "bad.json").write_text('{"a": 1,')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|corrupt|parse"):
        R.read(spark, "json", str(tmp_path / "bad.json")).collect()
    (tmp_path / "r.xml").write_text("<rows><row><a>1</a><b>x</b></row><row><a>2</a></row></rows>")
    assert sorted((r.a, r.b) for r in R.read(spark, "xml", str(tmp_path / "r.xml"), rowTag="row").collect()) == [(1, "x"), (2, None)]
    R.write(spark.createDataFrame([(1.5, 2.0, "n", None)], "x double, y double, name string, none string"), "geojson", str(tmp_path / "g"), lon="x", lat="y")
    assert [r.value for r in spark.read.text(str(tmp_path / "g")).collect()] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.0]},"properties":{"name":"n"}}']


def test_slices_of_a_key_join_up(spark):
    rows = [(i, "hot" if i % 4 else None, datetime(2024, 1, 1 + i // 24, i % 24) if i % 10 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "id long, k string, t timestamp")
    for seconds in (3600.0, 20000.0, 1e9):
        placed = {r.id: r.p for r in sliced_place(frame, "k", "t", ["id"], "p", seconds).collect()}
        lagged = {r.id: r.b for r in sliced_lag(frame, "k", "t", ["id"], "b", seconds).collect()}
        for k in ("hot", None):
            mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2] is not None, r[2] or datetime(1, 1, 1), r[0]))
            assert [placed[r[0]] for r in mine] == list(range(1, len(mine) + 1))
            assert [lagged[r[0]] for r in mine] == [None, *(r[2] for r in mine[:-1])]


def test_the_first_message_of_a_key_is_always_sampled(spark):
    rows = spark.createDataFrame([(i, f"u{i % 50}", datetime(2024, 1, 1, i // 60, i % 60)) for i in range(500)] + [(999, None, datetime(2024, 1, 2))], "id long, k string, t timestamp")
    got = {r.id for r in M.sample_share(rows, "id", 0.01, "k", "t").collect()}
    assert set(range(50)) | {999} <= got and len(got) < 80
    assert got - set(range(50)) - {999} <= {r.id for r in M.sample_share(rows, "id", 0.01).collect()}


def test_a_rate_window_opens_with_the_first_request(spark, tmp_path):
    rows = [("a", 5, 1), ("a", 12, 2), ("a", 15, 1), ("b", 9, 5), ("a", 24, 1), ("a", 25, 1), ("a", 36, 1)]
    frame = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, 0, s), w) for k, s, w in rows], "k string, t timestamp, w int").coalesce(1)
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = M.stream_rate_windows(stream, "k", "t", 10, "w", 3).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    base = 1704067200
    got = sorted((r.k, r.t.second, r.window_start - base, r.used, r.reset - base, r.exceeded) for r in spark.table("rates").collect())
    assert got == [("a", 5, 5, 1, 15, False), ("a", 12, 5, 3, 15, False), ("a", 15, 15, 1, 25, False), ("a", 24, 15, 2, 25, False), ("a", 25, 25, 1, 35, False), ("a", 36, 36, 1, 46, False), ("b", 9, 9, 5, 19, True)]
