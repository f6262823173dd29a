from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.errors import MissingColumns, SpecError
from plumbline.functions import sql_functions as Q
from plumbline.operators import joins as J
from plumbline.plans.flow import ForeignKey, InitialColumn, initial_columns

BOOK, AUTHOR, TOWN = ForeignKey("book", "author", "author", "id"), ForeignKey("author", "home", "town", "id"), ForeignKey("book", "printed", "town", "id")


@pytest.fixture(scope="module")
def tables(spark):
    found = {
        "book": spark.createDataFrame([(1, "a", 1, 10), (2, "b", 2, 11), (3, "c", None, None)], "id int, title string, author int, printed int"),
        "author": spark.createDataFrame([(1, "X", 10), (2, "Y", None)], "id int, name string, home int"),
        "town": spark.createDataFrame([(10, "P"), (11, "Q")], "id int, name string"),
    }
    return found.__getitem__


def test_columns_over_paths(tables):
    columns = [InitialColumn("title", "title"), InitialColumn("name", "home", (BOOK, AUTHOR)), InitialColumn("name", "printed", (TOWN,)), InitialColumn("name", "author", (BOOK,)), InitialColumn("id", "author_id", (BOOK,))]
    out = initial_columns(tables, "book", columns)
    assert out.columns == ["title", "home", "printed", "author", "author_id"]
    assert sorted(map(tuple, out.collect())) == [("a", "P", "P", "X", 1), ("b", None, "Q", "Y", 2), ("c", None, None, None, None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # the path to the author is one join


def test_paths_against_the_keys_direction(tables):
    out = initial_columns(tables, "town", [InitialColumn("name", "town"), InitialColumn("title", "book", (AUTHOR, BOOK)), InitialColumn("name", "author", (AUTHOR,))])
    assert sorted(map(tuple, out.collect())) == [("P", "a", "X"), ("Q", None, None)]


def test_paths_that_do_not_lead_on(tables):
    with pytest.raises(SpecError, match="does not lead on"):
        initial_columns(tables, "book", [InitialColumn("name", "n", (AUTHOR,))])
    with pytest.raises(MissingColumns):
        initial_columns(tables, "book", [InitialColumn("nope", "n", (BOOK,))])


def test_directions_of_joinable_tables(spark):
    edges = spark.createDataFrame([(1, "book", "author"), (2, "author", "town")], "id int, source string, target string")
    got = sorted((r.base, r.target, r.path, r.reversed, r.depth) for r in J.joinable_tables(edges, "author").collect())
    assert got == [("author", "book", [1], [True], 1), ("author", "town", [2], [False], 1)]


def test_sql_functions(spark):
    assert Q.register_functions(spark) == sorted(Q.SQL_FUNCTIONS)
    row = spark.sql(
        "SELECT uri_scheme('http://a.b/c?d=1#e') s, uri_authority('http://a.b/c') a, uri_path('x:/p') p, uri_query('?d=1') q, uri_fragment('#e') f, uri_scheme('none') n, uri_path(null) z, is_email('a@b.c') m, is_email('a b') k, email_domain_name('a@b.c') d, email_local_part('a@b.c') l,"
        " truncate_to_day(timestamp'2024-03-05 12:00:00') td, truncate_to_month(timestamp'2024-03-05') tm, truncate_to_year(timestamp'2024-03-05') ty, relative_difference(4, 5) rd, relative_difference(0, 5) r0, magnitude(12345) g, floor_to_seconds(timestamp'2024-03-05 12:34:56', 900) fl,"
        " json_array_contains('[\"x\", \"y\"]', '[\"y\"]') c, great_circle_km(0, 0, 0, 90) km"
    ).first()
    assert (row.s, row.a, row.p, row.q, row.f, row.n, row.z) == ("http", "a.b", "/p", "d=1", "e", None, None)
    assert (row.m, row.k, row.d, row.l, row.td, row.tm, row.ty) == (True, False, "b.c", "a", "2024-03-05", "2024-03", 2024)
    assert (row.rd, row.r0, row.g, row.fl, row.c) == (0.25, None, 3, datetime(2024, 3, 5, 12, 30), True) and round(row.km, 3) == 10007.543
    with pytest.raises(SpecError):
        Q.register_functions(spark, ["nope"])


def test_tags_survive_a_table(spark, tmp_path):
    rows = Q.tagged(spark.createDataFrame([("1.50", "x@y.z", "n")], "m string, e string, n string"), m="money", e="email")
    rows.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert Q.tags(back) == {"m": "money", "e": "email"}
    out = Q.downcasted(back.select("m", "e", "n").where(F.col("n") == "n"))
    assert dict(out.dtypes) == {"m": "decimal(38,10)", "e": "string", "n": "string"} and Q.tags(out) == {}
    with pytest.raises(SpecError):
        Q.tagged(rows, m="colour")
