from datetime import date, datetime
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.errors import MissingColumns, SpecError
from plumbline.functions.query_string import parse, query_column, query_filter

SCHEMA = "id int, tag string, n long, x double, d decimal(8,2), ok boolean, day date, at timestamp, tags array<string>, s struct<k string, m int>, js string, body string"
ROWS = [
    (1, "red", 5, 1.5, Decimal("10.00"), True, date(2024, 1, 5), datetime(2024, 1, 5, 10), ["a", "b"], ("u", 1), '{"k": 12, "q": {"w": "deep"}}', "The quick-brown fox"),
    (2, "red wine", 15, 2.5, Decimal("10.50"), False, date(2024, 2, 29), datetime(2024, 2, 29, 23, 59, 59), ["b"], ("v", 2), '{"k": 7}', "brown Quick"),
    (3, "a*b:c(d)", -3, None, None, None, date(2023, 12, 31), datetime(2023, 12, 31), [], None, "no json", "über 100% wahr"),
    (4, None, None, 0.0, Decimal("0.00"), True, None, None, None, ("u", None), None, None),
    (5, "RED", 5, -1.0, Decimal("99.99"), False, date(2024, 1, 5), datetime(2024, 1, 5, 23, 30), ["c", "red"], ("w", 5), '{"k": "x"}', "foxes; quick"),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).persist()


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("tag:red", [1]), ('tag:"red wine"', [2]), (r"tag:red\ wine", [2]), (r"tag:a\*b\:c\(d\)", [3]), ("tag:red*", [1, 2]), ("tag:?ed", [1]), ("tag:*", [1, 2, 3, 5]), ("_exists_:x", [1, 2, 4, 5]), ("*:*", [1, 2, 3, 4, 5]), ("", [1, 2, 3, 4, 5]),
        ("NOT tag:red", [2, 3, 4, 5]), ("-tag:red", [2, 3, 4, 5]), ("NOT NOT tag:red", [1]), ("NOT _exists_:tag", [4]),
        ("n:5", [1, 5]), ("n:[5 TO 15]", [1, 2, 5]), ("n:{5 TO 15]", [2]), ("n:[* TO 5}", [3]), ("n:>=5 AND n:<15", [1, 5]), (r"n:\-3", [3]), ("n:>4.5", [1, 2, 5]), ("n:[* TO *]", [1, 2, 3, 5]), ("NOT n:>5", [1, 3, 4, 5]),
        ("x:1.5", [1]), ("d:10.5", [2]), ("d:[10 TO 10.5]", [1, 2]), ("ok:true", [1, 4]), ("NOT ok:true", [2, 3, 5]),
        ("day:2024-01-05", [1, 5]), ("day:2024", [1, 2, 5]), ("at:2024-01-05", [1, 5]), ("at:2024-01-05T10", [1]), ("at:[2024-01 TO 2024-01-05]", [1, 5]), ("at:{2024-01 TO *]", [2]), ("at:>2024-01-05", [2]), ("at:<2024-01-05T10:00:01", [1, 3]), ("day:{2023 TO 2024-01]", [1, 5]), ("at:[* TO 2024-02-29T23:59:59]", [1, 2, 3, 5]),
        ("tags:b", [1, 2]), ("tags:(a OR c)", [1, 5]), ("NOT tags:b", [3, 4, 5]), ("tags:re*", [5]), ("s.k:u", [1, 4]), ("s.m:>1", [2, 5]), ("NOT s.m:>1", [1, 3, 4]), ("js.k:12", [1]), ("js.k:>7", [1]), ("js.k:>=7", [1, 2]), ("js.q.w:deep", [1]), ("js.k:>w", [5]),
        ("tag:/r.d/", [1]), ("tag:/[rR](ed|ED).*/", [1, 2, 5]), (r"tag:/a.b:c\(d\)/", [3]),
        ("tag:red OR tag:RED AND n:6", [1]), ("(tag:red OR tag:RED) AND n:5", [1, 5]), ("tag:red tag:RED", [1, 5]), ("+ok:true tag:red", [1, 4]), ("+ok:true +n:5", [1]), ("tag:red tag:RED -ok:true", [5]), ("+n:5 -ok:false x:1", [1]), ("tag:red || n:15 && ok:false", [1, 2]), ("!tag:red AND ok:true", [4]), ("n:(5 15)", [1, 2, 5]), ("n:(+>4 -15)", [1, 5]), ("tag:red^2 OR n:15^0.5", [1, 2]),
        ("quick", [1, 2, 5]), ('"quick brown"', [1]), ("fox", [1]), ("fox*", [1, 5]), ("ÜBER", [3]), ("body:(quick AND NOT brown)", [5]), ('"100%"', [3]), ("nothing", []),
    ],
)
def test_rows(frame, text, ids):
    got = query_filter(frame, text, fields=["body"], analyzed=["body"])
    assert sorted(r.id for r in got.collect()) == ids


def test_default_and(frame):
    where = query_column(frame, "ok:true n:5 OR tag:RED", default_and=True)
    assert sorted(r.id for r in frame.where(where).collect()) == [1, 5]


@pytest.mark.parametrize(
    ("text", "at"),
    [("a:1 AND", 7), ("(a:1", 4), ("a:1)", 3), ('a:"x', 2), ("a:[1 2]", 5), ("a:[1 TO 2", 9), ("AND a:1", 0), ("a:", 2), ("a:x~2", 3), ("a:1^y", 3), ("a:/(/", 2), ("a:/x", 2), ("a:()", 3), ("a:1 OR OR b:2", 7), ("a:x\\", 3), ("a:[ TO 3]", 4), ("a*:1", 0), ("a:1 ]", 4)],
)
def test_errors_name_the_position(text, at):
    with pytest.raises(SpecError, match=f"at position {at}$"):
        parse(text)


def test_errors_of_values_and_fields(frame):
    for text, at in (("n:abc", 2), ("id:1 AND at:yesterday", 12), ("ok:maybe", 3), ("at:2024-13", 3), ("d:1x", 2), ("red", 0)):
        with pytest.raises(SpecError, match=f"position {at}$"):
            query_column(frame, text)
    for text in ("missing:1", "s.missing:1", "n.k:1"):
        with pytest.raises(MissingColumns):
            query_column(frame, text)


def test_scans_see_the_filters(spark, frame, tmp_path):
    frame.drop("s", "tags").write.parquet(str(tmp_path / "p"))
    rows = query_filter(spark.read.parquet(str(tmp_path / "p")), "tag:red* AND n:[3 TO 9] AND NOT x:2.5", "at", datetime(2024, 1, 1), datetime(2024, 12, 31), id=1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    plan = rows.select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x).split("PushedFilters:")[1]
    for part in ("StringStartsWith(tag,red)", "GreaterThanOrEqual(n,3)", "LessThanOrEqual(n,9)", "Or(Not(EqualTo(x,2.5)),IsNull(x))", "EqualTo(id,1)", "GreaterThanOrEqual(at,"):
        assert part in pushed, pushed
    assert [r.id for r in rows.collect()] == [1]


words = st.sampled_from(["a:1", "b:x", "c:[1 TO 2]", "_exists_:a"])
trees = st.recursive(words, lambda inner: st.one_of(st.tuples(inner, st.sampled_from([" AND ", " OR ", " && ", " || "]), inner).map("".join), inner.map("({})".format), inner.map("NOT ({})".format)), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(trees)
def test_precedence_is_that_of_booleans(text):
    """AND binds tighter than OR, NOT tighter than AND: held against Python's own operators."""
    names = {"a:1": "p", "b:x": "q", "c:[1 TO 2]": "r", "_exists_:a": "s"}

    def holds(node, world):
        if not hasattr(node, "parts"):
            key = {"a": "s" if node.kind == "exists" else "p", "b": "q", "c": "r"}[node.field]
            return world[key]
        found = [holds(p, world) for p in node.parts]
        return {"and": all, "or": any, "not": lambda x: not x[0]}[node.kind](found)

    code = text
    for k, v in names.items():
        code = code.replace(k, v)
    code = code.replace("&&", "and").replace("||", "or").replace("AND", "and").replace("OR", "or").replace("NOT", "not")
    for bits in range(16):
        world = {k: bool(bits >> i & 1) for i, k in enumerate("pqrs")}
        assert holds(parse(text), world) == eval(code, {}, world)  # noqa: S307  built above from four names
