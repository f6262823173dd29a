import pytest

from plumbline.errors import MissingColumns, SpecError, UnknownFunction
from plumbline.functions.expressions import REGISTRY, apply_filter, columns_of, compile_tree, register


def col(c):
    return {"column_name": [c]}


def lit(v):
    return {"literal": [v]}


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(i, list(range(i % 5)), '["a","b","c"]' if i % 2 else "[]", f"http://u{i}@h{i}.org/p?q#f", f"n{i}@mail.org") for i in range(10)]
    return spark.createDataFrame(rows, "id int, xs array<int>, js string, uri string, mail string")


def test_trees(arrays):
    tree = {"and": [{"greater": [col("id"), lit(2)]}, {"or": [{"equal": [col("id"), lit(4)]}, {"null": [col("js")]}, {"not": [{"lesser": [col("id"), lit(8)]}]}]}]}
    assert sorted(r.id for r in apply_filter(arrays, tree).collect()) == [4, 8, 9]
    assert columns_of(tree) == {"id", "js"}


@pytest.mark.parametrize(
    ("tree", "n"),
    [
        ({"array_length_equals": [col("xs"), lit(3)]}, 2),
        ({"array_length_greater_or_equal": [col("xs"), lit(3)]}, 4),
        ({"array_not_empty": [col("xs")]}, 8),
        ({"array_contains": [col("xs"), lit(0), lit(1)]}, 6),
        ({"json_array_length_equals": [col("js"), lit(3)]}, 5),
        ({"json_array_contains": [col("js"), lit('["c","a"]')]}, 5),
        ({"json_array_not_empty": [col("js")]}, 5),
        ({"uri_scheme_equals": [col("uri"), lit("http")]}, 10),
        ({"uri_authority_contains": [col("uri"), lit("h3")]}, 1),
        ({"email_domain_equals": [col("mail"), lit("mail.org")]}, 10),
        ({"starts_with_case_insensitive": [col("mail"), lit("N1")]}, 1),
        ({"contains": [col("mail"), lit("N1")]}, 0),
        ({"in": [col("id"), lit(1), lit(3)]}, 2),
    ],
)
def test_functions(arrays, tree, n):
    assert apply_filter(arrays, tree).count() == n


def test_errors(arrays):
    for bad in ([], {"a": [], "b": []}, {"and": 3}, {"literal": [[1]]}):
        with pytest.raises(SpecError):
            compile_tree(bad)
    with pytest.raises(UnknownFunction):
        compile_tree({"nope": []})
    with pytest.raises(MissingColumns):
        apply_filter(arrays, {"null": [col("absent")]})


def test_registering_a_function(arrays):
    @register("double")
    def double(a):
        return a * 2

    assert apply_filter(arrays, {"equal": [{"double": [col("id")]}, lit(8)]}).count() == 1
    del REGISTRY["double"]
