from collections import Counter

import numpy as np
import pytest

from plumbline.errors import MissingColumns, SpecError
from plumbline.operators.assignment import assign, water_level
from plumbline.operators.stages import run_stages
from plumbline.sources import jdbc

ROWS = [(1, "b", 2.0, [1, 2], ("x", 1)), (2, "a", None, [], ("y", 2)), (3, None, 5.0, None, None), (4, "ab", 5.0, [3], ("x", 3))]
SCHEMA = "id int, s string, x double, tags array<int>, o struct<k:string,n:int>"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(frame, *stages):
    return [r.id for r in run_stages(frame, list(stages)).collect()]


def test_match(frame):
    assert ids(frame, {"$match": {"x": {"$gt": 1, "$ne": 2.0}}}, {"$sort": {"id": 1}}) == [3, 4]
    assert ids(frame, {"$match": {"s": None}}) == [3] and ids(frame, {"$match": {"x": {"$exists": False}}}) == [2]
    assert ids(frame, {"$match": {"s": {"$in": ["a", None]}}}, {"$sort": {"id": 1}}) == [2, 3]
    assert ids(frame, {"$match": {"s": {"$nin": ["a", "b"]}}}, {"$sort": {"id": 1}}) == [3, 4]
    assert ids(frame, {"$match": {"s": {"$not": {"$regex": "^a"}}}}, {"$sort": {"id": 1}}) == [1, 3]
    assert ids(frame, {"$match": {"$nor": [{"o.k": "x"}, {"id": 2}]}}) == [3]
    assert ids(frame, {"$match": {"$expr": {"$gt": ["$id", "$x"]}}}) == []


def test_nulls_in_order(frame):
    assert ids(frame, {"$sort": {"s": 1}}) == [3, 2, 4, 1] and ids(frame, {"$sort": {"s": -1}}) == [1, 4, 2, 3]
    assert ids(frame, {"$sort": {"x": -1, "s": 1}}, {"$skip": 1}, {"$limit": 2}) == [4, 1]


def test_first_last_push_follow_the_order(frame):
    for sort, want in (({"x": -1, "s": -1}, [4, 3, 1, 2]), ({"s": -1, "x": 1}, [1, 4, 2, 3]), ({"s": 1}, [3, 2, 4, 1]), ({"o.k": -1, "id": -1}, [2, 4, 1, 3])):
        r = run_stages(frame, [{"$sort": sort}, {"$group": {"_id": None, "f": {"$first": "$id"}, "l": {"$last": "$id"}, "p": {"$push": "$id"}, "s": {"$first": "$s"}}}]).first()
        assert r.p == want and (r.f, r.l) == (want[0], want[-1]) and r.s == {1: "b", 2: "a", 3: None, 4: "ab"}[want[0]]


def test_group_unwind_project(frame):
    got = run_stages(frame, [{"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}}, {"$sort": {"id": 1, "i": 1}}]).collect()
    assert [(r.id, r.tags, r.i) for r in got] == [(1, 1, 0), (1, 2, 1), (2, None, None), (3, None, None), (4, 3, 0)]
    assert len(run_stages(frame, [{"$unwind": "$tags"}]).collect()) == 3
    got = run_stages(frame, [{"$group": {"_id": {"k": "$o.k"}, "n": {"$sum": 1}, "x": {"$sum": "$x"}, "a": {"$avg": "$x"}, "set": {"$addToSet": "$s"}}}, {"$project": {"_id": 0, "k": "$_id.k", "n": 1, "x": 1, "a": 1, "set": 1, "twice": {"$multiply": ["$n", 2]}, "in": {"deep": {"$ifNull": ["$a", -1.0]}}}}, {"$sort": {"k": 1}}]).collect()
    assert [(r.k, r.n, r.x, r.a, r.set, r.twice, r["in"].deep) for r in got] == [(None, 1, 5.0, 5.0, [], 2, 5.0), ("x", 2, 7.0, 3.5, ["ab", "b"], 4, 3.5), ("y", 1, 0.0, None, ["a"], 2, -1.0)]
    assert run_stages(frame, [{"$project": {"o": 0, "tags": 0}}]).columns == ["id", "s", "x"]
    assert run_stages(frame, [{"$match": {"id": 99}}, {"$group": {"_id": None, "n": {"$sum": 1}}}]).collect() == []
    assert run_stages(frame, [{"$match": {"x": 5.0}}, {"$count": "many"}]).first().many == 2
    r = run_stages(frame, [{"$match": {"id": 4}}, {"$set": {"c": {"$cond": [{"$in": [3, "$tags"]}, "yes", "no"]}, "w": {"$split": ["a.b", "."]}, "e": {"$arrayElemAt": ["$tags", -1]}, "l": {"$literal": "$id"}, "z": {"$divide": [1, 0]}}}]).first()
    assert (r.c, r.w, r.e, r.l, r.z) == ("yes", ["a", "b"], 3, "$id", None)


@pytest.mark.parametrize(
    ("stages", "match"),
    [
        ([{"$lookup": {}}], "stage 1 is not known: .lookup"), ([{"$match": {}}, {"$sort": {"id": 2}}], "stage 2 .sort: a direction"), ([{"$group": {"n": {"$sum": 1}}}], "no _id"), ([{"$group": {"_id": None, "n": {"$median": "$x"}}}], "not an accumulator"), ([{"$group": {"_id": None, "n": {"$first": "$x"}}}], "needs a .sort"),
        ([{"$set": {"a": {"$pow": [1, 2]}}}], "no operator .pow"), ([{"$set": {"a": {"$divide": [1]}}}], "takes 2 arguments"), ([{"$set": {"a": "$$NOW"}}], "no variable"), ([{"$match": {"x": {"$near": 1}}}], "no operator .near"), ([{"$project": {"id": 1, "x": 0}}], "either keeps or drops"), ([{"$match": {}, "$sort": {}}], "one key"), ([{"$limit": -1}], "whole number"), ([{"$unwind": "tags"}], "takes a path"),
    ],
)
def test_what_is_not_known_raises(frame, stages, match):
    with pytest.raises(SpecError, match=match):
        run_stages(frame, stages)


def test_missing_fields_raise_and_matches_are_pushed(spark, frame, tmp_path):
    for path in ("$nope", "$o.nope", "$s.k"):
        with pytest.raises(MissingColumns):
            run_stages(frame, [{"$set": {"a": path}}])
    frame.write.parquet(str(tmp_path / "p"))
    plan = run_stages(spark.read.parquet(str(tmp_path / "p")), [{"$match": {"id": {"$gte": 2}, "x": {"$lt": 9}}}, {"$project": {"id": 1}}])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,2)" in plan and "LessThan(x,9.0)" in plan and "tags" not in plan.split("ReadSchema")[1]


# assignment


def greedy(users, items, each):
    """One user after another takes the items with the lowest loads that are not their own."""
    loads = {i: load or 0 for i, _, load in items}
    authors = {i: a for i, a, _ in items}
    for u in users:
        for i in sorted((i for i in loads if authors[i] != u), key=lambda i: (loads[i], i))[:each]:
            loads[i] += 1
    return loads


@pytest.mark.parametrize(("n", "each", "most"), [(40, 3, 1), (40, 3, 6), (200, 5, 30), (7, 2, 3)])
def test_assignment(spark, n, each, most):
    rng = np.random.default_rng(n + most)
    users = [f"u{i}" for i in range(n)]
    items = [(1000 + i, users[i % n] if i % 11 else None, int(rng.integers(0, most)) if i % 7 else None) for i in range(n + n // 3)]
    made = assign(spark.createDataFrame([(u,) for u in [*users, users[0]]], "user string"), spark.createDataFrame(items, "item int, author string, load int"), each).collect()
    authors = {i: a for i, a, _ in items}
    assert Counter(r.user for r in made) == Counter({u: each for u in users})
    assert len({(r.user, r.item) for r in made}) == len(made)
    assert all(authors[r.item] != r.user for r in made)
    loads = Counter({i: load or 0 for i, _, load in items})
    loads.update(r.item for r in made)
    assert sorted(loads.values()) == sorted(greedy(users, items, each).values())


def test_tight_assignment(spark):
    """Everyone checks everyone else: there is exactly one answer."""
    users = [(f"u{i}",) for i in range(5)]
    items = [(i, f"u{i}", 0) for i in range(5)]
    made = assign(spark.createDataFrame(users, "user string"), spark.createDataFrame(items, "item int, author string, load int"), 4).collect()
    assert {(r.user, r.item) for r in made} == {(f"u{i}", j) for i in range(5) for j in range(5) if i != j}
    with pytest.raises(SpecError):
        assign(spark.createDataFrame(users, "user string"), spark.createDataFrame(items, "item int, author string, load int"), 5)
    assert assign(spark.createDataFrame([], "user string"), spark.createDataFrame(items, "item int, author string, load int"), 2).collect() == []


def test_water_level(spark):
    loads = spark.createDataFrame([(0, 2), (3, 1), (10, 5)], "load long, n long")
    for places in range(0, 19):
        level, rest = water_level(loads, places, 6)
        rise = [min(6, max(0, level - c)) for c in (0, 0, 3)]
        could = sum(c <= level and level - c < 6 for c in (0, 0, 3, *[10] * 5))
        assert sum(rise) + min(5 * max(0, level - 10), 30) + rest == places and (rest < could or rest == 0)


# writes that are applied once

URL, DRIVER = "jdbc:derby:memory:plumbline;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def stored(spark):
    return sorted(tuple(r) for r in spark.read.jdbc(URL, "goods", properties={"driver": DRIVER}).collect())


def test_writes_are_applied_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string").repartition(2)
    plain = jdbc._Connection.commit
    calls = {"n": 0}

    def fails_before(self):
        calls["n"] += 1
        if calls["n"] == 2:  # the first makes the status table
            raise RuntimeError("before the commit")
        plain(self)

    monkeypatch.setattr(jdbc._Connection, "commit", fails_before)
    with pytest.raises(RuntimeError, match="before"):
        jdbc.write_once(rows, URL, "goods", "load 1", DRIVER)
    assert stored(spark) == []
    monkeypatch.setattr(jdbc._Connection, "commit", plain)
    assert jdbc.write_once(rows, URL, "goods", "load 1", DRIVER) is True
    assert stored(spark) == [(1, "a"), (2, "b")]

    def fails_after(self):
        plain(self)
        raise RuntimeError("after the commit")

    monkeypatch.setattr(jdbc._Connection, "commit", fails_after)
    more = spark.createDataFrame([(3, None)], "id int, name string")
    with pytest.raises(RuntimeError, match="after"):
        jdbc.write_once(more, URL, "goods", "load 2", DRIVER)
    monkeypatch.setattr(jdbc._Connection, "commit", plain)
    assert jdbc.write_once(more, URL, "goods", "load 2", DRIVER) is False
    assert jdbc.write_once(rows, URL, "goods", "load 1", DRIVER) is False
    assert stored(spark) == [(1, "a"), (2, "b"), (3, None)]
    status = spark.read.jdbc(URL, jdbc.STATUS_TABLE, properties={"driver": DRIVER}).collect()
    assert sorted((r.WRITE_ID, r.MOVED) for r in status) == [("load 1", 2), ("load 2", 1)]
    assert jdbc.forget_writes(spark, URL, 24, DRIVER) == 0 and jdbc.forget_writes(spark, URL, -1, DRIVER) == 2
    assert jdbc.write_once(rows.where("id = 1"), URL, "goods", "load 1", DRIVER) is True and len(stored(spark)) == 4
