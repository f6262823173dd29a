"""Pipelines of stage documents ($match, $group, $project, $sort, $unwind, ...) compiled to one plan.

Expressions are nested documents: "$a.b" is a field, {"$cond": [test, then, else]}
and the other operators of ``EXPRESSIONS`` compute, and what is neither is a
literal. A stage or operator that is not known raises SpecError with its place.

A $sort sorts rows only where rows of an order come out or are cut; before a
$group its order is kept for $first, $last and $push, which are aggregates over
an order key, so that no group is sorted in a window. As in document databases,
nulls come first in ascending and last in descending order, $sum of nothing is 0
and comparisons with null are false.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, mul, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import MissingColumns, SpecError


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _cond(args: Any, c: Callable[[Any], Column]) -> Column:
    if isinstance(args, dict):
        if set(args) != {"if", "then", "else"}:
            raise SpecError("$cond takes if, then and else")
        args = [args["if"], args["then"], args["else"]]
    if not isinstance(args, list) or len(args) != 3:
        raise SpecError("$cond takes three arguments")
    return F.when(_known(c(args[0]).cast("boolean")), c(args[1])).otherwise(c(args[2]))


def _switch(args: Any, c: Callable[[Any], Column]) -> Column:
    out: Any = F
    for branch in args.get("branches", []):
        out = out.when(_known(c(branch["case"])), c(branch["then"]))
    if out is F:
        raise SpecError("$switch has no branches")
    return out.otherwise(c(args["default"])) if "default" in args else out


def _fold(combine: Callable) -> Callable[..., Column]:
    return lambda *a: reduce(combine, a)


#: Operators of evaluated arguments: name -> (fewest, most, builder).
EXPRESSIONS: dict[str, tuple[int, int, Callable[..., Column]]] = {
    "$add": (1, 99, _fold(add)), "$multiply": (1, 99, _fold(mul)), "$subtract": (2, 2, lambda a, b: a - b), "$divide": (2, 2, lambda a, b: F.try_divide(a, b)), "$mod": (2, 2, lambda a, b: F.try_mod(a, b)),
    "$abs": (1, 1, F.abs), "$floor": (1, 1, F.floor), "$ceil": (1, 1, F.ceil),
    "$eq": (2, 2, lambda a, b: a.eqNullSafe(b)), "$ne": (2, 2, lambda a, b: ~a.eqNullSafe(b)), "$gt": (2, 2, lambda a, b: _known(a > b)), "$gte": (2, 2, lambda a, b: _known(a >= b)), "$lt": (2, 2, lambda a, b: _known(a < b)), "$lte": (2, 2, lambda a, b: _known(a <= b)),
    "$and": (1, 99, lambda *a: reduce(and_, map(_known, a))), "$or": (1, 99, lambda *a: reduce(or_, map(_known, a))), "$not": (1, 1, lambda a: ~_known(a)), "$in": (2, 2, lambda a, b: _known(F.array_contains(b, a))),
    "$ifNull": (2, 99, F.coalesce), "$concat": (1, 99, F.concat), "$toLower": (1, 1, F.lower), "$toUpper": (1, 1, F.upper), "$split": (2, 2, lambda a, b: F.split(a, F.concat(F.lit("\\Q"), b, F.lit("\\E")))), "$strLenCP": (1, 1, F.length), "$substrCP": (3, 3, lambda a, i, n: F.substring(a, i + 1, n)),
    "$size": (1, 1, F.size), "$arrayElemAt": (2, 2, lambda a, i: F.when(i >= 0, F.get(a, i)).otherwise(F.try_element_at(a, i))), "$year": (1, 1, F.year), "$month": (1, 1, F.month), "$dayOfMonth": (1, 1, F.dayofmonth), "$toString": (1, 1, lambda a: a.cast("string")), "$toDouble": (1, 1, lambda a: a.try_cast("double")), "$toLong": (1, 1, lambda a: a.try_cast("long")),
}
ACCUMULATORS = ("$sum", "$avg", "$min", "$max", "$count", "$first", "$last", "$push", "$addToSet")


class _Pipeline:
    def __init__(self, df: DataFrame) -> None:
        self.df, self.order = df, []

    # expressions

    def field(self, path: str) -> Column:
        kind: T.DataType = self.df.schema
        column: Column | None = None
        for part in path.split("."):
            element = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if not isinstance(element, T.StructType) or part not in element.names:
                raise MissingColumns([path])
            column = F.col(f"`{part}`") if column is None else column[part]
            kind = T.ArrayType(element[part].dataType) if isinstance(kind, T.ArrayType) else element[part].dataType
        return column

    def value(self, spec: Any) -> Column:
        if isinstance(spec, str) and spec.startswith("$$"):
            raise SpecError(f"no variable {spec}")
        if isinstance(spec, str) and spec.startswith("$"):
            return self.field(spec[1:])
        if isinstance(spec, list):
            return F.array(*map(self.value, spec))
        if not isinstance(spec, dict):
            return F.lit(spec)
        operators = [k for k in spec if k.startswith("$")]
        if not operators:
            return F.struct(*(self.value(v).alias(k) for k, v in spec.items()))
        if len(spec) != 1:
            raise SpecError(f"an expression has one operator: {sorted(spec)}")
        name, args = operators[0], spec[operators[0]]
        if name == "$literal":
            return F.lit(args)
        if name in ("$cond", "$switch"):
            return (_cond if name == "$cond" else _switch)(args, self.value)
        if name not in EXPRESSIONS:
            raise SpecError(f"no operator {name}")
        fewest, most, build = EXPRESSIONS[name]
        args = args if isinstance(args, list) else [args]
        if not fewest <= len(args) <= most:
            raise SpecError(f"{name} takes {fewest if fewest == most else f'{fewest} or more'} arguments, not {len(args)}")
        return build(*map(self.value, args))

    def test(self, spec: dict) -> Column:
        """A $match document: fields with values or comparisons, and $and, $or, $nor of documents."""
        tests = []
        for name, wanted in spec.items():
            if name in ("$and", "$or", "$nor"):
                parts = [self.test(x) for x in wanted]
                tests.append(reduce(and_, parts) if name == "$and" else reduce(or_, parts) if name == "$or" else ~reduce(or_, parts))
            elif name == "$expr":
                tests.append(_known(self.value(wanted)))
            elif name.startswith("$"):
                raise SpecError(f"no operator {name} in $match")
            else:
                tests.append(self.compared(self.field(name), wanted))
        return reduce(and_, tests) if tests else F.lit(True)

    def compared(self, column: Column, wanted: Any) -> Column:
        if not isinstance(wanted, dict) or not any(k.startswith("$") for k in wanted):
            return column.isNull() if wanted is None else _known(column == self.value({"$literal": wanted}))
        out = []
        for name, v in wanted.items():
            if name == "$exists":
                out.append(column.isNotNull() if v else column.isNull())
            elif name in ("$in", "$nin"):
                found = _known(column.isin([x for x in v if x is not None]))
                found = found | column.isNull() if None in v else found
                out.append(found if name == "$in" else ~found)
            elif name == "$regex":
                out.append(_known(column.rlike(v)))
            elif name == "$not":
                out.append(~self.compared(column, v))
            elif name in ("$eq", "$ne"):
                same = self.compared(column, v)
                out.append(same if name == "$eq" else ~same)
            elif name in ("$gt", "$gte", "$lt", "$lte"):
                # not wrapped: scans take the comparison as it is, and a null does not pass
                build = {"$gt": column > F.lit(v), "$gte": column >= F.lit(v), "$lt": column < F.lit(v), "$lte": column <= F.lit(v)}[name]
                out.append(build & column.isNotNull())
            else:
                raise SpecError(f"no operator {name} in $match")
        return reduce(and_, out)

    # order

    def order_key(self) -> Column:
        """A struct that ascends in the order of the last $sort."""
        parts = []
        for i, (path, direction) in enumerate(self.order):
            column = self.field(path)
            if direction < 0:
                text = F.translate(F.hex(column.cast("string").cast("binary")), "0123456789ABCDEF", "FEDCBA9876543210")
                kind = self.df.select(column.alias("c")).schema["c"].dataType
                down = F.concat(text, F.lit("G"))
                if isinstance(kind, (T.NumericType, T.BooleanType)):
                    down = -(column.cast("int") if isinstance(kind, T.BooleanType) else column)
                elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                    down = -F.unix_micros(column.cast("timestamp"))
                parts += [column.isNull().alias(f"n{i}"), down.alias(f"k{i}")]
            else:
                parts.append(column.alias(f"k{i}"))
        return F.struct(*parts)

    # stages

    def match(self, spec: dict) -> None:
        self.df = self.df.where(self.test(spec))

    def project(self, spec: dict) -> None:
        if not spec:
            raise SpecError("$project is empty")
        flags = {k: v for k, v in spec.items() if v in (0, False) and not isinstance(v, str)}
        if flags and set(flags) != {"_id"} and len(flags) < len(spec):
            raise SpecError("$project either keeps or drops")
        if len(flags) == len(spec):
            for k in spec:
                self.field(k)
            self.df = self.df.drop(*spec)
        else:
            out = [F.col("_id")] if "_id" in self.df.columns and "_id" not in spec else []
            for k, v in spec.items():
                if k not in flags:
                    out.append((self.field(k) if v in (1, True) and not isinstance(v, (str, float)) else self.value(v)).alias(k.rsplit(".", 1)[-1]))
            self.df = self.df.select(*out)
        self.order = [(p, s) for p, s in self.order if p.split(".")[0] in self.df.columns]

    def add_fields(self, spec: dict) -> None:
        self.df = self.df.withColumns({k: self.value(v) for k, v in spec.items()})
        self.order = [(p, s) for p, s in self.order if p.split(".")[0] not in spec]

    def sort(self, spec: dict) -> None:
        for path, direction in spec.items():
            if direction not in (1, -1):
                raise SpecError(f"a direction is 1 or -1: {direction!r}")
            self.field(path)
        if not spec:
            raise SpecError("$sort is empty")
        self.order = list(spec.items())

    def sorted(self) -> DataFrame:
        keys = [self.field(p).asc_nulls_first() if s > 0 else self.field(p).desc_nulls_last() for p, s in self.order]
        return self.df.orderBy(*keys) if keys else self.df

    def cut(self, skip: int = 0, limit: int | None = None) -> None:
        for n in (skip, limit):
            if n is not None and (not isinstance(n, int) or n < 0):
                raise SpecError(f"a number of rows is a whole number: {n!r}")
        rows = self.sorted()
        self.df = rows.offset(skip) if limit is None else rows.limit(limit)

    def unwind(self, spec: Any) -> None:
        spec = {"path": spec} if isinstance(spec, str) else spec
        unknown = set(spec) - {"path", "preserveNullAndEmptyArrays", "includeArrayIndex"}
        if unknown or not str(spec.get("path", "")).startswith("$"):
            raise SpecError(f"$unwind takes a path and two options: {spec!r}")
        name = spec["path"][1:]
        column, keep = self.field(name), spec.get("preserveNullAndEmptyArrays", False)
        if "." in name:
            raise SpecError("$unwind takes a field of the document itself")
        index = spec.get("includeArrayIndex")
        rest = [F.col(f"`{c}`") for c in self.df.columns if c not in (name, index)]
        exploded = (F.posexplode_outer if keep else F.posexplode)(column).alias("_at", "_one")
        made = self.df.select(*rest, exploded)
        self.df = made.select(*rest, F.col("_one").alias(name), *([F.col("_at").cast("long").alias(index)] if index else []))

    def accumulator(self, name: str, spec: Any) -> Column:
        if not isinstance(spec, dict) or len(spec) != 1 or next(iter(spec)) not in ACCUMULATORS:
            raise SpecError(f"{name} is not an accumulator: {spec!r}")
        kind, args = next(iter(spec.items()))
        if kind == "$count":
            return F.count("*")
        v = self.value(args)
        if kind == "$sum":
            return F.coalesce(F.sum(v), F.lit(0))
        if kind in ("$avg", "$min", "$max"):
            return {"$avg": F.avg, "$min": F.min, "$max": F.max}[kind](v)
        if kind == "$addToSet":
            return F.array_sort(F.collect_set(v))
        if kind == "$push":
            rows = F.array_sort(F.collect_list(F.struct(*([self.order_key().alias("key")] if self.order else []), v.alias("value"))))
            return F.transform(rows, lambda x: x["value"])
        if not self.order:
            raise SpecError(f"{kind} needs a $sort before its $group")
        return (F.min_by if kind == "$first" else F.max_by)(v, F.struct(self.order_key().alias("key"), v.alias("value")))

    def group(self, spec: dict) -> None:
        if "_id" not in spec:
            raise SpecError("$group has no _id")
        aggs = [self.accumulator(k, v).alias(k) for k, v in spec.items() if k != "_id"]
        key = spec["_id"]
        if key is None:
            made = self.df.agg(*(aggs or [F.count("*").alias("_n")])).withColumn("_id", F.lit(None).cast("string"))
            rows = self.df.limit(1).select(F.lit(1).alias("_some"))  # no rows, no group
            self.df = made.join(F.broadcast(rows), how="inner").select("_id", *(k for k in spec if k != "_id"))
        else:
            keyed = self.df.groupBy(self.value(key).alias("_id"))
            self.df = keyed.agg(*aggs) if aggs else keyed.agg(F.count("*").alias("_n")).select("_id")
        self.order = []


def run_stages(df: DataFrame, stages: list[dict]) -> DataFrame:
    """The rows of a list of stages, in the order of the last $sort that nothing has undone.

    $match, $project, $addFields or $set, $group, $sort, $skip, $limit, $count and
    $unwind; of equal rows in an order any may come first. $push and $addToSet
    make a list as long as their group.
    """
    p = _Pipeline(df)
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise SpecError(f"stage {i + 1} is an object with one key: {stage!r}")
        name, spec = next(iter(stage.items()))
        known = {"$match": p.match, "$project": p.project, "$addFields": p.add_fields, "$set": p.add_fields, "$group": p.group, "$sort": p.sort, "$unwind": p.unwind, "$skip": lambda n: p.cut(skip=n), "$limit": lambda n: p.cut(limit=n)}
        if name == "$count":
            p.df, p.order = p.df.agg(F.count("*").alias(spec)), []
        elif name not in known:
            raise SpecError(f"stage {i + 1} is not known: {name}")
        else:
            try:
                known[name](spec)
            except SpecError as e:
                raise type(e)(f"stage {i + 1} {name}: {e}") from e
    return p.sorted()
