"""Transform pipelines: a list of ``{"type", "spec"}`` applied from left to right."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.errors import UnknownFunction
from plumbline.functions.expressions import apply_filter
from plumbline.functions.scalars import like_escaped
from plumbline.operators.aggregates import summarize
from plumbline.plans.ranking import running_total

TRANSFORMS: dict[str, Callable[[DataFrame, Any], DataFrame]] = {}
DEFAULT_LIMIT = 10


def transform(name: str):
    def add(f: Callable[[DataFrame, Any], DataFrame]):
        TRANSFORMS[name] = f
        return f

    return add


def apply_transforms(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    for step in steps:
        if step["type"] not in TRANSFORMS:
            raise UnknownFunction(step["type"])
        df = TRANSFORMS[step["type"]](df, step.get("spec"))
    return df


def _orderable(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if not t.startswith(("map", "variant"))]


def total_order(df: DataFrame, spec: list[dict[str, str]]) -> list[Column]:
    """The order asked for, nulls last when ascending and first when descending, made total by all columns."""
    named = [s["field"] for s in spec]
    made = [F.col(s["field"]).desc_nulls_first() if s.get("direction") == "desc" else F.col(s["field"]).asc_nulls_last() for s in spec]
    return made + [F.col(c).asc_nulls_last() for c in _orderable(df) if c not in named]


TRANSFORMS["filter"] = apply_filter
TRANSFORMS["select"] = lambda df, columns: df.select(*columns)
TRANSFORMS["hide"] = lambda df, columns: df.drop(*columns)
TRANSFORMS["limit"] = lambda df, n: df.limit(n)
TRANSFORMS["offset"] = lambda df, n: df.offset(n)
TRANSFORMS["order"] = lambda df, spec: df.orderBy(*total_order(df, spec or []))
TRANSFORMS["summarize"] = lambda df, spec: summarize(df, spec["groups"], spec.get("aggregations", []))


@transform("duplicate_only")
def duplicates_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose key occurs more than once; keys are counted before rows are joined, so a hot key stays one row."""
    again = df.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1").select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & df[c].eqNullSafe(again[f"_k{i}"])
    return df.join(again, same, "left_semi")


@transform("search")
def search(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Best matches: a text column scores 4 for the whole value, 3 for a prefix, 2 for a substring (any case), others 4 for equality."""
    kinds = dict(df.dtypes)
    score = F.lit(0)
    for column, wanted in spec["columns"].items():
        c = F.col(column)
        if kinds[column] == "string":
            pattern = like_escaped(wanted)
            score = score + F.when(c.ilike(pattern), 4).when(c.ilike(pattern + "%"), 3).when(c.ilike(f"%{pattern}%"), 2).otherwise(0)
        else:
            score = score + F.when(c == wanted, 4).otherwise(0)
    scored = df.withColumn("_score", score).where("_score > 0")
    return scored.orderBy(F.desc("_score"), *total_order(df, [])).limit(spec.get("limit", DEFAULT_LIMIT)).drop("_score")


@transform("group")
def group_metadata(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add to each row its group's ``count``, ``first_value``, ``last_value`` and number (``group_id``, gap-free in key order)."""
    keys = [F.col(c) for c in columns]
    groups = df.groupBy(*columns).agg(F.count("*").alias("count"))
    groups = running_total(groups, [k.asc_nulls_last() for k in keys], F.lit(1), "group_id")
    key = F.struct(*columns)
    meta = groups.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(columns)), F.struct("count", key.alias("first_value"), key.alias("last_value"), "group_id").alias("group_metadata"))
    same = F.lit(True)
    for i, c in enumerate(columns):
        same = same & df[c].eqNullSafe(meta[f"_g{i}"])
    return df.join(meta, same).drop(*(f"_g{i}" for i in range(len(columns))))


def cume_dist_ranges(df: DataFrame, column: str, parts: int = 4) -> DataFrame:
    """range (0 to parts - 1), first, last and count of equal shares of the cumulative distribution."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    values = running_total(values, [F.col(column).asc()], F.col("_n"), "_upto")
    total = values.agg(F.sum("_n").alias("_all"))
    part = F.least(F.ceil(F.col("_upto") * parts / F.col("_all")) - 1, F.lit(parts - 1)).cast("int")
    ranged = values.crossJoin(F.broadcast(total)).withColumn("range", part)
    return ranged.groupBy("range").agg(F.min(column).alias("first"), F.max(column).alias("last"), F.sum("_n").alias("count"))


def extrema(df: DataFrame, column: str) -> DataFrame:
    """Add ``extrema_difference`` and the ``bucket`` of each value by the difference's order of magnitude, from a one-row aggregate."""
    one = df.agg((F.max(column) - F.min(column)).alias("extrema_difference"))
    power = F.floor(F.log10("extrema_difference")) - 1
    return df.crossJoin(F.broadcast(one)).withColumn("bucket", F.floor(F.col(column) / F.pow(F.lit(10.0), power)).cast("long"))


def grouped_order(groups: list[str], order: list[dict[str, str]]) -> list[dict[str, str]]:
    """Grouping implies a sort: the group columns, ascending, come before the order asked for."""
    return [{"field": g, "direction": "asc"} for g in groups] + [o for o in order if o["field"] not in groups]


def grouped_page(df: DataFrame, groups: list[str], order: list[dict[str, str]] | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows with their group's metadata in the order that grouping implies, a page of them."""
    rows = group_metadata(df, groups)
    rows = rows.orderBy(*total_order(df, grouped_order(groups, order or []))).offset(offset)
    return rows if limit is None else rows.limit(limit)


#: The steps of a records request, in the order in which they apply whatever order they are given in.
FIXED_ORDER = ("filter", "duplicate_only", "group", "order", "search", "select", "offset", "limit")


def in_fixed_order(df: DataFrame, **steps: Any) -> DataFrame:
    """Apply the given steps (name=spec) in ``FIXED_ORDER``; a group without an order sorts by its columns."""
    if unknown := set(steps) - set(FIXED_ORDER):
        raise UnknownFunction(sorted(unknown)[0])
    if steps.get("group"):
        steps["order"] = grouped_order(steps["group"], steps.get("order") or [])
    return apply_transforms(df, [{"type": name, "spec": steps[name]} for name in FIXED_ORDER if steps.get(name) is not None])


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; each task keeps n of a group before anything is shuffled."""
    at = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def with_column(df: DataFrame, name: str, kind: str, default: Any = None) -> DataFrame:
    """A new column of a type, filled with a default."""
    return df.withColumn(name, F.lit(default).cast(kind))


def duplicate_column(df: DataFrame, column: str, name: str, data: bool = True) -> DataFrame:
    """A copy of a column, with its values or only its type."""
    return df.withColumn(name, F.col(column) if data else F.lit(None).cast(df.schema[column].dataType))


def rank_in(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(*order)))


def page(df: DataFrame, order: list[dict[str, str]], number: int = 0, size: int = 300, most: int = 1000) -> DataFrame:
    """A page of a total order; the size is capped."""
    size = min(size, most)
    return df.orderBy(*total_order(df, order)).offset(number * size).limit(size)


def after_key(df: DataFrame, key: str, last: Any, size: int) -> DataFrame:
    """The next rows after a key, without counting the rows before it."""
    rows = df if last is None else df.where(F.col(key) > last)
    return rows.orderBy(key).limit(size)
