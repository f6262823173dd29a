"""Filter and function trees: one-key JSON objects compiled to Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import MissingColumns, SpecError, UnknownFunction
from plumbline.functions import scalars as S

Builder = Callable[..., Column]
REGISTRY: dict[str, Builder] = {}
#: Functions whose arguments are plain values.
LEAVES = ("literal", "column_name", "alias")


def register(name: str) -> Callable[[Builder], Builder]:
    """Add a function to the registry; a later registration replaces an earlier one."""

    def add(build: Builder) -> Builder:
        REGISTRY[name] = build
        return build

    return add


def _all(name: str, **builders: Builder) -> None:
    for k, f in builders.items():
        REGISTRY[name.format(k)] = f


_COMPARE: dict[str, Builder] = {
    "equals": lambda a, b: a == b,
    "greater_than": lambda a, b: a > b,
    "greater_or_equal": lambda a, b: a >= b,
    "less_than": lambda a, b: a < b,
    "less_or_equal": lambda a, b: a <= b,
}
REGISTRY.update(
    {
        "noop": lambda a: a,
        "and": lambda *a: reduce(and_, a),
        "or": lambda *a: reduce(or_, a),
        "not": lambda a: ~a,
        "null": lambda a: a.isNull(),
        "not_null": lambda a: a.isNotNull(),
        "equal": lambda a, b: a == b,
        "not_equal": lambda a, b: a != b,
        "greater": lambda a, b: a > b,
        "lesser": lambda a, b: a < b,
        "greater_or_equal": lambda a, b: a >= b,
        "lesser_or_equal": lambda a, b: a <= b,
        "between": lambda a, low, high: a.between(low, high),
        "in": lambda a, *values: reduce(or_, (a == v for v in values)),
        "to_lowercase": F.lower,
        "trim": F.trim,
        "length": F.length,
        "contains": lambda a, b: a.contains(b),
        "starts_with": lambda a, b: a.startswith(b),
        "contains_case_insensitive": lambda a, b: F.lower(a).contains(F.lower(b)),
        "starts_with_case_insensitive": lambda a, b: F.lower(a).startswith(F.lower(b)),
        "matches_case_insensitive": lambda a, b: F.regexp_like(a, F.concat(F.lit("(?iu)"), b)),
        "uri_scheme": lambda a: S.uri_part(a, "scheme"),
        "uri_authority": lambda a: S.uri_part(a, "authority"),
        "uri_authority_contains": lambda a, b: S.uri_part(a, "authority").contains(b),
        "uri_scheme_equals": lambda a, b: S.uri_part(a, "scheme") == b,
        "email_domain": S.email_domain,
        "email_domain_contains": lambda a, b: S.email_domain(a).contains(b),
        "email_domain_equals": lambda a, b: S.email_domain(a) == b,
        "json_array_not_empty": lambda a: F.json_array_length(a) > 0,
        "json_array_contains": lambda a, b: F.size(F.array_except(F.from_json(b, "array<string>"), F.from_json(a, "array<string>"))) == 0,
        "array_not_empty": lambda a: F.size(a) > 0,
        "array_contains": lambda a, *b: F.size(F.array_except(F.array(*b), a)) == 0,
        "truncate_to_day": lambda a: S.truncated(a, "day"),
        "truncate_to_month": lambda a: S.truncated(a, "month"),
        "truncate_to_year": lambda a: S.truncated(a, "year"),
    }
)
_all("json_array_length_{}", **{k: (lambda a, b, f=f: f(F.json_array_length(a), b)) for k, f in _COMPARE.items()})
_all("array_length_{}", **{k: (lambda a, b, f=f: f(F.size(a), b)) for k, f in _COMPARE.items()})


#: Spark functions that a function of the registry is built on, if they are not in every version.
REQUIRES: dict[str, tuple[str, ...]] = {
    "matches_case_insensitive": ("regexp_like",),
    "email_domain": ("split_part",),
    "email_domain_contains": ("split_part",),
    "email_domain_equals": ("split_part",),
    "json_array_not_empty": ("json_array_length",),
    "json_array_contains": ("from_json", "array_except"),
    "array_contains": ("array_except",),
}
REQUIRES |= {name: ("json_array_length",) for name in REGISTRY if name.startswith("json_array_length_")}


def supported_functions(spark: SparkSession) -> list[str]:
    """Names of the registry whose functions the session knows."""
    known = {f: spark.catalog.functionExists(f) for needs in REQUIRES.values() for f in needs}
    return sorted(name for name in REGISTRY if all(known[f] for f in REQUIRES.get(name, ())))


def any_term(columns: list[str], terms: list[str]) -> dict:
    """A tree: every term occurs, in any case, in some of the columns."""
    either = [{"or": [{"contains_case_insensitive": [{"column_name": [c]}, {"literal": [t]}]} for c in columns]} for t in terms]
    return {"and": either} if either else {"literal": [True]}


def missing(column: Column) -> Column:
    """Whether a value is absent: null, an empty text or an empty array (the text "[]" is a text like any other)."""
    text = column.cast("string")
    return column.isNull() | (text == "") | ((text == "[]") & F.startswith(F.typeof(column), F.lit("array")))


def columns_of(spec: Any) -> set[str]:
    """Names that a tree refers to."""
    if isinstance(spec, dict):
        if "column_name" in spec:
            return set(spec["column_name"])
        return set().union(*(columns_of(v) for v in spec.values()))
    if isinstance(spec, list):
        return set().union(*(columns_of(v) for v in spec)) if spec else set()
    return set()


def compile_tree(spec: Any) -> Column:
    """A Column from ``{"id": [arguments]}``; only leaves take plain values."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise SpecError(f"a function is an object with one key: {spec!r}")
    name, args = next(iter(spec.items()))
    if not isinstance(args, list):
        raise SpecError(f"the arguments of {name} are not a list: {args!r}")
    if name in LEAVES:
        if len(args) < 1 or any(isinstance(a, (dict, list)) for a in args[1 if name == "alias" else 0 :]):
            raise SpecError(f"{name} takes a plain value: {args!r}")
        if name == "alias":
            return compile_tree(args[0]).alias(args[1])
        return F.col(f"`{args[0]}`") if name == "column_name" else F.lit(args[0])
    if name not in REGISTRY:
        raise UnknownFunction(name)
    return REGISTRY[name](*(compile_tree(a) for a in args))


def apply_filter(df: DataFrame, spec: Any) -> DataFrame:
    """Rows for which the tree holds; every column it names must exist."""
    missing = columns_of(spec) - set(df.columns)
    if missing:
        raise MissingColumns(sorted(missing))
    return df.where(compile_tree(spec))
