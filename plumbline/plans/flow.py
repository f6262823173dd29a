"""Parameter tables and saved queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import MissingColumns, SpecError
from plumbline.operators.transforms import apply_transforms


def for_each(variables: dict[str, list]) -> list[dict[str, Any]]:
    """Every combination of the variables' values."""
    return [dict(zip(variables, values, strict=True)) for values in product(*variables.values())]


def for_range(spark: SparkSession, start: int, end: int, step: int | None = None, slices: int | None = None) -> DataFrame:
    """index, from, to of consecutive slices of [start, end); the last may be short."""
    if step is None:
        step = max(1, -(-(end - start) // slices))
    rows = spark.range(max(0, -(-(end - start) // step)))
    lo = F.lit(start) + F.col("id") * step
    return rows.select(F.col("id").alias("index"), lo.alias("from"), F.least(lo + step, F.lit(end)).cast("long").alias("to"))


def loop(spark: SparkSession, n: int) -> DataFrame:
    """i = 0, 1, ... n - 1, as rows that a plan joins instead of a driver's loop."""
    return spark.range(n).select(F.col("id").alias("i"))


def run_sql(spark: SparkSession, text: str, **args: Any) -> DataFrame:
    """SQL with named parameters, which are bound and never spliced into the text."""
    return spark.sql(text, args=args)


def last_results(df: DataFrame, store: str | bool) -> list[dict] | dict | None:
    """``False`` nothing, ``True`` or ``"first"`` the first row, ``"all"`` every row (small results only)."""
    if store in (True, "first"):
        row = df.first()
        return row.asDict() if row else {}
    return [r.asDict() for r in df.collect()] if store == "all" else None


@dataclass(frozen=True)
class ForeignKey:
    """``source``.``column`` refers to ``target``.``key``."""

    source: str
    column: str
    target: str
    key: str


@dataclass(frozen=True)
class InitialColumn:
    """A column of the base table, or of the table at the end of a path of foreign keys from it, under an alias."""

    column: str
    alias: str
    path: tuple[ForeignKey, ...] = ()


def initial_columns(tables: Callable[[str], DataFrame], base: str, columns: list[InitialColumn]) -> DataFrame:
    """The columns of a base table and of tables reached from it; every base row stays.

    A path may walk a foreign key either way: from a row to the one it refers
    to, or to those that refer to it, which repeats the row. Paths that begin
    alike share their joins, and each join reads the columns it needs.
    """
    needed: dict[tuple[ForeignKey, ...], list[InitialColumn]] = {}
    for c in columns:
        for n in range(len(c.path) + 1):
            needed.setdefault(c.path[:n], [])
        needed[c.path].append(c)
    names: dict[tuple[ForeignKey, ...], str] = {}
    out: DataFrame | None = None
    for i, path in enumerate(sorted(needed, key=len)):
        table = base
        for fk in path:
            if table not in (fk.source, fk.target):
                raise SpecError(f"{fk} does not lead on from {table}")
            table = fk.target if table == fk.source else fk.source
        names[path] = table
        following = {fk for other in needed if other[:-1] == path and other for fk in other[-1:]}
        keys = {fk.column if table == fk.source else fk.key for fk in following}
        if path:
            keys.add(path[-1].key if table == path[-1].target and names[path[:-1]] == path[-1].source else path[-1].column)
        rows = tables(table)
        unknown = ({c.column for c in needed[path]} | keys) - set(rows.columns)
        if unknown:
            raise MissingColumns(sorted(unknown))
        mine = rows.select(*(F.col(k).alias(f"k{i}_{k}") for k in sorted(keys)), *(F.col(c.column).alias(f"v_{c.alias}") for c in needed[path]))
        if out is None:
            out, places = mine, {path: i}
            continue
        places[path] = i
        last, before = path[-1], names[path[:-1]]
        here, there = (last.column, last.key) if before == last.source else (last.key, last.column)
        out = out.join(mine, F.col(f"k{places[path[:-1]]}_{here}") == F.col(f"k{i}_{there}"), "left")
    return out.select(*(F.col(f"v_{c.alias}").alias(c.alias) for c in columns))


@dataclass
class SavedQuery:
    """A base table, its initial columns (source name to alias), those of joined tables, and transforms."""

    table: str
    columns: dict[str, str]
    transforms: list[dict[str, Any]] = field(default_factory=list)
    joined: list[InitialColumn] = field(default_factory=list)

    def build(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = [InitialColumn(c, a) for c, a in self.columns.items()]
        df = initial_columns(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), self.table, own + self.joined)
        return apply_transforms(df, self.transforms)
