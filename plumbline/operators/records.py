"""Operations on records: merging documents, triage, constraints, histories and small graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.joins import co_occurrence


def _merged_type(a: T.DataType | None, b: T.DataType | None) -> T.DataType:
    """The fields of either side, the old ones first; the new side's type where they disagree."""
    if a is None or b is None:
        return a or b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.names, *(n for n in b.names if n not in a.names)]
        return T.StructType([T.StructField(n, _merged_type(a[n].dataType if n in a.names else None, b[n].dataType if n in b.names else None)) for n in names])
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_merged_type(a.elementType, b.elementType))
    return b


def _as(column: Column, kind: T.DataType, to: T.DataType) -> Column:
    """A value as a type that has all its fields; fields that it lacks are null."""
    if isinstance(kind, T.StructType) and isinstance(to, T.StructType):
        fields = [(_as(column[f.name], kind[f.name].dataType, f.dataType) if f.name in kind.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in to]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(column, lambda x: _as(x, kind.elementType, to.elementType))
    return column.cast(to)


def _merged(old: Column, new: Column, a: T.DataType, b: T.DataType, ids: dict[str, str], path: str) -> Column:
    to = _merged_type(a, b)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = []
        for f in to:
            here = f"{path}.{f.name}" if path else f.name
            if f.name not in a.names or f.name not in b.names:
                side, kind = (new, b) if f.name in b.names else (old, a)
                fields.append(_as(side[f.name], kind[f.name].dataType, f.dataType).alias(f.name))
            else:
                fields.append(_merged(old[f.name], new[f.name], a[f.name].dataType, b[f.name].dataType, ids, here).alias(f.name))
        return F.when(old.isNotNull() | new.isNotNull(), F.struct(*fields))
    left, right = _as(old, a, to), _as(new, b, to)
    if path in ids and isinstance(to, T.ArrayType):
        none = F.array().cast(to)
        known = F.coalesce(F.transform(right, lambda x: x[ids[path]]), F.array().cast(T.ArrayType(to.elementType[ids[path]].dataType)))
        return F.concat(F.filter(F.coalesce(left, none), lambda x: ~F.coalesce(F.array_contains(known, x[ids[path]]), F.lit(False))), F.coalesce(right, none))
    return F.coalesce(right, left)


def merge_documents(old: DataFrame, new: DataFrame, key: str, arrays: dict[str, str] | None = None) -> DataFrame:
    """Documents of both sides by key: the key and the fields of either side, at every level.

    A new value wins unless it is null, objects merge field by field, and arrays
    of objects that ``arrays`` names by their path merge by an element's id, new
    elements winning; elements without an id stay, and none at all give an empty
    array. Other arrays are replaced. A
    document of one side only has nulls for the fields of the other. Keys should
    not repeat within a side.
    """
    a, b = old.select(F.col(key), F.struct(*old.columns).alias("_old")), new.select(F.col(key), F.struct(*new.columns).alias("_new"))
    both = a.join(b, key, "full")
    to = _merged_type(old.schema, new.schema)
    merged = _merged(F.col("_old"), F.col("_new"), old.schema, new.schema, arrays or {}, "")
    return both.select(key, merged.alias("_row")).select(key, *(F.col(f"_row.`{n}`").alias(n) for n in to.names if n != key))


def triage(df: DataFrame, name: str, failures: str, jobs: str, confidence: str) -> DataFrame:
    """name, label, confidence: a known issue if its confidence is 100 or at most half of the jobs fail, else it needs investigation with confidence capped at 90.

    A row for each name and not a list for each label, since there are only two labels.
    """
    known = (F.col(confidence) == 100) | (F.col(failures) / F.col(jobs) <= 0.5)
    return df.select(name, F.when(known, "known issue").otherwise("needs investigation").alias("label"), F.when(known, F.col(confidence)).otherwise(F.least(confidence, F.lit(90))).alias("confidence"))


def history_confidence(failures: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """50, 75 or 100 for a failure that the history knows by its first key, by two or by three; 0 for a new one."""
    out = failures.withColumn("confidence", F.lit(0))
    for n, score in zip(range(1, len(keys) + 1), (50, 75, 100), strict=False):
        seen = history.select(*keys[:n]).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, keys[:n], "left").withColumn("confidence", F.when(F.col("_seen"), score).otherwise(F.col("confidence"))).drop("_seen")
    return out


def derive_required(features: DataFrame, requires: DataFrame) -> DataFrame:
    """config, feature with every required feature added, along chains of any length. ``requires``: feature, needs."""
    found = step = features.select("config", "feature").distinct()
    while True:
        step = step.join(requires, "feature").select("config", F.col("needs").alias("feature")).distinct().join(found, ["config", "feature"], "left_anti").persist()
        if step.isEmpty():
            return found
        found = found.unionByName(step)


def excluded_pairs(features: DataFrame, excludes: DataFrame) -> DataFrame:
    """config, feature, other for configurations that hold two features which exclude each other."""
    held = features.join(excludes, "feature")
    return held.join(features.select("config", F.col("feature").alias("other")), ["config", "other"], "left_semi").select("config", "feature", "other")


def ego_edges(links: DataFrame, group: str, member: str, who) -> DataFrame:
    """Distinct pairs of members that share a group with one of them being ``who`` or sharing a group with ``who``."""
    near = links.join(links.where(F.col(member) == who).select(group).distinct(), group, "left_semi").select(member).distinct()
    groups = links.join(near, member, "left_semi").select(group).distinct()
    rows = links.join(groups, group, "left_semi").select(group, member).distinct()
    return co_occurrence(rows, group, member).select("a", "b")


def progress(done: Column, of: Column) -> Column:
    """Percent done, -1 for nothing to do."""
    return F.when(of <= 0, -1).otherwise(F.floor(100.0 * done / of + 0.5)).cast("int")


def running_errors(df: DataFrame, key: str, order: list[str], error: Column) -> DataFrame:
    """Add ``message`` (1, 2, ...) and ``error`` (the errors so far on an error, else -1) within each key."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_e", error.cast("int"))
    so_far = F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("message", F.row_number().over(w)).withColumn("error", F.when(F.col("_e") == 1, so_far).otherwise(-1)).drop("_e")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A random order that a seed repeats."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key)


def interval_counts(df: DataFrame, ts: str, edges: list) -> DataFrame:
    """from, to, n for consecutive intervals [from, to), empty ones included, in one pass."""
    c = F.col(ts)
    cells = list(zip(edges, edges[1:], strict=False))
    one = df.agg(*(F.count_if((c >= lo) & (c < hi)).alias(f"n{i}") for i, (lo, hi) in enumerate(cells)))
    rows = [F.struct(F.lit(lo).alias("from"), F.lit(hi).alias("to"), F.col(f"n{i}").alias("n")) for i, (lo, hi) in enumerate(cells)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def method_at(lines: DataFrame, methods: DataFrame, unit: str) -> DataFrame:
    """The innermost method [start, end] of a unit that holds each line. lines: unit, line; methods: unit, method, start, end."""
    held = lines.join(methods, unit).where("line between start and end")
    return held.groupBy(unit, "line").agg(F.min_by("method", F.struct((F.col("end") - F.col("start")).alias("span"), "method")).alias("method"))
