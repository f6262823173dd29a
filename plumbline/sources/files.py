"""Readers and writers by format, and column hygiene."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.errors import UnsupportedFormat
from plumbline.functions.scalars import geo_feature

NAME_LIMIT = 63
#: Charsets that are read as another.
ENCODINGS = {"ascii": "utf-8", "utf-7": "utf-8", "utf-16": "utf-8", "utf-32": "utf-8"}

Reader = Callable[..., DataFrame]


def _csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, encoding: str = "utf-8", **options: Any) -> DataFrame:
    """Delimited text. Files are split over tasks unless a value holds a line break (``multiLine``, which makes each file one task's).

    Without that option a pass over the lines looks for one with an odd number of quotes.
    """
    if "multiLine" not in options:
        quotes = F.length("value") - F.length(F.translate("value", '"', ""))
        options["multiLine"] = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    settings = {"sep": sep, "header": header, "encoding": ENCODINGS.get(encoding, encoding), "escape": '"', "nullValue": "\x00"} | options
    reader = spark.read.options(**settings)
    # a null is what stands unquoted between separators, "" is the empty string
    df = reader.csv(path)
    return df if header else df.toDF(*(f"column_{i}" for i in range(len(df.columns))))


#: Separators that a delimited file may have, in order of preference.
SEPARATORS = (",", "\t", ";", ":", "|")


def sniffed_separator(spark: SparkSession, path: str, lines: int = 20) -> str:
    """The separator that occurs equally often in each of the first lines, the most frequent one, else the comma. Quoted parts do not count."""
    rows = [re.sub(r'"(?:[^"]|"")*"', "", r.value) for r in spark.read.text(path).limit(lines).collect() if r.value.strip()]
    found = {s: rows[0].count(s) for s in SEPARATORS if rows and rows[0].count(s) and all(r.count(s) == rows[0].count(s) for r in rows)}
    return max(found, key=lambda s: found[s]) if found else ","


def _json(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Objects or lists of objects; what is neither fails instead of becoming nulls."""
    return spark.read.options(**{"multiLine": True, "mode": "FAILFAST"} | options).json(path)


def first_seen_keys(lines: DataFrame, column: str = "value") -> list[str]:
    """Top-level keys of JSON objects, one a row, in the order in which they are first seen: by row, then by place in the object."""
    rows = lines.select(F.posexplode(F.json_object_keys(column)).alias("place", "key"), F.monotonically_increasing_id().alias("row"))
    return [r.key for r in rows.groupBy("key").agg(F.min(F.struct("row", "place")).alias("at")).orderBy("at").collect()]


READERS: dict[str, Reader] = {
    "csv": _csv,
    "tsv": lambda spark, path, **o: _csv(spark, path, sep="\t", **o),
    "json": _json,
    "jsonl": lambda spark, path, **o: spark.read.options(**o).json(path),
    "parquet": lambda spark, path, **o: spark.read.options(**o).parquet(path),
    "orc": lambda spark, path, **o: spark.read.options(**o).orc(path),
    "jdbc": lambda spark, path, **o: spark.read.format("jdbc").options(url=path, **o).load(),
    "xml": lambda spark, path, **o: spark.read.options(**o).xml(path),
    "text": lambda spark, path, **o: spark.read.options(**o).text(path),
}


def read(spark: SparkSession, kind: str, path: str, **options: Any) -> DataFrame:
    if kind not in READERS:
        raise UnsupportedFormat(kind)
    return READERS[kind](spark, path, **options)


def write(df: DataFrame, kind: str, path: str, mode: str = "error", **options: Any) -> None:
    """CSV quotes only where needed, doubles quotes, writes the empty string as "" and null as nothing; GeoJSON (lon=, lat=) a feature a line."""
    writer = df.write.mode(mode)
    if kind in ("csv", "tsv"):
        rows = df.select(*(F.regexp_replace(c, "\r\n?", "\n").alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))
        settings = {"header": True, "escape": '"', "emptyValue": '""', "nullValue": "", "sep": "\t" if kind == "tsv" else ","} | options
        rows.write.mode(mode).options(**settings).csv(path)
    elif kind in ("json", "jsonl"):
        writer.options(**options).json(path)
    elif kind == "geojson":
        lon, lat = options.pop("lon"), options.pop("lat")
        feature = geo_feature(F.col(lon), F.col(lat), *(c for c in df.columns if c not in (lon, lat)))
        df.select(feature.alias("value")).write.mode(mode).options(**options).text(path)
    elif kind in ("parquet", "orc"):
        getattr(writer.options(**options), kind)(path)
    else:
        raise UnsupportedFormat(kind)


def clean_names(names: list[str], limit: int = NAME_LIMIT) -> list[str]:
    """Stripped and shortened names; blank ones are numbered, repeated ones get a number, ``id`` another name."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = name.strip()[:limit] or f"column_{i}"
        base = "id_original" if base == "id" else base
        made, k = base, 1
        while made in out:
            k += 1
            made = f"{base[: limit - 4]}_{k}"
        out.append(made)
    return out


def flattened(df: DataFrame, levels: int = 10, sep: str = ".") -> DataFrame:
    """Struct fields as columns named by their path, down to a number of levels; arrays stay."""

    def walk(fields: list[T.StructField], path: list[str], depth: int) -> list[Column]:
        out: list[Column] = []
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType) and depth < levels:
                out += walk(f.dataType.fields, here, depth + 1)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return df.select(*walk(df.schema.fields, [], 0))


#: Types tried on text columns, from the narrowest; a column takes the first that no value fails.
INFERRED = ("boolean", "bigint", "decimal(38,10)", "date", "timestamp")


def inferred_types(df: DataFrame, skip: list[str] | None = None) -> dict[str, str]:
    """A type for each text column, found in one pass over all rows."""
    columns = [c for c, t in df.dtypes if t == "string" and c not in (skip or [])]
    tests = [F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t}) is null")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, t in enumerate(INFERRED)]
    seen = [F.count(c).alias(f"{i}_n") for i, c in enumerate(columns)]
    row = df.agg(*tests, *seen).first() if columns else {}
    return {c: next((t for k, t in enumerate(INFERRED) if row[f"{i}_n"] and not row[f"{i}_{k}"]), "string") for i, c in enumerate(columns)}


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(f"try_cast(`{c}` as {kinds[c]})").alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns))


def insert_select(target: DataFrame, source: DataFrame, mapping: list[tuple[str, str]] | None = None) -> DataFrame:
    """Target rows and the source's, matched by position or by (from, to) names; other columns are null."""
    if mapping is None:
        return target.union(source.select(*source.columns[: len(target.columns)]))
    names = {to: fr for fr, to in mapping}
    return target.unionByName(source.select(*((F.col(names[c]) if c in names else F.lit(None)).cast(t).alias(c) for c, t in target.dtypes)))


def update_rows(df: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows with the values of ``changes`` where the key matches (a copy; a null in a change is kept).

    Of several changes of a key the last by ``order`` counts (of equal ones the
    one with the largest values); without an order such a key fails the query,
    instead of multiplying its row.
    """
    new = [c for c in changes.columns if c not in (key, order)]
    values = F.struct(*new)
    made = changes.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(F.count("*").alias("_n"), F.max_by(values, F.struct(*([order] if order else []), *new)).alias("_new"))
    if order is None:
        made = made.withColumn("_new", F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error(F.concat(F.lit(f"more than one change for {key} "), F.col(key).cast("string")))))
    joined = df.join(made.select(key, "_new"), key, "left")
    return joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def delete_rows(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys, key, "left_anti")


def delete_range(df: DataFrame, ts: str, start_s: int, end_s: int) -> DataFrame:
    """Rows outside [start, end); both ends are whole hours in epoch seconds."""
    if start_s % 3600 or end_s % 3600:
        raise ValueError("a range is deleted by whole hours")
    at = F.unix_seconds(F.col(ts).cast("timestamp"))
    return df.where(F.coalesce(~((at >= start_s) & (at < end_s)), F.lit(True)))


def upsert(df: DataFrame, keys: list[str], loaded: str) -> DataFrame:
    """The latest row of each key, by load time and then by all columns."""
    order = F.struct(loaded, *df.columns)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


def log_lines(df: DataFrame, column: str, pattern: str, names: list[str]) -> DataFrame:
    """Groups of a pattern as columns, null where a line does not match."""
    assert re.compile(pattern).groups >= len(names)
    return df.select("*", *(F.nullif(F.regexp_extract(column, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)))


def create_table_as(df: DataFrame, name: str, temporary: bool = True) -> None:
    """Name a relation: a view, or a table of the catalog."""
    df.createOrReplaceTempView(name) if temporary else df.write.mode("overwrite").saveAsTable(name)


def delete_before(df: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows at or after a cut-off; rows without a time stay."""
    return df.where(F.coalesce(F.col(ts) >= cutoff, F.lit(True)))


def decode_records(df: DataFrame, schema: str, key: str = "key", value: str = "value") -> DataFrame:
    """Binary keys and JSON values of a log: ``key``, ``value`` (a struct) and ``size`` in bytes. Bad JSON fails the query."""
    size = F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))
    return df.select(F.col(key).cast("string").alias("key"), F.from_json(F.col(value).cast("string"), schema, {"mode": "FAILFAST"}).alias("value"), size.alias("size"))


def before_key(df: DataFrame, key: str, first: Any, size: int) -> DataFrame:
    """The previous rows before a key, nearest first; gaps between keys do not matter."""
    rows = df if first is None else df.where(F.col(key) < first)
    return rows.orderBy(F.desc(key)).limit(size)
