"""Scalar functions for SQL texts, and type tags of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import SpecError
from plumbline.functions.scalars import EMAIL_PATTERN, UNDERLYING, URI_GROUPS, URI_PATTERN, downcast

#: Key of a column's metadata that names its custom type.
TAG = "plumbline.type"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name -> (arguments, result, body): SQL expressions, which the optimizer inlines.
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    **{f"uri_{part}": ("x STRING", "STRING", f"nullif(regexp_extract(x, {_quoted(URI_PATTERN)}, {group}), '')") for part, group in URI_GROUPS.items()},
    "email_domain_name": ("x STRING", "STRING", "split_part(x, '@', 2)"),
    "email_local_part": ("x STRING", "STRING", "split_part(x, '@', 1)"),
    "is_email": ("x STRING", "BOOLEAN", f"x RLIKE {_quoted(EMAIL_PATTERN)}"),
    "truncate_to_day": ("x TIMESTAMP", "STRING", "date_format(x, 'yyyy-MM-dd')"),
    "truncate_to_month": ("x TIMESTAMP", "STRING", "date_format(x, 'yyyy-MM')"),
    "truncate_to_year": ("x TIMESTAMP", "INT", "year(x)"),
    "relative_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(abs(a - b), abs(a))"),
    "magnitude": ("x DOUBLE", "INT", "cast(floor(log10(x)) - 1 AS INT)"),
    "floor_to_seconds": ("x TIMESTAMP, seconds INT", "TIMESTAMP", "timestamp_seconds(floor(unix_seconds(x) / seconds) * seconds)"),
    "json_array_contains": ("x STRING, wanted STRING", "BOOLEAN", "size(array_except(from_json(wanted, 'array<string>'), from_json(x, 'array<string>'))) = 0"),
    "great_circle_km": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371.0D * asin(least(1.0D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
}


def register_functions(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Make the scalar functions known to the session's SQL, for as long as it lasts; null arguments give null.

    They are SQL functions: a call becomes its expression in the plan, with
    nothing run outside of it.
    """
    for name in names or SQL_FUNCTIONS:
        if name not in SQL_FUNCTIONS:
            raise SpecError(f"no SQL function {name}")
        arguments, result, body = SQL_FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return sorted(names or SQL_FUNCTIONS)


def tagged(df: DataFrame, **kinds: str) -> DataFrame:
    """Columns that carry their custom type in their metadata, where tables written as Parquet keep it."""
    for column, kind in kinds.items():
        if kind not in UNDERLYING:
            raise SpecError(f"no custom type {kind}")
        df = df.withMetadata(column, df.schema[column].metadata | {TAG: kind})
    return df


def tags(df: DataFrame) -> dict[str, str]:
    """The custom types of the columns that have one."""
    return {f.name: f.metadata[TAG] for f in df.schema.fields if TAG in f.metadata}


def downcasted(df: DataFrame) -> DataFrame:
    """Tagged columns as their underlying types; what is no value of the type fails, as a cast does."""
    found = tags(df)
    return df.select(*(downcast(F.col(f"`{c}`"), found[c]).alias(c, metadata={}) if c in found else F.col(f"`{c}`") for c in df.columns))
