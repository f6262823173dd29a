"""Amounts and currencies in texts of any locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Percent of likeness from which on a currency counts as meant.
LEAST_RATIO = 10
#: A number: digits with points, commas, apostrophes and blanks (also hard and thin ones) between them.
_NUMBER = r"\d(?:[\d.,'’   ]*\d)?"


def money_amount(text: Column) -> Column:
    """The first number of a text as a decimal, whatever its locale's separators; null without one.

    The decimal separator is the last point or comma if the other one, or a
    blank or apostrophe, groups the digits before it, or if it stands alone and
    other than three digits follow it. "(5.00)" and a minus on either side of the
    number are negative.
    """
    number = F.regexp_extract(text, _NUMBER, 0)
    both = F.regexp_extract(number, r"^(?:.*[,'’   ].*(?=\.)|.*[.'’   ].*(?=,))[.,](\d+)$", 1)
    alone = F.regexp_extract(number, r"^\d+[.,](\d{1,2}|\d{4,})$", 1)
    # a mark that occurs again, as in 1,234,567, groups
    last = F.regexp_extract(number, r"([.,])\d+$", 1)
    again = (last != "") & (F.length(number) - F.length(F.replace(number, last, F.lit(""))) > 1)
    places = F.when(again, "").when(both != "", both).otherwise(alone)
    whole = F.when(places != "", F.substring(number, F.lit(1), F.length(number) - F.length(places) - 1)).otherwise(number)
    digits = F.concat(F.regexp_replace(whole, r"\D", ""), F.lit("."), F.when(places != "", places).otherwise("0"))
    negative = text.rlike(r"^[^\d]*[-−(][^\d]*\d") | text.rlike(r"\d\s*[-−]\s*\D*$")
    return F.when(number != "", F.when(negative, -digits.cast("decimal(38,10)")).otherwise(digits.cast("decimal(38,10)")))


def currency_text(text: Column) -> Column:
    """What stands beside the number: a symbol or name; null without one."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(text, _NUMBER, ""), r"[-−()\s]+", " ")), F.lit(""))


def indel_ratio(a: Column, b: Column) -> Column:
    """Likeness in percent: twice the longest common subsequence over the lengths of both texts; 100 for two empty ones."""
    left, right = F.filter(F.split(a, ""), lambda x: x != ""), F.filter(F.split(b, ""), lambda x: x != "")

    def row(before: Column, x: Column) -> Column:
        """One row of the table of common lengths, from the row before."""
        places = F.sequence(F.lit(1), F.size(right))
        return F.aggregate(places, F.array(F.lit(0)), lambda made, j: F.array_append(made, F.when(x == F.get(right, j - 1), F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(made, j - 1), F.get(before, j)))))

    none = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))
    common = F.when(F.size(right) == 0, 0).otherwise(F.element_at(F.aggregate(left, none, row), -1))
    return F.when(F.length(a) + F.length(b) == 0, 100.0).otherwise(200.0 * common / (F.length(a) + F.length(b)))


def with_currency(df: DataFrame, text: str, currencies: DataFrame, least: float = LEAST_RATIO, name: str = "currency") -> DataFrame:
    """Add the code of the currency whose symbol or code is most like what stands beside each text's number.

    ``currencies``: code, symbol. Names that have no character in common are not
    alike at all, so names are joined on characters. Ties go to the first code;
    texts below ``least`` percent, or without a name, get null.
    """
    said = df.select(currency_text(F.col(text)).alias("_said")).where("_said is not null").distinct()
    names = currencies.select("code", F.explode(F.array("code", "symbol")).alias("_name")).where("_name is not null and _name <> ''").distinct()
    left = said.withColumn("_c", F.explode(F.array_distinct(F.split(F.upper("_said"), ""))))
    right = names.withColumn("_c", F.explode(F.array_distinct(F.split(F.upper("_name"), ""))))
    pairs = left.where("_c <> ''").join(right, "_c").select("_said", "code", "_name").distinct()
    scored = pairs.withColumn("_r", indel_ratio(F.upper("_said"), F.upper("_name"))).where(F.col("_r") >= least)
    best = scored.groupBy("_said").agg(F.min_by("code", F.struct(-F.col("_r"), "code")).alias(name))
    return df.withColumn("_mine", currency_text(F.col(text))).join(best, F.col("_mine") == F.col("_said"), "left").drop("_mine", "_said")
