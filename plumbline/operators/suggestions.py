"""The nearest known words, over an index of words with letters left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edits that the index finds.
EDITS = 2


def _shorter(word: Column) -> Column:
    """A word with each of its letters left out."""
    return F.when(F.length(word) > 0, F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))).otherwise(F.array().cast("array<string>"))


def deletions(words: DataFrame, word: str, edits: int = EDITS) -> DataFrame:
    """Each word with all that is left of it when up to ``edits`` letters are left out, as ``key``."""
    rows = words.withColumn("_level", F.array(word)).withColumn("_keys", F.col("_level"))
    for _ in range(edits):
        rows = rows.withColumn("_level", F.array_distinct(F.flatten(F.transform("_level", _shorter)))).withColumn("_keys", F.concat("_keys", "_level"))
    return rows.select(*words.columns, F.explode(F.array_distinct("_keys")).alias("key"))


def near_words(words: DataFrame, word: str, choices: DataFrame, choice: str, ratio: float = 0.5, edits: int = EDITS) -> DataFrame:
    """word, choice, edits: all choices within ``edits`` and within ``floor(length(word) * ratio)`` edits of each distinct word.

    Two words at most d edits apart have a common rest when each loses up to d
    letters: an equi-join on these rests finds all pairs, and the exact distance
    decides. Both sides are distinct words first, so a frequent one is one row.
    """
    left = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    right = choices.select(F.col(choice).alias("choice")).where("choice is not null").distinct()
    pairs = deletions(left, "word", edits).join(deletions(right, "choice", edits), "key").select("word", "choice").distinct()
    most = F.least(F.lit(edits), F.floor(F.length("word") * F.lit(ratio)).cast("int"))
    return pairs.withColumn("edits", F.levenshtein("word", "choice")).where(F.col("edits") <= most)


def with_suggestion(df: DataFrame, word: str, choices: DataFrame, choice: str, ratio: float = 0.5, edits: int = EDITS, name: str = "suggestion") -> DataFrame:
    """Add the nearest choice of each row's word, ties to the first in order; null without one that is near."""
    best = near_words(df, word, choices, choice, ratio, edits).groupBy("word").agg(F.min(F.struct("edits", "choice")).alias("_best")).withColumnRenamed("word", "_word")
    return df.join(best, df[word] == best["_word"], "left").select(*(df[c] for c in df.columns), F.col("_best.choice").alias(name))
