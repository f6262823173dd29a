"""Phrase collocations: counted n-grams, scored in exact decimals at their weakest cut.

All 1..max_n-grams of all pieces become rows and are counted by hash
aggregation. They are spelled in Python, where a table of at most about
``HELD`` phrases counts those of a task before they become rows; so a frequent
phrase is counted once for many. Counts under
``min_count`` can neither be candidates nor parts of one (a part occurs wherever
the phrase does), so after counting they are only kept as one sum for each
language. Every cut of a
candidate is joined with the counts of its two parts; a word that begins a large
share of all phrases is joined in ``SALTS`` parts. A candidate goes if a phrase
longer by one word covers it: a longer one that covers it holds one of these,
which occurs at least as often. Ranks come from a range partition with one
number for each language and partition, not from a window over a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, with_text_batches

#: Bytes of UTF-8 text: breaks of phrases become line feeds, capital letters small ones. Multi-byte characters hold none of them.
BREAKS = b".,;:!?\x0b\x0c\r"
FOLDED = bytes.maketrans(BREAKS + bytes(range(65, 91)), b"\n" * len(BREAKS) + bytes(range(97, 123)))
NO_LANG = "und"
MAX_WORDS, MIN_COUNT, COVERED_PERCENT, PER_LANG = 3, 10, 50, 2_000
SCALE = 1_000_000
#: Words of a long piece that are spelled at a time, phrases that a task holds, rows of a result batch.
BLOCK, HELD, BATCH = 4_096, 300_000, 256
#: Fewest buckets of a language's phrases, so that shuffle partitions are even; there is at least one for each partition.
BUCKETS = 512
#: Parts of a phrase's joins with the counts of its parts.
SALTS = 8


def _exploded(most: int, buckets: int):
    """Rows of language, bucket and counted phrases, as lines, from rows of language and text."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        room = HELD
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not text.is_valid:
                    continue
                counts = held.setdefault(lang, Counter())
                grams: list[bytes] = []
                for piece in text.as_py().translate(FOLDED).split(b"\n"):
                    words = piece.split()  # only blanks and tabs are left of what bytes.split takes for blanks
                    for at in range(0, len(words), BLOCK):
                        own = words[at : at + BLOCK + most - 1] if len(words) > BLOCK else words
                        grams += own[:BLOCK]
                        for k in range(2, most + 1):
                            grams += map(b" ".join, islice(zip(*(own[j:] for j in range(k)), strict=False), BLOCK))
                        if len(grams) >= HELD:
                            room -= _add(counts, grams)
                            grams = []
                            if room <= 0:
                                yield from _lines(held, buckets)
                                room = HELD
                room -= _add(counts, grams)
                if room <= 0:
                    yield from _lines(held, buckets)
                    room = HELD
        yield from _lines(held, buckets)

    return explode


def _add(counts: Counter, grams: list[bytes]) -> int:
    """Count phrases; returns how many of them are new."""
    before = len(counts)
    counts.update(grams)
    return len(counts) - before


def _lines(held: dict[str, Counter], buckets: int) -> Iterator[pa.RecordBatch]:
    """The counted phrases, a row for each bucket and language; the tables are emptied.

    A line is a phrase, and a tab and its count where that is not 1.
    """
    for lang, counts in held.items():
        if not counts:
            continue
        bucket = (np.fromiter(map(crc32, counts), np.uint32, len(counts)) % buckets).astype(np.int32)
        lines = np.empty(len(counts), object)
        lines[:] = [p if n == 1 else b"%b\t%d" % (p, n) for p, n in counts.items()]
        counts.clear()
        order = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[order], return_index=True)
        dealt, ends = lines[order].tolist(), [*starts[1:].tolist(), len(order)]
        texts = [b"\n".join(dealt[i:j]) for i, j in zip(starts.tolist(), ends, strict=True)]
        for at in range(0, len(found), BATCH):
            part = pa.array(texts[at : at + BATCH], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), pa.array(found[at : at + BATCH]), part], ["lang", "bucket", "lines"])


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """``lang, k, phrase, n``: phrases of k words that occur at least ``min_count`` times; null phrases sum up rarer words.

    Phrases are shuffled as lines of their bucket, some hundred a row, which
    takes less than two thirds of the bytes of a row each. Buckets of a language
    are dealt apart, ``BUCKETS`` or one for each shuffle partition.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").alias("text"))
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = with_text_batches(rows).mapInArrow(_exploded(max_words, buckets), "lang string, bucket int, lines string").repartition("lang", "bucket")
    phrases = lines.select("lang", "bucket", F.explode(F.split("lines", "\n")).alias("line"))
    tab = F.instr("line", "\t")
    phrases = phrases.select("lang", "bucket", F.when(tab == 0, F.col("line")).otherwise(F.substring_index("line", "\t", 1)).alias("phrase"), F.when(tab == 0, F.lit(1)).otherwise(F.substring_index("line", "\t", -1).cast("long")).alias("n"))
    # a phrase has one bucket: the rows are where they are needed
    counts = phrases.groupBy("lang", "bucket", "phrase").agg(F.sum("n").alias("n"))
    frequent = counts.where((F.col("n") >= min_count) | (F.instr("phrase", " ") == 0)).withColumn("phrase", F.when(F.col("n") >= min_count, F.col("phrase")))
    spaces = F.length("phrase") - F.length(F.translate("phrase", " ", ""))
    return frequent.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).select("lang", F.coalesce(spaces + 1, F.lit(1)).alias("k"), "phrase", "n")


def _cuts(counts: DataFrame, max_words: int) -> DataFrame:
    """``lang, phrase, a, cut, left, right``: every cut of every candidate."""
    words = F.split("phrase", " ")
    cuts = F.sequence(F.lit(1), F.col("k") - 1)
    rows = counts.where((F.col("k") >= 2) & (F.col("k") <= max_words)).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"), "k", F.explode(cuts).alias("cut"))
    return rows.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"))


def _with_part(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """Cuts with the count of one part; a part's cuts are dealt by their phrase as well."""
    salted = counts.where(F.col("phrase").isNotNull()).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("n").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to"))
    dealt = cuts.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(salted, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part")) & (F.col("_salt") == F.col("_to")))
    return joined.drop("_lang", "_part", "_to", "_salt", part)


def scored_phrases(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of each candidate at its lowest-scoring cut, ties to the earliest.

    Products are decimals of 38 digits: exact up to counts of 10^15.
    """
    cuts = _with_part(_with_part(_cuts(counts, max_words), counts.where(F.col("k") < max_words), "left", "l"), counts.where(F.col("k") < max_words), "right", "r")
    a, lr = "cast(a AS DECIMAL(16,0))", "(cast(l AS DECIMAL(19,0)) * cast(r AS DECIMAL(19,0)))"
    score = F.expr(f"({SCALE} * {a} * {a}) div {lr}")
    lowest = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def extended(counts: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``lang, phrase, most``: parts of candidates without their first or last word, and the most frequent candidate around each."""
    longer = counts.where((F.col("k") >= 3) & (F.col("k") <= max_words))
    parts = F.array(F.regexp_replace("phrase", "^[^ ]+ ", ""), F.regexp_replace("phrase", " [^ ]+$", ""))
    return longer.select("lang", F.explode(parts).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first ``most`` rows of each key in an order, with their ranks.

    Rows are range-partitioned by key and order and written, so that each
    partition holds a stretch of the order; the counts of a key's earlier
    partitions (one number for each key and partition) come before the places
    within. Only partitions that reach into the first rows are ordered.
    """
    placed = stored(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < most)
    near = placed.join(F.broadcast(starts), placed[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) + F.col("_before")
    return near.withColumn(name, place.cast("long")).where(F.col(name) <= most).drop("_part", "_key", "_of", "_before")


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, per_lang: int = PER_LANG
) -> DataFrame:
    """Return ``lang, rank, phrase, a, l, r, n, score``: the ``per_lang`` best phrases of each language.

    A null language is "und" (one language with rows that say so); a null or
    empty text has no words. Texts of any length are counted whole, repeated
    rows as often as they occur; other columns are ignored; an empty table, or
    one without a phrase that is frequent enough, gives an empty result. Ties of
    score go to the more frequent phrase, then to the one with smaller bytes.
    """
    counts = stored(phrase_counts(docs, text, lang, max_words, min_count), "phrases")
    totals = counts.where("k = 1").groupBy("lang").agg(F.sum("n").alias("total"))
    around = extended(counts, max_words).select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "most")
    covered = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (100 * F.col("most") >= covered_percent * F.col("a"))
    kept = scored_phrases(counts, max_words).join(around, covered, "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = first_of_each(kept, "lang", order, per_lang)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
