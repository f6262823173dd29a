"""Quality rules with adaptive thresholds, in DataFrame operations only.

Each document gets integer statistics of its whole text. Per language and
source, every metric is summarised by a mergeable quantile sketch: counts of
log-linear bins (64 linear bins, then 32 to a power of two), exact below 64 and
within 1/32 above. Sketches of parts of a group add up, so a group with a third
of all rows is merged from partial counts, and a language's sketch is the sum of
its sources'. A fence lies ``spreads`` times the distance between the median and
an upper quantile above that quantile. Where both are the same (three quarters
without any symbol, say) it lies half-way from the median to where the values
above the median begin. A group's fence is averaged with its language's, which
counts as ``PRIOR_ROWS`` rows. Documents are joined with their group's fences
and kept within all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_or_shuffled, stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: name -> (upper quantile in percent, spreads). Metrics are whole numbers: per ten thousand, and hundredths of a character.
METRICS = {"symbol_rate": (75, 4), "dup_line_rate": (98, 2), "repeat_rate": (95, 4), "word_length": (90, 3)}
#: Where the values above the median begin: their quantile in percent, and the least distance of a fence from its median if the upper quantile is the median.
BEGIN, LEAST_DISTANCE = 5, 50
#: Rows that a language's fence counts for beside those of the group.
PRIOR_ROWS = 200


def _repeats(words: str) -> Column:
    """Window hashes of a word array; null for fewer than three words."""
    n = F.size(words)
    three = F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"))
    return F.when(n >= 3, F.transform(F.slice(three, 1, n - 2), lambda z: F.xxhash64(z["a"], z["b"], z["c"])))


def text_statistics(docs: DataFrame, text: str = "text", *keep: Column) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row.

    A repeated three-word window is found by sorting (hash, position) within the
    row; the words it covers are counted from the gaps between the sorted
    positions of repeated windows, three for the last. No shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, body.alias("_text"))
    kept = [c for c in rows.columns if c != "_text"]
    solid = F.length(F.regexp_replace("_text", SPACES, ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *kept,
        solid.cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.filter(F.split("_text", SPACES), lambda x: x != "").alias("_words"),
    )
    rows = rows.select(
        *kept,
        "word_chars",
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeats("_words").alias("_hashes"),
    )
    stats = [*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    repeated = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    ordered = F.when(repeated, F.array_sort(F.transform("_hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    rows = rows.select(*stats, ordered.alias("_at"))
    pairs = F.arrays_zip(F.col("_at").alias("x"), F.slice("_at", 2, F.size("_at")).alias("y"))
    same = F.filter(pairs, lambda z: z["x"]["h"] == z["y"]["h"])
    rows = rows.select(*stats, F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda z: F.array(z["x"]["p"], z["y"]["p"]))))).alias("_places"))
    gaps = F.arrays_zip(F.col("_places").alias("x"), F.slice("_places", 2, F.size("_places")).alias("y"))
    covered = F.aggregate(gaps, F.lit(0), lambda total, z: total + F.least(F.lit(3), F.coalesce(z["y"] - z["x"], F.lit(3))))
    return rows.select(*stats, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _per(part: str, whole: str, scale: int) -> Column:
    return F.expr(f"({scale} * {part}) div greatest({whole}, 1)")


def sketch_bin(value: str) -> tuple[Column, Column]:
    """(shift, high bits) of the bin of a non-negative whole number."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(shift), F.expr(f"shiftright({value}, {shift})")


def quantile_sketches(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """groups, metric, shift, high, n: mergeable by adding n."""
    long = rows.select(*groups, F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m))))).alias("metric", "value"))
    shift, high = sketch_bin("value")
    return long.groupBy(*groups, "metric", shift.alias("shift"), high.alias("high")).agg(F.count("*").alias("n"))


def sketch_quantiles(sketch: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """groups, metric, rows, q<percent> and begin: the upper end of the bin that holds each quantile.

    ``begin`` is quantile ``BEGIN`` of the values above the median's bin, null if there are none.
    """
    whole = Window.partitionBy(*groups, "metric")
    rows = sketch.withColumn("upto", F.sum("n").over(whole.orderBy("shift", "high").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(whole))
    rows = rows.withColumn("middle", F.min(F.when(2 * F.col("upto") >= F.col("total"), F.col("upto"))).over(whole))
    end = F.expr("shiftleft(high + 1, shift) - 1")
    beyond = F.col("upto") - F.col("middle")
    begun = (beyond > 0) & (100 * beyond >= BEGIN * (F.col("total") - F.col("middle")))
    return rows.groupBy(*groups, "metric").agg(
        F.max("total").alias("rows"), F.min(F.when(begun, end)).alias("begin"), *(F.min(F.when(100 * F.col("upto") >= p * F.col("total"), end)).alias(f"q{p}") for p in percents)
    )


def sketch_fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """groups, metric, rows, fence of a sketch."""
    found = sketch_quantiles(sketch, groups, [50, *sorted({p for p, _ in METRICS.values()})])
    upper, spreads = F.lit(None).cast("long"), F.lit(None).cast("long")
    for metric, (percent, times) in METRICS.items():
        upper, spreads = F.when(F.col("metric") == metric, F.col(f"q{percent}")).otherwise(upper), F.when(F.col("metric") == metric, times).otherwise(spreads)
    found = found.select(*groups, "metric", "rows", "q50", "begin", upper.alias("upper"), spreads.alias("spreads"))
    half = F.expr("coalesce((begin - q50) div 2, 0)")
    fence = F.when(F.col("upper") > F.col("q50"), F.col("upper") + F.col("spreads") * (F.col("upper") - F.col("q50"))).otherwise(F.col("q50") + F.greatest(F.lit(LEAST_DISTANCE), half))
    return found.select(*groups, "metric", "rows", fence.alias("fence"))


def group_fences(sketch: DataFrame, group: str, part: str) -> DataFrame:
    """group, part, metric, fence: the fences of parts, averaged with their group's."""
    merged = sketch.groupBy(group, "metric", "shift", "high").agg(F.sum("n").alias("n"))
    own, prior = sketch_fences(sketch, [group, part]), sketch_fences(merged, [group]).select(group, "metric", F.col("fence").alias("prior"))
    return own.join(prior, [group, "metric"]).select(group, part, "metric", F.expr(f"(rows * fence + {PRIOR_ROWS} * prior) div (rows + {PRIOR_ROWS})").alias("fence"))


def filter_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Return ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for each row.

    Null languages and sources are groups of their own. A null text counts as
    empty and fails the base rule (fewer than 50 words); texts of any length are
    counted whole. Only rows that pass the base rule shape their group's fences. Null ids and repeated rows are judged
    like any row; other columns are ignored; an empty table gives an empty
    result.
    """
    stats = text_statistics(
        docs,
        text,
        F.col(doc_id).cast("long").alias("doc_id"),
        *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(g) for c, g in ((lang, "g_lang"), (source, "g_source"))),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = stats.select(
        "*",
        failed.alias("base_failed"),
        _per("n_symbols", "word_chars", 10000).alias("symbol_rate"),
        _per("n_dup_lines", "n_lines", 10000).alias("dup_line_rate"),
        _per("n_repeat_words", "n_words", 10000).alias("repeat_rate"),
        _per("word_chars", "n_words", 100).alias("word_length"),
    )
    stats = stored(stats, "stats")
    groups = ["g_lang", "g_source"]
    sketch = quantile_sketches(stats.where(~F.col("base_failed")), groups, list(METRICS))
    fences = group_fences(sketch, *groups)
    fences = fences.groupBy(*groups).agg(*(F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"most_{m}") for m in METRICS))
    fences = stored(fences, "fences")
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(m) <= F.col(f"most_{m}"))
    joined = stats.join(small_or_shuffled(fences, fences.count()), groups, "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept")
    )
