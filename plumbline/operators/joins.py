"""Joins: foreign-key paths, merges, as-of, range and co-occurrence joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.storage import checkpointed, small_or_shuffled

#: Items of a block of a group whose items are paired.
BLOCK_ITEMS = 1_000
#: Pairs that a task makes, and tasks at most.
PAIRS_A_TASK, MOST_PARTS = 1_000_000, 10_000


def fk_path_join(base: DataFrame, edges: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Follow foreign keys from a base table; every base row stays (left joins). Edges: table, its key, the key that refers to it."""
    for table, key, fk in edges:
        base = base.join(table, base[fk] == table[key], "left")
    return base


def merge_distinct(left: DataFrame, right: DataFrame, fk: str, key: str, columns: list[str]) -> DataFrame:
    """Natural join over a foreign key, distinct rows of the kept columns."""
    return left.join(right, left[fk] == right[key]).select(*columns).distinct()


def split_table(df: DataFrame, columns: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Move columns to a table of their own: (remainder with the key, distinct rows with the key). The key is a hash of the values."""
    keyed = df.withColumn(key, F.xxhash64(*columns))
    return keyed.drop(*columns), keyed.select(key, *columns).distinct()


def joinable_tables(edges: DataFrame, base: str, depth: int = 2) -> DataFrame:
    """Tables within ``depth`` foreign-key steps of a base: base, target, path (ids of edges), reversed (for each, whether it is walked against its direction), depth.

    ``edges``: id, source (the table that refers), target; walked both ways, never straight back.
    """
    turned = edges.select("id", F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("back"))
    both = edges.select("id", "source", "target", F.lit(False).alias("back")).unionByName(turned)
    reached = both.where(F.col("source") == base).select(F.lit(base).alias("base"), "target", F.array("id").alias("path"), F.array("back").alias("reversed"), F.lit(1).alias("depth"))
    found, step = reached, reached
    for d in range(2, depth + 1):
        step = step.alias("r").join(both.alias("e"), (F.col("r.target") == F.col("e.source")) & (F.element_at("r.path", -1) != F.col("e.id")))
        step = step.select("r.base", F.col("e.target").alias("target"), F.concat("r.path", F.array("e.id")).alias("path"), F.concat("r.reversed", F.array("e.back")).alias("reversed"), F.lit(d).alias("depth"))
        found = found.unionByName(step)
    return found


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys, on, "left_anti")


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, values: list[str], width: float | None = None) -> DataFrame:
    """Each left row with the latest right values at or before its time (null without one).

    Both sides become one timeline a key: a union, one shuffle and a running
    last value; no pair of rows is ever formed. Of right rows at the same time
    the largest values win; a right row comes before a left row at the same
    time. With ``width`` (seconds for times, else units) a timeline is cut into
    slices that are ordered in different tasks, so that one key may hold much of
    the data; each slice starts from the last value of the slices before it.
    """
    kind = dict(left.dtypes)[left_ts]
    number = F.col("_ts").cast("timestamp").cast("double") if kind.startswith("timestamp") else F.col("_ts").cast("double")
    cut = F.floor(number / width) if width else F.lit(0)
    lefts = left.select(F.col(on), F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).alias("_right"))
    rights = right.where(F.col(on).isNotNull())
    rights = rights.select(F.col(on), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), F.struct(*values).alias("_right"))
    line = Window.partitionBy(on, "_slice").orderBy("_ts", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    merged = lefts.unionByName(rights).withColumn("_slice", cut)
    found = merged.withColumn("_last", F.last("_right", ignorenulls=True).over(line)).where("_side = 1")
    if width:
        newest = F.max(F.when(F.col("_side") == 0, F.struct("_ts", "_right")))
        earlier = Window.partitionBy(on).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = merged.groupBy(on, "_slice").agg(newest.alias("_newest")).select(on, "_slice", F.last("_newest._right", ignorenulls=True).over(earlier).alias("_carried"))
        found = found.join(carried, [on, "_slice"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    return found.select("_left.*", *(F.col(f"_last.{v}").alias(v) for v in values))


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Points with every range [lo, hi) that holds them: an equi-join on cells of a width, then the exact test."""
    keys = keys or []
    celled = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    placed = points.withColumn("_cell", F.floor(F.col(point) / width))
    return placed.join(celled, [*keys, "_cell"]).where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("_cell")


def co_occurrence(df: DataFrame, group: str, item: str) -> DataFrame:
    """Unordered pairs of items that share a group, and in how many groups.

    A group of up to ``BLOCK_ITEMS`` rows gives its pairs from a sorted array,
    without a join. A larger one is cut into blocks of about so many items by a
    hash of the item, and pairs of blocks are joined apart, so that no task holds
    all pairs of one group. Groups are dealt to so many tasks, counted, that each
    makes about ``PAIRS_A_TASK`` pairs, at any size of the table.
    """
    rows = df.select(group, item).where(F.col(group).isNotNull() & F.col(item).isNotNull())
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    # repeated rows count as well: never fewer tasks than the pairs need
    pairs, large = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2), F.count_if(F.col("_n") > BLOCK_ITEMS)).first()
    parts = int(min(MOST_PARTS, max(1, -(-(pairs or 0) // PAIRS_A_TASK))))
    small = rows
    if large:
        crowded = small_or_shuffled(checkpointed(counts.where(F.col("_n") > BLOCK_ITEMS).select(group)), large)
        small = rows.join(crowded, group, "left_anti")
    sets = small.repartition(parts, group).groupBy(group).agg(F.sort_array(F.collect_set(item)).alias("_items"))
    each = sets.where(F.size("_items") > 1).select("_items", F.posexplode("_items").alias("_at", "a"))
    found = each.select("a", F.explode(F.slice("_items", F.col("_at") + 2, F.size("_items"))).alias("b"))
    if large:
        found = found.unionByName(_block_pairs(rows.join(crowded, group, "left_semi").distinct(), group, item, parts))
    return found.groupBy("a", "b").agg(F.count("*").alias("n"))


def _block_pairs(rows: DataFrame, group: str, item: str, parts: int) -> DataFrame:
    """a, b: each pair of items of a group, by pairs of its blocks."""
    blocks = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("_blocks"))
    rows = rows.join(blocks, group).withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    a = rows.select(group, F.col(item).alias("a"), F.col("_own").alias("_i"), other.alias("_j"))
    b = rows.select(group, F.col(item).alias("b"), F.col("_own").alias("_j"), other.alias("_i"))
    keys = [group, "_i", "_j"]
    return a.repartition(parts, *keys).join(b.repartition(parts, *keys).hint("merge"), keys).where("a < b").select("a", "b")


def related_counts(df: DataFrame, related: DataFrame, key: str, fk: str, least: int) -> DataFrame:
    """Rows with ``n``, how many related rows refer to them, if that is at least ``least`` (1 or more); related rows are counted before the join."""
    counts = related.groupBy(F.col(fk).alias(key)).agg(F.count("*").alias("n"))
    return df.join(counts.where(F.col("n") >= least), key)


def latest_rows(df: DataFrame, keys: list[str], ts: str, at: Column | None = None) -> DataFrame:
    """All rows of each key's latest time, at or before ``at`` if given."""
    rows = df if at is None else df.where(F.col(ts) <= at)
    newest = rows.groupBy(*keys).agg(F.max(ts).alias(ts))
    return rows.join(newest, [*keys, ts], "left_semi")
