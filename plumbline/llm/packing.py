"""Best-fit packing of token pieces with a Martello-Toth dominance reduction.

How many pieces have each length is all that packing needs to know, and that is
one number for each of at most ``CAPACITY`` lengths at any corpus size. The
counts are planned as a whole: sets of at most three pieces that provably
dominate every other set with their largest piece are fixed first, for as many
copies as the counts allow, then the remainder is packed best-fit decreasing,
many equal sequences in a step. The plan gives each rank of a length its
sequence and offset; ranks are counted in salted groups, so no length, however
frequent, goes to one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import stored, with_text_batches
from plumbline.llm.tokens import default_path, in_portions, word_tokenizer

CAPACITY = 4096
END_ID = 1
#: Ranks are counted in groups of about so many pieces, in at most so many groups a length.
GROUP_ROWS, MOST_GROUPS = 2_000, 65_536

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = word_tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for pdf in batches:
            ids, at = pdf["doc_id"].tolist(), 0
            rows = []
            for portion in in_portions(pdf["text"]):
                for raw in tokenizer.encode(portion):
                    raw += end
                    for k, cut in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[cut : cut + 4 * capacity]
                        rows.append((ids[at], k, cut // 4, len(part) // 4, zlib.crc32(part)))
                    at += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


class _Counts:
    """Multiset of lengths with its distinct values in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.of = {k: v for k, v in counts.items() if v > 0}
        self.values = sorted(self.of)

    def take(self, value: int, n: int) -> None:
        self.of[value] -= n
        if not self.of[value]:
            del self.of[value]
            del self.values[bisect_left(self.values, value)]

    def put(self, value: int, n: int) -> None:
        if value not in self.of:
            insort(self.values, value)
        self.of[value] = self.of.get(value, 0) + n

    def largest(self, limit: int) -> int | None:
        at = bisect_right(self.values, limit)
        return self.values[at - 1] if at else None

    def smallest(self, k: int) -> int | None:
        """Sum of the k smallest, None if there are fewer."""
        total = 0
        for v in self.values:
            n = min(k, self.of[v])
            total, k = total + n * v, k - n
            if not k:
                return total
        return None


def dominating_set(left: _Counts, j: int, capacity: int) -> list[int] | None:
    """Companions of one piece j (already taken out) in a set that dominates all others with j.

    ``left`` holds the other pieces. Dominance: the pieces of any other feasible
    set with j can be exchanged, each for one at least as large, so some best
    packing has this set. Tried in order: nothing fits beside j; the largest
    fitting piece fills the sequence, or no two pieces fit beside j; no three
    fit beside j and no pair has a larger second piece than the best pair.
    """
    rest = capacity - j
    k = left.largest(rest)
    if k is None:
        return []
    two = left.smallest(2)
    if k == rest or two is None or two > rest:
        return [k]
    three = left.smallest(3)
    if three is not None and three <= rest:
        return None
    left.take(k, 1)
    b = left.largest(rest - k)
    left.put(k, 1)
    if b is None:
        return None
    # the largest second piece of any fitting pair
    at = bisect_right(left.values, rest // 2)
    second = left.values[at - 1] if at else None
    while second is not None:
        above = left.values[at] if at < len(left.values) else None
        if left.of[second] > 1 or (above is not None and second + above <= rest):
            break
        at -= 1
        second = left.values[at - 1] if at else None
    return [k, b] if second is None or second <= b else None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], _Counts]:
    """Fix dominating sets until none is found; returns (sets with multiplicity, the remainder)."""
    left, fixed = _Counts(counts), []
    changed = True
    while changed and left.values:
        changed = False
        for j in reversed(list(left.values)):
            while left.of.get(j):
                left.take(j, 1)
                mates = dominating_set(left, j, capacity)
                left.put(j, 1)
                if mates is None:
                    break
                group = [j, *mates]
                need = {v: group.count(v) for v in group}
                copies = min(left.of[v] // n for v, n in need.items())
                # taking pieces away only raises the smallest sums and lowers the largest fits, so the proof holds for all copies
                for v, n in need.items():
                    left.take(v, n * copies)
                fixed.append((group, copies))
                changed = True
    return fixed, left


def best_fit(left: _Counts, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts: [(length, copies) in order], number of such sequences."""
    open_at: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rooms: list[int] = []

    def opened(room: int, content: list[tuple[int, int]], n: int) -> None:
        if n:
            if room not in open_at:
                open_at[room] = []
                insort(rooms, room)
            open_at[room].append((content, n))

    for length in reversed(left.values):
        remaining = left.of[length]
        while remaining:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, content, n = capacity, [], None
            else:
                room = rooms[at]
                content, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room], rooms[at]
            fit = room // length
            full = remaining // fit if n is None else min(n, remaining // fit)
            opened(room - fit * length, [*content, (length, fit)], full)
            remaining -= fit * full
            spare = (remaining > 0) if n is None else n - full
            if spare and 0 < remaining < fit:
                opened(room - remaining * length, [*content, (length, remaining)], 1)
                remaining, spare = 0, spare - 1
            if n is not None:
                opened(room, content, spare)
    return [x for found in open_at.values() for x in found]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where each rank of each length goes, as arrays sorted by (length, first rank).

    Rank r of a length in a row with first rank ``lo`` and ``n`` sequences goes
    to sequence ``base + (r - lo) % n`` at offset ``offset + (r - lo) // n * length``.
    """
    fixed, left = reduce_instance(counts, capacity)
    sets = [([(v, 1) for v in group], n) for group, n in fixed] + best_fit(left, capacity)
    used: dict[int, int] = {}
    rows, base = [], 0
    for content, n in sets:
        offset = 0
        for length, copies in content:
            lo = used.get(length, 0)
            rows.append((length, lo, n, base, offset))
            used[length] = lo + copies * n
            offset += copies * length
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "n", "base", "offset"), table, strict=True))


def _placed(plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        first = np.searchsorted(p["length"], np.arange(p["length"].max(initial=0) + 2))
        for pdf in batches:
            pdf = pdf.sort_values("length")
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            at = np.empty(len(pdf), np.int64)
            for value, rows in pdf.groupby("length").indices.items():
                lo, hi = first[value], first[value + 1]
                at[rows] = lo + np.searchsorted(p["lo"][lo:hi], rank[rows], "right") - 1
            past = rank - p["lo"][at]
            pdf["sequence_id"] = p["base"][at] + past % p["n"][at]
            pdf["offset"] = p["offset"][at] + past // p["n"][at] * length
            yield pdf.drop(columns="rank")

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    A document is its token ids and then id 1; only one longer than
    ``capacity`` is cut. Null and empty texts are the single id 1. Repeated
    rows, also with a null id, are packed as often as they occur; other columns
    are ignored; an empty table gives an empty result. The driver holds the
    counts of at most ``capacity`` lengths and the plan made of them.
    """
    spark = docs.sparkSession
    texts = with_text_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    pieces = texts.mapInPandas(_pieces(tokenizer_path or default_path(), capacity), _PIECES)
    # a number of the row's own splits any number of rows that are alike
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_sequences(counts, capacity))
    groups = min(MOST_GROUPS, max(1, sum(counts.values()) // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "row")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInPandas(_placed(plan), f"{_PIECES}, sequence_id long, offset long")
