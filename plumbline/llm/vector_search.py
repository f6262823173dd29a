"""Exact top-k by inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it. Distances are
cut into at most ``SLICES`` slices a pivot, and these are joined to annuli of
about ``CHUNK_ROWS`` vectors; a crowded slice (one vector repeated without end)
is salted into several chunks. A query first visits the ``FIRST`` annuli that
lie nearest, which gives it a k-th score. Around each pivot it then expands over
the sorted annuli as far as the triangle inequality allows a score that reaches
it: for a query q, a vector v and a pivot p, |q - v| >= |d(q, p) - d(v, p)|, and
2 q.v = |q|^2 + |v|^2 - |q - v|^2. Only visits are written, and an annulus is
copied only for the blocks of queries that visit it. Inside a chunk the vectors
lie in order of distance and blocks are skipped by the same bound; a query's
candidates come back as at most k rows a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, small_or_shuffled, stored

#: Sample rows from which pivots are chosen, pivots, vectors of a chunk and of a block in it, queries of a block.
SAMPLE_ROWS, PIVOTS, CHUNK_ROWS, BLOCK, QUERY_BLOCK = 2_000, 64, 4_096, 256, 2_048
#: Distance slices of a pivot; annuli, and tables of them, are at most PIVOTS * (SLICES + 1).
SLICES = 1_024
#: Annuli that a query visits before it has a k-th score.
FIRST = 3
#: Doubles are exact integers below this, and scores end at the range of a long.
EXACT, LAST = 2.0**52, 2**63 - 1
#: Share of the squared lengths that covers the rounding of a bound.
ROUNDING = 1e-11


def _matrix(vectors, width: int = 0) -> np.ndarray:
    """Whole numbers (rows, components); shorter vectors end in zeros."""
    vectors = list(vectors)
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal of the sample from its first vector."""
    chosen = [0]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots), by differences, so that a small distance is as precise as a large one."""
    width = max(x.shape[1], pivots.shape[1])
    x, pivots = _wide(x.astype(float), width), _wide(pivots, width)
    return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(float) ** 2).sum(axis=1)


def _scores(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products as longs, exact; those beyond a long stop at its ends."""
    if sqrt(_squares(queries).max()) * sqrt(_squares(x).max()) < EXACT:
        return (queries.astype(float) @ x.T.astype(float)).astype(np.int64)
    return np.clip(queries.astype(object) @ x.T.astype(object), -LAST, LAST).astype(np.int64)


def _keyed(pivots):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                d = _distances(x, pivots.value)
                at = d.argmin(axis=1)
                pdf["pivot"], pdf["dist"] = at.astype(np.int32), d[np.arange(len(x)), at]
                pdf["norm2"] = _squares(x)
                yield pdf[["vec_id", "v", "pivot", "dist", "norm2"]]

    return run


class Annuli:
    """The index's annuli in order of pivot and distance, with the bounds of a query on them."""

    def __init__(self, pivots: np.ndarray, annuli: list[dict]) -> None:
        self.pivots = pivots
        self.pivot = np.array([a["pivot"] for a in annuli])
        self.lo, self.hi, self.norm2 = (np.array([a[c] for a in annuli], float) for c in ("lo", "hi", "norm2"))
        self.start = np.searchsorted(self.pivot, np.arange(len(pivots) + 1))
        self.top = np.array([self.norm2[s:e].max(initial=0) for s, e in zip(self.start[:-1], self.start[1:], strict=True)])
        self.pivot2 = _squares(pivots)

    def _near(self, d: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The least distance between the query and a vector of each annulus."""
        mine = d[self.pivot[at]]
        return np.maximum(0, np.maximum(mine - self.hi[at], self.lo[at] - mine))

    def first(self, d: np.ndarray) -> np.ndarray:
        """The nearest annuli: around each pivot those at the query's own distance are tried."""
        spots = []
        for p, (s, e) in enumerate(zip(self.start[:-1], self.start[1:], strict=True)):
            at = s + np.searchsorted(self.hi[s:e], d[p])
            spots.append(np.arange(max(s, at - FIRST), min(e, at + FIRST)))
        spots = np.concatenate(spots)
        return spots[np.lexsort((spots, self._near(d, spots)))[:FIRST]]

    def reaching(self, d: np.ndarray, q2: float, floor: float) -> np.ndarray:
        """All annuli that may hold a vector with a score of ``floor`` or more."""
        if floor == -np.inf:
            return np.arange(len(self.pivot))
        # the square of the radius within which a vector of the pivot's largest length reaches the floor
        reach = q2 + self.top - 2 * floor + 2 * (1 + ROUNDING * (q2 + self.top + self.pivot2))
        spots = []
        for p in np.flatnonzero(reach >= 0):
            s, e, radius = self.start[p], self.start[p + 1], sqrt(reach[p])
            spots.append(np.arange(s + np.searchsorted(self.hi[s:e], d[p] - radius), s + np.searchsorted(self.lo[s:e], d[p] + radius, "right")))
        spots = np.concatenate(spots) if spots else np.empty(0, np.int64)
        best = (q2 + self.norm2[spots] - self._near(d, spots) ** 2) / 2 + 1 + ROUNDING * (q2 + self.norm2[spots] + self.pivot2[self.pivot[spots]])
        return spots[best >= floor]


def _visits(annuli, first: bool):
    """query_id, annulus, floor of the first visits, or of the others that the floor leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = annuli.value
        for pdf in batches:
            if not len(pdf):
                continue
            q = _matrix(pdf["q"])
            d, q2 = _distances(q, index.pivots), _squares(q)
            floors = np.full(len(pdf), -np.inf) if first else pdf["floor"].fillna(-np.inf).to_numpy(float)
            for query_id, row, square, floor in zip(pdf["query_id"], d, q2, floors, strict=True):
                at = index.first(row)
                if not first:
                    at = np.setdiff1d(index.reaching(row, square, floor), at)
                if len(at):
                    yield pd.DataFrame({"query_id": query_id, "annulus": at.astype(np.int32), "floor": floor})

    return run


def top_of_chunk(ids: np.ndarray, x: np.ndarray, norm2: np.ndarray, dist: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, pivot: np.ndarray, k: int):
    """(query row, id, score) of each query's k best in one chunk that reach its floor; blocks in order of distance."""
    order = np.argsort(dist, kind="stable")
    ids, x, norm2, dist = ids[order], x[order], norm2[order], dist[order]
    d, q2, p2 = _distances(queries, pivot[None, :])[:, 0], _squares(queries), float((pivot**2).sum())
    starts = list(range(0, len(ids), BLOCK))
    # blocks nearest in distance to the queries' middle first, so that floors rise early
    middle = np.median(d)
    starts.sort(key=lambda s: abs(dist[s] - middle))
    none = -LAST - 1
    best_ids, best_scores = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0), np.int64)
    floors = floors.copy()
    for s in starts:
        e = min(len(ids), s + BLOCK)
        near, most = np.maximum(0, np.maximum(d - dist[e - 1], dist[s] - d)), norm2[s:e].max()
        live = np.flatnonzero((q2 + most - near**2) / 2 + 1 + ROUNDING * (q2 + most + p2) >= floors)
        if not len(live):
            continue
        scores = np.full((len(queries), e - s), none, np.int64)
        scores[live] = _scores(queries[live], x[s:e])
        scores[query_ids[:, None] == ids[s:e]] = none
        all_scores = np.concatenate([best_scores, scores], axis=1)
        all_ids = np.concatenate([best_ids, np.broadcast_to(ids[s:e], scores.shape)], axis=1)
        # the complement turns the order around without leaving the range of a long
        keep = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
        best_scores, best_ids = np.take_along_axis(all_scores, keep, 1), np.take_along_axis(all_ids, keep, 1)
        if best_scores.shape[1] == k:
            floors = np.maximum(floors, np.where(best_scores[:, -1] > none, best_scores[:, -1], -np.inf))
    row, col = np.nonzero(best_scores > none)
    return row, best_ids[row, col], best_scores[row, col]


def _searched(annuli, k: int):
    def run(key, chunk: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(chunk) and len(queries):
            x = _matrix(chunk["v"])
            q = _matrix(queries["q"], x.shape[1])
            x = _wide(x, q.shape[1])
            pivot = annuli.value.pivots[int(chunk["pivot"].iloc[0])]
            ids, floors = queries["query_id"].to_numpy(), queries["floor"].to_numpy(float)
            for s in range(0, len(q), 256):
                part = slice(s, s + 256)
                row, vec, score = top_of_chunk(chunk["vec_id"].to_numpy(), x, chunk["norm2"].to_numpy(), chunk["dist"].to_numpy(), q[part], ids[part], floors[part], pivot, k)
                out.append(pd.DataFrame({"query_id": ids[part][row], "vec_id": vec, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v: one vector of whole numbers for each id."""
    sound = F.col("v0").isNotNull() & (F.size("v0") > 0) & ~F.exists("v0", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v0"))
    rows = rows.where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", F.transform("v0", lambda x: F.floor(x * 256).cast("long")).alias("v"))
    repeats = checkpointed(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))
    if not (n := repeats.count()):
        return rows
    repeats = small_or_shuffled(repeats, n)
    return rows.join(repeats, "vec_id", "left_anti").unionByName(rows.join(repeats, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def top_k(vectors: DataFrame, query_every: int = 50, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Return ``query_id, rank, vec_id, score``: the k best of every query.

    Components become floor(256 * x). Queries are the rows whose id is divisible
    by ``query_every``, candidates all rows but the query's own id; ties go to
    the smaller id. Vectors that are null, empty or hold a null or non-finite
    component, or without an id take no part; of vectors of different lengths the
    common components count (the shorter ones end in zeros). Components and
    scores of any size are exact up to the range of a long, where they end. Rows
    that repeat an id count once, with the smallest of their vectors. Other
    columns are ignored. Fewer than k candidates give as many rows; an empty
    table none. Pivots come from a sample of ``SAMPLE_ROWS``; every row is
    indexed and the result is exact.
    """
    spark = vectors.sparkSession
    rows = _vectors(vectors, vec_id, embedding)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = choose_pivots(_matrix(r.v for r in sample).astype(float), int(min(PIVOTS, max(1, sqrt(rows.count()) / 8))))
    keyed = rows.mapInPandas(_keyed(spark.sparkContext.broadcast(pivots)), "vec_id long, v array<long>, pivot int, dist double, norm2 double")
    keyed = stored(keyed, "keyed")
    width = (keyed.agg(F.max("dist")).first()[0] or 1.0) / SLICES
    keyed = keyed.withColumn("slice", F.floor(F.col("dist") / F.lit(width)).cast("int"))

    # annuli: runs of distance slices of a pivot
    slices = keyed.groupBy("pivot", "slice").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm2").alias("norm2"))
    annuli, of_slice = [], []
    for r in slices.orderBy("pivot", "slice").collect():
        last = annuli[-1] if annuli else None
        if last is None or last["pivot"] != r.pivot or last["n"] + r.n > CHUNK_ROWS:
            annuli.append({"pivot": r.pivot, "n": 0, "lo": r.lo, "hi": r.hi, "norm2": r.norm2})
        last = annuli[-1]
        last.update(n=last["n"] + r.n, hi=r.hi, norm2=max(last["norm2"], r.norm2))
        of_slice.append((r.pivot, r.slice, len(annuli) - 1))
    salts = spark.createDataFrame([(i, max(1, ceil(a["n"] / CHUNK_ROWS))) for i, a in enumerate(annuli)], "annulus int, salts int")
    where = spark.createDataFrame(of_slice, "pivot int, slice int, annulus int")
    placed = keyed.join(small_or_shuffled(where, len(of_slice)), ["pivot", "slice"])
    index = spark.sparkContext.broadcast(Annuli(pivots, annuli))
    queries = stored(rows.where(F.col("vec_id") % query_every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "queries")

    def search(visits: DataFrame) -> DataFrame:
        visits = stored(visits, "visits")
        blocks = visits.groupBy("annulus").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        plan = small_or_shuffled(checkpointed(blocks.join(small_or_shuffled(salts, len(annuli)), "annulus")), len(annuli))
        every = visits.join(queries, "query_id").join(plan, "annulus")
        wanted = every.select(
            "annulus", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "q", "floor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        )
        target = placed.join(plan, "annulus").select(
            "annulus", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int").alias("salt"), "vec_id", "v", "pivot", "dist", "norm2", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        )
        keys = ["annulus", "salt", "block"]
        return target.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(_searched(index, k), "query_id long, vec_id long, score long")

    shape = "query_id long, annulus int, floor double"
    first = stored(search(queries.mapInPandas(_visits(index, True), shape)), "first")
    floors = _ranked(first, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    floors = floors.select("query_id", F.when(F.col("n") == k, F.col("kth").cast("double")).alias("floor"))
    second = search(queries.join(floors, "query_id", "left").mapInPandas(_visits(index, False), shape))
    return _ranked(first.union(second), k).select("query_id", "rank", "vec_id", "score")
