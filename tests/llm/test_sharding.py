import zlib
from math import floor, log2

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.sharding import kd_shards


def check(out, texts, shards):
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == sorted(
        (i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts
    )
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


def test_sizes_are_near_equal(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        n = int(rng.lognormal(5, 1))
        rows.append((i, "é" * (n // 3) + "x" * n, None if i % 50 == 0 else ["en", "fr"][i % 2], "hot" if i % 3 else f"s{i % 17}", 5))
    rows += [(i, "same text " * 20, "en", "hot", 5) for i in range(5000, 5200)] + [(1, rows[1][1], "fr", "hot", 5), (None, "x", None, None, 5), (9000, None, "en", "s1", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    sizes = check(kd_shards(frame, 5).collect(), [(r[0], r[1]) for r in rows], 5)
    largest = max(len((r[1] or "").encode()) for r in rows)
    assert len(sizes) == 5 and max(sizes.values()) - min(sizes.values()) <= 4 * largest
    parts = {r.shard for r in kd_shards(frame, None, sum(sizes.values()) * 2 // 3).collect()}
    assert parts == {0, 1}


def test_small_tables(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert kd_shards(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a", "en", "s")] * 3
    assert sum(check(kd_shards(spark.createDataFrame(rows, schema)).collect(), [(5, "a")] * 3, 8).values()) == 6


def axis(values, sizes, key):
    """The middle of each value's bytes on the axis of all bytes, in parts of 2**22."""
    total, before, out = sum(sizes), 0, {}
    each = {v: sum(s for w, s in zip(values, sizes, strict=True) if w == v) for v in set(values)}
    for v in sorted(each, key=lambda v: key(v, each[v])):
        out[v] = int((before + each[v] / 2) / total * (2**22 - 1))
        before += each[v]
    return [out[v] for v in values]


def brute_tree(points, sizes, rows, shards, first, out):
    """Split the rows at the weighted median of the dimension with the largest deviation, down to one shard."""
    if shards == 1 or not rows:
        out.update(dict.fromkeys(rows, first))
        return
    weight = np.array([sizes[i] for i in rows], float)
    widths = []
    for d in range(3):
        x = np.array([points[i][d][0] for i in rows]) / 2**22
        mean = (weight * x).sum() / weight.sum()
        widths.append((round(float(np.sqrt(max(0, (weight * x * x).sum() / weight.sum() - mean**2))), 9), d))
    d = max(widths)[1]
    rows = sorted(rows, key=lambda i: points[i][d])
    goal, below, cut = weight.sum() * (shards // 2) / shards, 0, 0
    for at, i in enumerate(rows):
        if below + sizes[i] >= goal:
            cut = at + 1 if below + sizes[i] - goal <= goal - below else at
            break
        below += sizes[i]
    brute_tree(points, sizes, rows[:cut], shards // 2, first, out)
    brute_tree(points, sizes, rows[cut:], shards - shards // 2, first + shards // 2, out)


def test_equals_a_brute_force_tree(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(260):
        lang = ["en", "en", "fr", None][int(rng.integers(4))]
        rows.append((i, f"t{i} " + "x" * int(rng.integers(60, 900)), lang, "hot" if rng.random() < 0.4 else f"s{rng.integers(30)}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    tie = {r.doc_id: r.t for r in frame.select("doc_id", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(2**28)).alias("t")).collect()}
    sizes = [len(r[1]) + 1 for r in rows]
    names = [[zlib.crc32((r[k] if r[k] is not None else "\x00").encode()) % 4096 for r in rows] for k in (2, 3)]
    axes = [axis(v, sizes, lambda v, n: (-n, v)) for v in names]
    axes.append(axis([floor(128 * log2(1 + len(r[1]))) for r in rows], sizes, lambda v, n: v))
    points = [[(a[i], tie[i]) for a in axes] for i in range(len(rows))]
    for shards in (8, 5):
        want = {}
        brute_tree(points, sizes, list(range(len(rows))), shards, 0, want)
        assert {r.doc_id: r.shard for r in kd_shards(frame, shards).collect()} == want


def test_rows_that_are_alike_and_very_long_texts_split(spark):
    rows = [(None, "same", "en", "hot")] * 4000 + [(1, "y" * 5_000_000, "en", "hot"), (2, "z" * 6_000_000, "en", "hot")]
    out = kd_shards(spark.createDataFrame(rows[:4000], "doc_id long, text string, lang string, source string"), 8).collect()
    sizes = check(out, [(r[0], r[1]) for r in rows[:4000]], 8)
    assert max(sizes.values()) - min(sizes.values()) <= 0.05 * max(sizes.values())
    out = kd_shards(spark.createDataFrame(rows[4000:], "doc_id long, text string, lang string, source string"), 2).collect()
    assert sorted((r.doc_id, r.slot) for r in out) == [(1, 0), (2, 0)] and {r.shard for r in out} == {0, 1}
