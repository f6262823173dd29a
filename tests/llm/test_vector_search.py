import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import vector_search
from plumbline.llm.vector_search import top_k

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, every, k):
    kept = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in kept if i % every == 0):
        scored = sorted((-int(kept[q] @ v), i) for i, v in kept.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32((centres[i % 6] + 0.3 * rng.normal(size=8)) / 4)]) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(900)]  # one vector many times
    rows += [(5000, None), (5010, [1.0, None] * 4), (5020, [float("nan")] * 8), (5030, [float("inf")] * 8), (None, rows[0][1]), (10, rows[10][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, 10, 5).collect())
    assert got == brute(rows, 10, 5)


def test_few_and_no_rows(spark):
    rows = [(0, [0.5, 0.5]), (1, [0.1, 0.2]), (2, [0.1, 0.2])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in top_k(frame, 50, 5).collect()) == [(0, 1, 1), (0, 2, 2)]
    assert top_k(frame.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    """Beyond 2**53 doubles are no whole numbers any more: scores that differ by one keep their order."""
    big = 1e6
    rows = [(0, [big, 1.0, 0.0]), (1, [big, 1.0, 0.0]), (2, [big, 1.0 + 1 / 256, 0.0]), (3, [big, 1.0 - 1 / 256, 0.0]), (4, [-big, 0.0, 0.0]), (5, [1e8, 0.0, 0.0])]
    rows += [(10 + i, [0.5, 0.25, i / 64]) for i in range(20)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA.replace("float", "double"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(frame, 10, 5).collect())
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    ends = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in top_k(ends).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63 - 1))]


def test_only_annuli_within_the_bound_are_visited(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 6))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None])
    pivots = vector_search.choose_pivots(x, 8)
    d = vector_search._distances(x, pivots)
    of = d.argmin(axis=1)
    annuli, members = [], []
    for p in range(8):
        rows = np.flatnonzero(of == p)
        rows = rows[np.argsort(d[rows, p])]
        for part in np.array_split(rows, max(1, len(rows) // 50)):
            annuli.append({"pivot": p, "lo": d[part, p].min(), "hi": d[part, p].max(), "norm2": (x[part] ** 2).sum(axis=1).max()})
            members.append(part)
    index = vector_search.Annuli(pivots, annuli)
    for q in range(0, 4000, 400):
        scores = x @ x[q]
        floor = np.sort(scores)[-6]
        reached = index.reaching(d[q], float(x[q] @ x[q]), floor)
        assert set(np.flatnonzero(scores >= floor)) <= set(np.concatenate([members[i] for i in reached]))
        assert len(reached) < len(annuli) / 2 and len(index.first(d[q])) == vector_search.FIRST


def test_vectors_of_other_lengths_take_part(spark):
    """The row with the smallest hash is the odd one; SQL sums over the common components."""
    rng = np.random.default_rng(4)
    sizes = spark.range(300).orderBy(F.xxhash64("id"), "id").limit(2).collect()
    odd = {sizes[0].id: 3, sizes[1].id: 11}
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=odd.get(i, 8)))]) for i in range(300)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), 10, 5).collect())
    assert got == brute([(i, v + [0.0] * (11 - len(v))) for i, v in rows], 10, 5)
