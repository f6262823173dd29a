import numpy as np

import pytest
from pyspark.sql import functions as F

from plumbline.llm.mixing import BUCKETS, EVIDENCE_WORDS, fit_rates, mix, mixed, soft_memberships


def test_rates_equal_a_numpy_reference(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    n = rng.integers(1, 500, 200)
    frame = spark.createDataFrame([(int(i), int(a), [float(x) for x in b]) for i, (a, b) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p array<double>")
    weights = [0.6, 0.3, 0.1]
    out, targets, reached = fit_rates(frame, weights)
    natural = (n[:, None] * p).sum(0)
    budget = min(natural / weights)
    rate = np.ones(200)
    for _ in range(400):
        s = (rate * n) @ p
        if np.all(np.abs(s - budget * np.array(weights)) <= 1e-4 * budget):
            break
        rate = np.maximum(0, rate - p @ ((s - budget * np.array(weights)) / natural))
    got = np.array([r.rate for r in out.orderBy("doc_id").collect()])
    assert np.allclose(got, rate, atol=1e-9) and (got >= 0).all()
    assert np.allclose(reached, targets, atol=0.01 * budget)
    # optimality: a positive rate has no gradient left, a zero rate none that points up
    gradient = p @ ((np.array(reached) - targets) / natural)
    assert np.abs(gradient[got > 1e-6]).max() < 0.01 and gradient[got <= 1e-6].min(initial=0) > -0.01


def test_mix(spark):
    rng = np.random.default_rng(1)
    kinds = {"a": ["red", "green", "blue", "pink"], "b": ["one", "two", "three", "four"]}
    rows = [(i, " ".join(rng.choice(kinds["a" if i % 4 else "b"], 30)), "x", 1.0) for i in range(400)]
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(200)] + [(3, None), (None, "a")], "doc_id long, domain string")
    rows += [(900, None, "x", 1.0), (901, "", "x", 1.0), (None, "red red", "x", 1.0), (902, "one two " * 20000, "x", 1.0), (5, rows[5][1], "x", 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, domain string, rate double")
    out = mix(frame, labelled, {"a": 1, "b": 1}).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].domain == ("a" if i % 4 else "b") for i in range(400)]) > 0.99
    totals = {d: sum(r.rate * r.n_tokens for r in out if r.domain == d) for d in "ab"}
    assert abs(totals["a"] - totals["b"]) < 0.02 * totals["a"]
    assert all(r.rate >= 0 and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in out)
    assert got[900].n_tokens == got[901].n_tokens == 0
    assert {r.rate for r in mix(frame, labelled.limit(0)).collect()} == {1.0}
    assert mix(frame.limit(0), labelled).count() == 0


def test_mixed_rows_are_the_copies_of_mix(spark):
    rng = np.random.default_rng(2)
    kinds = {"a": ["red", "green", "blue", "pink"], "b": ["one", "two", "three", "four"]}
    rows = [(i, " ".join(rng.choice(kinds["a" if i % 4 else "b"], 30)), i % 7, 0.5) for i in range(300)] + [(900, None, 1, None), (None, "red red", 2, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, copies int, rate double")
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(200)], "doc_id long, domain string")
    plan = {r.doc_id: r.copies for r in mix(frame, labelled, {"a": 1, "b": 3}).collect()}
    got = mixed(frame, labelled, {"a": 1, "b": 3})
    assert got.columns == frame.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((row for row in rows for _ in range(plan[row[0]])), key=str)
    assert len(set(plan.values())) > 1
    assert mixed(frame, labelled.limit(0)).count() == len(rows)
    assert mixed(frame.limit(0), labelled).count() == 0


def test_posteriors_equal_a_brute_force_bayes(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    bucket = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b")).collect()}
    texts = [" ".join(rng.choice(words[: 40 + 10 * (i % 3)], rng.integers(1, 80))) for i in range(90)]
    labelled = {i: f"domain {i % 3}" for i in range(60)}
    frame = spark.createDataFrame([(i, t.upper() if i % 2 else t) for i, t in enumerate(texts)], "doc_id long, text string")
    domains, rows = soft_memberships(frame, spark.createDataFrame(list(labelled.items()), "doc_id long, domain string"))
    counts = {d: np.zeros(BUCKETS) for d in domains}
    for i, d in labelled.items():
        for w in set(texts[i].split()):
            counts[d][bucket[w]] += 1
    seen = sum(counts.values()) > 0
    for r in rows.collect():
        distinct = [bucket[w] for w in set(texts[r.doc_id].split())]
        ll = np.array([sum(np.log((c[b] + 0.5) / (c.sum() + 0.5 * BUCKETS)) if seen[b] else min(np.log((c[k] + 0.5) / (c.sum() + 0.5 * BUCKETS)) for k in np.flatnonzero(seen)) for b in distinct) for c in (counts[d] for d in domains)])
        want = np.exp(ll * EVIDENCE_WORDS / (EVIDENCE_WORDS + len(distinct)))
        assert np.allclose(r.p, want / want.sum(), atol=1e-9) and r.n_tokens == len(texts[r.doc_id].split())


def test_a_domain_without_a_target_keeps_its_share_and_unmet_targets_are_told(spark):
    rng = np.random.default_rng(7)
    p = np.repeat(np.eye(3), [100, 60, 40], axis=0)
    n = rng.integers(50, 60, 200)
    frame = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens long, p array<double>")
    _, targets, reached = fit_rates(frame, [1.0, 1.0, None])
    natural = n @ p
    assert abs(targets[2] / sum(targets) - natural[2] / natural.sum()) < 1e-9 and abs(targets[0] - targets[1]) < 1e-6
    assert np.allclose(reached, targets, atol=2e-4 * sum(targets))
    same = spark.createDataFrame([(100, [0.5, 0.5])] * 20, "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss the targets"):
        _, targets, reached = fit_rates(same, [3.0, 1.0])
    assert reached[0] == reached[1] and targets[0] == 3 * targets[1]


def test_more_domains_than_any_list_names(spark):
    rows = [(i, f"only{i % 70} word{i % 70} of{i % 70}") for i in range(280)]
    labelled = spark.createDataFrame([(i, f"d{i % 70:02d}") for i in range(140)], "doc_id long, domain string")
    out = mix(spark.createDataFrame(rows, "doc_id long, text string"), labelled, {"d00": 1.0, "d01": 2.0}).collect()
    assert np.mean([r.domain == f"d{r.doc_id % 70:02d}" for r in out]) > 0.95
    assert {r.copies for r in out if r.doc_id % 70 > 1} <= {0, 1} and sum(r.copies for r in out) > 200
