import itertools

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import near_dedup
from plumbline.llm.components import connected_components
from plumbline.llm.near_dedup import least_matches, near_duplicates, one_of_each
from plumbline.llm.shingles import shingle_set, words

SCHEMA = "doc_id long, text string, digest string, band long, component string"


def brute(rows):
    sets = {i: set(shingle_set(words(t)).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(500)]
    base = list(rng.choice(vocab, 120))
    passage = " ".join(rng.choice(vocab, 60))
    rows = []
    for i in range(60):  # edited copies of one text around the threshold
        edited = list(base)
        for at in rng.choice(120, rng.integers(0, 6), replace=False):
            edited[at] = rng.choice(vocab)
        rows.append((i, " ".join(edited).upper() if i % 3 else " ".join(edited)))
    rows += [(100 + i, passage + " " + " ".join(rng.choice(vocab, 30))) for i in range(50)]
    rows += [(200, "one two"), (201, "One  two"), (202, "one two three"), (203, ""), (204, None), (205, "  \t")]
    rows += [(300, " ".join(rng.choice(vocab, 20000)))]
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    want = brute(rows)
    assert got == want
    assert got[201][1] == 200 and got[203] == (0, 203) and got[204] == (0, 204)


def test_repeats_nulls_and_empty(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (3, 3, True), (7, 3, False), (7, 3, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_with_two_texts_is_one_document(spark):
    rows = [(7, "a b c d e f", "x"), (7, "b b c d e f", "y"), (3, "B b c d e f", "z"), (9, "a b c d e f", "v"), (None, "a b c d e f", "n"), (11, None, "u"), (11, None, "u")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_shingles string")
    out = near_duplicates(frame).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in out) == [(-1, -1), (3, 3), (7, 7), (7, 7), (9, 7), (11, 11), (11, 11)]
    stay = sorted((r.doc_id or -1, r.text, r.n_shingles) for r in one_of_each(frame).collect())
    assert stay == [(-1, "a b c d e f", "n"), (3, "B b c d e f", "z"), (7, "a b c d e f", "x"), (11, None, "u")]
    assert one_of_each(frame.limit(0)).count() == 0


def sharing(n, passage=200, own=40, near=()):
    """Texts around one passage, at similarity passage / (passage + 2 * own); ``near`` places repeat the text before but for two words."""
    texts = []
    for i in range(n):
        text = [f"p{k}" for k in range(passage + 4)] + [f"d{i}x{k}" for k in range(own)]
        texts.append(texts[-1][:-2] + [f"e{i}", "end"] if i in near else text)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_shared_passage_below_the_threshold_makes_no_pairs_of_its_texts(spark):
    pairs = {}
    for n in (500, 1000, 2000):
        rows = spark.createDataFrame([(i, i, t) for i, t in sharing(n, near=(n // 2, n - 1))], "doc_id long, component long, text string")
        pairs[n] = {(r.a, r.b) for r in near_dedup.index_pairs(rows).collect()}
        assert {(n // 2 - 1, n // 2), (n - 2, n - 1)} <= pairs[n]
        assert len(pairs[n]) <= n // 50
    rows = sharing(400, near=(200, 399)) + [(1000 + i, t) for i, t in sharing(60, own=20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_the_index_loses_no_pair_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(120):
        text = list(base)
        for at in rng.choice(90, rng.integers(0, 5), replace=False):
            text[at] = f"n{rng.integers(0, 300)}"
        rows.append((i, " ".join(text[: rng.integers(70, 91)])))
    sets = {i: set(shingle_set(words(t)).tolist()) for i, t in rows}
    linked = {(a, b) for a, b in itertools.combinations(range(120), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    found = near_dedup.index_pairs(spark.createDataFrame([(i, i, t) for i, t in rows], "doc_id long, component long, text string")).collect()
    assert linked and linked <= {(r.a, r.b) for r in found}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_pruning_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    least = least_matches()
    draws = (rng.random((20000, 192)) < 0.75).reshape(20000, -1, 32).sum(axis=2).cumsum(axis=1)
    assert (draws < np.array(least)).any(axis=1).mean() < 2e-3
    assert least[-1] > 100 and list(least) == sorted(least)


def test_unrelated_long_texts_are_pruned_and_near_copies_are_not():
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        tokens = [f"w{k}" for k in rng.integers(0, 5000, 2000)]
        texts += [" ".join(tokens), " ".join([*tokens[:1900], *(f"x{k}" for k in rng.integers(0, 5000, 100))])]
    signed = next(near_dedup._sign(iter([pd.DataFrame({"doc_id": range(len(texts)), "copies": 1, "text": texts})])))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    frame = pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs], "sig_a": [signed["sig"][a] for a, _ in pairs], "sig_b": [signed["sig"][b] for _, b in pairs]}).assign(component_a=0, component_b=1)
    kept = next(near_dedup._plausible(iter([frame])))
    assert set(zip(kept["a"], kept["b"], strict=True)) == {(2 * i + 1, 2 * i) for i in range(40)}
