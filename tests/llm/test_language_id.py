import zlib

import numpy as np
import pytest

from plumbline.llm import gru
from plumbline.llm.language_id import ROWS_A_LANGUAGE, document_probabilities, identified, identify, labelled_sample, training_windows


def loss(model, steps, labels):
    p = gru.probabilities(model, steps)
    return -np.log(p[:, labels, np.arange(steps.shape[1])]).mean()


def test_backpropagation_matches_differences(monkeypatch):
    rng = np.random.default_rng(0)
    steps, labels = rng.integers(97, 105, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    caught = {}
    model = gru.init(3, 4, seed=1)
    model = {k: v.astype(np.float64) for k, v in model.items()}
    monkeypatch.setattr(gru, "init", lambda *a, **k: {n: v.copy() for n, v in model.items()})
    real = np.sqrt

    def spy(x):
        caught.setdefault("norm", float(x)) if np.ndim(x) == 0 else None
        return real(x)

    monkeypatch.setattr(gru.np, "sqrt", spy)
    gru.train(steps.T.copy(), labels, 3, epochs=1, batch=5)
    monkeypatch.setattr(gru.np, "sqrt", real)
    total = 0.0
    for name, values in model.items():
        flat = values.reshape(-1)
        touched = range(flat.size) if name[0] != "E" else [r * 256 + c for r in range(12) for c in range(97, 105)]
        for i in touched:
            old, eps = flat[i], 1e-3
            flat[i] = old + eps
            up = loss(model, steps, labels)
            flat[i] = old - eps
            down = loss(model, steps, labels)
            flat[i] = old
            total += ((up - down) / (2 * eps)) ** 2
    assert abs(caught["norm"] - total) < 0.03 * total


def test_identify(spark):
    rng = np.random.default_rng(1)
    kinds = {"aa": ["the", "thing", "that", "of", "and"], "bb": ["öde", "ünd", "schön", "zu", "ach"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join(rng.choice(kinds[lang], 40)), lang, "s"))
    rows += [(1000, None, "aa", "s"), (1001, "123 !!", "bb", "s"), (1002, "", None, "s"), (None, "the thing", "bb", "s"), (1003, "öde ünd " * 5000, None, "s"), (5, rows[5][1], "bb", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = identify(frame).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].lang_pred == ["aa", "bb"][i % 2] for i in range(240)]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "bb" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.lang_pred for r in identify(frame.where("lang is null")).collect()} == {"und"}
    assert identify(frame.limit(0)).count() == 0


def test_windows_pool_like_one_document():
    model = gru.init(3)
    texts = [b"", b"short", b"x" * 128, b"some longer text " * 40]
    together = document_probabilities(model, texts)
    alone = np.concatenate([document_probabilities(model, [t]) for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and np.allclose(together[1:].sum(axis=1), 1, atol=1e-5)


def test_labelled_rows_are_bounded_and_read_whole(spark):
    rows = [(i, f"abc {i} " * (i % 5 * 40 + 1), f"lang{i % 70:02d}") for i in range(700)] + [(9000 + i, f"hot {i}", "hot") for i in range(3000)] + [(7, "Z later", "lang07")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = labelled_sample(frame, False)
    texts = {(lang, text) for _, text, lang in rows}
    assert set((lang, text) for lang, text in sample) <= texts and ("lang07", "Z later") not in sample
    by = {}
    for lang, _ in sample:
        by[lang] = by.get(lang, 0) + 1
    assert by["hot"] == ROWS_A_LANGUAGE and len(by) > 65 and sum(by.values()) > 250 + 450
    windows, classes, names = training_windows(sample)
    assert len(names) == len(by) and len(windows) == len(classes) == sum(-(-len(t.encode()) // 64) for _, t in sample)
    held = labelled_sample(frame, True)
    assert not set(held) & set(sample) and set(held) <= texts


def test_texts_of_no_learnt_language_are_rejected(spark):
    rng = np.random.default_rng(3)
    kinds = {"aa": ["the", "thing", "that", "of", "and"], "bb": ["öde", "ünd", "schön", "zu", "ach"]}
    rows = [(i, " ".join(rng.choice(kinds[["aa", "bb"][i % 2]], 40)), ["aa", "bb"][i % 2], "k") for i in range(400)]
    odd = [(1000 + i, " ".join(w for pair in zip(rng.choice(kinds["aa"], 20), rng.choice(kinds["bb"], 20)) for w in pair), None, "k") for i in range(20)]
    odd += [(2000, None, "aa", "k"), (2001, "", "aa", "k"), (2002, "12 !", "aa", "k")]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    kept = [r.doc_id for r in identified(frame, frame).collect()]
    assert len(kept) == len(set(kept)) and identified(frame, frame).columns == frame.columns
    assert len([i for i in kept if i < 1000]) >= 0.99 * 400 and len([i for i in kept if 1000 <= i < 2000]) <= 4 and not [i for i in kept if i >= 2000]
    assert identified(frame.limit(0), frame).count() == identified(frame, frame.limit(0)).count() == 0


def test_threshold_counts_every_held_out_row(spark):
    """More held-out rows of a language than a training sample has: all count, repeated and null ids too."""
    from plumbline.llm.language_id import HELD_OUT, RECALL, fit, least_score

    words = ["haus", "baum", "wald", "house", "tree", "wood"]
    rows = [(i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 9)), "de" if i % 2 else "en") for i in range(3000)]
    rows += [(None, "zzz qqq", "de")] * 6 + [(5, "12 34", "en"), (6, None, "en"), (7, "tree", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, _ = fit(frame)
    held = [t for i, t, lang in rows if (i is None or zlib.crc32(str(i).encode()) % 4 == HELD_OUT) and lang and t and any(c.isalpha() for c in t)]
    assert len(held) > 2 * ROWS_A_LANGUAGE
    scores = document_probabilities(model, [t.encode() for t in held]).max(axis=1)
    assert least_score(model, frame) == pytest.approx(np.quantile(scores, 1 - RECALL, method="lower"), abs=2e-5)
    assert least_score(model, frame.limit(0)) == 0
