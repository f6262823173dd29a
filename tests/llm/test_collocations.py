import re
from collections import Counter

import numpy as np

from plumbline.llm import collocations as module
from plumbline.llm.collocations import collocations

DOCS = "doc_id long, text string, lang string, phrase string, n long"
UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, most=3, least=10, percent=50, top=2000):
    langs = {}
    for _, text, lang, *_ in rows:
        f, n = langs.setdefault("und" if lang is None else lang, (Counter(), [0]))
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(str.maketrans(UPPER))):
            words = re.findall("[^\x20\x09]+", piece)
            n[0] += len(words)
            f.update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, (f, n) in langs.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, cut = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[0], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def table(rng, many):
    words = np.array(["the", "New", "york", "City", "of", "Zürich", "a\x0bb", "étage", "\xa0x", "im", "Über"])
    rows = []
    for i in range(many):
        text = "".join(str(w) + str(rng.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ", "])) for w in rng.choice(words, 40, p=[0.3, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]))
        rows.append((i, text + "new york city " * (i % 5 == 0), ["en", "de", None, "und"][i % 4] if i % 3 else "en", "x", 1))
    return rows + [(None, None, "en", "x", 1), (1, "", None, "x", 1), (2, " ,.! ", "zz", "x", 1), (3, "solo", "zz", "x", 1), (3, "tie tie " * 40, "tt", "x", 1)]


def test_equal_to_brute_force(spark):
    rows = table(np.random.default_rng(2), 120)
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    got = collocations(frame)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert collocations(frame.limit(0)).collect() == []


def test_longer_phrases_and_ties_across_ranges(spark):
    rows = table(np.random.default_rng(4), 60)
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, collocations(frame, max_words=4, min_count=3, covered_percent=60, per_lang=7).collect())) == brute(rows, 4, 3, 60, 7)


def test_long_pieces_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(1, " ".join(rng.choice(list("abcd"), 500)), "en", "x", 1), (2, "a b c d e f g", "en", "x", 1)]
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, DOCS)).collect())) == brute(rows)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", 1, "a", 10**12), ("en", 1, "b", 10**12 + 7), ("en", 2, "a b", 10**12 - 3)], "lang string, k int, phrase string, n long")
    a, left, right = 10**12 - 3, 10**12, 10**12 + 7
    assert [tuple(r) for r in module.scored_phrases(counts).collect()] == [("en", "a b", a, left, right, 1_000_000 * a * a // (left * right))]


def test_small_tables_and_long_words(spark, monkeypatch):
    """Tables of counts that are emptied again and again, in batches of few buckets; very long words."""
    for name, value in (("HELD", 40), ("BATCH", 3)):
        monkeypatch.setattr(module, name, value)
    rows = table(np.random.default_rng(6), 50) + [(9, ("x" * 3000 + " y ") * 12, "en", "x", 1), (9, ("x" * 2999 + " y ") * 12, "en", "x", 1)]
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, DOCS)).collect())) == brute(rows)
