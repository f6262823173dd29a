import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import divergence as module
from plumbline.llm.divergence import divergences

DOCS = "doc_id long, text string, lang string, source string, term string, rank long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, shown=50):
    counts, docs, groups = {}, {}, {}
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        groups.setdefault(lang, set()).add(source)
        counts.setdefault((lang, source), Counter()).update(words)
        docs.setdefault(lang, Counter()).update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= least]
        shares = {}
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, total)]:
            n = sum(c[t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            far = sorted((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            more = sorted((shares[None][t] - shares[s][t], t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > shares[None][t])
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", far), ("term", more[:shown])) for k, (v, i) in enumerate(found)]
    return sorted(out)


def table(rng, sources, many, vocab):
    """Some terms in all sources, some in one or two; a source with a third of the rows."""
    rows = []
    for i in range(many):
        s = 0 if i % 3 == 0 else int(rng.integers(sources))
        own = [f"Own{'abcdefghijklmnop'[s % 16]}é", f"par{'abcdefghijklmnop'[s // 2 % 16]}"]
        words = [*rng.choice(vocab, 12), *rng.choice(own, int(rng.integers(0, 5)))]
        rows.append((i, "1, ".join(words), ["en", "de", None][i % 7 % 3], f"s{s}" if s % 5 else None, "x", 1))
    return rows + [(None, None, "en", "empty", "x", 1), (1, "", "xx", None, "x", 1), (2, "12 ,", "xx", "b", "x", 1), (3, "Word", "xx", "c", "x", 1), (3, "Word", "xx", "c", "x", 1)]


@pytest.mark.parametrize(("side", "postings", "percent"), [(256, 200_000, 25), (3, 20, 25), (4, 30, 101), (2, 50, 0)])
def test_equal_to_brute_force(spark, monkeypatch, side, postings, percent):
    """Whatever the tiles, the slices and the share of heavy terms (all, some, none)."""
    monkeypatch.setattr(module, "SIDE", side)
    monkeypatch.setattr(module, "POSTINGS", postings)
    monkeypatch.setattr(module, "HEAVY_PERCENT", percent)
    vocab = np.array([a + b for a in "abcdefg" for b in "xyzÄ"])
    rows = table(np.random.default_rng(1), 11, 400, vocab)
    got = divergences(spark.createDataFrame(rows, DOCS).repartition(4))
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_and_without_kept_terms(spark):
    rows = [(i, f"word{i}", "en", f"s{i % 3}", "x", 1) for i in range(9)]
    frame = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, divergences(frame).collect())) == brute(rows)
    assert {r.value for r in divergences(frame).collect()} == {0}
    assert divergences(frame.limit(0)).collect() == []


@pytest.mark.parametrize("held", [1, 50, 10**6])
def test_tiles_in_parts(monkeypatch, held):
    """Light corrections and heavy tiles are the same sums, whatever numpy holds at a time."""
    monkeypatch.setattr(module, "HELD", held)
    rng = np.random.default_rng(0)
    z = rng.integers(1, 50, 9)
    shares = np.where(rng.random((40, 9)) < 0.4, rng.integers(50, 10**9, (40, 9)), 0)
    term, g = np.nonzero(shares)
    p = shares[term, g]
    full = np.where(shares > 0, shares, z)
    want = np.abs(full[:, :, None] - full[:, None, :]).sum(axis=0) - 40 * np.abs(z[:, None] - z[None, :])
    a, b = np.array([0, 3, 4]), np.array([1, 2, 8])
    mixed = rng.permutation(len(term))
    assert (module._tile_sums(True, a, b, term[mixed], g[mixed], p[mixed], z) == want[np.ix_(a, b)]).all()
    light = module._tile_sums(False, a, b, term[mixed], g[mixed], p[mixed], z)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = (shares[:, x] > 0) & (shares[:, y] > 0)
            px, py = shares[both, x], shares[both, y]
            assert light[i, j] == (np.abs(px - py) - np.abs(px - z[y]) - np.abs(py - z[x]) + abs(z[x] - z[y])).sum()
