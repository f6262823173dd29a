import re

import numpy as np

from plumbline.llm.quality_rules import BEGIN, LEAST_DISTANCE, METRICS, PRIOR_ROWS, filter_quality, group_fences, quantile_sketches, sketch_quantiles


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for places in seen.values() if len(places) > 1 for p in places for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_verdicts(spark):
    rng = np.random.default_rng(0)
    vocab = [f"w{i}é" for i in range(3000)]
    rows = []
    for i in range(300):
        words = rng.choice(vocab, rng.integers(55, 120))
        junk = i % 10 == 0
        rows.append((i, "\n".join(" ".join(f"{w}###" if junk else w for w in words[s : s + 9]) for s in range(0, len(words), 9)), None if i % 3 else "en", "s" if i % 2 else None, "x"))
    rows += [
        (900, None, "en", "s", "x"), (901, "", "en", "s", "x"), (902, "a b c a b c d " * 30, "en", "s", "x"), (903, "same line here\n" * 40, "en", "s", "x"),
        (904, " \t\n\n x  y\x0bz ", "en", "s", "x"), (None, rows[1][1], "en", "s", "x"), (1, rows[1][1], None, "s", "x"), (905, " ".join(rng.choice(vocab, 60000)), "en", "s", "x"), (906, "a a a a", "en", "s", "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    out = filter_quality(frame).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for i, text, *_ in rows:
        r = got[i]
        n, chars, symbols, dup, covered = brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, covered), i
        assert r.base_failed == (n < 50 or 100 * covered > 50 * n)
    assert [got[i].kept for i in range(300)] == [i % 10 != 0 for i in range(300)]
    assert filter_quality(frame.limit(0)).count() == 0


def test_sketches_bound_quantiles_and_merge(spark):
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.lognormal(4, 2, 4000)]
    frame = spark.createDataFrame([("g", v) for v in values], "g string, m long")
    sketch = quantile_sketches(frame, ["g"], ["m"])
    halves = quantile_sketches(frame.where("m % 2 = 0"), ["g"], ["m"]).union(quantile_sketches(frame.where("m % 2 = 1"), ["g"], ["m"]))
    merged = halves.groupBy("g", "metric", "shift", "high").sum("n").withColumnRenamed("sum(n)", "n")
    ps = [5, 50, 95]
    one, two = (sketch_quantiles(s, ["g"], ps).first() for s in (sketch, merged))
    assert one == two
    for p in ps:
        exact = sorted(values)[int(np.ceil(p / 100 * len(values))) - 1]
        assert exact <= one[f"q{p}"] <= exact * (1 + 1 / 32) + 1
    assert set(METRICS) == {"symbol_rate", "dup_line_rate", "repeat_rate", "word_length"}


def bin_end(v):
    shift = max(v.bit_length() - 6, 0)
    return ((v >> shift) + 1 << shift) - 1


def brute_fence(values, percent, spreads):
    values = sorted(bin_end(v) for v in values)
    quantile = lambda xs, p: xs[-(-p * len(xs) // 100) - 1]
    middle, upper = quantile(values, 50), quantile(values, percent)
    if upper > middle:
        return upper + spreads * (upper - middle)
    beyond = [v for v in values if v > middle]
    return middle + max(LEAST_DISTANCE, (quantile(beyond, BEGIN) - middle) // 2 if beyond else 0)


def test_every_group_has_fences_of_its_own_for_every_metric(spark):
    rng = np.random.default_rng(4)
    rows = []
    for part, scale in (("calm", 1), ("wild", 6), ("small", 3)):
        for i in range(40 if part == "small" else 900):
            junk = i % 15 == 0
            rows.append(("en", part, 700 * scale + i % 9 if junk else 0, int(rng.integers(0, 200 * scale)) if i % 12 == 0 else 0, int(rng.exponential(40 * scale)), int(rng.normal(400 + 30 * scale, 15 * scale))))
    rows += [("de", "flat", 0, 0, 0, 500)] * 30
    frame = spark.createDataFrame(rows, "g string, s string, symbol_rate long, dup_line_rate long, repeat_rate long, word_length long")
    got = {(r.g, r.s, r.metric): r.fence for r in group_fences(quantile_sketches(frame, ["g", "s"], list(METRICS)), "g", "s").collect()}
    for k, (metric, (percent, spreads)) in enumerate(METRICS.items()):
        assert len({got["en", s, metric] for s in ("calm", "wild", "small")}) == 3, metric
        assert got["de", "flat", metric] == bin_end(500 if metric == "word_length" else 0) + LEAST_DISTANCE
        for s in ("calm", "wild", "small"):
            own = [r[k + 2] for r in rows if r[:2] == ("en", s)]
            prior = brute_fence([r[k + 2] for r in rows if r[0] == "en"], percent, spreads)
            assert got["en", s, metric] == (len(own) * brute_fence(own, percent, spreads) + PRIOR_ROWS * prior) // (len(own) + PRIOR_ROWS)


def test_a_document_is_judged_by_its_own_group(spark):
    """The same text is usual in one source and an outlier in the other."""
    rng = np.random.default_rng(6)
    plain = [" ".join(f"w{k}" for k in rng.integers(0, 9000, 80)) for _ in range(300)]
    coded = [" ".join(f"w{k}##" if j % 2 else f"w{k}" for j, k in enumerate(rng.integers(0, 9000, 80))) for _ in range(301)]
    rows = [(i, t, "en", "news") for i, t in enumerate(plain)] + [(1000 + i, t, "en", "code") for i, t in enumerate(coded[:300])]
    rows += [(5000, coded[300], "en", "news"), (5001, coded[300], "en", "code")]
    kept = {r.doc_id: r.kept for r in filter_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept.pop(5000) and all(kept.values())
