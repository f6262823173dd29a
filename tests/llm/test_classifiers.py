import numpy as np

from plumbline.llm import quality, toxicity
from plumbline.llm.quality import score_quality
from plumbline.llm.toxicity import score_toxicity

SCHEMA = "doc_id long, text string, lang string, score double, y int"


def corpus(seed=0, n=600):
    rng = np.random.default_rng(seed)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocab, 40))
        good, insult, group = i % 7 != 0, rng.random() < 0.5, rng.random() < 0.5
        if not good:
            words = [w + "###" for w in words]
        if insult:
            words[3] = "vermin"
        if group:
            words[5] = "teachers"
        rows.append((i, " ".join(words), "en", 0.0, 1))
        labels.append((i, int(good), int(insult and group)))
    return rows, labels


def test_quality_and_toxicity(spark):
    rows, labels = corpus()
    rows += [(9000, None, None, 0.0, 1), (9001, "", "en", 0.0, 1), (None, "wordaa", "en", 0.0, 1), (9002, "wordaa " * 30000, "en", 0.0, 1), (3, rows[3][1], "en", 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f, at, cut in ((score_quality, 1, 0.3), (score_toxicity, 2, 0.5)):
        out = f(docs, marks).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= cut) for r in out)
        got = {r.doc_id: r for r in out}
        held = [x for x in labels if got[x[0]].held_out]
        assert 80 < len(held) < 160
        assert np.mean([got[x[0]].predicted == x[at] for x in held]) > 0.95
        empty = f(docs, marks.limit(0)).collect()
        assert {r.score for r in empty} == {0.5}
        assert f(docs.limit(0), marks).count() == 0


def test_pairs_of_terms_are_learnt():
    """The label is a conjunction, which weights alone score below three quarters of both single words."""
    rows, labels = corpus(1, 1500)
    terms = toxicity.Terms()
    lists, y = [terms.of(r[1]) for r in rows], np.array([float(x[2]) for x in labels])
    kept = toxicity.select_terms(lists, y)
    place = {k: i for i, k in enumerate(kept)}
    own = [[place[k] for k in x if k in place] for x in lists]
    model = toxicity.fit_machine(own, y, len(kept))
    assert np.mean((toxicity.raw_scores(model, own) > 0) == y) > 0.98
    assert np.abs(model["v"]).max() > 0.3


def test_pairs_of_terms_that_say_nothing_alone(spark):
    """The label is an exclusive-or: either word alone has no log-odds."""
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(2000):
        one, other = (i // 2) % 2, i % 2
        fillers = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvxy'[k // 100]}" for k in rng.integers(0, 400, 12)]
        rows.append((i, " ".join([*fillers, *["moonish"] * one, *["sunward"] * other])))
        labels.append((i, int(one != other)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.score_toxicity(docs, marks).collect() if r.held_out]
    assert np.mean([r.predicted == labels[r.doc_id][1] for r in held]) > 0.95


def test_machine_equals_explicit_pairs():
    rng = np.random.default_rng(0)
    model = {"bias": np.array(0.3), "w": rng.normal(size=9), "v": rng.normal(size=(9, 4))}
    lists = [[0, 3, 5], [], [2], [1, 2, 3, 4, 8]]
    want = [0.3 + sum(model["w"][k] for k in x) + sum(model["v"][a] @ model["v"][b] for i, a in enumerate(x) for b in x[i + 1 :]) for x in lists]
    assert np.allclose(toxicity.raw_scores(model, lists), want)


def test_flattened_tree_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    edges = quality.bin_edges(x)
    b = quality.binned(x, edges)
    feature, split, value = tree = quality.grow(b, 0.5 - y, np.full(400, 0.25))

    def walk(row, node=0, depth=0):
        if depth == quality.DEPTH:
            return value[node]
        return walk(row, 2 * node + 1 + int(row[feature[node]] > split[node]), depth + 1)

    assert np.allclose(quality.traverse(tree, b), [walk(r) for r in b])
    model = quality.fit_trees(x, y)
    assert ((quality.predict(model, x) > 0.5) == y).mean() > 0.95
