"""Quality classifier: histogram gradient-boosted trees over document statistics, in numpy.

Statistics of whole texts are computed where the texts are. A bounded,
documented sample of labelled rows brings its statistics (not its texts) to the
driver, where the trees are grown over quantile bins; the trees are flattened
into arrays, broadcast, and traversed level by level for a whole batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, fold, labelled_ids, small_or_shuffled, with_text_batches

FOLDS, HELD_OUT = 5, 0
#: Bound of the labelled sample.
SAMPLE_ROWS = 12_000
#: A document is predicted good from this score.
THRESHOLD = 0.3
BINS, DEPTH, TREES, RATE, RIDGE, LEAF = 48, 4, 60, 0.2, 2.0, 10

STATISTICS = (
    "bytes", "words", "word_bytes", "distinct_words", "top_word", "pairs_repeated", "lines", "lines_repeated", "upper", "digits", "symbols", "marks",
    "stops", "wide", "controls", "capitalised", "longest_word", "distinct_bytes", "byte_entropy", "short_lines",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>{}[]~^_=+\\@/")] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?;:\"'()-")] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".,")] = True
_CONTROLS = np.zeros(256, bool)
_CONTROLS[:32] = True


def statistics(text: str | None) -> list[float]:
    """Statistics of one whole text; a null text counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATISTICS)
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    count = max(1, len(words))
    distinct = Counter(words)
    pairs = len(words) - 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = histogram[histogram > 0] / n
    return [
        float(n),
        float(len(words)),
        sum(map(len, distinct)) / max(1, len(distinct)),
        len(distinct) / count,
        max(distinct.values(), default=0) / count,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs if pairs > 0 else 0.0,
        float(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        *(float(histogram[x].sum()) / n for x in (_UPPER, _DIGITS, _SYMBOLS, _MARKS, _STOPS)),
        float(histogram[128:].sum()) / n,
        float(histogram[_CONTROLS].sum()) / n,
        sum(65 <= w[0] <= 90 for w in words) / count,
        float(max(map(len, distinct), default=0)),
        len(share) / 256,
        float(-(share * np.log2(share)).sum()),
        sum(len(x) < 20 for x in lines) / max(1, len(lines)),
    ]


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.int64)


def grow(b: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int = BINS, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree as complete-binary arrays (feature, bin, value); rows with bin <= the split go left."""
    nodes = 2 ** (depth + 1) - 1
    feature, split, value = np.zeros(nodes, np.int64), np.full(nodes, bins, np.int64), np.zeros(nodes)
    at = np.zeros(len(b), np.int64)
    value[0] = -g.sum() / (h.sum() + RIDGE)
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        gain, best_feature, best_split = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, bins, np.int64)
        for j in range(b.shape[1]):
            cell = (at - first) * bins + b[:, j]
            gs = np.bincount(cell, g, width * bins).reshape(width, bins)
            hs = np.bincount(cell, h, width * bins).reshape(width, bins)
            ns = np.bincount(cell, minlength=width * bins).reshape(width, bins)
            gl, hl, nl = gs.cumsum(1), hs.cumsum(1), ns.cumsum(1)
            gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
            score = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - gl[:, -1:] ** 2 / (hl[:, -1:] + RIDGE)
            score = np.where((nl >= LEAF) & (nr >= LEAF), score, -1)
            k = score.argmax(1)
            found = score[np.arange(width), k]
            better = found > gain
            gain[better], best_feature[better], best_split[better] = found[better], j, k[better]
        feature[first : first + width], split[first : first + width] = best_feature, best_split
        at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > split[at])
        children = np.arange(2 * first + 1, 2 * first + 1 + 2 * width)
        own_g, own_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[children] = np.where(own_h[children] > 0, -own_g[children] / (own_h[children] + RIDGE), 0)
    return feature, split, value


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> dict:
    """Boosted trees on the logistic loss; no or one-class labels give a constant."""
    edges = bin_edges(x) if len(x) else []
    rate = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate / (1 - rate)))
    grown = []
    if len(x) and 0 < y.sum() < len(y):
        b, f = binned(x, edges), np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            tree = grow(b, p - y, p * (1 - p))
            f += RATE * traverse(tree, b)
            grown.append(tree)
    stacked = [np.stack(a) for a in zip(*grown, strict=True)] if grown else None
    return {"edges": edges, "base": base, "trees": stacked}


def traverse(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
    feature, split, value = tree
    at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (b[rows, feature[at]] > split[at])
    return value[at]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model["base"])
    if model["trees"] is not None:
        b = binned(x, model["edges"])
        for tree in zip(*model["trees"], strict=True):
            f += RATE * traverse(tree, b)
    return 1 / (1 + np.exp(-f))


def _statistics_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [statistics(t) for t in pdf["text"]]})


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, y, text of the bounded sample of labelled rows outside the held-out fold.

    An id counts once, with its smallest text, so that repeated rows do not
    widen the bound.
    """
    ids = checkpointed(labelled_ids(labels, label, HELD_OUT, FOLDS, bound, doc_id))
    texts = with_text_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return texts.join(small_or_shuffled(ids, ids.count()), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict:
    sample = labelled_texts(docs, labels, label, bound, doc_id, text)
    rows = sorted((r.doc_id, r.y, r.x) for r in sample.mapInPandas(_statistics_rows, "doc_id long, y int, x array<double>").collect())
    x = np.array([r[2] for r in rows], float).reshape(-1, len(STATISTICS))
    return fit_trees(x, np.array([float(r[1] > 0) for r in rows]))


def _scored(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array([statistics(t) for t in pdf["text"]], float).reshape(-1, len(STATISTICS))
            pdf["score"] = predict(model.value, x)
            yield pdf[["doc_id", "held_out", "score"]]

    return run


def good_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted good.

    Null and empty texts have statistics that are all zero; texts of any length
    are scored whole. Rows are judged one by one, so null ids and repeated rows
    stay or go like any row; an empty table gives an empty result. Without
    labels every score is 0.5 and every row stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled if labelled is not None else docs, labels, label, doc_id=doc_id, text=text))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(predict(shared.value, np.array([statistics(t) for t in texts], float).reshape(-1, len(STATISTICS))))

    return docs.where(score(F.col(text)) >= THRESHOLD)


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted``, a row for each input row.

    ``labelled`` (default: ``docs``) has the texts of the labelled ids. Rows
    whose crc32 of the id modulo 5 is 0 are never learnt from. Null and empty
    texts are scored like any text, on statistics that are all zero; texts of any
    length are read whole. A null id counts as held out; repeated rows each get a
    row; other columns are ignored; an empty table gives an empty result. Without
    labels every score is the prior, 0.5.
    """
    model = fit(labelled if labelled is not None else docs, labels, label, doc_id=doc_id, text=text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInPandas(_scored(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
