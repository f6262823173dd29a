"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed lower-cased letter runs and of their stems. On a bounded,
documented sample of labelled rows a factorization machine
with a bias, a weight and a ``FACTORS``-vector for each frequent term is fitted by Adam on
the logistic loss; the vectors give each pair of terms its own weight, so that
two words can mean more, or less, than their sum. Terms that do not tell the classes
apart by themselves (a log-odds test) decay faster, unless their pairs hold against it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import fold
from plumbline.llm.quality import FOLDS, HELD_OUT, labelled_texts

BUCKETS = 2**20
#: Bounds: labelled rows, and terms that decay slowly.
SAMPLE_ROWS, TERMS = 8_000, 8_192
FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 40, 256, 0.03, 1e-5
#: Decay of a term whose own presence does not separate the classes.
WEAK_DECAY = 0.03
#: A longer letter run also gives its first letters as a term, which inflected forms share.
STEM = 4
#: A term is kept from this many sample rows, and decays slowly from this many standard errors of its log-odds.
LEAST_ROWS, LEAST_Z = 4, 2.5
#: Weight of a toxic row in the loss; toxic rows are a tenth of the labels.
TOXIC_WEIGHT = 5.0
CACHED_WORDS = 300_000
_RUNS = re.compile(r"[^\W\d_]+")


class Terms:
    """Hashed terms of texts; each spaced word is split and hashed once."""

    def __init__(self, keep: np.ndarray | None = None) -> None:
        self.keep = keep
        self.words: dict[str, tuple[int, ...]] = {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        runs = _RUNS.findall(word)
        runs += [f"{run[:STEM]}-" for run in runs if len(run) > STEM]
        found = [xxh3_64_intdigest(run.encode("utf-8", "replace")) % BUCKETS for run in runs]
        if self.keep is not None:
            found = [k for k in self.keep[found].tolist() if k >= 0] if found else found
        return tuple(found)

    def of(self, text: str | None) -> list[int]:
        words = set((text or "").lower().split())
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        for w in words.difference(self.words):
            self.words[w] = self._of_word(w)
        return sorted(set().union(*map(self.words.__getitem__, words)))


def _rows_of(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter((k for x in lists for k in x), np.int64)
    return flat, np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def raw_scores(model: dict, lists: list[list[int]]) -> np.ndarray:
    """bias + sum of weights + sum over pairs of terms of the product of their vectors."""
    return _raw(model, *_rows_of(lists), len(lists))


def _raw(model: dict, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = model["bias"] + np.bincount(row, model["w"][flat], n)
    for f in range(model["v"].shape[1]):
        v = model["v"][flat, f]
        out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
    return out


def frequent_terms(lists: list[list[int]]) -> np.ndarray:
    """Hash buckets in at least ``LEAST_ROWS`` rows."""
    return np.flatnonzero(np.bincount(_rows_of(lists)[0], minlength=BUCKETS) >= LEAST_ROWS)


def select_terms(lists: list[list[int]], y: np.ndarray, most: int = TERMS) -> np.ndarray:
    """Hash buckets whose presence differs between the classes, the clearest ``most`` of them."""
    flat, row = _rows_of(lists)
    positive = np.bincount(flat, y[row], BUCKETS)
    total = np.bincount(flat, minlength=BUCKETS).astype(float)
    some = np.flatnonzero(total >= LEAST_ROWS)
    p, t = positive[some], total[some]
    n1, n = max(1.0, y.sum()), max(1.0, len(y))
    odds = np.log((p + 0.5) / (n1 - p + 0.5)) - np.log((t - p + 0.5) / (n - n1 - t + p + 0.5))
    error = np.sqrt(1 / (p + 0.5) + 1 / (t - p + 0.5) + 1 / (n1 - p + 0.5) + 1 / (n - n1 - t + p + 0.5))
    z = np.abs(odds) / error
    best = np.lexsort((some, -z))[:most]
    return np.sort(some[best[z[best] >= LEAST_Z]])


def fit_machine(lists: list[list[int]], y: np.ndarray, terms: int, seed: int = 3, decay: np.ndarray | None = None) -> dict:
    """Fit on rows of term numbers below ``terms``; ``decay`` (default: ``DECAY``) is of each term."""
    decay = np.full(terms, DECAY) if decay is None else decay
    rng = np.random.default_rng(seed)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = {"bias": np.array(np.log(rate / (1 - rate))), "w": np.zeros(terms), "v": rng.normal(0, 0.05, (terms, FACTORS))}
    if not terms or not 0 < y.sum() < len(y):
        return model
    arrays = [np.array(x, np.int64) for x in lists]
    first, second, step = {k: np.zeros_like(a) for k, a in model.items()}, {k: np.zeros_like(a) for k, a in model.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            own = [arrays[i] for i in rows]
            flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
            weight = np.where(y[rows] > 0, TOXIC_WEIGHT, 1.0)
            error = weight * (1 / (1 + np.exp(-np.clip(_raw(model, flat, row, len(rows)), -40, 40))) - y[rows]) / len(rows)
            each = error[row]
            grads = {"bias": error.sum(), "w": np.bincount(flat, each, terms) + decay * model["w"], "v": decay[:, None] * model["v"]}
            for f in range(FACTORS):
                v = model["v"][flat, f]
                sums = np.bincount(row, v, len(rows))
                grads["v"][:, f] += np.bincount(flat, each * (sums[row] - v), terms)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = model[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def _term_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    terms = Terms()
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [terms.of(t) for t in pdf["text"]]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE_ROWS, doc_id: str = "doc_id", text: str = "text") -> dict:
    sample = labelled_texts(docs, labels, label, bound, doc_id, text)
    rows = sorted((r.doc_id, r.y, r.x) for r in sample.mapInPandas(_term_rows, "doc_id long, y int, x array<int>").collect())
    lists, y = [r[2] for r in rows], np.array([float(r[1] > 0) for r in rows])
    kept = frequent_terms(lists)
    decay = np.where(np.isin(kept, select_terms(lists, y)), DECAY, WEAK_DECAY)
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    lists = [[k for k in number[x].tolist() if k >= 0] if x else [] for x in lists]
    return fit_machine(lists, y, len(kept), decay=decay) | {"number": number}


def _scored(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = model.value
        terms = Terms(machine["number"])
        for pdf in batches:
            raw = raw_scores(machine, [terms.of(t) for t in pdf["text"]])
            pdf["score"] = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
            yield pdf[["doc_id", "held_out", "score"]]

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, held_out, score, predicted``, a row for each input row.

    ``labelled`` (default: ``docs``) has the texts of the labelled ids. Rows
    whose crc32 of the id modulo 5 is 0 are never learnt from. Null and empty
    texts hold no terms and get the score of the bias; texts of any length are
    read whole. A null id counts as held out; repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result. Without labels
    every score is the prior, 0.5.
    """
    model = fit(labelled if labelled is not None else docs, labels, label, doc_id=doc_id, text=text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True)).alias("held_out")
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.mapInPandas(_scored(shared), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
