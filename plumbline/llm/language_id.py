"""Language identification of whole texts by a bidirectional GRU over their bytes.

The model is fitted on the whole texts of a bounded, documented sample of
labelled rows, cut into windows, and broadcast (about 60 kB). Scoring cuts every
whole text into windows of ``WINDOW`` bytes, labels every byte of every window
and pools the position probabilities of a document by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import gru
from plumbline.llm.common import checkpointed, fold, small_or_shuffled, with_text_batches
from plumbline.plans.ranking import running_total

FOLDS, HELD_OUT = 4, 2
#: Bound of the training sample: labelled rows of each language, read whole; bytes of a training window.
ROWS_A_LANGUAGE, TRAIN_BYTES = 250, 64
#: Parts of a language in which its rows are ranked before they meet.
PARTS = 64
#: Passes over the windows, and steps at least, of the fit.
EPOCHS, LEAST_STEPS, BATCH = 2, 150, 256
#: Share of all held-out rows that reach the score below which a document's language counts as unknown.
RECALL = 0.999
#: Bytes of a scoring window, and windows scored together.
WINDOW, TOGETHER = 128, 2048
UNKNOWN = "und"


def labelled_sample(docs: DataFrame, held_out: bool, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, whole text) of at most ``ROWS_A_LANGUAGE`` rows of each language, outside the held-out fold or of it.

    The rows are those with the smallest hashes of the id; an id that repeats in
    a language counts once, with its smallest text.
    """
    rows = with_text_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(((fold("doc_id", FOLDS) == HELD_OUT) == held_out) & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    # ranked in parts of a language first, so that no task meets more of it than ``PARTS * ROWS_A_LANGUAGE`` rows
    ids = rows.groupBy("lang", "doc_id").agg(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).alias("part"))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id")
        ids = ids.withColumn("at", F.row_number().over(order)).where(F.col("at") <= ROWS_A_LANGUAGE)
    ids = checkpointed(ids.select("lang", "doc_id", "at"))
    texts = rows.join(small_or_shuffled(ids, ids.count()), ["lang", "doc_id"]).groupBy("lang", "at").agg(F.min("text").alias("text"))
    return [(r.lang, r.text) for r in sorted(texts.collect(), key=lambda r: (r.lang, r["at"]))]


def training_windows(sample: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Byte windows, classes and language names of whole texts."""
    names = sorted({lang for lang, _ in sample})
    windows, classes = [], []
    for lang, text in sample:
        raw = text.encode("utf-8", "replace")
        n = -(-len(raw) // TRAIN_BYTES)
        windows.append(raw.ljust(n * TRAIN_BYTES))
        classes += [names.index(lang)] * n
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, TRAIN_BYTES), np.array(classes, np.int64), names


def fit(docs: DataFrame, **columns: str) -> tuple[dict[str, np.ndarray], list[str]]:
    windows, classes, names = training_windows(labelled_sample(docs, False, **columns))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // max(1, len(windows))))
    return gru.train(windows, classes, max(1, len(names)), epochs=epochs, batch=BATCH), names


def least_score(model: dict[str, np.ndarray], docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> float:
    """The score that ``RECALL`` of all held-out rows with a language and a letter reach; 0 without any.

    Every such row is scored whole in its partition. The place of the threshold
    is found among counts of equal scores in a global order.
    """
    held_out = F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True))
    rows = with_text_batches(docs).where(held_out & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    counts = checkpointed(rows.select(_best(docs.sparkSession, model)(F.col(text)).alias("score")).groupBy("score").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("n")).first().n
    if not total:
        return 0.0
    place = int((total - 1) * (1 - RECALL) + 1e-9)
    return float(running_total(counts, [F.col("score")], F.col("n"), "upto").where(F.col("upto") > place).agg(F.min("score").alias("least")).first().least)


def _best(spark: SparkSession, model: dict[str, np.ndarray]):
    """The highest mean probability of whole texts to five digits; further ones vary with the texts scored beside."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        scores: list[float] = []
        for portion in _portions(texts.tolist()):
            scores += document_probabilities(shared.value, portion).max(axis=1).astype(np.float64).round(5).tolist()
        return pd.Series(scores, dtype="float64")

    return best


def document_probabilities(model: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Mean position probabilities (documents, classes); windows of all texts share the steps."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    joined = b"".join(t.ljust(n * WINDOW) for t, n in zip(texts, counts, strict=True))
    windows = np.frombuffer(joined, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    valid = np.full(len(windows), WINDOW)
    lengths = np.array([len(t) for t in texts])
    some = counts > 0
    valid[ends[some] - 1] = lengths[some] - (counts[some] - 1) * WINDOW
    totals = np.zeros((len(texts), len(model["c"])))
    for at in range(0, len(windows), TOGETHER):
        steps = np.ascontiguousarray(windows[at : at + TOGETHER].T)
        part = gru.probabilities(model, steps)
        n = valid[at : at + TOGETHER]
        if n.min() < WINDOW:
            part *= (np.arange(WINDOW)[:, None] < n)[:, None, :]
        np.add.at(totals, owner[at : at + TOGETHER], part.sum(axis=0).T)
    return totals / np.maximum(lengths, 1)[:, None]


def _portions(texts: list[str | None]) -> Iterator[list[bytes]]:
    """Consecutive texts of about a million bytes together."""
    portion, held = [], 0
    for text in texts:
        portion.append((text or "").encode("utf-8", "replace"))
        held += len(portion[-1])
        if held >= 1_000_000:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


def _scored(model, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = model.value
        for pdf in batches:
            langs, scores = [], []
            for portion in _portions(pdf["text"].tolist()):
                p = document_probabilities(weights, portion)
                langs += [names[k] for k in p.argmax(axis=1)]
                scores += p.max(axis=1).tolist()
            pdf["lang_pred"], pdf["score"] = langs, scores
            yield pdf[["doc_id", "held_out", "lettered", "lang_pred", "score"]]

    return run


def identified(docs: DataFrame, labelled: DataFrame, least: float | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of ``least`` or more.

    Without ``least`` it is the score that ``RECALL`` of the held-out labelled
    rows reach. A text that is null, empty or without a letter goes, whatever its
    length the others are scored whole. Rows are judged one by one: null ids and
    repeated rows stay or go like any row. Without labels, or from an empty
    table, no row stays.
    """
    columns = {"doc_id": doc_id, "text": text, "lang": lang}
    model, names = fit(labelled, **columns)
    if not names:
        return docs.limit(0)
    if least is None:
        least = least_score(model, labelled, **columns)
    best = _best(docs.sparkSession, model)
    return docs.where(F.col(text).rlike("\\p{L}")).where(best(F.col(text)) >= least)


def identify(docs: DataFrame, labelled: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Return ``doc_id, held_out, lang_pred, score``, a row for each input row.

    ``labelled`` (default: ``docs``) has the texts and languages to learn from;
    rows whose crc32 of the id modulo 4 is 2 are held out, null languages are
    ignored. A text that is null or has no letter is ``und`` with score 0, and
    so is every text if there is nothing to learn from. A null id counts as
    held out. Long texts are scored whole. Repeated rows each get a row; other
    columns are ignored; an empty table gives an empty result. Any number of
    languages is learnt.
    """
    spark = docs.sparkSession
    model, names = fit(labelled if labelled is not None else docs, doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(fold(doc_id, FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"),
        F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("lettered"),
    )
    if not names:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = rows.mapInPandas(_scored(spark.sparkContext.broadcast(model), names), "doc_id long, held_out boolean, lettered boolean, lang_pred string, score double")
    return out.select(
        "doc_id",
        "held_out",
        F.when(F.col("lettered"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )
