"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Every stage but the last returns rows of its input with the columns of its
input, whatever else these are called, and an empty table from an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import stored
from plumbline.llm.language_id import identified
from plumbline.llm.mixing import labelled_languages, mixed
from plumbline.llm.near_dedup import one_of_each
from plumbline.llm.packing import pack
from plumbline.llm.quality import good_documents
from plumbline.llm.queries import LANGUAGE_WEIGHTS, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or a recognisable language go.

    So do null and empty texts. Long texts are scored whole; null ids and
    repeated rows are judged like any row. The score that counts as recognised
    is the one that 99.9 % of the held-out labelled documents reach.
    """
    return identified(docs, table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go.

    Null and empty texts have the statistics of an empty text. Long texts are
    scored whole; null ids and repeated rows are judged like any row.
    """
    return good_documents(docs, table(spark, sf_dir, "labels"), labelled=table(spark, sf_dir, "documents"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Null and empty texts and rows without an id stay; of rows that repeat an id
    one stays.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as its fitted rate says.

    Null and empty texts have no tokens and the same posterior in every
    language. Null ids and repeated rows have rates like any row.
    """
    return mixed(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences.

    A null or empty text is one token, a long one is cut into pieces; null ids
    and repeated rows are packed as often as they occur.
    """
    return pack(docs)


STAGES = [("language_id", language), ("quality_classifier", quality), ("near_dedup", dedup), ("mixing", mixing), ("packing", packing)]

#: Trained models decide the rows, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
