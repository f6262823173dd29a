"""The operators of this subpackage as queries over a folder of Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.byte_bpe import coded
from plumbline.llm.collocations import collocations
from plumbline.llm.divergence import divergences
from plumbline.llm.html_text import extract_main_text
from plumbline.llm.language_id import identify
from plumbline.llm.mixing import labelled_languages, mix
from plumbline.llm.near_dedup import near_duplicates
from plumbline.llm.packing import pack
from plumbline.llm.quality import score_quality
from plumbline.llm.quality_rules import filter_quality
from plumbline.llm.sharding import kd_shards
from plumbline.llm.toxicity import score_toxicity
from plumbline.llm.vector_search import top_k

#: Target shares of tokens by language.
LANGUAGE_WEIGHTS = {"en": 0.57, "de": 0.16, "fr": 0.16, "es": 0.11}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op6_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_WEIGHTS)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_quality(table(spark, sf_dir, "documents"))


def op11_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
