"""The queries of the subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.llm import (configuration_packing, language_id, licenses, line_chunks, mask_search, merkle, mixing, ngram_jaccard, packing,
                         prefix_hash, quality, suffix_tree, unit_dedup)
from lexspan.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _query(function):
    QUERIES[function.__name__] = function
    return function


@_query
def op5_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_hash.fingerprints(table(spark, folder, "documents"))


@_query
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.assess(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard.join(table(spark, folder, "documents"))


@_query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, docs.where(language_id.fold("doc_id", 3) != 1))
    return found.select("doc_id", (language_id.fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@_query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


@_query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return suffix_tree.score(docs, language_id.fold("doc_id", 5) != 1)


@_query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return unit_dedup.removals(table(spark, folder, "documents"), nested=False).drop("tie")


# Production parameters of the mix: weights by level, relative to siblings.
MIX = [{"0": 5.0, "1": 3.0, "2": 2.0}, {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, {}]


def with_domain(docs: DataFrame) -> DataFrame:
    """Sources belong to one of three domains, by the number in their name."""
    return docs.withColumn("domain", (F.coalesce(F.regexp_extract("source", r"(\d+)$", 1).try_cast("int"), F.lit(0)) % 3).cast("string"))


@_query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.select(with_domain(table(spark, folder, "documents")), MIX, share=0.8, max_epochs=2)
    return taken.drop("__tie")


@_query
def op9_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.dedup(table(spark, folder, "documents")).select("doc_id", "text", "n_lines", "n_removed_lines")


ORACLES["op9_line_chunks"] = line_chunks.SQL


@_query
def op10_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@_query
def op11_mask_search(spark: SparkSession, folder: str) -> DataFrame:
    return mask_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), top=10)


ORACLES["op11_mask_search"] = mask_search.SQL


@_query
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


ORACLES["op12_merkle_manifest"] = merkle.SQL


@_query
def op13_configuration_packing(spark: SparkSession, folder: str) -> DataFrame:
    return configuration_packing.pack(table(spark, folder, "documents"), tokenizer_path())
