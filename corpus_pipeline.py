"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.llm import line_chunks, mixing, ngram_jaccard, packing, quality
from lexspan.llm.common import cut_lineage, table
from lexspan.llm.queries import MIX, tokenizer_path, with_domain


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; a document of which nothing is left was a copy and goes too."""
    found = line_chunks.dedup(docs)
    left = found.where((F.col("n_removed_lines") == 0) | (F.trim(F.col("text")) != ""))
    return left.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents that share three quarters of their shingles."""
    return ngram_jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, up to two epochs of each."""
    return mixing.mix(with_domain(docs), MIX, share=0.8, max_epochs=2).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_jaccard", near_duplicate_stage), ("mixing", mixing_stage),
          ("packing", packing_stage)]

# The first, the third and the fifth stage (a fitted model, exact similarity of shingle
# sets, a tokenizer) have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
