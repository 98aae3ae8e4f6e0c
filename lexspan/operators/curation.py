"""Selection of core documents and the curated article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.classify import index_disposition, topic_candidates
from lexspan.functions.columns import first_reason
from lexspan.functions.ids import sha256
from lexspan.functions.text import casefold, collapse_whitespace, decode_entities
from lexspan.operators.audit import INCLUDE
from lexspan.operators.skew import lookup


def gate_reason(duplicate: bool = False) -> Column:
    """Why a document may not enter the core corpus, over decision columns; NULL when it may.
    A known duplicate may carry the identity flag and has to be quarantined for it."""
    allowed = F.array(F.lit("duplicate_bibliographic_identity")) if duplicate else F.array().cast("array<string>")
    wanted = "quarantine_duplicate_bibliographic_identity" if duplicate else INCLUDE
    return first_reason(
        (F.col("primary_reason").isNull() | (F.col("content_state") == "missing_content_row"), "missing source or audit record"),
        (F.col("scope_reason") != "central_exact", "not central"),
        ((F.col("content_state") != "present") | (F.coalesce("visible_characters", F.lit(0)) <= 0), "content quality"),
        (F.col("issuer_signal") != "central_issuer_signal", "issuer conflict"),
        (F.size(F.array_except("flags", allowed)) > 0, "unresolved audit flags"),
        (F.col("primary_reason") != wanted, "audit disposition"), default=F.lit(None).cast("string"))


def core_gate(decided: DataFrame, duplicate: bool = False) -> DataFrame:
    return decided.select("id", gate_reason(duplicate).alias("reason"))


def pair_differences(metadata: DataFrame, left: str, right: str, same: list[str], different: list[str]) -> DataFrame:
    """Fields in which two named documents break their relation: one row, empty list when none."""
    a, b = metadata.where(F.col("id") == left), metadata.where(F.col("id") == right)
    first = a.select(*[F.col(c).alias(f"a_{c}") for c in same + different])
    both = first.crossJoin(F.broadcast(b.select(*[F.col(c).alias(f"b_{c}") for c in same + different])))
    wrong = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in same]
    wrong += [F.when(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in different]
    return both.select(F.array_compact(F.array(*wrong)).alias("differences"))


def content_marker(markup, marker: str) -> Column:
    """Whether the visible text contains a marker, case folded."""
    shown = collapse_whitespace(decode_entities(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")))
    return F.contains(casefold(shown), casefold(F.lit(marker)))


def staged_violations(staged: DataFrame, documents: DataFrame) -> DataFrame:
    """Staged articles whose document is not selected or whose content hash differs."""
    known = documents.select(F.col("id").alias("document_id"), sha256("content_html").alias("content_sha256"))
    return staged.join(known, ["document_id", "content_sha256"], "left_anti").select("document_id", "article_id")


def curate(articles: DataFrame, documents: DataFrame, allowlist: dict[str, tuple[str, ...]], topics: dict | None = None,
           heading: str = "heading") -> DataFrame:
    """Articles with topics, index disposition and their document's metadata. One document
    may hold very many of the articles, so its metadata comes by a skew-safe lookup."""
    rows = articles.withColumn("topic_candidates", topic_candidates(heading, topics))
    rows = rows.withColumn("index_disposition", index_disposition("document_id", "label", "topic_candidates", allowlist))
    rows = rows.withColumn("retrieval_index_candidate", F.col("index_disposition") != "out_of_scope")
    known = documents.withColumn("__known", F.lit(True))
    values = [c for c in known.columns if c != "id"]
    return lookup(rows, known, {"document_id": "id"}, values).where("__known").drop("__known")


def topic_labels(curated: DataFrame) -> DataFrame:
    """Distinct (document, topic, label) rows."""
    return curated.select("document_id", F.explode("topic_candidates").alias("topic"), "label").distinct()


def disposition_counts(curated: DataFrame) -> DataFrame:
    return curated.groupBy("index_disposition").agg(F.count(F.lit(1)).alias("articles"))
