"""Evaluation of rankings: parameter grids, case checks, behaviour summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.columns import first_reason, is_true
from lexspan.functions.ids import iso_ordinal
from lexspan.functions.text import is_blank

# The retrieval grid.
DEPTH_PAIRS = ((10, 10), (20, 20), (40, 40), (20, 40), (40, 20))
RERANK_DEPTHS = (10, 20, 40)
EVIDENCE_CAPS = (3, 5, 8)
KINDS = ("answerable", "ambiguous", "negative")
EXPECTED_STATES = ("answer", "partial", "clarify", "unavailable", "abstain_conflict", "abstain_insufficient_evidence")


def sweep(hits: DataFrame, cases: DataFrame, sparse: str = "bm25", dense: str = "dense") -> DataFrame:
    """45 rows per case from hits (query_id, branch, article_id, position): how many
    articles, candidates and evidence rows each setting reaches.

    One count per depth pair serves all settings of that pair: fusion keeps every
    article, and the later cuts only take the smaller number.
    """
    depth = F.array(*[F.struct(F.lit(s).alias("k_bm25"), F.lit(d).alias("k_dense")) for s, d in DEPTH_PAIRS])
    limit = F.when(F.col("branch") == sparse, F.col("k_bm25")).when(F.col("branch") == dense, F.col("k_dense"))
    reached = hits.select("query_id", "branch", "article_id", "position", F.explode(depth).alias("d")).select(
        "query_id", "branch", "article_id", "position", "d.*").where(F.col("position") <= limit)
    counts = reached.select("query_id", "k_bm25", "k_dense", "article_id").distinct().groupBy(
        "query_id", "k_bm25", "k_dense").agg(F.count(F.lit(1)).alias("n"))
    grid = cases.select("query_id", F.explode(depth).alias("d")).select("query_id", "d.*").join(
        counts, ["query_id", "k_bm25", "k_dense"], "left")
    grid = grid.withColumn("k_rerank", F.explode(F.array(*[F.lit(k) for k in RERANK_DEPTHS]))).withColumn(
        "k_evidence", F.explode(F.array(*[F.lit(k) for k in EVIDENCE_CAPS])))
    achieved = F.coalesce("n", F.lit(0)).cast("long")
    return grid.select("query_id", "k_bm25", "k_dense", "k_rerank", "k_evidence",
                       F.greatest("k_bm25", "k_dense").alias("requested_unique_articles"), achieved.alias("achieved_unique_articles"),
                       F.least(achieved, F.col("k_rerank")).alias("actual_rerank_candidates"),
                       F.least(achieved, F.col("k_rerank"), F.col("k_evidence")).alias("actual_evidence_articles"),
                       F.lit("score_only_unmeasured_latency").alias("measurement_status"))


def case_errors(cases: DataFrame) -> DataFrame:
    """Held-out cases whose fields or targets contradict their kind, with the reason."""
    targets = F.col("relevant_article_ids")
    size = F.size(F.coalesce(targets, F.array().cast("array<string>")))
    reason = first_reason(
        (is_blank("case_id") | is_blank("scenario_family_id") | is_blank("query") | ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False))
         | targets.isNull() | (F.size(F.array_distinct(targets)) != size), "schema"),
        (((F.col("kind") == "negative") != (size == 0)) | ((F.col("kind") == "answerable") & (size != 1))
         | ((F.col("kind") == "ambiguous") & (size < 2)), "targets_do_not_match_kind"), default=F.lit(None).cast("string"))
    return cases.select("case_id", reason.alias("reason")).where("reason IS NOT NULL")


def reviewed_case_errors(cases: DataFrame) -> DataFrame:
    """Reviewed cases that may not be measured, with the reason."""
    refs, relevant = F.col("references"), F.col("relevant_article_ids")
    positive = F.col("expected_answer_state").isin("answer", "partial")
    bad_ref = F.exists(refs, lambda r: is_blank(r["source_locator"]) | r["document_version_id"].isNull() | is_blank(r["quote"])
                       | r["span_start"].isNull() | r["span_end"].isNull() | (r["span_start"] < 0) | (r["span_end"] <= r["span_start"])
                       | ~is_true(r["applicable_on_requested_date"]) | ~F.coalesce(F.array_contains(relevant, r["article_id"]), F.lit(False)))
    blank = F.lit(False)
    for name in ("case_id", "scenario_family_id", "family", "query"):
        blank = blank | is_blank(name)
    same = F.array_sort(F.array_distinct(F.transform(refs, lambda r: r["article_id"]))) == F.array_sort(relevant)
    reason = first_reason(
        (blank | (F.coalesce("reference_status", F.lit("")) != "reviewed") | ~F.coalesce(F.col("expected_answer_state").isin(*EXPECTED_STATES), F.lit(False))
         | relevant.isNull() | refs.isNull() | (F.size(F.array_distinct(relevant)) != F.size(relevant)) | F.exists(relevant, is_blank), "schema"),
        (iso_ordinal("legal_date").isNull(), "legal_date"),
        (positive & ((F.size(relevant) == 0) | (F.size(refs) == 0)), "answerable_without_reference"),
        (is_true(bad_ref), "incomplete_reference"), (positive & ~same, "relevant_article_without_reference"),
        default=F.lit(None).cast("string"))
    return cases.select("case_id", reason.alias("reason")).where("reason IS NOT NULL")


def split_violations(cases: DataFrame) -> DataFrame:
    """Families that occur in more than one split. Two booleans per family, no sets."""
    return cases.groupBy("scenario_family_id").agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count(F.lit(1)).alias("cases")).where(
        "first_split <> last_split")


def leaked_families(heldout: DataFrame, dev: DataFrame) -> DataFrame:
    return heldout.join(dev.select("scenario_family_id").distinct(), "scenario_family_id", "left_semi")


def leaked_targets(heldout: DataFrame, dev: DataFrame) -> DataFrame:
    """Held-out cases that share a relevant article with the development cases."""
    seen = dev.select(F.explode("relevant_article_ids").alias("article_id")).distinct()
    return heldout.select("case_id", F.explode("relevant_article_ids").alias("article_id")).join(
        seen, "article_id", "left_semi").select("case_id").distinct()


def missing_targets(cases: DataFrame, articles: DataFrame) -> DataFrame:
    """Relevant ids that are not retrieval candidates of the corpus."""
    known = articles.where(is_true("retrieval_index_candidate")).select("article_id").distinct()
    return cases.select("case_id", F.explode("relevant_article_ids").alias("article_id")).join(known, "article_id", "left_anti")


def readiness(cases: DataFrame) -> DataFrame:
    """Cases, families, and whether all cases may be measured."""
    bad = reviewed_case_errors(cases).agg(F.count(F.lit(1)).alias("bad"))
    total = cases.agg(F.count(F.lit(1)).alias("cases"))
    families = cases.select("family").distinct().agg(F.count(F.lit(1)).alias("families"))
    return total.crossJoin(F.broadcast(families)).crossJoin(F.broadcast(bad)).select(
        "cases", "families", (F.col("bad") == 0).alias("ready_for_measurement"))


def case_status(relevant: Column) -> Column:
    return F.when(relevant > 0, "measured").otherwise("not_applicable_no_reference")


def behaviour_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a behaviour run (kind, retrieval_hit, evidence_hit, exact_answer,
    safe_abstention, contract_valid), overall or per split."""
    answerable = F.col("kind") == "answerable"
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(answerable).alias("answerable"),
        F.count_if(answerable & F.col("retrieval_hit")).alias("answerable_retrieval_hits"),
        F.count_if(answerable & F.col("evidence_hit")).alias("answerable_provider_evidence_hits"),
        F.count_if(answerable & F.col("exact_answer")).alias("exact_answer_citations"),
        F.count_if(answerable & F.col("safe_abstention")).alias("answerable_safe_abstentions"),
        F.count_if(F.col("kind") == "ambiguous").alias("ambiguous_cases"),
        F.count_if(F.col("kind") == "negative").alias("negative_cases"),
        F.count_if(~answerable & F.col("safe_abstention")).alias("nonanswerable_safe_abstentions"),
        F.count_if("contract_valid").alias("citation_contract_passes"))


def miss_reasons(rows: DataFrame) -> DataFrame:
    """Why a relevant article did not reach the provider: (query_id, article_id, in_top12,
    gate_reason, gate_allowed, provider_hit) to a histogram."""
    reason = first_reason((~F.col("in_top12"), "outside_retrieval_top12"), (~F.col("gate_allowed"), F.col("gate_reason")),
                          (~F.col("provider_hit"), "not_selected_for_three_source_provider_cap"), default=F.lit(None).cast("string"))
    return rows.withColumn("miss_reason", reason).where("miss_reason IS NOT NULL").groupBy("miss_reason").agg(
        F.count(F.lit(1)).alias("count"))
