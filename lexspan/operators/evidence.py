"""Selection of quotable evidence for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexspan.functions.classify import CENTRAL_SCOPE, article_number, document_identity
from lexspan.functions.columns import equals, first_reason, is_true
from lexspan.functions.text import casefold, clip_excerpt, is_blank
from lexspan.operators import policy
from lexspan.operators.skew import top_k

EXCERPT_CHARS, EXCERPT_CAP, PROVIDER_CAP = 2_400, 12, 3
REFERENCE = r"(?iuU)\b(?:điều|article)\s+(\d+[a-z]?)\b|\btrích\s+(?:nguyên văn\s+)?(?:điều\s+)?(\d+[a-z]?)\b"
QUALIFIER = r"(?iuU)\b(?:trong|của)\s+((?:bộ luật|nghị định|thông tư)(?:\s+(?:lao\s+động|số\s+\d+[\w/-]*)){1,2})"


def configured_evidence(hits: DataFrame, day) -> DataFrame:
    """Reviewed rows per question; one row that fails empties the whole set."""
    checked = hits.withColumn("__ok", policy.configured_evidence_ok(day))
    whole = checked.groupBy("query_id").agg(F.bool_and("__ok").alias("__all")).where("__all").select("query_id")
    return checked.join(whole, "query_id", "left_semi").drop("__ok").withColumn(
        "evidence_id", F.concat_ws(":", "article_id", "document_version_id"))


def requested_articles(questions: DataFrame) -> DataFrame:
    """Questions that name articles: how many different numbers, the number, the document qualifier."""
    numbers = F.array_distinct(F.transform(F.concat(
        F.regexp_extract_all("query", F.lit(REFERENCE), F.lit(1)), F.regexp_extract_all("query", F.lit(REFERENCE), F.lit(2))),
        casefold))
    qualifier = F.regexp_extract("query", QUALIFIER, 1)
    rows = questions.withColumn("numbers", F.filter(numbers, lambda n: n != "")).where(F.size("numbers") > 0)
    return rows.select("query_id", F.size("numbers").alias("distinct_numbers"), F.get("numbers", F.lit(0)).alias("number"),
                       F.when(qualifier != "", casefold(qualifier)).alias("qualifier"))


def resolve_articles(questions: DataFrame, catalog: DataFrame, topical: bool = True) -> DataFrame:
    """The one catalogue article a question names, or the reason there is none.

    The same article number occurs in very many documents, so the catalogue is first
    reduced to counts per number and per (number, document identity), and equal requests
    are resolved once.
    """
    requests = requested_articles(questions)
    wanted = requests.where("distinct_numbers = 1").select("number", "qualifier").distinct()
    label = F.coalesce("label", "canonical_text")
    rows = catalog.where(equals("pham_vi", CENTRAL_SCOPE) & is_true("retrieval_index_candidate"))
    if topical:
        rows = rows.where(F.size(F.coalesce("topic_candidates", F.array().cast("array<string>"))) > 0)
    rows = rows.select(article_number(label).alias("number"), document_identity("title", "so_ky_hieu").alias("identity"),
                       "article_id", "document_version_id").where(F.col("number").isNotNull()).distinct()
    per_document = rows.groupBy("number", "identity").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("article_id", "document_version_id")).alias("only"))
    per_number = per_document.groupBy("number").agg(F.sum("n").alias("n"), F.min("only").alias("only"))
    free = wanted.where("qualifier IS NULL").join(per_number, "number").select("number", "qualifier", "n", "only")
    bound = (wanted.where("qualifier IS NOT NULL").join(per_document, "number")
             .where(F.contains("identity", F.col("qualifier"))).groupBy("number", "qualifier")
             .agg(F.sum("n").alias("n"), F.min("only").alias("only")))
    found = free.unionByName(bound).select(F.col("number").alias("__number"), F.col("qualifier").alias("__qualifier"), "n", "only")
    joined = requests.join(found, (F.col("number") == F.col("__number")) & F.col("qualifier").eqNullSafe(F.col("__qualifier")), "left")
    status = first_reason((F.col("distinct_numbers") > 1, "requested_article_ambiguous"),
                          (F.coalesce("n", F.lit(0)) != 1, "requested_article_not_unambiguous"), default="resolved")
    return joined.withColumn("status", status).select(
        "query_id", "number", "qualifier", "status", F.when(F.col("status") == "resolved", F.col("only.article_id")).alias("article_id"),
        F.when(F.col("status") == "resolved", F.col("only.document_version_id")).alias("document_version_id"))


def decide_articles(questions: DataFrame, catalog: DataFrame, topical: bool = True) -> DataFrame:
    """Questions (query_id, query, dated) that name articles: whether the article's text may be
    shown, the reason, and which it is.

    The gate for source texts comes first, as if there were no evidence; what passes it is
    looked up, and the gate is asked again with the row that was found. Rows of the catalogue
    that repeat an article and version count as one, which has to pass as a whole.
    """
    asked = questions.join(requested_articles(questions).select("query_id"), "query_id", "left_semi").withColumn(
        "before", policy.source_text_gate("query", "dated", F.lit(0), F.lit(False), F.lit(True)))
    keys = ["article_id", "document_version_id"]
    found = resolve_articles(asked.where("before = 'no_evidence'"), catalog, topical).select("query_id", "status", *keys)
    facts = catalog.join(found.where("status = 'resolved'").select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(
        F.bool_or(is_true("reported_status_conflict")).alias("conflict"), F.bool_and(policy.provisional_row_ok()).alias("row_ok"))
    rows = asked.join(found, "query_id", "left").join(facts, keys, "left")
    after = policy.source_text_gate("query", "dated", F.lit(1), "conflict", "row_ok")
    reason = F.when(F.col("before") != "no_evidence", F.col("before")).when(F.col("status") != "resolved", F.col("status")).otherwise(after)
    allowed = F.col("reason") == "snapshot_text_only"
    return rows.withColumn("reason", reason).select(
        "query_id", "reason", allowed.alias("allowed"), F.when(allowed, F.concat_ws(":", *keys)).alias("evidence_id"))


def unique_catalog(catalog: DataFrame) -> DataFrame:
    """Catalogue rows whose (article, version) occurs once."""
    keys = ["article_id", "document_version_id"]
    once = catalog.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(*keys)
    return catalog.join(once, keys, "left_semi")


def _gated_hits(questions: DataFrame, hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits on catalogue rows that occur once and have a text, with the excerpt gate's reason for each alone."""
    keys = ["article_id", "document_version_id"]
    rows = hits.select("query_id", *keys, F.col("rank").alias("hit_rank")).join(unique_catalog(catalog), keys)
    rows = rows.where(~is_blank("canonical_text")).join(questions.select("query_id", "query", "dated"), "query_id")
    topic = F.get(policy.query_topics("query"), F.lit(0))
    ok = policy.provisional_row_ok() & F.coalesce(F.array_contains("topic_candidates", topic), F.lit(False))
    return rows.withColumn("gate", policy.excerpt_gate("query", "dated", F.lit(1), is_true("reported_status_conflict"), ok))


def excerpt_evidence(questions: DataFrame, hits: DataFrame, catalog: DataFrame, cap: int = EXCERPT_CAP) -> DataFrame:
    """Hits (query_id, article_id, document_version_id, rank) that the excerpt gate lets
    through, first ``cap`` in rank order, with the clipped excerpt. Filtering comes before
    the cap, so denied rows do not use it up."""
    allowed = _gated_hits(questions, hits, catalog).where("gate = 'snapshot_excerpt_only'").drop("gate")
    picked = top_k(allowed, ["query_id"], [F.asc("hit_rank")], cap, "evidence_rank")
    return picked.withColumns({"evidence_id": F.concat_ws(":", "article_id", "document_version_id"),
                               "excerpt": clip_excerpt("canonical_text", EXCERPT_CHARS)}).drop("query", "dated")


def decide_excerpts(questions: DataFrame, hits: DataFrame, catalog: DataFrame, cap: int = EXCERPT_CAP) -> DataFrame:
    """One decision per question: the number of excerpts (``cap`` at most), whether any of
    their sources reports a conflict, and the reason. Without an excerpt it is the denial of
    the best hit, or the gate's own answer where no hit is on a usable row."""
    gated = _gated_hits(questions, hits, catalog).select("query_id", "hit_rank", "gate", is_true("reported_status_conflict").alias("conflict"))
    picked = top_k(gated.where("gate = 'snapshot_excerpt_only'"), ["query_id"], [F.asc("hit_rank")], cap, "evidence_rank").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("excerpts"), F.bool_or("conflict").alias("conflict"))
    denied = gated.where("gate <> 'snapshot_excerpt_only'").groupBy("query_id").agg(F.min_by("gate", "hit_rank").alias("denial"))
    rows = questions.join(picked, "query_id", "left").join(denied, "query_id", "left")
    empty = policy.excerpt_gate("query", "dated", F.lit(0), F.lit(False), F.lit(True))
    excerpts = F.coalesce("excerpts", F.lit(0))
    return rows.select("query_id", excerpts.alias("excerpts"), is_true("conflict").alias("conflict"),
                       F.when(excerpts > 0, "snapshot_excerpt_only").otherwise(F.coalesce("denial", empty)).alias("reason"))


def first_sources(evidence: DataFrame, cap: int = PROVIDER_CAP) -> DataFrame:
    return evidence.where(F.col("evidence_rank") <= cap)
