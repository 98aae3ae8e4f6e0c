"""The answer contract: claims and citations checked as joins against evidence rows.

``answers`` hold one struct-free row per answer: answer_id, state, legal_date, text,
reason, unanswered, requested_legal_date, claims (array of claim_id, text, evidence_ids)
and citations (array of evidence_id, quote, span_start, span_end, document_version_id).
``evidence`` holds rows of (answer_id, evidence_id, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.classify import CENTRAL_SCOPE
from lexspan.functions.columns import equals, first_reason, flag, is_true
from lexspan.functions.ids import iso_ordinal
from lexspan.functions.text import is_blank, strip_whitespace

ANSWERING = ("answer", "partial", "provisional")
STATES = (*ANSWERING, "clarify", "unavailable", "abstain_conflict", "abstain_insufficient_evidence")


def _strip(text: Column) -> Column:
    return strip_whitespace(F.coalesce(text, F.lit("")))


def schema_error() -> Column:
    """First structural error of an answer row, NULL when there is none."""
    claims, citations = F.col("claims"), F.col("citations")
    bad_claim = F.exists(claims, lambda c: c.isNull() | is_blank(c["claim_id"]) | is_blank(c["text"]) | c["evidence_ids"].isNull()
                         | F.exists(c["evidence_ids"], is_blank))
    repeated = F.size(F.array_distinct(F.transform(claims, lambda c: c["claim_id"]))) != F.size(claims)
    bad_citation = F.exists(citations, lambda c: c.isNull() | is_blank(c["evidence_id"]) | c["quote"].isNull() | c["span_start"].isNull()
                            | c["span_end"].isNull() | is_blank(c["document_version_id"]))
    no_claims = F.coalesce(F.size(claims), F.lit(0)) <= 0
    return first_reason(
        (~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), "invalid_state"), (F.col("text").isNull(), "invalid_schema"),
        (F.col("state").isin(*ANSWERING) & no_claims, "empty_claims"),
        (is_true(bad_claim) | is_true(repeated), "invalid_claim_schema"), (is_true(bad_citation), "invalid_citation_schema"),
        ((F.col("state") == "partial") & (_strip(F.col("unanswered")) == "") & (_strip(F.col("reason")) == ""),
         "partial_reason_required"), default=F.lit(None).cast("string"))


def _citation_rows(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per citation with whether it holds against its evidence row."""
    cited = answers.select("answer_id", "state", iso_ordinal("requested_legal_date").alias("day"),
                           F.posexplode("citations").alias("at", "c")).select(
        "answer_id", "state", "day", "at", F.col("c.evidence_id").alias("evidence_id"), "c.quote", "c.span_start", "c.span_end",
        F.col("c.document_version_id").alias("cited_version"))
    rows = cited.join(evidence.withColumn("__known", F.lit(True)), ["answer_id", "evidence_id"], "left")
    provisional = F.col("state") == "provisional"
    snapshot = (is_true("provisional_snapshot_eligible") & equals("pham_vi", CENTRAL_SCOPE) & is_true("retrieval_index_candidate")
                & equals("current_validity", "unverified") & equals("expiry_state", "unknown_expiry")
                & F.col("reported_status_conflict").isNotNull() & (F.coalesce("source_dataset_revision", F.lit("")) != "")
                & (F.coalesce("content_sha256", F.lit("")) != ""))
    reviewed = equals("reviewed_status", "reviewed") & is_true("central_eligible")
    eligible = is_true("__known") & F.when(provisional, snapshot).otherwise(reviewed)
    start, end, text = F.col("span_start"), F.col("span_end"), F.coalesce("canonical_text", F.lit(""))
    span = (start >= 0) & (start < end) & (end <= F.length(text)) & (text.substr(start + 1, end - start) == F.col("quote"))
    open_ended = F.col("effective_to_day").isNull() & is_true("reviewed_open_ended")
    in_force = ((F.col("effective_from_day") <= F.col("day")) & (open_ended | (F.col("effective_to_day") > F.col("day")))
                & (F.col("reviewed_through_day") >= F.col("day")))
    dated = F.col("day").isNotNull() & ~provisional
    holds = (eligible & F.coalesce(span, F.lit(False)) & F.col("cited_version").eqNullSafe(F.col("document_version_id"))
             & (~dated | F.coalesce(in_force, F.lit(False))))
    return rows.select("answer_id", "at", "evidence_id", "quote", F.coalesce(holds, F.lit(False)).alias("holds"))


def validate(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """valid, citation_ids, unknown_ids, uncited_claims and invalid_citations per answer.
    ``citation_ids`` are the cited evidence ids in order, none where the answer's form is wrong.

    Lists per answer come from the answer's own claims and citations, so they stay as
    small as the answer; evidence is only ever joined.
    """
    rows = answers.withColumns({"claims": F.coalesce("claims", F.expr("array()").cast(answers.schema["claims"].dataType)),
                                "citations": F.coalesce("citations", F.expr("array()").cast(answers.schema["citations"].dataType))})
    rows = rows.withColumn("schema_error", schema_error())
    sound = rows.where("schema_error IS NULL")
    checked = _citation_rows(sound, evidence)
    broken = checked.where("NOT holds").groupBy("answer_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id"))), lambda b: b["evidence_id"]).alias("broken"))
    claims = sound.select("answer_id", "state", F.posexplode("claims").alias("claim_at", "claim"))
    ids = claims.select("answer_id", "state", "claim_at", F.col("claim.claim_id").alias("claim_id"), F.col("claim.text").alias("claim_text"),
                        F.explode_outer("claim.evidence_ids").alias("evidence_id"))
    known = evidence.select("answer_id", "evidence_id", F.lit(True).alias("known")).distinct()
    quotes = checked.groupBy("answer_id", "evidence_id").agg(F.collect_set("quote").alias("quotes"))
    linked = ids.join(known, ["answer_id", "evidence_id"], "left").join(quotes, ["answer_id", "evidence_id"], "left")
    unknown = F.col("evidence_id").isNotNull() & F.col("known").isNull()
    uncited = F.col("evidence_id").isNull() | (F.col("known").isNotNull() & F.col("quotes").isNull())
    per_claim = linked.groupBy("answer_id", "state", "claim_at", "claim_id").agg(
        F.collect_set(F.when(unknown, F.col("evidence_id"))).alias("unknown"), F.bool_or(uncited).alias("uncited"),
        F.bool_or(F.coalesce(F.array_contains("quotes", F.col("claim_text")), F.lit(False))).alias("extracted"))
    per_answer = per_claim.groupBy("answer_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown")))).alias("unknown_ids"),
        F.array_sort(F.collect_set(F.when(F.col("uncited"), F.col("claim_id")))).alias("uncited_claims"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("state") == "provisional") & ~F.col("extracted"), F.struct("claim_at", "claim_id")))),
                    lambda c: c["claim_id"]).alias("not_extracted"))
    joined = rows.join(broken, "answer_id", "left").join(per_answer, "answer_id", "left")
    requested, day = F.col("requested_legal_date"), iso_ordinal("requested_legal_date")
    asked = F.coalesce(requested, F.lit("")) != ""
    before = F.array_compact(F.array(
        flag(asked & day.isNull(), "invalid_legal_date"),
        flag(F.col("state").isin("answer", "partial") & day.isNull(), "requested_legal_date_required"),
        flag((F.col("state") == "provisional") & (day.isNotNull() | F.col("legal_date").isNotNull()), "provisional_as_of_date_not_allowed"),
        flag((F.coalesce("legal_date", F.lit("")) != "") & asked & (F.col("legal_date") != requested), "contradictory_legal_date")))
    expected = strip_whitespace(F.array_join(F.transform("claims", lambda c: strip_whitespace(c["text"])), " "))
    silent = ~F.col("state").isin(*ANSWERING)
    after = F.array_compact(F.array(
        flag(_strip(F.col("text")) != expected, "unvalidated_text"),
        flag(silent & ((F.size("claims") > 0) | (F.size("citations") > 0) | (_strip(F.col("text")) != "")),
             "non_answer_state_contains_claims")))
    none = F.array().cast("array<string>")
    invalid = F.when(F.col("schema_error").isNotNull(), F.array("schema_error")).otherwise(
        F.concat(before, F.coalesce("broken", none), F.coalesce("not_extracted", none), after))
    cited = F.when(F.col("schema_error").isNull(), F.transform("citations", lambda c: c["evidence_id"]))
    result = joined.select("answer_id", F.coalesce(cited, none).alias("citation_ids"), F.coalesce("unknown_ids", none).alias("unknown_ids"),
                           F.coalesce("uncited_claims", none).alias("uncited_claims"), invalid.alias("invalid_citations"))
    return result.withColumn("valid", (F.size("unknown_ids") == 0) & (F.size("uncited_claims") == 0) & (F.size("invalid_citations") == 0))


def joined_claims() -> Column:
    return strip_whitespace(F.array_join(F.transform("claims", lambda c: strip_whitespace(c["text"])), " "))


def repair_text(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adopt the joined claims as the text of answers whose text is all that is wrong with them:
    provisional ones, and those with a blank text. A new text mends nothing else, so one
    validation decides. A NULL text is an error of form and stays."""
    checked = validate(answers, evidence)
    only_text = ((F.size("unknown_ids") == 0) & (F.size("uncited_claims") == 0) & (F.size("invalid_citations") == 1)
                 & (F.get("invalid_citations", F.lit(0)) == "unvalidated_text"))
    rows = answers.join(checked.select("answer_id", F.col("valid").alias("__valid"), only_text.alias("__only_text")), "answer_id")
    adopt = F.col("__only_text") & ((F.col("state") == "provisional") | (_strip(F.col("text")) == ""))
    return rows.select(*[F.when(adopt, joined_claims()).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in answers.columns],
                       adopt.alias("text_repaired"), (F.col("__valid") | adopt).alias("valid"))


def unique_span(text: Column, quote: Column) -> Column:
    """Struct of 0-based span_start and span_end when the quote occurs exactly once, else
    NULL. Overlapping occurrences count."""
    at = F.position(quote, text)
    again = F.position(quote, text, at + 1)
    return F.when((F.length(quote) > 0) & (at > 0) & (again == 0), F.struct(
        (at - 1).alias("span_start"), (at - 1 + F.length(quote)).alias("span_end")))
