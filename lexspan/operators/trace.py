"""Trace rows without questions or answers: hashes, allow-listed fields, bounded values.

Works on a static table and, being stateless, unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.classify import UPSTREAM_CLASSES, upstream_values
from lexspan.functions.columns import as_col, lit_array
from lexspan.functions.ids import sha256

# What a trace row may hold.
REASONS = ("provider_timeout", "provider_error", "invalid_provider_output", "clarify", "unavailable", "abstain_conflict",
           "abstain_insufficient_evidence")
PROVENANCE_KEYS = ("model_version", "prompt_version", "index_version")
USAGE_KEYS = ("prompt_tokens", "completion_tokens", "total_tokens")
PHASES = ("http_transport", "http_response_read", "provider_envelope_json", "response_envelope", "provider_content",
          "content_json", "citation_validation")
OUTCOMES = ("failed", "response_received", "parsed", "extracted", "valid", "rejected")
FINISH_REASONS = ("stop", "length", "tool_calls", "function_call", "content_filter", "other")
TYPE_NAMES = ("dict", "list", "str", "int", "float", "bool", "NoneType", "tuple")
SHAPE_COUNTS = ("top_level_key_count", "choices_count", "content_length")
VALIDATION_CODES = (
    "structured_answer_required", "invalid_evidence_schema", "invalid_state", "invalid_schema", "empty_claims",
    "invalid_claim_schema", "invalid_citation_schema", "partial_reason_required", "invalid_legal_date",
    "requested_legal_date_required", "provisional_as_of_date_not_allowed", "invalid_answer_legal_date",
    "contradictory_legal_date", "non_answer_state_contains_claims", "unvalidated_text", "unknown_evidence_reference",
    "uncited_claim", "evidence_or_claim_reference")
GENERATION_VERDICTS = ("absent", "not_string", "valid", "invalid", "unassessed")
# Fields of a diagnostic beyond the ones it always has, with what each may hold: one of the
# values, any flag (None) or a count that is not negative (0).
FURTHER_FIELDS = {
    **{f"upstream_error_{kind}": (*upstream_values(kind), "other") for kind in ("type", "code", "param")},
    "upstream_error_classification": (*UPSTREAM_CLASSES, "other"), "upstream_error_message_classification": (*UPSTREAM_CLASSES, "other"),
    "failed_generation_present": None, "failed_generation_length_chars": 0, "failed_generation_json_verdict": GENERATION_VERDICTS,
    "invalid_citation_count": 0, "unknown_evidence_count": 0, "uncited_claim_count": 0}


def only(value, allowed) -> Column:
    return F.when(as_col(value).isin(*allowed), as_col(value))


def keep_keys(mapping, allowed) -> Column:
    return F.map_filter(as_col(mapping), lambda key, value: key.isin(*allowed) & value.isNotNull())


def keep_counts(mapping, allowed) -> Column:
    """Allow-listed non-negative counts; NULL when none is left."""
    kept = F.map_filter(as_col(mapping), lambda key, value: key.isin(*allowed) & (value >= 0))
    return F.when(F.size(kept) > 0, kept)


def class_name(value) -> Column:
    col = as_col(value)
    return F.when(col.rlike(r"^[A-Za-z][A-Za-z0-9_]{0,79}\z"), col)


def _further(source: Column, name: str) -> Column:
    allowed, value = FURTHER_FIELDS[name], source[name]
    return (value if allowed is None else F.when(value >= 0, value) if allowed == 0 else only(value, allowed)).alias(name)


def safe_diagnostic(source: Column, further: Iterable[str] = ()) -> Column:
    """A diagnostic struct reduced to its allowed values; NULL when its phase is unknown.
    Expects fields phase, outcome, exception_class, upstream_http_status, elapsed_ms,
    finish_reason, reason_class, response_shape (map of strings), usage and
    validation_reason_codes, and those of FURTHER_FIELDS that are named."""
    status, elapsed = source["upstream_http_status"], source["elapsed_ms"]
    shape = F.transform_values(
        F.map_filter(source["response_shape"], lambda key, value: F.when(key.isin(*SHAPE_COUNTS), value.rlike(r"^\d+\z"))
                     .otherwise(F.endswith(key, F.lit("_type")))),
        lambda key, value: F.when(key.isin(*SHAPE_COUNTS) | value.isin(*TYPE_NAMES), value).otherwise("other"))
    return F.when(source["phase"].isin(*PHASES), F.struct(
        source["phase"].alias("phase"), only(source["outcome"], OUTCOMES).alias("outcome"),
        class_name(source["exception_class"]).alias("exception_class"), class_name(source["reason_class"]).alias("reason_class"),
        F.when(status.between(100, 599), status).alias("upstream_http_status"),
        F.when((elapsed >= 0) & (elapsed < float("inf")), F.round(elapsed, 2)).alias("elapsed_ms"),
        only(source["finish_reason"], FINISH_REASONS).alias("finish_reason"), shape.alias("response_shape"),
        keep_counts(source["usage"], USAGE_KEYS).alias("usage"),
        F.array_sort(F.array_intersect(source["validation_reason_codes"], lit_array(VALIDATION_CODES))).alias("validation_reason_codes"),
        *[_further(source, name) for name in further]))


def redact(events: DataFrame) -> DataFrame:
    """Trace rows from raw events (trace_id, stage, outcome, duration_ms, query, provenance,
    evidence_ids, usage, reason and, optionally, diagnostics)."""
    columns = [
        F.col("trace_id"), F.col("stage"), F.col("outcome"), F.col("duration_ms"),
        F.coalesce(keep_keys("provenance", PROVENANCE_KEYS), F.create_map().cast("map<string,string>")).alias("provenance"),
        F.coalesce(F.array_compact("evidence_ids"), F.array().cast("array<string>")).alias("evidence_ids"),
        keep_counts("usage", USAGE_KEYS).alias("usage"), only("reason", REASONS).alias("reason"), sha256("query").alias("query_sha256")]
    if "diagnostics" in events.columns:
        given = events.schema["diagnostics"].dataType.elementType.fieldNames()
        further = [name for name in FURTHER_FIELDS if name in given]
        safe = F.array_compact(F.transform("diagnostics", lambda source: safe_diagnostic(source, further)))
        columns.append(F.when(F.size(safe) > 0, safe).alias("diagnostics"))
    return events.select(*columns)


def recent(events: DataFrame, order: str, size: int = 100) -> DataFrame:
    """The last rows by time, as the bounded event log keeps them."""
    return events.orderBy(F.desc(order), F.desc("trace_id")).limit(size)
