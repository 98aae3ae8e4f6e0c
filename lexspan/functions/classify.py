"""Rule-based classifications of metadata, headings and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspan.functions.columns import as_col, equals, first_reason, is_true, let, lit_array
from lexspan.functions.text import casefold, collapse_whitespace, contains_any, decode_entities, is_blank, norm

# The words below have to be exactly these for equal results.
CENTRAL_SCOPE = "Trung ương"
NAMED_LOCAL_SCOPES = ("tuyên quang", "lâm đồng")
LOCAL_SCOPE_PREFIXES = r"^(?:địa phương|tỉnh(?:\s|$)|huyện |quận |xã |phường |thị xã |thành phố |ubnd tỉnh )"
LOCAL_ISSUER_WORDS = (
    r"\b(?:ubnd|hđnd|tỉnh|huyện|quận|phường|thành phố|thành ủy|thành uỷ|tỉnh ủy|tỉnh uỷ)\b"
    r"|(?:uỷ|ủy) ban nhân dân|hội đồng nhân dân|(?:^|, )sở |\btp\.|ban quản lý khu")
CENTRAL_ISSUER_WORDS = (
    r"^(?:bộ |chính phủ|thủ tướng|chủ tịch (?:nước|chính phủ|hội đồng|quốc hội)|quốc hội|uỷ ban |ủy ban "
    r"|tổng cục |tổng liên đoàn |tổng công đoàn |ngân hàng |văn phòng |viện |tòa án |toà án |hội đồng "
    r"|ban (?:bí thư|chấp hành trung ương|thường trực quốc hội|tổ chức|tài chính - quản trị trung ương"
    r"|vật giá|tôn giáo|việt kiều)|thanh tra |kiểm toán |hội |trung ương |the |đoàn "
    r"|bảo hiểm xã hội việt nam|cục |liên bộ |phủ thủ tướng|trọng tài kinh tế nhà nước"
    r"|cộng hoà xã hội chủ nghĩa việt nam)")
UNKNOWN_ISSUER = "chưa xác định"
EMPLOYMENT_TERMS = (
    "bộ luật lao động", "quan hệ lao động", "người lao động", "hợp đồng lao động", "hợp đồng thử việc",
    "chấm dứt hợp đồng", "thử việc", "tiền lương", "thời giờ làm việc", "làm thêm giờ", "nghỉ hằng năm",
    "nghỉ hàng năm", "nghỉ phép", "nghỉ lễ", "kỷ luật lao động", "trợ cấp thôi việc", "tạm hoãn hợp đồng")
TOPIC_TERMS = {
    "probation": ("thử việc",),
    "contracts": ("hợp đồng lao động", "hợp đồng thử việc"),
    "working_time": ("thời giờ làm việc", "thời giờ nghỉ ngơi", "làm thêm giờ"),
    "leave": ("nghỉ hằng năm", "nghỉ hàng năm", "nghỉ lễ", "nghỉ phép", "ngày nghỉ hằng năm"),
}
WORKSHEET_TERMS = r"(?iu)thử việc|hợp đồng lao động|thời giờ làm việc|thời giờ nghỉ ngơi|nghỉ phép"


def scope_reason(scope) -> Column:
    return let(norm(scope), lambda value: first_reason(
        (value == "trung ương", "central_exact"),
        (value.rlike("(?U)" + LOCAL_SCOPE_PREFIXES) | value.isin(*NAMED_LOCAL_SCOPES), "exclude_local_scope"),
        (value == "", "quarantine_missing_scope"), default="quarantine_unrecognized_scope"))


def issuer_signal(issuer) -> Column:
    """Local words win over unknown, unknown over central: the order is part of the rule."""
    return let(norm(decode_entities(F.coalesce(as_col(issuer), F.lit("")))), lambda value: first_reason(
        (value.rlike("(?U)" + LOCAL_ISSUER_WORDS), "local_issuer_signal"),
        ((value == "") | F.contains(value, F.lit(UNKNOWN_ISSUER)), "missing_or_unknown_issuer"),
        (value.rlike("(?U)" + CENTRAL_ISSUER_WORDS), "central_issuer_signal"), default="unrecognized_issuer"))


def expiry_state(expiry) -> Column:
    return F.when(is_blank(expiry), "unknown_expiry").otherwise("reported_expiry_unverified")


def content_state(body, visible: Column, joined: Column) -> Column:
    return first_reason((~joined, "missing_content_row"), (is_blank(body), "blank_html"),
                        (visible == "", "no_visible_text_heuristic"), default="present")


def employment_reasons(title, sector, field, terms: tuple[str, ...] = EMPLOYMENT_TERMS) -> Column:
    """Sorted distinct terms of a title, and the contract-in-labour-context rule. A title may
    be a whole text: it is folded once, whatever the number of terms."""
    context = casefold(F.concat_ws(" ", F.coalesce(as_col(sector), F.lit("")), F.coalesce(as_col(field), F.lit(""))))

    def reasons(heading: Column) -> Column:
        contract = F.contains(heading, F.lit("hợp đồng")) & F.contains(F.concat_ws(" ", heading, context), F.lit("lao động"))
        extra = F.when(contract, F.array(F.lit("labor_context_for_contract"))).otherwise(F.array().cast("array<string>"))
        return F.array_sort(F.array_distinct(F.concat(contains_any(heading, terms), extra)))

    return let(casefold(F.coalesce(as_col(title), F.lit(""))), reasons)


def topic_candidates(heading, topics: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Topics whose terms occur in a heading, in the order the topics are declared."""
    text = casefold(collapse_whitespace(F.coalesce(as_col(heading), F.lit(""))))
    found = [F.when(F.exists(lit_array(terms), lambda term: F.contains(text, term)), F.lit(topic))
             for topic, terms in (topics or TOPIC_TERMS).items()]
    return F.array_compact(F.array(*found))


def index_disposition(document_id, label, topics, allowlist: dict[str, tuple[str, ...]]) -> Column:
    allowed = F.lit(False)
    for doc, labels in allowlist.items():
        allowed = allowed | (equals(document_id, doc) & as_col(label).isin(*labels))
    return first_reason((F.size(as_col(topics)) > 0, "in_scope_topic"), (is_true(allowed), "explicit_dependency"),
                        default="out_of_scope")


def article_number(label) -> Column:
    """Case-folded number of a leading article label, NULL when there is none."""
    number = F.regexp_extract(as_col(label), r"(?iuU)^\s*(?:điều|article)\s+(\d+[a-z]?)\b", 1)
    return F.when(number != "", casefold(number))


def document_identity(title, number) -> Column:
    return casefold(F.concat_ws(" ", F.coalesce(as_col(title), F.lit("")), F.coalesce(as_col(number), F.lit(""))))


def safe_url(url) -> Column:
    """The address when it is http(s), names a host and carries no user info; else NULL."""
    col = as_col(url)
    scheme = F.lower(F.regexp_extract(col, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.regexp_replace(authority, r":[0-9]*\z", "")
    return F.when(scheme.isin("http", "https") & (host != "") & ~F.contains(authority, F.lit("@")), col)


# Classes of refused provider calls in order of precedence. A class holds where
# the type, code or parameter of the error is among its own, or the message names it: one of
# its words, or one of its second words beside "model".
UPSTREAM_CLASSES = {
    "structured_output_rejected": {"code": ("json_validate_failed", "response_format_not_supported"), "param": ("response_format",),
                                   "words": ("response_format", "json schema")},
    "request_parameter_rejected": {"code": ("unsupported_value", "invalid_value", "missing_required_parameter", "unknown_parameter"),
                                   "param": ("max_completion_tokens", "max_tokens", "reasoning_effort"),
                                   "words": ("max_completion_tokens", "max_tokens", "reasoning_effort")},
    "authentication_or_permission_rejected": {"type": ("authentication_error", "permission_error"), "code": ("invalid_api_key", "insufficient_quota"),
                                              "words": ("invalid api key", "authentication", "permission")},
    "rate_limited": {"type": ("rate_limit_error",), "code": ("rate_limit_exceeded",), "words": ("rate limit",)},
    "model_unavailable": {"type": ("not_found_error",), "code": ("model_not_found",), "model_words": ("not found", "unavailable")},
}
# Values that are in no class but may be told.
UPSTREAM_OTHERS = {"type": ("invalid_request_error", "server_error", "internal_server_error"), "code": ("context_length_exceeded",), "param": ("model", "messages")}


def upstream_values(kind: str) -> tuple[str, ...]:
    """What an error's type, code or parameter may be told as, besides ``other``."""
    return tuple(v for rule in UPSTREAM_CLASSES.values() for v in rule.get(kind, ())) + UPSTREAM_OTHERS[kind]


def upstream_error_class(error_type, code, param, message) -> Column:
    """The first class that the error's values or its message name, else ``other``."""
    said = message_class(message)
    given = {kind: casefold(as_col(c)) for kind, c in (("type", error_type), ("code", code), ("param", param))}

    def named(name: str, rule: dict) -> Column:
        found = equals(said, name)
        for kind, values in given.items():
            if kind in rule:
                found = found | F.coalesce(values.isin(*rule[kind]), F.lit(False))
        return found

    return first_reason(*((named(name, rule), name) for name, rule in UPSTREAM_CLASSES.items()), default="other")


def message_class(message) -> Column:
    """The first class whose words a message has, ``other`` where none does; NULL without one."""
    text = casefold(as_col(message))

    def has(words):
        return F.exists(lit_array(words), lambda word: F.contains(text, word))

    rules = [(has(rule["words"]) if "words" in rule else F.contains(text, F.lit("model")) & has(rule["model_words"]), name)
             for name, rule in UPSTREAM_CLASSES.items()]
    return F.when(as_col(message).isNotNull(), first_reason(*rules, default="other"))


def upstream_error(body) -> Column:
    """What may be told of the body of a refused call, as a struct; NULL where the body is no
    JSON object with an object ``error``. Values outside the known ones become ``other``; of a
    failed generation only its length and whether it is JSON are told (an object that repeats a
    key counts as invalid)."""
    parsed = F.try_parse_json(as_col(body))

    def told(error: Column) -> Column:
        def text(key: str) -> Column:
            value = F.try_variant_get(error, f"$.{key}", "variant")
            return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(error, f"$.{key}", "string"))

        values = {kind: text(kind) for kind in ("type", "code", "param")}
        made = F.try_variant_get(error, "$.failed_generation", "variant")
        present, output = made.isNotNull(), text("failed_generation")
        verdict = first_reason((~present, "absent"), (output.isNull(), "not_string"), (F.try_parse_json(output).isNotNull(), "valid"), default="invalid")
        mapped = [F.coalesce(F.when(casefold(value).isin(*upstream_values(kind)), casefold(value)), F.lit("other")).alias(f"upstream_error_{kind}")
                  for kind, value in values.items()]
        return F.struct(
            *mapped, upstream_error_class(*values.values(), text("message")).alias("upstream_error_classification"),
            message_class(text("message")).alias("upstream_error_message_classification"), present.alias("failed_generation_present"),
            F.length(output).alias("failed_generation_length_chars"), verdict.alias("failed_generation_json_verdict"))

    error = F.try_variant_get(parsed, "$.error", "variant")
    return F.when(F.startswith(F.schema_of_variant(error), F.lit("OBJECT")), let(error, told))


def collection_name(prefix: str, revision: Column | str, spec_hash=None) -> Column:
    """Versioned name of a vector collection; NULL when the revision has other characters."""
    name = as_col(revision)
    parts = [F.lit(prefix), name] + ([F.substring(as_col(spec_hash), 1, 12)] if spec_hash is not None else [])
    return F.when(name.rlike(r"^[A-Za-z0-9_.-]+\z"), F.concat_ws("_", *parts))
