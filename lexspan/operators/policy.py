"""Eligibility predicates and request gates as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.classify import CENTRAL_SCOPE
from lexspan.functions.columns import as_col, equals, first_reason, is_true, let
from lexspan.functions.text import is_blank, strip_whitespace
from lexspan.operators import intervals

# Request patterns and messages. "(?iuU)" gives Java the Unicode case
# folding and word boundaries the patterns are written for.
_FLAGS = "(?iuU)"
VALIDITY_QUERY = (
    r"\b(hiện nay|hiện tại|hiện hành|hôm nay|today|còn hiệu lực|hết hiệu lực|tình trạng hiệu lực|hiệu lực"
    r"|đang có hiệu lực|đang áp dụng|còn áp dụng|áp dụng hiện tại|buộc phải tuân thủ|phải tuân thủ|có bắt buộc"
    r"|có nghĩa vụ|must comply|applicable|validity|currently|in force|currently applicable)\b")
AS_OF_QUERY = (
    r"\b(?:tính đến ngày|vào ngày|as of)\b|\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/(?:19|20)\d{2}\b"
    r"|\bnăm\s+(?:19|20)\d{2}\b")
AMENDMENT_QUERY = (r"\b(sửa đổi|bổ sung|bản hợp nhất|hợp nhất|mới nhất|đã sửa đổi|amendment|consolidated|latest version)\b")
_QUALIFIER = r"(?:\s+(?:trong|của)\s+(?:bộ luật|nghị định|thông tư)(?:\s+(?:lao\s+động|số\s+\d+[\w/-]*)){1,2})?"
SOURCE_TEXT_REQUEST = (
    r"(?:điều\s+\d+\s+(?:quy định|nói|ghi)\s+gì(?:\s+về\s+(?:thử việc|hợp đồng|giờ làm|nghỉ phép))?" + _QUALIFIER +
    r"|nội dung\s+(?:của\s+)?điều\s+\d+(?:\s+là\s+gì)?" + _QUALIFIER +
    r"|trích\s+(?:nguyên văn\s+)?(?:điều\s+)?\d+" + _QUALIFIER +
    r"|what does article\s+\d+\s+say(?:\s+about\s+(?:probation|employment contracts?|working hours?|leave))?"
    r"|(?:show|quote)\s+(?:me\s+)?(?:the\s+)?(?:exact\s+)?(?:text|quote)\s+(?:of\s+)?article\s+\d+"
    r"|exact text of article\s+\d+)[?.! ]*")
TOPIC_QUERIES = {
    "probation": r"thử\s+việc|probation",
    "contracts": r"hợp\s+đồng|giao\s+kết|employment\s+contract",
    "working_time": r"làm\s+thêm\s+giờ|giờ\s+làm|thời\s+giờ\s+làm|thời\s+gian\s+làm\s+việc|working\s+hours?",
    "leave": r"nghỉ\s+phép|nghỉ\s+hằng\s+năm|annual\s+leave",
}
PERSONAL_QUERY = (
    r"\b(tôi|của tôi|trường hợp của (?:tôi|em)|nếu|em có|doanh nghiệp tôi|công ty tôi|được phép|có được|được không"
    r"|nên làm gì|tôi phải)\b")
APPLICABILITY_QUERY = (
    r"\b(áp dụng cho ai|đối tượng áp dụng|đối tượng nào|ai được áp dụng|trường hợp nào áp dụng|có áp dụng cho)\b")
ARTICLE_REFERENCE = r"\b(?:điều|article)\s+\d+[a-z]?\b|\btrích\s+(?:nguyên văn\s+)?(?:điều\s+)?\d+\b"
OUT_OF_SCOPE_QUERY = (
    r"\b(thuế|tax(?:ation)?|bảo hiểm|insurance|tranh chấp|disputes?|hình sự|criminal|immigration|visa|đất đai"
    r"|công chức|viên chức|cán bộ|cơ quan nhà nước|khu vực công|lực lượng vũ trang|quân nhân|công an|sĩ quan"
    r"|civil servants?|public employees?|chưa thành niên|chưa đủ 18 tuổi|dưới 18 tuổi|người khuyết tật"
    r"|người cao tuổi|người lao động cao tuổi|lao động cao tuổi|lao động nữ|lao động mang thai"
    r"|người lao động mang thai|phụ nữ (?:mang thai|có thai)|người mang thai|thai sản|maternity"
    r"|lao động nước ngoài|người lao động nước ngoài|người nước ngoài|giúp việc gia đình|domestic workers?)\b")
CAVEAT = ("Trả lời này chỉ mô tả nội dung trong bản dữ liệu đã thu thập; "
          "hiệu lực hiện tại, sửa đổi và tình trạng áp dụng chưa được xác minh.")
CONFLICT_CAVEAT = ("Các bản ghi nguồn có thông tin trạng thái được báo cáo xung đột; "
                   "trích đoạn không xác nhận bản ghi nào đúng hoặc hiệu lực hiện tại.")
MESSAGES = {
    "conflicting_status": "Tình trạng hiệu lực trong các bản ghi xung đột; chưa thể xác nhận câu trả lời theo thời điểm yêu cầu.",
    "validity_unverified": "Bản dữ liệu chưa xác minh hiệu lực hiện tại hoặc tình trạng áp dụng.",
    "requested_date_unverified": "Bản dữ liệu chưa đủ thông tin để xác nhận quy định áp dụng vào ngày yêu cầu.",
    "amendments_unverified": "Các quan hệ sửa đổi/hợp nhất chưa được xác minh; bản trích chỉ thể hiện nội dung của nguồn đã ghim.",
    "source_text_request_required": "Chỉ có thể trích nội dung nguồn khi câu hỏi yêu cầu rõ văn bản; câu hỏi áp dụng pháp luật cần được xác minh riêng.",
    "applicability_unverified": "Không thể áp dụng nội dung snapshot cho tình huống cá nhân khi chưa xác minh.",
    "ambiguous_facts": "Câu hỏi bao gồm nhiều chủ đề; cần làm rõ phạm vi trước khi trích đoạn.",
    "out_of_scope": "Câu hỏi nằm ngoài phạm vi nội dung lao động được hỗ trợ.",
    "no_evidence": "Không tìm thấy đoạn văn bản phù hợp trong phạm vi dữ liệu này.",
    "evidence_not_provisional_eligible": "Đoạn văn bản không đạt điều kiện để trích dẫn tạm thời.",
    "snapshot_text_only": "Có thể mô tả nội dung trong bản dữ liệu.",
    "snapshot_excerpt_only": "Chỉ có thể trích đoạn nguyên văn từ bản dữ liệu.",
}


def legal_eligibility(day, *, include_open_ended: bool = False, provision: str | None = None) -> Column:
    """Reviewed central text in force on a legal day. The end is exclusive, the review
    horizon inclusive; an open end counts only on request and never beside an end date."""
    start, end, through = F.col("effective_from_day"), F.col("effective_to_day"), F.col("reviewed_through_day")
    wanted = as_col(day)
    open_ended = end.isNull() & is_true("reviewed_open_ended")
    contradictory = is_true("reviewed_open_ended") & end.isNotNull()
    ok = (~contradictory & start.isNotNull() & through.isNotNull() & (open_ended | end.isNotNull())
          & equals("pham_vi", CENTRAL_SCOPE) & equals("reviewed_status", "reviewed") & is_true("central_eligible")
          & (start <= wanted) & (through >= wanted)
          & ((F.lit(include_open_ended) & open_ended) | F.coalesce(end > wanted, F.lit(False))))
    if provision is not None:
        ok = ok & equals("provision", provision)
    return F.coalesce(ok, F.lit(False))


def legal_filter(day, *, include_open_ended: bool = False, provision: str | None = None, scope: str = CENTRAL_SCOPE) -> Column:
    """The same rule as a filter for scans: conjunctions that push down, and one OR."""
    wanted = as_col(day)
    must = ((F.col("pham_vi") == scope) & (F.col("reviewed_status") == "reviewed") & F.col("central_eligible")
            & (F.col("effective_from_day") <= wanted) & (F.col("reviewed_through_day") >= wanted))
    if provision is not None:
        must = must & (F.col("provision") == provision)
    window = (F.col("effective_to_day") > wanted) & ~is_true("reviewed_open_ended")
    if include_open_ended:
        window = window | (is_true("reviewed_open_ended") & F.col("effective_to_day").isNull())
    return must & window


def contradictory_open_end() -> Column:
    return is_true("reviewed_open_ended") & F.col("effective_to_day").isNotNull()


def configured_evidence_ok(day) -> Column:
    """The stricter check of reviewed evidence: never open-ended, reviewed version is the version."""
    blank = F.lit(False)
    for name in ("article_id", "document_version_id", "canonical_text"):
        blank = blank | is_blank(name)
    wanted = as_col(day)
    return ~blank & F.coalesce(
        F.col("reviewed_version_id").eqNullSafe(F.col("document_version_id")) & ~is_true("reviewed_open_ended")
        & equals("pham_vi", CENTRAL_SCOPE) & equals("reviewed_status", "reviewed") & is_true("central_eligible")
        & (F.col("effective_from_day") <= wanted) & (wanted < F.col("effective_to_day"))
        & (F.col("reviewed_through_day") >= wanted), F.lit(False))


def provisional_row_ok() -> Column:
    """Evidence that may be quoted from the snapshot without a claim of validity."""
    filled = F.lit(True)
    for name in ("source_dataset_revision", "content_sha256", "document_version_id", "canonical_text"):
        filled = filled & ~is_blank(name)
    return (equals("pham_vi", CENTRAL_SCOPE) & is_true("retrieval_index_candidate") & equals("current_validity", "unverified")
            & equals("expiry_state", "unknown_expiry") & F.col("reported_status_conflict").isNotNull() & filled)


def _asks(question: Column, pattern: str) -> Column:
    return question.rlike(_FLAGS + pattern)


def query_topics(question) -> Column:
    """Topics a question names, in declared order."""
    return let(F.coalesce(as_col(question), F.lit("")), lambda q: F.array_compact(F.array(
        *[F.when(_asks(q, pattern), F.lit(topic)) for topic, pattern in TOPIC_QUERIES.items()])))


def _time_reasons(question: Column, dated, conflict) -> list[tuple]:
    """What both gates refuse first: questions about validity, a day or amendments."""
    torn = is_true(conflict)
    unless_torn = lambda reason: F.when(torn, "conflicting_status").otherwise(reason)
    return [(_asks(question, VALIDITY_QUERY), unless_torn("validity_unverified")),
            (is_true(dated) | _asks(question, AS_OF_QUERY), unless_torn("requested_date_unverified")),
            (_asks(question, AMENDMENT_QUERY), "amendments_unverified")]


def source_text_gate(question, dated, rows, conflict, all_ok) -> Column:
    """Reason of the source-text gate. Evidence comes as its row count, whether any row
    has a status conflict, and whether every row may be quoted."""
    full = rf"{_FLAGS}^(?:{SOURCE_TEXT_REQUEST})\z"
    return let(F.coalesce(as_col(question), F.lit("")), lambda q: first_reason(
        *_time_reasons(q, dated, conflict), (~strip_whitespace(q).rlike(full), "source_text_request_required"),
        (F.coalesce(as_col(rows), F.lit(0)) == 0, "no_evidence"),
        (~is_true(all_ok), "evidence_not_provisional_eligible"), default="snapshot_text_only"))


def excerpt_gate(question, dated, rows, conflict, all_ok) -> Column:
    """Reason of the ordinary-topic excerpt gate."""
    return let(F.coalesce(as_col(question), F.lit("")), lambda q: first_reason(
        *_time_reasons(q, dated, conflict), (_asks(q, OUT_OF_SCOPE_QUERY), "out_of_scope"),
        (_asks(q, ARTICLE_REFERENCE), "source_text_request_required"),
        (_asks(q, PERSONAL_QUERY) | _asks(q, APPLICABILITY_QUERY), "applicability_unverified"),
        (F.size(query_topics(q)) > 1, "ambiguous_facts"), (F.size(query_topics(q)) == 0, "out_of_scope"),
        (F.coalesce(as_col(rows), F.lit(0)) == 0, "no_evidence"),
        (~is_true(all_ok), "evidence_not_provisional_eligible"), default="snapshot_excerpt_only"))


def _evidence_facts(evidence: DataFrame, row_ok: Column) -> DataFrame:
    return evidence.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("evidence_rows"), F.bool_or(is_true("reported_status_conflict")).alias("conflict"),
        F.bool_and(row_ok).alias("all_ok"))


def _decision(rows: DataFrame, reason: Column, allowed_reason: str, mode: str, caveat: Column) -> DataFrame:
    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    decided = rows.withColumn("reason", reason)
    allowed = F.col("reason") == allowed_reason
    return decided.select(
        *rows.columns, "reason", allowed.alias("allowed"), F.when(allowed, mode).otherwise("abstain").alias("mode"),
        message[F.col("reason")].alias("message"), F.when(allowed, caveat).otherwise(CAVEAT).alias("caveat"))


def decide_source_text(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Gate (query_id, query, dated) with evidence rows (query_id, ...): one decision each."""
    rows = questions.join(_evidence_facts(evidence, provisional_row_ok()), "query_id", "left")
    reason = source_text_gate("query", "dated", "evidence_rows", "conflict", "all_ok")
    return _decision(rows, reason, "snapshot_text_only", "provisional_snapshot", F.lit(CAVEAT)).drop("evidence_rows", "conflict", "all_ok")


def decide_excerpt(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """As above for ordinary topics; a row must also carry the question's topic."""
    topics = questions.select("query_id", F.get(query_topics("query"), F.lit(0)).alias("topic"))
    ok = provisional_row_ok() & F.coalesce(F.array_contains("topic_candidates", F.col("topic")), F.lit(False))
    rows = questions.join(_evidence_facts(evidence.join(topics, "query_id"), ok), "query_id", "left")
    reason = excerpt_gate("query", "dated", "evidence_rows", "conflict", "all_ok")
    caveat = F.when(is_true("conflict"), f"{CAVEAT} {CONFLICT_CAVEAT}").otherwise(CAVEAT)
    return _decision(rows, reason, "snapshot_excerpt_only", "experimental_snapshot_excerpt", caveat).drop(
        "evidence_rows", "conflict", "all_ok")


def answer_state(missing_facts, conflict, sufficient) -> Column:
    return first_reason((is_true(missing_facts), "clarify"), (is_true(conflict), "abstain_conflict"),
                        (~is_true(sufficient), "abstain_insufficient_evidence"), default="answer")


def abstain_state(reason) -> Column:
    return F.when(as_col(reason) == "conflicting_status", "abstain_conflict").otherwise("abstain_insufficient_evidence")


def evidence_in_force(questions: DataFrame, evidence: DataFrame, *, include_open_ended: bool = False, day: str = "legal_day") -> DataFrame:
    """Each question with the evidence that is in force on its own day. What does not depend
    on a day filters the evidence first; the days then meet the ranges of days on which each
    row is eligible: from its start to the day before its end, or to the review horizon."""
    open_ended = F.col("effective_to_day").isNull() & is_true("reviewed_open_ended")
    must = (equals("pham_vi", CENTRAL_SCOPE) & equals("reviewed_status", "reviewed") & is_true("central_eligible") & ~contradictory_open_end()
            & (F.col("effective_to_day").isNotNull() | (F.lit(include_open_ended) & open_ended)))
    last = F.least("reviewed_through_day", F.col("effective_to_day") - 1)
    ranges = evidence.where(must & F.col("reviewed_through_day").isNotNull()).withColumn("__last", last)
    return intervals.containing(questions, day, ranges, "effective_from_day", "__last").drop("__last")
