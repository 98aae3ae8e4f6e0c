"""Eligibility, gates, citations and trace queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions.classify import CENTRAL_SCOPE, topic_candidates
from lexspan.functions.ids import ordinal_day, stable_id
from lexspan.functions.text import clip_excerpt
from lexspan.operators import citations, evidence, policy, trace
from lexspan.plans.registry import query
from lexspan.plans.retrieval import BM25_SQL, sparse_hits
from lexspan.plans.tables import queries_from_benchmark, table
from lexspan.session import cut_lineage

LEGAL_DAY = 729_390  # 1998-01-01

# Orders read as reviewed legal text: order date as start, status as the kind of end.
_REVIEWED_SQL = """rv AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'Trung ương' ELSE 'Tỉnh' END pham_vi,
CASE WHEN o_orderpriority <> '2-HIGH' THEN 'reviewed' ELSE 'draft' END reviewed_status, o_totalprice > 50000 central_eligible,
date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 effective_from_day,
CASE o_orderstatus WHEN 'F' THEN date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 366
  WHEN 'O' THEN CASE WHEN o_custkey > 700 THEN date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 900 END END effective_to_day,
date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 700 reviewed_through_day, o_orderstatus <> 'F' reviewed_open_ended FROM orders)"""
_ELIGIBLE_SQL = """NOT (reviewed_open_ended AND effective_to_day IS NOT NULL) AND pham_vi = 'Trung ương' AND reviewed_status = 'reviewed'
AND central_eligible AND effective_from_day <= {day} AND reviewed_through_day >= {day} AND ({open}coalesce(effective_to_day > {day}, false))"""


def _reviewed(spark: SparkSession, folder: str) -> DataFrame:
    start = ordinal_day("o_orderdate")
    end = F.when(F.col("o_orderstatus") == "F", start + 365).when((F.col("o_orderstatus") == "O") & (F.col("o_custkey") > 700), start + 899)
    return table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "1-URGENT", CENTRAL_SCOPE).otherwise("Tỉnh").alias("pham_vi"),
        F.when(F.col("o_orderpriority") != "2-HIGH", "reviewed").otherwise("draft").alias("reviewed_status"),
        (F.col("o_totalprice") > 50000).alias("central_eligible"), start.alias("effective_from_day"), end.alias("effective_to_day"),
        (start + 699).alias("reviewed_through_day"), (F.col("o_orderstatus") != "F").alias("reviewed_open_ended"))


@query(f"WITH {_REVIEWED_SQL} SELECT o_orderkey, effective_from_day, effective_to_day FROM rv WHERE {_ELIGIBLE_SQL.format(day=LEGAL_DAY, open='')}")
def legal_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed(spark, folder).where(policy.legal_eligibility(F.lit(LEGAL_DAY))).select(
        "o_orderkey", "effective_from_day", "effective_to_day")


@query(f"""WITH {_REVIEWED_SQL} SELECT o_orderkey, {_ELIGIBLE_SQL.format(day=LEGAL_DAY, open='(effective_to_day IS NULL AND reviewed_open_ended) OR ')} eligible,
reviewed_open_ended AND effective_to_day IS NOT NULL contradictory FROM rv""")
def open_ended_eligibility(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed(spark, folder).select(
        "o_orderkey", policy.legal_eligibility(F.lit(LEGAL_DAY), include_open_ended=True).alias("eligible"),
        policy.contradictory_open_end().alias("contradictory"))


@query(f"""WITH {_REVIEWED_SQL} SELECT o_orderkey FROM rv WHERE {_ELIGIBLE_SQL.format(day=LEGAL_DAY, open='(effective_to_day IS NULL AND reviewed_open_ended) OR ')}""")
def legal_filter_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _reviewed(spark, folder).where(policy.legal_filter(F.lit(LEGAL_DAY), include_open_ended=True)).select("o_orderkey")


@query(f"""WITH {_REVIEWED_SQL}, q AS (SELECT item_id query_id, CASE WHEN item_id % 9 <> 4 THEN CAST({LEGAL_DAY} - 1500 + item_id * 37 AS INT) END legal_day FROM benchmark)
SELECT query_id, legal_day, o_orderkey FROM q JOIN rv ON {_ELIGIBLE_SQL.format(day='legal_day', open='(effective_to_day IS NULL AND reviewed_open_ended) OR ')}""")
def evidence_by_day(spark: SparkSession, folder: str) -> DataFrame:
    """Items as questions with days of their own (some without), and what is in force on each."""
    item = F.col("item_id")
    questions = table(spark, folder, "benchmark").select(
        item.alias("query_id"), F.when(item % 9 != 4, (F.lit(LEGAL_DAY - 1500) + item * 37).cast("int")).alias("legal_day"))
    return policy.evidence_in_force(questions, _reviewed(spark, folder), include_open_ended=True).select("query_id", "legal_day", "o_orderkey")


# Phrases put before a user turn, by its first letter, so that every gate rule is met; and
# requests for a source text, one more question of each conversation.
REQUESTS = ("Điều 24 quy định gì về thử việc?", "Nội dung của Điều 5 là gì")
PHRASES = {
    "e": "Quy định thử việc hiện nay: ", "i": "Hợp đồng và thử việc: ",
    "o": "Làm thêm giờ là gì: ", "u": "Luật sửa đổi: ", "t": "Nghỉ phép vào ngày 2020-01-02: ", "d": "Tôi được nghỉ phép: ",
    "l": "Thuế và hợp đồng: ", "b": "Giờ làm theo Điều 7: ", "r": "thử  việc: "}
_ASK = "lower(left(text, 1))"
_QUESTION_SQL = (f"CASE {_ASK} " + " ".join(
    f"WHEN '{k}' THEN '{v}' || text" for k, v in PHRASES.items()) + " ELSE text END")
_LEFT, _RIGHT = r"(?:^|[^\p{L}\p{M}\p{N}_])", r"(?:$|[^\p{L}\p{M}\p{N}_])"


def _sql_pattern(pattern: str) -> str:
    """The pattern with word boundaries that know letters beyond ASCII, which \\b in RE2 does not."""
    opened = pattern.replace(r"|\b", "|" + _LEFT)
    opened = _LEFT + opened[2:] if opened.startswith(r"\b") else opened
    return "(?i)" + opened.replace(r"\b", _RIGHT)


def _matches(pattern: str, column: str = "q") -> str:
    return f"regexp_matches({column}, '{_sql_pattern(pattern)}')"


_QUESTIONS_SQL = f"""qs AS (SELECT conv_id, CAST(turn AS VARCHAR) turn, {_QUESTION_SQL} q, conv_id % 7 = 6 bare, conv_id % 3 = 0 AND conv_id % 7 <> 6 torn
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT DISTINCT conv_id, 'request', ['{REQUESTS[0]}', '{REQUESTS[1]}'][conv_id % 2 + 1], conv_id % 7 = 6, conv_id % 3 = 0 AND conv_id % 7 <> 6 FROM conversations)"""
_TOPICS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_matches(p)} THEN '{t}' END" for t, p in policy.TOPIC_QUERIES.items()) + "], lambda x: x IS NOT NULL)"


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    letter, text, phrase = F.lower(F.substring("text", 1, 1)), F.col("text"), None
    for key, value in PHRASES.items():
        phrase = F.when(letter == key, value) if phrase is None else phrase.when(letter == key, value)
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").cast("string").alias("turn"), F.concat(phrase.otherwise(""), text).alias("query"))
    requests = turns.select("conv_id").distinct().select(
        "conv_id", F.lit("request").alias("turn"), F.when(F.col("conv_id") % 2 == 0, REQUESTS[0]).otherwise(REQUESTS[1]).alias("query"))
    return asked.unionByName(requests).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), "turn").alias("query_id"), "conv_id", "query", F.lit(False).alias("dated"))


def _evidence(questions: DataFrame) -> DataFrame:
    """One evidence row per question; the conversation decides conflict and scope, and one in seven has no evidence."""
    return questions.where("conv_id % 7 <> 6").select(
        "query_id", F.when(F.col("conv_id") % 5 != 0, CENTRAL_SCOPE).otherwise("Tỉnh").alias("pham_vi"), F.lit(True).alias("retrieval_index_candidate"),
        F.lit("unverified").alias("current_validity"), F.lit("unknown_expiry").alias("expiry_state"),
        (F.col("conv_id") % 3 == 0).alias("reported_status_conflict"), F.lit("r").alias("source_dataset_revision"),
        F.lit("h").alias("content_sha256"), F.lit("v").alias("document_version_id"), F.col("query").alias("canonical_text"),
        F.array(F.lit("probation"), F.lit("working_time")).alias("topic_candidates"))


_FULL = "(?i)^(?:" + policy.SOURCE_TEXT_REQUEST + ")$"


@query(f"""WITH {_QUESTIONS_SQL} SELECT conv_id || ':' || turn query_id, CASE
WHEN {_matches(policy.VALIDITY_QUERY)} THEN CASE WHEN torn THEN 'conflicting_status' ELSE 'validity_unverified' END
WHEN {_matches(policy.AS_OF_QUERY)} THEN CASE WHEN torn THEN 'conflicting_status' ELSE 'requested_date_unverified' END
WHEN {_matches(policy.AMENDMENT_QUERY)} THEN 'amendments_unverified'
WHEN NOT regexp_matches(trim(q), '{_FULL}') THEN 'source_text_request_required'
WHEN bare THEN 'no_evidence' WHEN conv_id % 5 = 0 THEN 'evidence_not_provisional_eligible' ELSE 'snapshot_text_only' END reason FROM qs""")
def source_text_gate(spark: SparkSession, folder: str) -> DataFrame:
    questions = _questions(spark, folder)
    return policy.decide_source_text(questions, _evidence(questions)).select("query_id", "reason")


@query(f"""WITH {_QUESTIONS_SQL}, t AS (SELECT *, {_TOPICS_SQL} topics FROM qs) SELECT conv_id || ':' || turn query_id, CASE
WHEN {_matches(policy.VALIDITY_QUERY)} THEN CASE WHEN torn THEN 'conflicting_status' ELSE 'validity_unverified' END
WHEN {_matches(policy.AS_OF_QUERY)} THEN CASE WHEN torn THEN 'conflicting_status' ELSE 'requested_date_unverified' END
WHEN {_matches(policy.AMENDMENT_QUERY)} THEN 'amendments_unverified' WHEN {_matches(policy.OUT_OF_SCOPE_QUERY)} THEN 'out_of_scope'
WHEN {_matches(policy.ARTICLE_REFERENCE)} THEN 'source_text_request_required'
WHEN {_matches(policy.PERSONAL_QUERY)} OR {_matches(policy.APPLICABILITY_QUERY)} THEN 'applicability_unverified'
WHEN len(topics) > 1 THEN 'ambiguous_facts' WHEN len(topics) = 0 THEN 'out_of_scope'
WHEN bare THEN 'no_evidence' WHEN conv_id % 5 = 0 OR topics[1] NOT IN ('probation', 'working_time') THEN 'evidence_not_provisional_eligible'
ELSE 'snapshot_excerpt_only' END reason FROM t""")
def policy_gate(spark: SparkSession, folder: str) -> DataFrame:
    questions = _questions(spark, folder)
    return policy.decide_excerpt(questions, _evidence(questions)).select("query_id", "reason")


@query(f"WITH {_QUESTIONS_SQL} SELECT conv_id || ':' || turn query_id, array_to_string({_TOPICS_SQL}, '|') topics FROM qs")
def query_topics(spark: SparkSession, folder: str) -> DataFrame:
    return _questions(spark, folder).select("query_id", F.array_join(policy.query_topics("query"), "|").alias("topics"))


TOPICS = {"animals": ("ther", "ion"), "verbs": ("ing", "ed "), "french": ("eau", "ment"), "german": ("ung", "keit")}
_HEADING = "replace(lower(split_part(text, chr(10), 1)), 'ß', 'ss')"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains({_HEADING}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}' END" for name, terms in TOPICS.items())
    + "], lambda x: x IS NOT NULL), '|') topics FROM documents")
def topic_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("heading"))
    return docs.select("doc_id", F.array_join(topic_candidates("heading", TOPICS), "|").alias("topics"))


@query("""WITH n AS (SELECT doc_id, 'lexspan:' || doc_id || ':' || sha256(text) name FROM documents),
h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(name)) s FROM n)
SELECT doc_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' ||
substr('89ab89ab89ab89ab', CAST('0x' || substr(s, 17, 1) AS INT) + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) stable_id FROM h""")
def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", stable_id("doc_id", F.sha2("text", 256)).alias("stable_id"))


@query("""SELECT doc_id, CASE WHEN length(text) > 2400 THEN regexp_replace(substr(text, 1, 2400), '(?s)^(.+) [^ ]*$', '\\1') ELSE text END excerpt FROM documents""")
def excerpt_clips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", clip_excerpt("text", 2400).alias("excerpt"))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Each benchmark item as a quote from its first BM25 document."""
    best = cut_lineage(sparse_hits(spark, folder, 1).select("query_id", "doc_id"))
    texts = table(spark, folder, "documents").select("doc_id", "text")
    return texts.join(best, "doc_id").join(queries_from_benchmark(spark, folder), "query_id")


_QUOTES_SQL = f"""{BM25_SQL}, q AS (SELECT query_id, doc_id, d.text, b.text quote FROM bmr JOIN documents d USING (doc_id)
JOIN benchmark b ON b.item_id = query_id WHERE rank = 1)"""


@query(f"""WITH {_QUOTES_SQL}, s AS (SELECT *, instr(text, quote) pos FROM q)
SELECT query_id, doc_id, CASE WHEN pos > 0 AND instr(substr(text, pos + 1), quote) = 0 THEN pos - 1 END span_start,
CASE WHEN pos > 0 AND instr(substr(text, pos + 1), quote) = 0 THEN pos - 1 + length(quote) END span_end FROM s""")
def unique_span_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _quotes(spark, folder).withColumn("span", citations.unique_span(F.col("text"), F.col("query")))
    return rows.select("query_id", "doc_id", F.col("span.span_start").cast("long").alias("span_start"), F.col("span.span_end").cast("long").alias("span_end"))


@query(f"""WITH {_QUOTES_SQL}, s AS (SELECT *, instr(text, quote) pos FROM q) SELECT CAST(query_id AS VARCHAR) answer_id, pos > 0 valid,
'' unknown_ids, '' uncited_claims, CASE WHEN pos > 0 THEN '' ELSE CAST(doc_id AS VARCHAR) END invalid_citations FROM s""")
def citation_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Provisional answers that quote an item from its first BM25 document at its first place there."""
    rows = _quotes(spark, folder).select(F.col("query_id").cast("string").alias("answer_id"), F.col("doc_id").cast("string").alias("evidence_id"),
                                         "text", F.col("query").alias("quote"), F.instr("text", F.col("query")).alias("at"))
    start = F.greatest(F.col("at") - 1, F.lit(0))
    answers = rows.select(
        "answer_id", F.lit("provisional").alias("state"), F.lit(None).cast("string").alias("legal_date"),
        F.lit(None).cast("string").alias("requested_legal_date"), F.trim("quote").alias("text"), F.lit("").alias("reason"), F.lit("").alias("unanswered"),
        F.array(F.struct(F.lit("C1").alias("claim_id"), F.col("quote").alias("text"), F.array("evidence_id").alias("evidence_ids"))).alias("claims"),
        F.array(F.struct("evidence_id", "quote", start.alias("span_start"), (start + F.length("quote")).alias("span_end"),
                         F.lit("v1").alias("document_version_id"))).alias("citations"))
    sources = rows.select(
        "answer_id", "evidence_id", F.col("text").alias("canonical_text"), F.lit("v1").alias("document_version_id"), F.lit(True).alias("provisional_snapshot_eligible"),
        F.lit(CENTRAL_SCOPE).alias("pham_vi"), F.lit(True).alias("retrieval_index_candidate"), F.lit("unverified").alias("current_validity"),
        F.lit("unknown_expiry").alias("expiry_state"), F.lit(False).alias("reported_status_conflict"), F.lit("r").alias("source_dataset_revision"),
        F.lit("h").alias("content_sha256"), F.lit(None).cast("string").alias("reviewed_status"), F.lit(None).cast("boolean").alias("central_eligible"),
        F.lit(None).cast("boolean").alias("reviewed_open_ended"), F.lit(None).cast("int").alias("effective_from_day"),
        F.lit(None).cast("int").alias("effective_to_day"), F.lit(None).cast("int").alias("reviewed_through_day"))
    checked = citations.validate(answers, sources)
    return checked.select("answer_id", "valid", *[F.array_join(c, "|").alias(c) for c in ("unknown_ids", "uncited_claims", "invalid_citations")])


@query("""SELECT CAST(event_id AS VARCHAR) trace_id, event_type stage, round(value, 2) duration_ms, sha256(props) query_sha256,
CASE WHEN event_type = 'error' THEN 'provider_error' END reason, CAST(json_extract(props, '$.k') AS BIGINT) total_tokens,
'm-' || user_id model_version FROM events""")
def redacted_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Events as raw trace rows; what is not allowed to be logged does not come out."""
    used = F.get_json_object("props", "$.k").cast("long")
    raw = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("stage"), F.lit("ok").alias("outcome"),
        F.round("value", 2).alias("duration_ms"), F.col("props").alias("query"),
        F.create_map(F.lit("model_version"), F.concat(F.lit("m-"), F.col("user_id").cast("string")), F.lit("secret"), F.col("props")).alias("provenance"),
        F.array(F.col("event_id").cast("string")).alias("evidence_ids"), F.create_map(F.lit("total_tokens"), used, F.lit("other"), used).alias("usage"),
        F.when(F.col("event_type") == "error", "provider_error").otherwise(F.col("event_type")).alias("reason"))
    return trace.redact(raw).select("trace_id", "stage", "duration_ms", "query_sha256", "reason", F.col("usage")["total_tokens"].alias("total_tokens"),
                                    F.col("provenance")["model_version"].alias("model_version"))


@query("""SELECT CAST(event_id AS VARCHAR) trace_id, event_type stage, epoch_us(ts) ts_us FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC LIMIT 100""")
def recent_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("trace_id"), F.col("event_type").alias("stage"),
                                                 F.unix_micros(F.to_timestamp("ts")).alias("ts_us"))
    return trace.recent(rows, "ts_us")


@query("""WITH c AS (SELECT p_partkey, p_size, p_brand identity FROM part), n AS (SELECT p_size number, identity, count(DISTINCT p_partkey) n, min(p_partkey) only_key FROM c GROUP BY ALL),
w AS (SELECT DISTINCT l_quantity::INT number FROM lineitem), f AS (SELECT number, sum(n) n, min(only_key) only_key FROM n GROUP BY number)
SELECT CAST(w.number AS VARCHAR) query_id, CASE WHEN coalesce(n, 0) = 1 THEN 'resolved' ELSE 'requested_article_not_unambiguous' END status,
CASE WHEN n = 1 THEN CAST(only_key AS VARCHAR) END article_id FROM w LEFT JOIN f USING (number)""")
def exact_article_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Articles asked for by number: parts as catalogue (size as number), quantities as requests."""
    catalog = table(spark, folder, "part").select(
        F.concat(F.lit("Điều "), F.col("p_size").cast("string")).alias("label"), F.col("p_name").alias("canonical_text"),
        F.lit(CENTRAL_SCOPE).alias("pham_vi"), F.lit(True).alias("retrieval_index_candidate"), F.array(F.lit("leave")).alias("topic_candidates"),
        F.col("p_brand").alias("title"), F.lit("").alias("so_ky_hieu"), F.col("p_partkey").cast("string").alias("article_id"),
        F.lit("v").alias("document_version_id"))
    asked = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("int").cast("string").alias("query_id")).distinct()
    questions = asked.withColumn("query", F.concat(F.lit("trích điều "), F.col("query_id")))
    return evidence.resolve_articles(questions, catalog).select("query_id", "status", "article_id")
