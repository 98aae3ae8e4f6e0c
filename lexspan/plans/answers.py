"""Answers, article requests, excerpts and provider errors: rows that meet every rule.

Documents stand for evidence, and each has an answer whose faults follow from its id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspan.functions import classify
from lexspan.functions.classify import CENTRAL_SCOPE
from lexspan.functions.vectors import is_valid_vector, l2_normalize, masked_mean
from lexspan.operators import citations, evidence, policy, trace
from lexspan.plans.policy import _QUESTIONS_SQL, _TOPICS_SQL, _matches, _questions
from lexspan.plans.registry import query
from lexspan.plans.tables import sql_collapse, spread, table

# Kinds of answers: the number of a document modulo KINDS.
(OK, UNKNOWN, NO_EVIDENCE, NOT_CITED, SHIFTED, OLD_VERSION, NOT_YET, PROVISIONAL, PARAPHRASE, DATED_PROVISIONAL, ODD_STATE, NO_TEXT, NO_CLAIMS, NO_REASON,
 OTHER_TEXT, LOUD, NO_DAY, TWO_DAYS, SAME_CLAIM, NO_VERSION, UNDATED, SILENT, PARTIAL, TWO_CLAIMS, NOT_CENTRAL, NO_CONFLICT_FLAG, BLANK_TEXT,
 OTHER_PROVISIONAL) = range(28)
KINDS = 28
STATES = {"provisional": (PROVISIONAL, PARAPHRASE, DATED_PROVISIONAL, NO_CONFLICT_FLAG, OTHER_PROVISIONAL), "maybe": (ODD_STATE,), "partial": (NO_REASON, PARTIAL),
          "abstain_conflict": (LOUD,), "unavailable": (SILENT,)}
START, END, THROUGH = 729_390, 730_120, 730_485  # 1998-01-01, 2000-01-01, 2000-12-31
_EVIDENCE_TYPE = "array<struct<claim_id:string,text:string,evidence_ids:array<string>>>"
_CITATION_TYPE = "array<struct<evidence_id:string,quote:string,span_start:int,span_end:int,document_version_id:string>>"


def _answers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Answers that quote the first line of a document, and the documents as evidence."""
    rows = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").cast("string").alias("answer_id"), F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"),
        F.pmod("doc_id", F.lit(KINDS)).alias("kind"), F.col("text").alias("body"), F.substring_index("text", "\n", 1).alias("line"))
    kind, line, own = F.col("kind"), F.col("line"), F.array("evidence_id")

    def by(values: dict, default) -> Column:
        chain = None
        for kinds, value in values.items():
            chain = (F.when if chain is None else chain.when)(kind.isin(*(kinds if isinstance(kinds, tuple) else (kinds,))), value)
        return chain.otherwise(default)

    def claim(name: str, text: Column, ids: Column) -> Column:
        return F.struct(F.lit(name).alias("claim_id"), text.alias("text"), ids.alias("evidence_ids"))

    none = F.lit(None).cast("string")
    claims = by({(NO_CLAIMS, SILENT): F.array().cast(_EVIDENCE_TYPE), UNKNOWN: F.array(claim("C1", line, F.array(F.concat(F.lit("x"), "evidence_id")))),
                 NO_EVIDENCE: F.array(claim("C1", line, F.array().cast("array<string>"))), PARAPHRASE: F.array(claim("C1", F.concat(line, F.lit(" more")), own)),
                 SAME_CLAIM: F.array(claim("C1", line, own), claim("C1", line, own)),
                 TWO_CLAIMS: F.array(claim("C1", line, own), claim("C2", line, own))}, F.array(claim("C1", line, own)))
    start = by({SHIFTED: F.lit(1)}, F.lit(0))
    version = by({OLD_VERSION: F.lit("v0"), NO_VERSION: none}, F.lit("v1"))
    cited = F.array(F.struct("evidence_id", line.alias("quote"), start.alias("span_start"), (start + F.length(line)).alias("span_end"), version.alias("document_version_id")))
    state = by({kinds: F.lit(name) for name, kinds in STATES.items()}, F.lit("answer"))
    answers = rows.select(
        "answer_id", state.alias("state"), by({TWO_DAYS: F.lit("1999-01-01"), OK: F.lit("1998-06-01")}, none).alias("legal_date"),
        by({NOT_YET: F.lit("1990-01-01"), NO_DAY: F.lit("2020-13-40"), (PROVISIONAL, PARAPHRASE, NO_CONFLICT_FLAG, OTHER_PROVISIONAL, UNDATED, LOUD, SILENT): none},
           F.lit("1998-06-01")).alias("requested_legal_date"),
        by({NO_TEXT: none, (OTHER_TEXT, OTHER_PROVISIONAL): F.concat(line, F.lit("!")), (NO_CLAIMS, SILENT): F.lit(""), BLANK_TEXT: F.lit(" \n"),
            PARAPHRASE: F.concat(line, F.lit(" more")), TWO_CLAIMS: F.concat(F.trim(line), F.lit(" "), F.trim(line))}, F.concat(F.lit(" "), line)).alias("text"),
        by({PARTIAL: F.lit("the rest")}, F.lit(" ")).alias("reason"), F.lit("").alias("unanswered"), claims.alias("claims"),
        by({(NOT_CITED, NO_CLAIMS, SILENT): F.array().cast(_CITATION_TYPE)}, cited).alias("citations"))
    sources = rows.select(
        "answer_id", "evidence_id", F.col("body").alias("canonical_text"), F.lit("v1").alias("document_version_id"), F.lit(True).alias("provisional_snapshot_eligible"),
        F.lit(CENTRAL_SCOPE).alias("pham_vi"), F.lit(True).alias("retrieval_index_candidate"), F.lit("unverified").alias("current_validity"),
        F.lit("unknown_expiry").alias("expiry_state"), by({NO_CONFLICT_FLAG: F.lit(None).cast("boolean")}, F.lit(False)).alias("reported_status_conflict"),
        F.lit("r").alias("source_dataset_revision"), F.lit("h").alias("content_sha256"), F.lit("reviewed").alias("reviewed_status"),
        (kind != NOT_CENTRAL).alias("central_eligible"), F.lit(False).alias("reviewed_open_ended"), F.lit(START).alias("effective_from_day"),
        F.lit(END).alias("effective_to_day"), F.lit(THROUGH).alias("reviewed_through_day"))
    return answers, sources


_ANSWERS_SQL = f"""a AS (SELECT CAST(doc_id AS VARCHAR) answer_id, 'e' || doc_id e, doc_id % {KINDS} kind, split_part(text, chr(10), 1) line, text body FROM documents),
f AS (SELECT *, CASE WHEN kind = {ODD_STATE} THEN 'invalid_state' WHEN kind = {NO_TEXT} THEN 'invalid_schema' WHEN kind = {NO_CLAIMS} THEN 'empty_claims'
  WHEN kind <> {SILENT} AND ({sql_collapse('line')} = '' AND kind <> {PARAPHRASE} OR kind = {SAME_CLAIM}) THEN 'invalid_claim_schema'
  WHEN kind = {NO_VERSION} THEN 'invalid_citation_schema' WHEN kind = {NO_REASON} THEN 'partial_reason_required' END form FROM a WHERE body IS NOT NULL),
c AS (SELECT *, CASE WHEN form IS NOT NULL OR kind IN ({NOT_CITED}, {SILENT}) THEN '' ELSE e END citation_ids,
  CASE WHEN form IS NULL AND kind = {UNKNOWN} THEN 'x' || e ELSE '' END unknown_ids,
  CASE WHEN form IS NULL AND kind IN ({NO_EVIDENCE}, {NOT_CITED}) THEN 'C1' ELSE '' END uncited_claims,
  coalesce(form, array_to_string(list_filter([
    CASE WHEN kind = {NO_DAY} THEN 'invalid_legal_date' END, CASE WHEN kind IN ({NO_DAY}, {UNDATED}) THEN 'requested_legal_date_required' END,
    CASE WHEN kind = {DATED_PROVISIONAL} THEN 'provisional_as_of_date_not_allowed' END, CASE WHEN kind = {TWO_DAYS} THEN 'contradictory_legal_date' END,
    CASE WHEN kind IN ({OLD_VERSION}, {NOT_YET}, {NOT_CENTRAL}, {NO_CONFLICT_FLAG}) OR (kind = {SHIFTED} AND substr(body, 2, length(line)) <> line)
      OR (kind <> {SILENT} AND kind <> {NOT_CITED} AND line = '') THEN e END,
    CASE WHEN kind = {PARAPHRASE} THEN 'C1' END, CASE WHEN kind IN ({OTHER_TEXT}, {OTHER_PROVISIONAL}, {BLANK_TEXT}) THEN 'unvalidated_text' END,
    CASE WHEN kind = {LOUD} THEN 'non_answer_state_contains_claims' END], lambda x: x IS NOT NULL), '|')) invalid_citations FROM f)"""


@query(f"""WITH {_ANSWERS_SQL} SELECT answer_id, unknown_ids = '' AND uncited_claims = '' AND invalid_citations = '' valid, citation_ids, unknown_ids, uncited_claims,
invalid_citations FROM c""")
def answer_contract(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's answer against the contract, all its rules met by some answer."""
    answers, sources = _answers(spark, folder)
    checked = citations.validate(answers.where("answer_id IS NOT NULL"), sources.where("canonical_text IS NOT NULL"))
    lists = ("citation_ids", "unknown_ids", "uncited_claims", "invalid_citations")
    return checked.select("answer_id", "valid", *[F.array_join(c, "|").alias(c) for c in lists])


@query(f"""WITH {_ANSWERS_SQL}, r AS (SELECT *, invalid_citations = 'unvalidated_text' AND kind IN ({OTHER_PROVISIONAL}, {BLANK_TEXT}) repaired,
unknown_ids = '' AND uncited_claims = '' AND invalid_citations = '' sound FROM c)
SELECT answer_id, repaired text_repaired, sound OR repaired valid, CASE WHEN repaired THEN {sql_collapse('line')} END repaired_text FROM r""")
def repaired_answers(spark: SparkSession, folder: str) -> DataFrame:
    rows = citations.repair_text(*_answers(spark, folder))
    shown = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    return rows.select("answer_id", "text_repaired", "valid", F.when(F.col("text_repaired"), shown).alias("repaired_text"))


# Parts as a catalogue of articles: numbers divisible by three belong to the next part's
# number, so two in three numbers occur, every second of those in two documents.
REQUESTS = ("Điều {k} quy định gì?", "điều {k} nói gì trong Bộ luật Lao động", "Điều {k} hiện nay quy định gì?", "Nội dung của Điều {k} là gì",
            "Điều {k} sửa đổi", "Điều {k}, xin hỏi", "Nội dung điều {k}")
DATED_REQUEST = 3


@query(f"""WITH cat AS (SELECT p_partkey, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END number, p_partkey % 3 <> 0 code, p_partkey % 13 <> 0 unverified
  FROM part WHERE p_partkey % 7 <> 0 AND p_size > 3 AND p_partkey % 11 <> 0),
n AS (SELECT number, count(*) FILTER (WHERE code) codes, count(*) every, min(p_partkey) FILTER (WHERE code) code_key, min(p_partkey) any_key FROM cat GROUP BY number),
q AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % {len(REQUESTS)} AS INT) kind FROM orders),
l AS (SELECT q.*, CASE WHEN kind = 1 THEN codes ELSE every END hits, CASE WHEN kind = 1 THEN code_key ELSE any_key END found FROM q LEFT JOIN n ON number = o_custkey),
d AS (SELECT l.*, CASE WHEN kind = 2 THEN 'validity_unverified' WHEN kind = {DATED_REQUEST} THEN 'requested_date_unverified' WHEN kind = 4 THEN 'amendments_unverified'
  WHEN kind = 5 THEN 'source_text_request_required' WHEN coalesce(hits, 0) <> 1 THEN 'requested_article_not_unambiguous'
  WHEN NOT unverified THEN 'evidence_not_provisional_eligible' ELSE 'snapshot_text_only' END reason FROM l LEFT JOIN cat ON p_partkey = found)
SELECT CAST(o_orderkey AS VARCHAR) query_id, reason, reason = 'snapshot_text_only' allowed, CASE WHEN reason = 'snapshot_text_only' THEN found || ':v1' END evidence_id FROM d""")
def article_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as requests for an article by number, with the gates before and after the lookup."""
    key = F.col("p_partkey")
    catalog = table(spark, folder, "part").select(
        F.concat(F.lit("Điều "), (key + F.when(key % 3 == 0, 1).otherwise(0)).cast("string"), F.lit(". "), "p_name").alias("label"),
        F.col("p_name").alias("canonical_text"), F.when(key % 7 == 0, "Tỉnh").otherwise(CENTRAL_SCOPE).alias("pham_vi"),
        (F.col("p_size") > 3).alias("retrieval_index_candidate"), F.when(key % 11 != 0, F.array(F.lit("leave"))).alias("topic_candidates"),
        F.when(key % 3 == 0, "Nghị định").otherwise("Bộ luật LAO ĐỘNG").alias("title"), F.col("p_brand").alias("so_ky_hieu"), key.cast("string").alias("article_id"),
        F.lit("v1").alias("document_version_id"), F.when(key % 13 == 0, "verified").otherwise("unverified").alias("current_validity"),
        F.lit("unknown_expiry").alias("expiry_state"), (key % 5 == 0).alias("reported_status_conflict"), F.lit("r").alias("source_dataset_revision"),
        F.lit("h").alias("content_sha256"))
    number = F.pmod("o_orderkey", F.lit(len(REQUESTS))).cast("int")
    asked = F.replace(F.element_at(F.array(*[F.lit(r) for r in REQUESTS]), number + 1), F.lit("{k}"), F.col("o_custkey").cast("string"))
    questions = table(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("query_id"), asked.alias("query"), (number == DATED_REQUEST).alias("dated"))
    return evidence.decide_articles(questions, catalog)


def _gate_sql(torn: str, empty: str, ok: str) -> str:
    return f"""CASE WHEN {_matches(policy.VALIDITY_QUERY)} THEN CASE WHEN {torn} THEN 'conflicting_status' ELSE 'validity_unverified' END
WHEN {_matches(policy.AS_OF_QUERY)} THEN CASE WHEN {torn} THEN 'conflicting_status' ELSE 'requested_date_unverified' END
WHEN {_matches(policy.AMENDMENT_QUERY)} THEN 'amendments_unverified' WHEN {_matches(policy.OUT_OF_SCOPE_QUERY)} THEN 'out_of_scope'
WHEN {_matches(policy.ARTICLE_REFERENCE)} THEN 'source_text_request_required'
WHEN {_matches(policy.PERSONAL_QUERY)} OR {_matches(policy.APPLICABILITY_QUERY)} THEN 'applicability_unverified'
WHEN len(topics) > 1 THEN 'ambiguous_facts' WHEN len(topics) = 0 THEN 'out_of_scope' WHEN {empty} THEN 'no_evidence'
WHEN NOT {ok} THEN 'evidence_not_provisional_eligible' ELSE 'snapshot_excerpt_only' END"""


_HIT_TOPICS = "CASE doc_id % 3 WHEN 0 THEN ['probation', 'working_time'] WHEN 1 THEN ['contracts', 'leave'] ELSE ['probation', 'leave'] END"
_HIT_OK = f"(doc_id % 4 <> 0 AND list_contains({_HIT_TOPICS}, topics[1]))"


@query(f"""WITH {_QUESTIONS_SQL}, t AS (SELECT conv_id || ':' || turn query_id, conv_id, q, {_TOPICS_SQL} topics FROM qs),
h AS (SELECT query_id, doc_id, doc_id - conv_id rank, doc_id % 5 = 0 torn, {_gate_sql('doc_id % 5 = 0', 'FALSE', _HIT_OK)} gate
  FROM t JOIN documents ON doc_id > conv_id AND doc_id <= conv_id + 3 WHERE conv_id % 7 <> 6 AND doc_id % 9 <> 8 AND {sql_collapse("coalesce(text, '')")} <> ''),
g AS (SELECT query_id, count(*) FILTER (WHERE gate = 'snapshot_excerpt_only') excerpts, bool_or(torn) FILTER (WHERE gate = 'snapshot_excerpt_only') torn,
  arg_min(gate, rank) FILTER (WHERE gate <> 'snapshot_excerpt_only') denial FROM h GROUP BY query_id)
SELECT query_id, coalesce(excerpts, 0) excerpts, coalesce(g.torn, FALSE) conflict,
CASE WHEN excerpts > 0 THEN 'snapshot_excerpt_only' ELSE coalesce(denial, {_gate_sql('FALSE', 'TRUE', 'TRUE')}) END reason FROM t LEFT JOIN g USING (query_id)""")
def excerpt_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as questions whose hits are the three documents after the conversation's number;
    one document in nine stands in the catalogue twice, so no hit may use it."""
    questions = _questions(spark, folder)
    doc = F.col("doc_id")
    topics = F.when(doc % 3 == 0, F.array(F.lit("probation"), F.lit("working_time"))).when(doc % 3 == 1, F.array(F.lit("contracts"), F.lit("leave"))).otherwise(
        F.array(F.lit("probation"), F.lit("leave")))
    catalog = table(spark, folder, "documents").withColumn("copy", F.explode(F.when(doc % 9 == 8, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select(
        doc.cast("string").alias("article_id"), F.lit("v1").alias("document_version_id"), F.col("text").alias("canonical_text"), F.lit(CENTRAL_SCOPE).alias("pham_vi"),
        F.lit(True).alias("retrieval_index_candidate"), F.when(doc % 4 == 0, "verified").otherwise("unverified").alias("current_validity"),
        F.lit("unknown_expiry").alias("expiry_state"), (doc % 5 == 0).alias("reported_status_conflict"), F.lit("r").alias("source_dataset_revision"),
        F.lit("h").alias("content_sha256"), topics.alias("topic_candidates"))
    hits = questions.where("conv_id % 7 <> 6").select("query_id", "conv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select(
        "query_id", (F.col("conv_id") + F.col("rank")).cast("string").alias("article_id"), F.lit("v1").alias("document_version_id"), "rank")
    return evidence.decide_excerpts(questions, hits, catalog).select("query_id", "excerpts", "conflict", "reason")


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity > 1 AND l_discount < 0.10 AND l_tax > 0.0 AND l_returnflag <> 'A' ok FROM lineitem)
SELECT l_orderkey query_id, l_partkey || ':v' || l_linenumber evidence_id FROM h WHERE l_orderkey IN (SELECT l_orderkey FROM h GROUP BY 1 HAVING bool_and(ok))""")
def reviewed_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as reviewed evidence of their order: one that fails empties the whole set."""
    version = F.concat(F.lit("v"), F.col("l_linenumber").cast("string"))
    hits = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").cast("string").alias("article_id"), version.alias("document_version_id"),
        F.when(F.col("l_quantity") > 1, F.lit("text")).otherwise(" ").alias("canonical_text"),
        F.when(F.col("l_discount") < 0.10, version).otherwise("v0").alias("reviewed_version_id"), (F.col("l_tax") <= 0.0).alias("reviewed_open_ended"),
        F.lit(CENTRAL_SCOPE).alias("pham_vi"), F.lit("reviewed").alias("reviewed_status"), F.lit(True).alias("central_eligible"), F.lit(START).alias("effective_from_day"),
        F.when(F.col("l_returnflag") == "A", F.lit(START + 10)).otherwise(F.lit(END)).alias("effective_to_day"), F.lit(THROUGH).alias("reviewed_through_day"))
    return evidence.configured_evidence(hits, F.lit(START + 10)).select("query_id", "evidence_id")


# Bodies of refused calls; {k} is the event's own number.
ERROR_BODIES = tuple(json.dumps(b, ensure_ascii=False) for b in (
    {"error": {"type": "Invalid_Request_Error", "code": "json_validate_failed", "param": "messages", "message": "call {k}", "failed_generation": "{\"k\": {k}}"}},
    {"error": {"type": "invalid_request_error", "code": "no such code {k}", "param": "Max_Tokens", "failed_generation": "{\"k\": {k}"}},
    {"error": {"type": 7, "message": "Authentication failed for {k}", "failed_generation": {"k": 1}}},
    {"error": {"type": "rate_limit_error", "message": None}}, {"error": {"message": "The model {k} is unavailable"}}, {"error": {"message": "bad JSON schema {k}"}},
    {"error": "text {k}"}, {"other": 1}, {"error": {"code": "context_length_exceeded", "message": "too long"}})) + ("not JSON {k}",)
_ERROR_SQL = f"""b AS (SELECT event_id, replace([{', '.join("'" + b + "'" for b in ERROR_BODIES)}][event_id % {len(ERROR_BODIES)} + 1], '{{k}}', CAST(event_id AS VARCHAR)) body FROM events),
j AS (SELECT event_id, json_extract(body, '$.error') err FROM b WHERE json_valid(body)),
v AS (SELECT event_id, err, json_type(err, '$.failed_generation') made, json_extract_string(err, '$.failed_generation') output, {', '.join(
    f"CASE WHEN json_type(err, '$.{k}') = 'VARCHAR' THEN lower(json_extract_string(err, '$.{k}')) END {n}" for k, n in (("type", "kind"), ("code", "code"), ("param", "param"), ("message", "said")))}
  FROM j WHERE json_type(err) = 'OBJECT'),
s AS (SELECT *, CASE WHEN said IS NULL THEN NULL {' '.join(
    'WHEN ' + (" OR ".join(f"contains(said, '{w}')" for w in r["words"]) if "words" in r else "contains(said, 'model') AND (" + " OR ".join(f"contains(said, '{w}')" for w in r["model_words"]) + ")")
    + f" THEN '{n}'" for n, r in classify.UPSTREAM_CLASSES.items())} ELSE 'other' END named FROM v)"""


def _told(kind: str) -> str:
    column = {"type": "kind"}.get(kind, kind)
    return f"CASE WHEN {column} IN ({', '.join(repr(v) for v in dict.fromkeys(classify.upstream_values(kind)))}) THEN {column} ELSE 'other' END"


@query(f"""WITH {_ERROR_SQL} SELECT CAST(event_id AS VARCHAR) trace_id, {_told('type')} upstream_error_type, {_told('code')} upstream_error_code, {_told('param')} upstream_error_param,
CASE {' '.join('WHEN ' + " OR ".join([f"named = '{n}'"] + [f"coalesce({dict(type='kind').get(k, k)} IN ({', '.join(repr(x) for x in r[k])}), FALSE)" for k in ('type', 'code', 'param') if k in r])
    + f" THEN '{n}'" for n, r in classify.UPSTREAM_CLASSES.items())} ELSE 'other' END upstream_error_classification,
named upstream_error_message_classification, made IS NOT NULL failed_generation_present, CASE WHEN made = 'VARCHAR' THEN length(output) END failed_generation_length_chars,
CASE WHEN made IS NULL THEN 'absent' WHEN made <> 'VARCHAR' THEN 'not_string' WHEN json_valid(output) THEN 'valid' ELSE 'invalid' END failed_generation_json_verdict,
CASE WHEN event_id % 3 > 0 THEN event_id % 3 - 1 END invalid_citation_count FROM s""")
def upstream_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Events as refused provider calls: what the trace may tell of them."""
    number = F.col("event_id")
    body = F.replace(F.element_at(F.array(*[F.lit(b) for b in ERROR_BODIES]), (number % len(ERROR_BODIES) + 1).cast("int")), F.lit("{k}"), number.cast("string"))
    rows = table(spark, folder, "events").select(number.cast("string").alias("trace_id"), (number % 3 - 1).alias("counted"), classify.upstream_error(body).alias("e")).where("e IS NOT NULL")
    names = [n for n in trace.FURTHER_FIELDS if n.startswith(("upstream_error_", "failed_generation_"))]
    none = F.lit(None).cast("string")
    diagnostic = F.struct(
        F.lit("http_transport").alias("phase"), F.lit("failed").alias("outcome"), F.lit("HTTPError").alias("exception_class"), F.lit(400).alias("upstream_http_status"),
        F.lit(1.0).alias("elapsed_ms"), none.alias("finish_reason"), none.alias("reason_class"), F.lit(None).cast("map<string,string>").alias("response_shape"),
        F.lit(None).cast("map<string,bigint>").alias("usage"), F.lit(None).cast("array<string>").alias("validation_reason_codes"),
        *[F.col(f"e.{n}").alias(n) for n in names], F.col("counted").alias("invalid_citation_count"))
    raw = rows.select(
        "trace_id", F.lit("provider").alias("stage"), F.lit("failed").alias("outcome"), F.lit(1.0).alias("duration_ms"), none.alias("query"),
        F.lit(None).cast("map<string,string>").alias("provenance"), F.lit(None).cast("array<string>").alias("evidence_ids"),
        F.lit(None).cast("map<string,bigint>").alias("usage"), F.lit("provider_error").alias("reason"), F.array(diagnostic).alias("diagnostics"))
    told = trace.redact(raw).select("trace_id", F.get("diagnostics", F.lit(0)).alias("d"))
    return told.select("trace_id", *[F.col(f"d.{n}").alias(n) for n in names], F.col("d.invalid_citation_count").alias("invalid_citation_count"))


@query("""WITH e AS (SELECT vec_id, vec_id % 7 kind, CAST(embedding AS DOUBLE[]) v FROM embeddings),
n AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-12) length FROM e)
SELECT vec_id, kind NOT IN (1, 2, 3, 4, 5) valid, round(list_sum(list_transform(v, lambda x: x / length)), 6) normal_sum,
round(list_sum(list_transform(v, lambda x: x * CASE WHEN vec_id % 3 = 0 THEN -0.5 WHEN vec_id % 3 = 1 THEN 1 ELSE 0 END)), 6) mean_sum FROM n""")
def vector_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a NaN, an infinity, a gap, another length or no place are invalid; the
    normalised vector and the masked mean of three states (v, -2v, 3v) by their sums."""
    kind, v = F.col("vec_id") % 7, F.col("embedding").cast("array<double>")
    put = lambda value: F.concat(F.slice(v, 1, 63), F.array(F.lit(value).cast("double")))
    shaped = (F.when(kind == 1, put(float("nan"))).when(kind == 2, put(float("inf"))).when(kind == 3, put(None)).when(kind == 4, F.slice(v, 1, 63))
              .when(kind == 5, F.array().cast("array<double>")).otherwise(v))
    states = F.array(v, F.transform(v, lambda x: x * -2), F.transform(v, lambda x: x * 3))
    mask = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit(1), F.lit(1), F.lit(0))).when(F.col("vec_id") % 3 == 1, F.array(F.lit(1), F.lit(0), F.lit(0))).otherwise(
        F.array(F.lit(0), F.lit(0), F.lit(0)))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    return table(spark, folder, "embeddings").select(
        "vec_id", is_valid_vector(shaped, 64).alias("valid"), total(l2_normalize(v)).alias("normal_sum"), total(masked_mean(states, mask)).alias("mean_sum"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 1 THEN 'ftp' || substr(url, instr(url, '://')) WHEN 2 THEN replace(url, '://', '://user:word@')
WHEN 3 THEN replace(url, '://', ':///') WHEN 4 THEN upper(split_part(url, ':', 1)) || substr(url, instr(url, ':')) ELSE url END shown, page_id % 6 NOT IN (1, 2, 3) ok,
md5(url) spec, page_id % 5 = 0 odd FROM pages)
SELECT page_id, CASE WHEN ok THEN shown END url, CASE WHEN NOT odd THEN 'lexspan_r' || page_id || '_' || substr(spec, 1, 12) END collection FROM u""")
def shown_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that may be shown, and names of collections by revision (one in five has a slash)."""
    kind, url = F.col("page_id") % 6, F.col("url")
    scheme, rest = F.substring_index("url", ":", 1), F.expr("substr(url, instr(url, ':'))")
    changed = (F.when(kind == 1, F.concat(F.lit("ftp"), rest)).when(kind == 2, F.replace(url, F.lit("://"), F.lit("://user:word@")))
               .when(kind == 3, F.replace(url, F.lit("://"), F.lit(":///"))).when(kind == 4, F.concat(F.upper(scheme), rest)).otherwise(url))
    revision = F.concat(F.when(F.col("page_id") % 5 == 0, "a/").otherwise("r"), F.col("page_id").cast("string"))
    return table(spark, folder, "pages").select(
        "page_id", classify.safe_url(changed).alias("url"), classify.collection_name("lexspan", revision, F.md5("url")).alias("collection"))
