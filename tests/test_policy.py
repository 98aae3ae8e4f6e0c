import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import citations, evidence, intervals, policy, trace

DAY = 738886


def test_eligibility_boundaries(spark):
    schema = ("id int, pham_vi string, reviewed_status string, central_eligible boolean, effective_from_day int, effective_to_day int, "
              "reviewed_through_day int, reviewed_open_ended boolean, provision string")
    base = ("Trung ương", "reviewed", True)
    rows = [(0, *base, DAY, DAY + 1, DAY, False, "p"), (1, *base, DAY, DAY, DAY, False, "p"), (2, *base, DAY, None, DAY, True, "p"),
            (3, *base, DAY, DAY + 9, DAY, True, "p"), (4, *base, DAY + 1, DAY + 9, DAY, False, "p"), (5, *base, DAY, DAY + 9, DAY - 1, False, "p"),
            (6, *base, DAY, None, DAY, None, "p"), (7, "Tỉnh", "reviewed", True, DAY, DAY + 9, DAY, False, "p"),
            (8, *base, None, DAY + 9, DAY, False, "p"), (9, *base, DAY, DAY + 9, DAY, None, "q")]
    df = spark.createDataFrame(rows, schema)

    def ids(condition):
        return {r.id for r in df.where(condition).collect()}

    assert ids(policy.legal_eligibility(F.lit(DAY))) == ids(policy.legal_filter(F.lit(DAY))) == {0, 9}
    assert ids(policy.legal_eligibility(F.lit(DAY), include_open_ended=True)) == ids(policy.legal_filter(F.lit(DAY), include_open_ended=True)) == {0, 2, 9}
    assert ids(policy.legal_eligibility(F.lit(DAY), provision="q")) == ids(policy.legal_filter(F.lit(DAY), provision="q")) == {9}
    assert ids(policy.contradictory_open_end()) == {3}


EVIDENCE = ("query_id string, pham_vi string, retrieval_index_candidate boolean, current_validity string, expiry_state string, reported_status_conflict boolean, "
            "source_dataset_revision string, content_sha256 string, document_version_id string, canonical_text string, topic_candidates array<string>")


def good(query, conflict=False, **other):
    row = {"query_id": query, "pham_vi": "Trung ương", "retrieval_index_candidate": True, "current_validity": "unverified", "expiry_state": "unknown_expiry",
           "reported_status_conflict": conflict, "source_dataset_revision": "r", "content_sha256": "h", "document_version_id": "v", "canonical_text": "t",
           "topic_candidates": ["working_time"]}
    return tuple({**row, **other}.values())


def gate(spark, decide, cases):
    questions = spark.createDataFrame([(str(i), q, dated) for i, (q, dated, _) in enumerate(cases)], "query_id string, query string, dated boolean")
    rows = [good(str(i), **e) for i, (_, _, es) in enumerate(cases) for e in es]
    return [r for r in sorted(decide(questions, spark.createDataFrame(rows, EVIDENCE)).collect(), key=lambda r: int(r.query_id))]


def test_excerpt_gate(spark):
    one, torn = [{}], [{"conflict": True}]
    cases = [("Tôi làm thêm giờ", False, one), ("làm thêm giờ hiện nay", False, one), ("làm thêm giờ năm 2020", False, one),
             ("sửa đổi về làm thêm giờ", False, one), ("công chức làm thêm giờ", False, one), ("xin chào", False, one),
             ("làm thêm giờ và thử việc", False, one), ("làm thêm giờ", False, one), ("làm thêm giờ", True, one), ("làm thêm giờ hiện nay", False, torn),
             ("làm thêm giờ", False, torn), ("làm thêm giờ", False, []), ("thử việc", False, one), ("làm thêm giờ theo Điều 5", False, one),
             ("làm thêm giờ", False, [{}, {"pham_vi": "Tỉnh"}]), ("LÀM THÊM GIỜ", False, one)]
    rows = gate(spark, policy.decide_excerpt, cases)
    assert [r.reason for r in rows] == [
        "applicability_unverified", "validity_unverified", "requested_date_unverified", "amendments_unverified", "out_of_scope", "out_of_scope",
        "ambiguous_facts", "snapshot_excerpt_only", "requested_date_unverified", "conflicting_status", "snapshot_excerpt_only", "no_evidence",
        "evidence_not_provisional_eligible", "source_text_request_required", "evidence_not_provisional_eligible", "snapshot_excerpt_only"]
    assert rows[7].allowed and rows[7].caveat == policy.CAVEAT and policy.CONFLICT_CAVEAT in rows[10].caveat and rows[0].mode == "abstain"


def test_source_text_gate(spark):
    ask = "Điều 24 quy định gì về thử việc?"
    cases = [(ask, False, [{}]), (ask, False, []), (ask, True, [{}]), ("Điều 24 còn hiệu lực?", False, [{"conflict": True}]),
             (ask, False, [{"current_validity": "valid"}]), (ask, False, [{"retrieval_index_candidate": False}]), ("thử việc?", False, [{}]),
             ("what does article 3 say about leave?", False, [{}]), (" trích nguyên văn điều 5 của bộ luật lao động ", False, [{}])]
    assert [r.reason for r in gate(spark, policy.decide_source_text, cases)] == [
        "snapshot_text_only", "no_evidence", "requested_date_unverified", "conflicting_status", "evidence_not_provisional_eligible",
        "evidence_not_provisional_eligible", "source_text_request_required", "snapshot_text_only", "snapshot_text_only"]


def test_article_lookup_and_excerpts(spark):
    schema = ("article_id string, document_version_id string, label string, canonical_text string, title string, so_ky_hieu string, pham_vi string, "
              "retrieval_index_candidate boolean, topic_candidates array<string>, current_validity string, expiry_state string, reported_status_conflict boolean, "
              "source_dataset_revision string, content_sha256 string")
    tail = ("Trung ương", True, ["working_time"], "unverified", "unknown_expiry", False, "r", "h")
    catalog = spark.createDataFrame([("a", "v", "Điều 24", "x " * 2000, "Bộ luật Lao động", "45", *tail), ("b", "v", "Điều 24", "t", "Nghị định số 1", "1", *tail),
                                     ("c", "v", "Điều 7", "t", "Nghị định số 1", "1", *tail), ("d", "v", "Điều 8", "t", "x", "1", *tail),
                                     ("d", "v", "Điều 8", "u", "x", "1", *tail)], schema)
    ask = [("1", "trích điều 24"), ("2", "trích điều 24 của bộ luật lao động"), ("3", "trích Điều 7"), ("4", "điều 7 và điều 8"), ("5", "no number"), ("6", "trích điều 99")]
    questions = spark.createDataFrame([(*a, False) for a in ask], "query_id string, query string, dated boolean")
    rows = {r.query_id: (r.status, r.article_id) for r in evidence.resolve_articles(questions, catalog).collect()}
    assert rows == {"1": ("requested_article_not_unambiguous", None), "2": ("resolved", "a"), "3": ("resolved", "c"),
                    "4": ("requested_article_ambiguous", None), "6": ("requested_article_not_unambiguous", None)}
    hits = spark.createDataFrame([("q", "d", "v", 1), ("q", "a", "v", 2), ("q", "b", "v", 3)], "query_id string, article_id string, document_version_id string, rank int")
    topic = spark.createDataFrame([("q", "làm thêm giờ", False)], "query_id string, query string, dated boolean")
    picked = evidence.excerpt_evidence(topic, hits, catalog).orderBy("evidence_rank").collect()
    assert [r.evidence_id for r in picked] == ["a:v", "b:v"] and len(picked[0].excerpt) == 2399
    assert evidence.first_sources(evidence.excerpt_evidence(topic, hits, catalog), 1).count() == 1


ANSWER = ("answer_id string, state string, legal_date string, text string, reason string, unanswered string, requested_legal_date string, "
          "claims array<struct<claim_id:string,text:string,evidence_ids:array<string>>>, "
          "citations array<struct<evidence_id:string,quote:string,span_start:int,span_end:int,document_version_id:string>>")
SOURCE = ("answer_id string, evidence_id string, canonical_text string, document_version_id string, reviewed_status string, central_eligible boolean, "
          "effective_from_day int, effective_to_day int, reviewed_through_day int, reviewed_open_ended boolean, provisional_snapshot_eligible boolean, "
          "pham_vi string, retrieval_index_candidate boolean, current_validity string, expiry_state string, reported_status_conflict boolean, "
          "source_dataset_revision string, content_sha256 string")


@pytest.fixture(scope="module")
def contract(spark):
    claim, cite = ("C1", "quote", ["E1"]), ("E1", "quote", 2, 7, "v")
    day = "2024-01-01"
    answers = {
        "ok": ("answer", day, "quote", "", "", day, [claim], [cite]),
        "unknown": ("answer", day, "quote", "", "", day, [("C1", "quote", ["E1", "E9"])], [cite]),
        "empty": ("answer", day, "quote", "", "", day, [("C1", "quote", [])], []),
        "span": ("answer", day, "quote", "", "", day, [claim], [("E1", "quote", 1, 6, "v")]),
        "version": ("answer", day, "quote", "", "", day, [claim], [("E1", "quote", 2, 7, "w")]),
        "nodate": ("answer", None, "quote", "", "", None, [claim], [cite]),
        "late": ("answer", "2030-01-01", "quote", "", "", "2030-01-01", [claim], [cite]),
        "prov": ("provisional", None, "quote", "", "", None, [claim], [cite]),
        "provday": ("provisional", None, "quote", "", "", day, [claim], [cite]),
        "paraphrase": ("provisional", None, "other", "", "", None, [("C1", "other", ["E1"])], [cite]),
        "text": ("provisional", None, " ", "", "", None, [claim], [cite]),
        "state": ("odd", None, "", "", "", None, [], []), "noclaims": ("answer", day, "", "", "", day, [], []),
        "nullids": ("answer", day, "quote", "", "", day, [("C1", "quote", None)], [cite]),
        "partial": ("partial", day, "quote", "", " ", day, [claim], [cite]),
        "silent": ("clarify", None, "words", "", "", None, [], []), "quiet": ("unavailable", None, "", "r", "", None, [], [])}
    sources = [(k, "E1", "a quote b", "v", "reviewed", True, DAY - 5, DAY + 5, DAY + 9, False, True, "Trung ương", True, "unverified", "unknown_expiry", False, "r", "h")
               for k in answers]
    return (spark.createDataFrame([(k, *v) for k, v in answers.items()], ANSWER), spark.createDataFrame(sources, SOURCE))


def test_citation_contract(contract):
    rows = {r.answer_id: r for r in citations.validate(*contract).collect()}
    assert {k for k, r in rows.items() if r.valid} == {"ok", "prov", "quiet"}
    assert rows["unknown"].unknown_ids == ["E9"] and rows["empty"].uncited_claims == ["C1"]
    assert {k: rows[k].invalid_citations for k in ("span", "version", "late", "nodate", "provday", "paraphrase", "text", "state", "noclaims", "nullids", "partial", "silent")} == {
        "span": ["E1"], "version": ["E1"], "late": ["E1"], "nodate": ["requested_legal_date_required"], "provday": ["provisional_as_of_date_not_allowed"],
        "paraphrase": ["C1"], "text": ["unvalidated_text"], "state": ["invalid_state"], "noclaims": ["empty_claims"], "nullids": ["invalid_claim_schema"],
        "partial": ["partial_reason_required"], "silent": ["unvalidated_text", "non_answer_state_contains_claims"]}


def test_text_repair_and_unique_span(contract, values):
    rows = {r.answer_id: r for r in citations.repair_text(*contract).collect()}
    assert rows["text"].text == "quote" and rows["text"].text_repaired and rows["text"].valid and not rows["ok"].text_repaired
    spans = values(["a quote b", "quote quote", "none", "𝒜 quote", "aaa"], lambda c: citations.unique_span(c, F.lit("quote")))
    assert [s and (s.span_start, s.span_end) for s in spans] == [(2, 7), None, None, (2, 7), None]
    assert values(["aaa"], lambda c: citations.unique_span(c, F.lit("aa"))) == [None]


def test_states(values):
    assert values(["x"], lambda c: policy.answer_state(F.lit(True), F.lit(True), F.lit(False))) == ["clarify"]
    assert values(["x"], lambda c: policy.answer_state(F.lit(False), F.lit(True), F.lit(False))) == ["abstain_conflict"]
    assert values(["x"], lambda c: policy.answer_state(F.lit(False), F.lit(None), F.lit(False))) == ["abstain_insufficient_evidence"]
    assert values(["conflicting_status", "x"], policy.abstain_state) == ["abstain_conflict", "abstain_insufficient_evidence"]


def test_trace_rows_hold_nothing_private(spark):
    diagnostic = ("struct<phase:string,outcome:string,exception_class:string,reason_class:string,upstream_http_status:int,elapsed_ms:double,finish_reason:string,"
                  "response_shape:map<string,string>,usage:map<string,bigint>,validation_reason_codes:array<string>>")
    raw = spark.createDataFrame([(
        "t", "provider", "ok", 1.5, "secret question", {"model_version": "m", "key": "k"}, ["e", None], {"total_tokens": 3, "cost": 9}, "because",
        [("http_transport", "failed", "Bad Name", "Ok_1", 700, 1.239, "stop", {"content_length": "5", "a_type": "zzz", "x": "y"}, {"total_tokens": -1}, ["invalid_state", "zz"]),
         ("unknown", None, None, None, None, None, None, None, None, None)])],
        "trace_id string, stage string, outcome string, duration_ms double, query string, provenance map<string,string>, evidence_ids array<string>, "
        f"usage map<string,bigint>, reason string, diagnostics array<{diagnostic}>")
    row = trace.redact(raw).first()
    assert row.provenance == {"model_version": "m"} and row.usage == {"total_tokens": 3} and row.reason is None and row.evidence_ids == ["e"]
    assert "secret" not in str(row) and len(row.query_sha256) == 64 and len(row.diagnostics) == 1
    d = row.diagnostics[0]
    assert (d.exception_class, d.reason_class, d.upstream_http_status, d.elapsed_ms, d.usage) == (None, "Ok_1", None, 1.24, None)
    assert d.response_shape == {"content_length": "5", "a_type": "other"} and d.validation_reason_codes == ["invalid_state"]


def test_days_meet_the_intervals_that_hold_them(spark):
    rng = random.Random(6)
    days = [(i, rng.choice([None, 0, intervals.LAST_DAY, intervals.LAST_DAY + 1, -3, rng.randint(0, 200), rng.randint(729_000, 731_000)])) for i in range(80)]
    spans = [(i, *sorted((rng.randint(0, 200), rng.randint(0, 200)))) for i in range(60)] + [
        (60, 0, intervals.LAST_DAY), (61, -50, 7), (62, 9, 8), (63, None, 9), (64, 3, None), (65, 729_390, 9_999_999), (66, 5, 5), (67, 729_001, 730_999)]
    left = spark.createDataFrame(days, "q int, day int")
    right = spark.createDataFrame(spans, "e int, first int, last int")
    joined = intervals.containing(left, "day", right, "first", "last")
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()
    expected = sorted((q, e) for q, d in days for e, a, b in spans if None not in (d, a, b) and a <= d <= b and 0 <= d <= intervals.LAST_DAY)
    assert sorted((r.q, r.e) for r in joined.collect()) == expected
    blocks = right.select("e", F.size(intervals.interval_blocks(F.col("first"), F.col("last"))).alias("n")).collect()
    assert max(r.n for r in blocks if r.n is not None) <= 2 * intervals.LEVELS


def test_article_and_excerpt_decisions(spark):
    schema = ("article_id string, document_version_id string, label string, canonical_text string, title string, so_ky_hieu string, pham_vi string, "
              "retrieval_index_candidate boolean, topic_candidates array<string>, current_validity string, expiry_state string, reported_status_conflict boolean, "
              "source_dataset_revision string, content_sha256 string")

    def row(key, number, validity="unverified", conflict=False, text="t"):
        return (key, "v", f"Điều {number}", text, "Bộ luật", "1", "Trung ương", True, ["leave"], validity, "unknown_expiry", conflict, "r", "h")

    catalog = spark.createDataFrame([row("a", 1), row("b", 2, "verified"), row("c", 3), row("d", 3), row("e", 4), row("e", 4, "verified"), row("f", 5, text=" "),
                                     row("g", 6, conflict=True), row("h", 7, "verified", True)], schema)
    asked = {"1": "trích điều 1", "2": "trích điều 2", "3": "trích điều 3", "4": "trích điều 4", "5": "điều 1 và điều 2", "6": "điều 1 còn hiệu lực?", "9": "trích điều 9",
             "x": "no number", "n": None}
    questions = spark.createDataFrame([(k, q, False) for k, q in asked.items()] + [("d", "trích điều 1", True)], "query_id string, query string, dated boolean")
    got = {r.query_id: (r.reason, r.evidence_id) for r in evidence.decide_articles(questions, catalog).collect()}
    assert got == {"1": ("snapshot_text_only", "a:v"), "2": ("evidence_not_provisional_eligible", None), "3": ("requested_article_not_unambiguous", None),
                   "4": ("evidence_not_provisional_eligible", None), "5": ("source_text_request_required", None), "6": ("validity_unverified", None),
                   "9": ("requested_article_not_unambiguous", None), "d": ("requested_date_unverified", None)}
    hits = [("p", "b", 1), ("p", "a", 2), ("p", "g", 3), ("q", "f", 1), ("q", "e", 2), ("r", "h", 1), ("r", "b", 2), ("s", "zz", 1), ("t", "h", 1), ("t", "a", 2)]
    topic = spark.createDataFrame([(k, "nghỉ phép", False) for k in "pqrsu"] + [("t", "nghỉ phép hiện nay", False)], "query_id string, query string, dated boolean")
    found = spark.createDataFrame([(q, a, "v", k) for q, a, k in hits], "query_id string, article_id string, document_version_id string, rank int")
    decided = {r.query_id: (r.excerpts, r.conflict, r.reason) for r in evidence.decide_excerpts(topic, found, catalog).collect()}
    refused = "evidence_not_provisional_eligible"
    assert decided == {"p": (2, True, "snapshot_excerpt_only"), "q": (0, False, "no_evidence"), "r": (0, False, refused), "s": (0, False, "no_evidence"),
                       "t": (0, False, "conflicting_status"), "u": (0, False, "no_evidence")}
    assert evidence.decide_excerpts(topic, found, catalog, cap=1).where("query_id = 'p'").first().excerpts == 1


def test_only_the_text_is_repaired(contract):
    answers, sources = contract
    nulled = answers.where("answer_id = 'text'").withColumn("text", F.lit(None).cast("string"))
    assert not citations.repair_text(nulled, sources).first().text_repaired
    stated = answers.where("answer_id = 'ok'").withColumn("text", F.lit("other words"))
    assert not citations.repair_text(stated, sources).first().text_repaired
    assert citations.validate(*contract).where("answer_id = 'ok'").first().citation_ids == ["E1"]
