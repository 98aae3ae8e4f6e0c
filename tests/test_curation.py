from pyspark.sql import functions as F

from lexspan.functions.classify import employment_reasons
from lexspan.operators import curation, evaluation, staging
from lexspan.operators.audit import latest_rows

DECIDED = ("id string, primary_reason string, scope_reason string, content_state string, visible_characters long, issuer_signal string, flags array<string>")


def test_core_gate(spark):
    good = ("include_for_employment_review", "central_exact", "present", 9, "central_issuer_signal", [])
    twin = "duplicate_bibliographic_identity"
    rows = [("ok", *good), ("local", good[0], "exclude_local_scope", *good[2:]), ("empty", *good[:3], 0, *good[4:]), ("issuer", *good[:4], "local_issuer_signal", []),
            ("flag", *good[:5], ["x"]), ("other", "quarantine_x", *good[1:]), ("twin", "quarantine_" + twin, *good[1:5], [twin])]
    df = spark.createDataFrame(rows, DECIDED)
    assert {r.id: r.reason for r in curation.core_gate(df).collect()} == {
        "ok": None, "local": "not central", "empty": "content quality", "issuer": "issuer conflict", "flag": "unresolved audit flags",
        "other": "audit disposition", "twin": "unresolved audit flags"}
    assert {r.id: r.reason for r in curation.core_gate(df, duplicate=True).collect()}["twin"] is None


def test_pairs_staging_and_topics(spark):
    meta = spark.createDataFrame([("1", "45", "a", "x"), ("2", "45", "b", "x")], "id string, number string, kind string, status string")
    assert curation.pair_differences(meta, "1", "2", ["number"], ["kind"]).first().differences == []
    assert curation.pair_differences(meta, "1", "2", ["number", "kind"], ["status"]).first().differences == ["kind", "status"]
    docs = spark.createDataFrame([("1", "<p>QUỐC HỘI</p>")], "id string, content_html string")
    assert docs.select(curation.content_marker(F.col("content_html"), "Quốc hội")).first()[0]
    staged = docs.select(F.col("id").alias("document_id"), F.sha2("content_html", 256).alias("content_sha256"), F.lit("a").alias("article_id"))
    assert curation.staged_violations(staged, docs).count() == 0
    assert curation.staged_violations(staged.withColumn("content_sha256", F.lit("x")), docs).count() == 1
    articles = spark.createDataFrame([("1", "Điều 1", "Thử việc"), ("1", "Điều 2", "khác"), ("1", "Điều 3", "khác"), ("9", "Điều 1", "Thử việc")],
                                     "document_id string, label string, heading string")
    curated = curation.curate(articles, docs.select("id", F.lit("t").alias("title")), {"1": ("Điều 2",)})
    assert {r.label: r.index_disposition for r in curated.collect()} == {"Điều 1": "in_scope_topic", "Điều 2": "explicit_dependency", "Điều 3": "out_of_scope"}
    assert [(r.topic, r.label) for r in curation.topic_labels(curated).collect()] == [("probation", "Điều 1")]


def test_worksheet_preview(spark):
    priority = spark.createDataFrame([("1", "employment_seed"), ("2", "employment_seed"), ("3", "dangling_dependency")], "id string, stage_role string")
    articles = spark.createDataFrame([("1", f"a{i}", f"Điều {i}", i, i + 1, "Thử VIỆC") for i in range(5)] + [("2", "b", "Điều 1", 0, 1, "khác")],
                                     "document_id string, article_id string, label string, source_start int, source_end int, canonical_text string")
    rows = {r.dataset_id: r for r in staging.review_worksheet(priority, articles).collect()}
    assert rows["1"].article_candidate_count == 5 and rows["1"].article_candidates_preview.endswith("| +2 additional candidates")
    assert rows["1"].article_candidates_preview.startswith("Điều 0 [a0] offsets 0:1 | ") and rows["2"].article_candidates_preview.startswith("none derived")
    assert set(rows) == {"1", "2"}


def test_reviewed_cases(spark):
    schema = ("case_id string, scenario_family_id string, family string, query string, legal_date string, reference_status string, expected_answer_state string, "
              "relevant_article_ids array<string>, references array<struct<source_locator:string,document_version_id:string,article_id:string,quote:string,"
              "span_start:int,span_end:int,applicable_on_requested_date:boolean>>")
    ref = ("loc", "v", "a", "q", 0, 1, True)
    rows = [("ok", "f", "f", "q", "2024-01-01", "reviewed", "answer", ["a"], [ref]), ("date", "f", "f", "q", "x", "reviewed", "answer", ["a"], [ref]),
            ("draft", "f", "f", "q", "2024-01-01", "draft", "answer", ["a"], [ref]), ("none", "f", "f", "q", "2024-01-01", "reviewed", "answer", [], []),
            ("span", "f", "f", "q", "2024-01-01", "reviewed", "answer", ["a"], [(*ref[:4], 3, 1, True)]),
            ("more", "f", "g", "q", "2024-01-01", "reviewed", "partial", ["a", "b"], [ref]), ("abstain", "f", "f", "q", "2024-01-01", "reviewed", "clarify", [], [])]
    cases = spark.createDataFrame(rows, schema)
    assert {r.case_id: r.reason for r in evaluation.reviewed_case_errors(cases).collect()} == {
        "date": "legal_date", "draft": "schema", "none": "answerable_without_reference", "span": "incomplete_reference",
        "more": "relevant_article_without_reference"}
    ready = evaluation.readiness(cases.where("case_id IN ('ok', 'abstain')")).first()
    assert (ready.cases, ready.families, ready.ready_for_measurement) == (2, 1, True)
    assert not evaluation.readiness(cases).first().ready_for_measurement


def test_titles_are_folded_once_and_latest_rows_leave_out_what_is_not_read(spark, tmp_path, capsys):
    titles = ["Hợp đồng lao động và THỬ VIỆC", "Hợp đồng thuê", None, "Bộ Luật Lao Động, hợp đồng"]
    spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(titles)], "id int, row_index int, title string").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")

    def plan(df):
        df.explain(True)
        return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]

    found = rows.select("row_index", employment_reasons("title", F.lit(None).cast("string"), F.lit("Lao động")).alias("why"))
    assert plan(found).split("== Physical Plan ==")[0].count("coalesce(title#") == 1
    assert {r.row_index: r.why for r in found.collect()} == {
        0: ["hợp đồng lao động", "labor_context_for_contract", "thử việc"], 1: ["labor_context_for_contract"], 2: [],
        3: ["bộ luật lao động", "labor_context_for_contract"]}
    last = latest_rows(rows, "title", "row_index")
    assert sorted(map(tuple, last.collect())) == [(0, titles[3], 3), (1, titles[1], 1), (2, None, 2)]
    assert "title#" not in plan(latest_rows(rows, "title", "row_index").select("id", "row_index")).split("== Physical Plan ==")[1]
