import html
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspan.functions import spans
from lexspan.operators import audit, chunks, parse, staging
from lexspan.sources import artifacts

META = ("id string, title string, so_ky_hieu string, pham_vi string, co_quan_ban_hanh string, ngay_ban_hanh string, "
        "ngay_het_hieu_luc string, tinh_trang_hieu_luc string, row_index long")


@pytest.fixture(scope="module")
def small(spark):
    meta = spark.createDataFrame([
        ("1", "Thử việc", "1/L", "Trung ương", "Bộ Lao động", "01/01/2020", None, "x", 0),
        ("2", "Thử việc", "2/L", "Trung ương", "UBND tỉnh A", "01/01/2020", " ", "x", 1),
        ("3", "t", "3/L", "Tỉnh A", "Bộ Lao động", "01/01/2020", "d", "x", 2),
        ("4", "t", " 4/l ", "Trung ương", "Bộ  Lao động", "01/01/2020", None, "y", 3),
        ("5", "t", "4/L", "Trung ương", "bộ lao động", "01/01/2020", None, "z", 4),
        ("6", "Nghỉ lễ", "6/L", "Trung ương", "Chính phủ", "01/01/2020", None, None, 5)], META)
    body = spark.createDataFrame([("1", "<p>A</p>", 0), ("2", "<p>B</p>", 1), ("3", "<p>C</p>", 2), ("4", "<p>D</p>", 3), ("5", "<p> D </p>", 4),
                                  ("1", "<p>A2</p>", 5), ("9", "<p>E</p>", 6), ("6", "<p>F</p>", 7)], "id string, content_html string, row_index long")
    return meta, body, audit.decisions(meta, body)


def test_decisions_flags_and_primary_reason(small):
    rows = {r.id: r for r in small[2].collect()}
    assert rows["1"].primary_reason == "quarantine_duplicate_content_id" and rows["1"].visible_characters == 2
    assert rows["2"].flags == ["central_scope_local_issuer_conflict"]
    assert rows["3"].primary_reason == "exclude_local_scope" and rows["3"].flags == ["local_scope_central_issuer_suspected_conflict"]
    assert rows["4"].flags == ["duplicate_bibliographic_identity", "duplicate_normalized_text_candidate"]
    assert rows["6"].primary_reason == audit.INCLUDE and rows["6"].all_flags_json == "[]" and rows["6"].expiry_state == "unknown_expiry"
    total = audit.reconcile(small[2]).first()
    assert total.rows == total.scope_total == total.primary_total == 6 and total.central_rows == total.central_primary_total == 5


def test_last_row_of_a_repeated_id_wins(spark, small):
    meta, body, _ = small
    later = meta.where("id = '6'").withColumns({"pham_vi": F.lit(None).cast("string"), "title": F.lit("later"), "row_index": F.lit(99).cast("long")})
    both = meta.unionByName(later).repartition(5)
    decided = audit.decisions(both, body)
    assert [(r.primary_reason, r.row_index) for r in decided.where("id = '6'").orderBy("row_index").collect()] == [
        ("quarantine_duplicate_bibliographic_identity", 5), ("quarantine_missing_scope", 99)]
    edges = spark.createDataFrame([("6", "6", "x")], "doc_id string, other_doc_id string, relationship string")
    assert audit.edge_audit(edges, decided).first().source_state == "quarantine_missing_scope"
    seed = spark.createDataFrame([("6",)], "id string")
    role = staging.review_roles(both, decided, seed, seed.where("false")).first()
    assert (role.title, role.audit_primary_reason, role.source_scope_reason) == ("later", "quarantine_missing_scope", "quarantine_missing_scope")
    counts = {r.metric: r["count"] for r in audit.corpus_counts(both, audit.content_facts(body)).collect()}
    assert counts == {"metadata_unique_ids": 6, "content_rows": 8, "content_unique_ids": 7, "orphan_content_ids": 1,
                      "scope_raw_value_count": 3, "scope_normalized_value_count": 3}
    twice = edges.unionAll(edges).unionAll(edges)
    assert {r.metric: r["count"] for r in audit.duplicate_edge_counts(twice).collect()} == {"duplicate_groups": 1, "duplicate_excess_rows": 2}


def test_duplicate_ledger_splits_hot_groups(small):
    keys = audit.group_keys(small[0], audit.content_facts(small[1]))
    plain = sorted(audit.duplicate_members(keys).collect())
    assert sorted(audit.duplicate_members(keys, hot_rows=2).collect()) == plain
    ledger = {r.kind: r for r in audit.duplicate_ledger(audit.duplicate_members(keys)).collect()}
    assert all(r.record_count == 2 for r in ledger.values())
    members = {kind: sorted(r.id for r in plain if r.kind == kind) for kind in ledger}
    assert members["bibliographic_identity"] == ["4", "5"] and members["content_id"] == ["1", "1"]


def test_edges_seeds_and_roles(spark, small):
    meta, _, decided = small
    edges = spark.createDataFrame([("6", "4", "Sửa đổi, bổ sung"), ("6", "99", "x"), ("3", "6", " "), ("6", "6", "x"), ("6", "4", "Sửa đổi, bổ sung")],
                                  "doc_id string, other_doc_id string, relationship string")
    for hot in (1, 10**6):
        flags = {(r.doc_id, r.other_doc_id): r.flags for r in audit.edge_audit(edges, decided, hot).collect()}
        assert flags[("6", "99")] == ["target_missing_metadata", "included_source_target_unavailable_after_audit",
                                      "central_source_target_unavailable_after_audit"]
        assert flags[("3", "6")] == ["missing_relationship_label"] and flags[("6", "6")] == ["self_edge"]
    assert audit.duplicate_edges(edges).first()["count"] == 2
    seeds = staging.seeds(meta, decided)
    assert [r.id for r in seeds.collect()] == ["6"]
    touching = staging.touching_edges(edges, seeds)
    assert {r.id for r in staging.one_hop(touching, seeds).collect()} == {"4", "99", "3"}
    assert staging.directed_edges(edges.join(seeds, edges.doc_id == seeds.id, "left_semi").withColumns(
        {"source_seed": F.lit(True), "target_seed": F.col("other_doc_id") == "6"})).count() == 5
    roles = staging.review_roles(meta, decided, seeds, staging.one_hop(touching, seeds))
    assert {r.id: (r.stage_role, r.searchable_candidate) for r in roles.collect()} == {
        "6": ("employment_seed", True), "4": ("central_dependency_candidate", False), "3": ("excluded_dependency", False),
        "99": ("dangling_dependency", False)}
    listed = {(r.bucket, r.id): r.stage_role for r in staging.priority_list(roles).collect()}
    assert listed[("not_included_dependency", "4")] == "quarantined_dependency" and len(listed) == 5
    plan = touching._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    boundary = staging.amendment_boundary(edges, ["6"])
    assert {(r.core_document_id, r.related_document_id) for r in boundary.collect()} == {("6", "4")}


def articles_of(spark, html, size=6000):
    docs = spark.createDataFrame([("d", html)], "id string, content_html string")
    return parse.articles(parse.parse_documents(docs, max_chars=size))


def test_headings_and_references(spark):
    rows = articles_of(spark, "<div>Điều 7. Kho sách</div><div>Người mượn theo Điều 21 phải trả sách.</div><div>Điều 8. Giờ mở cửa</div>").orderBy("source_start").collect()
    assert [r.label for r in rows] == ["Điều 7", "Điều 8"] and rows[0].cross_references == ["Điều 21"]
    morning, evening = (articles_of(spark, f"<li>Điều 4. Buổi {x}</li>").first() for x in ("sáng", "tối"))
    assert morning.article_id != evening.article_id and morning.document_version_id != evening.document_version_id
    html = ("<div>Chương III</div><div>Mục 2</div><div>Điều 30. Thẻ</div><div>4. Cấp thẻ</div><div>b) Gia hạn</div>"
            "<div>Chương IV</div><div>Điều 31. Phí</div>")
    rows = articles_of(spark, html).orderBy("source_start").collect()
    assert [(r.chapter, r.section) for r in rows] == [("Chương III", "Mục 2"), ("Chương IV", None)]
    assert ["Điều 30", "khoản 4", "điểm b)"] in [n.structure_path for n in rows[0].hierarchy]
    assert all(html[r.source_start:r.source_end] == r.source_html for r in rows)


def _clauses(*sizes):
    return "<div>Điều 9. Mượn</div>" + "".join(f"<div>{k}. {'sách ' * n}</div>" for k, n in enumerate(sizes, 1))


@pytest.mark.parametrize("html,size", [
    (_clauses(3, 3, 20), 80), (_clauses(2500) + "<p>hết</p>", 5000), (_clauses(12, 12), 50),
    ("<div>Điều 6. " + "&lt;ơ<i>k</i>" * 150 + "</div><!-- ẩn --><div>𝒳𝒴 cuối</div>", 29)])
def test_children_cover_the_article_within_the_limit(spark, html, size):
    rows = articles_of(spark, html, size)
    article, parts = rows.first(), parse.children(rows).orderBy("child_index").collect()
    assert "".join(p.source_html for p in parts) == article.source_html and len(parts) > 1
    assert all(len(p.canonical_text) <= size for p in parts)
    assert len({p.child_id for p in parts}) == len(parts)


def test_grouped_clauses_keep_their_common_path(spark):
    first = parse.children(articles_of(spark, _clauses(3, 3, 20), 80)).orderBy("child_index").first()
    assert first.structure_path == ["Điều 9"] and first.label is None and len(first.covered_structure_paths) > 1


def test_entities_for_spaces_between_blocks_are_no_text(spark):
    docs = spark.createDataFrame([("space", "<div>&nbsp;<p>Điều 2. Giá sách</p> &#160;</div>"), ("text", "<div>&amp;<p>Điều 2. Giá sách</p></div>")],
                                 "id string, content_html string")
    assert [(r.id, r[1]) for r in parse.layout_anomalies(docs).collect()] == [("text", "mixed_block_content")]


def test_layout_and_ledger(spark):
    docs = spark.createDataFrame([("ok", "<p>Điều 1. A</p>"), ("none", "<p>text</p>"), ("mixed", "<div>Điều 1. A<p>1. B</p></div><p>Điều 2. B</p>"),
                                  ("open", "<div><p>Điều 1. A</p>"), ("bare", "<b>Điều 1. X</b> y <i>z</i>"), ("null", None)], "id string, content_html string")
    rows = {r.document_id: r for r in parse.parse_ledger(parse.parse_documents(docs)).collect()}
    assert {k: r.status for k, r in rows.items()} == {"ok": "segmented", "none": "zero_article", "mixed": "quarantined_layout",
                                                      "open": "quarantined_layout", "bare": "segmented", "null": "zero_article"}
    assert rows["mixed"].reasons == ["mixed_block_content"] and rows["open"].reasons == ["unclosed_block"]


def test_common_path(values):
    kind = "array<array<string>>"
    assert values([[["a", "b"], ["a", "c"]], [["a"], ["a", "b"]], [["a", "b"], ["a", "b"]], [["x"], ["y"]], []], parse.common_path, kind) == [
        ["a"], ["a"], ["a", "b"], [], []]


def test_windows(spark):
    words = " ".join(f"word{i}" for i in range(1000))
    docs = spark.createDataFrame([("a", words), ("b", ""), ("c", " one  two "), ("d", " ".join(f"w{i}" for i in range(500)))], "id string, t string")
    rows = chunks.word_windows(docs, ["id"], "t").orderBy("id", "word_start").collect()
    assert [(r.word_start, r.word_end) for r in rows if r.id == "a"] == [(0, 440), (392, 832), (784, 1000)]
    assert all(words[r.char_start:r.char_end] == r.text for r in rows if r.id == "a")
    assert [r.text for r in rows if r.id == "c"] == ["one two"] and sum(r.id == "d" for r in rows) == 2 and not any(r.id == "b" for r in rows)
    single = spark.createDataFrame([("k", "ab cd ef")], "id string, t string")
    with_special = lambda texts: [[(0, 0)] + [(w.start(), w.end()) for w in re.finditer(r"\w", t)] + [(len(t), len(t))] for t in texts]
    cut = chunks.token_windows(single, ["id"], "t", with_special, 3, 1, prefix="q ").orderBy("first").collect()
    assert [(r.first, r.last, r.text, r.tokens) for r in cut] == [(0, 3, "ab c", 6), (2, 5, "cd e", 6), (4, 6, "ef", 5)]


def test_embedding_records_fail_closed(spark):
    schema = ("article_id string, article_version_id string, document_id string, document_version_id string, label string, topic_candidates array<string>, "
              "pham_vi string, validity string, current_validity string, answer_evidence_enabled boolean, retrieval_index_candidate boolean, canonical_text string")
    row = ("a", "av", "d", "dv", "Điều 1", ["contracts"], "Trung ương", "unverified", "unverified", False, True, "w " * 500)
    records = chunks.embedding_records(spark.createDataFrame([row], schema)).collect()
    assert len(records) == 2 and records[0].text.startswith("passage: ") and len({r.id for r in records}) == 2 and len(records[0].payload) == 29
    full = spark.createDataFrame([row], schema).withColumns({"expiry_state": F.lit("unknown_expiry"), "amendment_state": F.lit("none"),
                                                             "source_dataset_revision": F.lit("r")})
    points = chunks.embedding_records(full).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    assert artifacts.point_violations(points, 2, "r").count() == 0
    with pytest.raises(Exception, match="token limit"):
        chunks.embedding_records(spark.createDataFrame([row], schema), max_tokens=400).collect()
    for place, value, why in ((6, None, "noncentral"), (8, "valid", "promotion"), (9, True, "evidence"), (11, " ", "empty")):
        bad = row[:place] + (value,) + row[place + 1:]
        with pytest.raises(Exception, match=why):
            chunks.embedding_records(spark.createDataFrame([bad], schema)).collect()


def _shown_letters(raw):
    """Every visible character that is no space, with its place, by cutting the markup letter by letter."""
    found, at = [], 0
    while at < len(raw):
        hidden = re.match(r"(?is)<!--.*?-->|<(head|script|style|title)\b[^>]*>.*?</\1\s*>|<[^>]*>?", raw[at:])
        entity = re.match(r"(?s)&[^;]*;", raw[at:])
        size = len((hidden or entity).group(0)) if hidden or entity else 1
        if not hidden:
            found += [(c, at, at + size) for c in html.unescape(raw[at:at + size]) if not c.isspace()]
        at += size
    return found


def test_span_map_against_single_letters():
    rng = random.Random(3)
    bits = ["a", "bc", "é ", "  ", "<p>", "</p>", "<b>", "<br>", "&amp;", "&nbsp;", "&zzz;", "&NotEqualTilde;", "<!-- x -->", "<script>q</script>", "&", "word", "<", "\n"]
    for _ in range(1500):
        raw = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        mapped, letters = spans.spans_of(raw), _shown_letters(raw)
        places = [i for i, c in enumerate(mapped.text) if c != " "]
        assert [(mapped.text[i], mapped.markup_end(i)[0]) for i in places] == [(c, e) for c, _, e in letters]
        a, b = sorted((rng.randint(0, len(raw)), rng.randint(0, len(raw))))
        inside = [i for i, (_, s, e) in zip(places, letters) if s >= a and e <= b]
        assert mapped.shown(a, b) == (inside[-1] - inside[0] + 1 if inside else 0)


def test_quotes_are_found_in_the_markup(spark):
    page = "<p>Giá &amp; sách<b>vở</b></p><td>thư&nbsp;viện</td>"
    rows = [("one", page, "& sáchvở thư"), ("absent", page, "báo"), ("empty", page, ""), ("null", None, "x"), ("no quote", page, None), ("end", page, "n"),
            ("many", "<i>x</i> " * 3000 + "&lt;đích&gt;", "<đích>")]
    docs = spark.createDataFrame(rows, "id string, content_html string, quote string").repartition(3)
    got = {r.id: r for r in spans.quote_spans(docs, "content_html", "quote").collect()}
    assert page[got["one"].source_start:got["one"].source_end] == "&amp; sách<b>vở</b></p><td>thư" and got["one"].text_start == 4
    assert all(got[k].text_start is None and got[k].source_start is None for k in ("absent", "empty", "null", "no quote"))
    many = rows[-1][1]
    assert many[got["many"].source_start:got["many"].source_end] == "&lt;đích&gt;" and page[got["end"].source_start:got["end"].source_end] == "n"


def test_staging_chain_counts_what_it_writes(spark):
    docs = spark.createDataFrame([("ok", "<p>Điều 1. A</p><p>1. " + "sách " * 30 + "</p>"), ("two", "<p>Điều 1. A</p><p>Điều 2. B</p>"), ("none", "<p>x</p>"),
                                  ("open", "<div><p>Điều 1. A</p>"), ("barred", "<p>Điều 1. A</p>"), ("null", None)], "id string, content_html string")
    roles = spark.createDataFrame([(i, i != "barred") for i in ("ok", "two", "none", "open", "barred", "null", "absent")], "id string, searchable_candidate boolean")
    staged, counters = staging.stage_documents(docs, roles, max_chars=60)
    assert counters == {"attempted_documents": 5, "documents_with_successful_article_segmentation": 2, "zero_article_documents": 2,
                        "quarantined_layout_documents": 1, "article_versions": 3}
    assert {r.document_id: r.status for r in staged.collect()} == {"ok": "segmented", "two": "segmented", "none": "zero_article", "open": "quarantined_layout", "null": "zero_article"}
    articles = staging.staged_articles(staged)
    passages = parse.passages(articles, parse.children(articles)).collect()
    assert articles.count() == 3 and sum(p.document_id == "two" and p.child_id.endswith(":article") for p in passages) == 2
    assert sum(p.document_id == "ok" for p in passages) == 4
    assert staging.stage_documents(docs, roles.where("false"))[1]["attempted_documents"] == 0
