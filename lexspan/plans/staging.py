"""Staging queries: seeds, dependencies, roles, amendment edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions import classify
from lexspan.operators import curation, parse, staging
from lexspan.plans import parse_sql
from lexspan.plans.audit import DECISIONS_SQL, decided
from lexspan.plans.registry import query
from lexspan.plans.policy import _HEADING, TOPICS
from lexspan.plans.tables import metadata, relationships, sql_with, statutes, table
from lexspan.session import cut_lineage

CORE_IDS = ["1", "7", "42", "120"]

_TITLE = "replace(lower(title), 'ß', 'ss')"
_HAS_TERM = " OR ".join(f"contains({_TITLE}, '{t}')" for t in classify.EMPLOYMENT_TERMS) + (
    f" OR contains({_TITLE}, 'hợp đồng') AND contains({_TITLE} || ' ' || lower(coalesce(linh_vuc, '')), 'lao động')")
STAGE_SQL = f"""{DECISIONS_SQL}, {sql_with('relationships')[5:]},
seeds AS (SELECT id FROM decided WHERE scope_reason = 'central_exact' AND primary_reason = 'include_for_employment_review' AND ({_HAS_TERM})),
touching AS (SELECT * FROM (SELECT *, doc_id IN (SELECT id FROM seeds) source_seed, other_doc_id IN (SELECT id FROM seeds) target_seed
             FROM relationships) WHERE source_seed OR target_seed),
deps AS (SELECT DISTINCT id FROM (SELECT other_doc_id id FROM touching WHERE source_seed
         UNION ALL SELECT doc_id FROM touching WHERE target_seed) WHERE id NOT IN (SELECT id FROM seeds)),
review AS (SELECT id, true seed FROM seeds UNION ALL SELECT id, false FROM deps),
roles AS (SELECT r.id, d.title, CASE WHEN d.id IS NOT NULL THEN d.scope_reason END source_scope_reason, d.primary_reason audit_primary_reason,
  d.content_state, CASE WHEN d.id IS NULL THEN 'dangling_dependency' WHEN seed THEN 'employment_seed'
    WHEN d.scope_reason = 'central_exact' THEN 'central_dependency_candidate' ELSE 'excluded_dependency' END stage_role
  FROM review r LEFT JOIN audits d ON r.id = d.id),
staged AS (SELECT *, coalesce(stage_role IN ('employment_seed', 'central_dependency_candidate')
  AND audit_primary_reason = 'include_for_employment_review' AND content_state = 'present', false) searchable_candidate FROM roles)"""


def _seeds(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    meta = metadata(spark, folder, ordered=True)
    audit = cut_lineage(decided(spark, folder).select("id", "row_index", "primary_reason", "content_state"))
    return meta, audit, staging.seeds(meta, audit)


def _touching(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    meta, audit, seed_ids = _seeds(spark, folder)
    seed_ids = cut_lineage(seed_ids)
    return meta, audit, seed_ids, staging.touching_edges(relationships(spark, folder), seed_ids)


def _roles(spark: SparkSession, folder: str) -> DataFrame:
    meta, audit, seed_ids, touching = _touching(spark, folder)
    return staging.review_roles(meta, audit, seed_ids, staging.one_hop(touching, seed_ids))


@query(f"{STAGE_SQL} SELECT id FROM seeds")
def employment_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return _seeds(spark, folder)[2]


@query(f"{STAGE_SQL} SELECT id FROM deps")
def one_hop_expansion(spark: SparkSession, folder: str) -> DataFrame:
    _, _, seed_ids, touching = _touching(spark, folder)
    return staging.one_hop(touching, seed_ids)


@query(f"""{STAGE_SQL}, pairs AS (SELECT DISTINCT id, neighbor FROM (SELECT doc_id id, other_doc_id neighbor FROM touching
UNION ALL SELECT other_doc_id, doc_id FROM touching)) SELECT id, count(*) neighbors FROM pairs GROUP BY id""")
def neighbor_sets(spark: SparkSession, folder: str) -> DataFrame:
    return staging.neighbor_sets(staging.neighbors(_touching(spark, folder)[3]))


@query(f"""{STAGE_SQL} SELECT DISTINCT id, neighbor FROM (SELECT doc_id id, other_doc_id neighbor FROM touching
UNION ALL SELECT other_doc_id, doc_id FROM touching)""")
def neighbor_rows(spark: SparkSession, folder: str) -> DataFrame:
    return staging.neighbors(_touching(spark, folder)[3])


@query(f"""{STAGE_SQL} SELECT doc_id id, doc_id source, other_doc_id target, relationship, 'outgoing' direction FROM touching WHERE source_seed
UNION ALL SELECT other_doc_id, doc_id, other_doc_id, relationship, 'incoming' FROM touching WHERE target_seed""")
def directed_edges(spark: SparkSession, folder: str) -> DataFrame:
    return staging.directed_edges(_touching(spark, folder)[3])


@query(f"""{STAGE_SQL} SELECT id, source_scope_reason, audit_primary_reason, content_state, stage_role, searchable_candidate FROM staged""")
def review_roles(spark: SparkSession, folder: str) -> DataFrame:
    return _roles(spark, folder).select("id", "source_scope_reason", "audit_primary_reason", "content_state", "stage_role",
                                        "searchable_candidate")


@query(f"""{STAGE_SQL} SELECT stage_role, count(*) documents, count(*) FILTER (searchable_candidate) eligible FROM staged GROUP BY stage_role""")
def role_counts(spark: SparkSession, folder: str) -> DataFrame:
    return staging.role_counts(_roles(spark, folder))


@query(f"""{STAGE_SQL}, b AS (SELECT 'employment_seed' bucket, 20 size, * FROM staged WHERE stage_role = 'employment_seed'
UNION ALL SELECT 'central_dependency_candidate', 15, * FROM staged WHERE stage_role = 'central_dependency_candidate'
UNION ALL SELECT 'not_included_dependency', 10, * FROM staged WHERE stage_role IN ('central_dependency_candidate', 'excluded_dependency')
  AND audit_primary_reason <> 'include_for_employment_review'
UNION ALL SELECT 'dangling_dependency', 5, * FROM staged WHERE stage_role = 'dangling_dependency'),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY id) position FROM b)
SELECT bucket, position, id, CASE WHEN bucket <> 'not_included_dependency' THEN bucket
  WHEN source_scope_reason <> 'central_exact' THEN 'excluded_dependency' ELSE 'quarantined_dependency' END stage_role,
  coalesce(source_scope_reason, 'missing_metadata') source_scope_reason FROM n WHERE position <= size""")
def priority_topn(spark: SparkSession, folder: str) -> DataFrame:
    return staging.priority_list(_roles(spark, folder)).drop("title", "so_ky_hieu")


# Visible characters per passage of the staged markup.
PASSAGE_CHARS = 400
_STAGED_SQL = "WITH RECURSIVE " + STAGE_SQL.removeprefix("WITH ") + f""", {sql_with('statutes')[5:]},
src AS (SELECT * FROM statutes WHERE id IN (SELECT id FROM staged WHERE searchable_candidate)), {parse_sql.LAYOUT},
{parse_sql.LEGAL_ARTICLES}, {parse_sql.LEDGER}"""


def _staged(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    return staging.stage_documents(statutes(spark, folder), cut_lineage(_roles(spark, folder)), max_chars=PASSAGE_CHARS)


@query(f"{_STAGED_SQL} SELECT document_id, article_count, status, array_to_string(reasons, '|') reasons FROM ledger")
def staging_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(spark, folder)[0].select("document_id", "article_count", "status", F.array_join("reasons", "|").alias("reasons"))


@query(f"""{_STAGED_SQL} SELECT unnest(['attempted_documents', 'documents_with_successful_article_segmentation', 'zero_article_documents',
'quarantined_layout_documents', 'article_versions']) counter, unnest([count(*), count(*) FILTER (status = 'segmented'), count(*) FILTER (status = 'zero_article'),
count(*) FILTER (status = 'quarantined_layout'), coalesce(sum(article_count) FILTER (status = 'segmented'), 0)]) count FROM ledger""")
def staging_counters(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame(list(_staged(spark, folder)[1].items()), "counter string, count long")


@query(f"""{_STAGED_SQL} SELECT article_id, id document_id, label, chapter, section, source_start, source_end, canonical_text,
array_to_string(list_sort(list_distinct(regexp_extract_all(canonical_text, '{parse_sql.REFERENCE}')[2:])), '|') cross_references,
(SELECT string_agg(n.path || '@' || n."start" || '-' || n."end", '|' ORDER BY n."start", length(n.path)) FROM nodes n WHERE n.id = s.id AND n.article = s.article) hierarchy
FROM shown s WHERE id IN (SELECT document_id FROM ledger WHERE status = 'segmented')""")
def staged_articles(spark: SparkSession, folder: str) -> DataFrame:
    rows = staging.staged_articles(_staged(spark, folder)[0])
    node = F.transform("hierarchy", lambda n: F.concat(F.array_join(n["structure_path"], " > "), F.lit("@"), n["source_start"].cast("string"), F.lit("-"),
                                                       n["source_end"].cast("string")))
    return rows.select("article_id", "document_id", "label", "chapter", "section", "source_start", "source_end", "canonical_text",
                       F.array_join("cross_references", "|").alias("cross_references"), F.array_join(node, "|").alias("hierarchy"))


@query(f"""{_STAGED_SQL}, {parse_sql.CHARACTERS}, {parse_sql.chunks(PASSAGE_CHARS)},
good AS (SELECT document_id FROM ledger WHERE status = 'segmented')
SELECT article_id, article_id || ':article' child_id, canonical_text, NULL AS path FROM shown WHERE id IN (FROM good) AND article_id NOT IN (SELECT article_id FROM pieces)
UNION ALL SELECT article_id, {parse_sql.sql_uuid5("'lexspan:' || article_id || ':' || child_index")}, {parse_sql.sql_shown("substr(html, source_start + 1, source_end - source_start)")},
array_to_string(path, ' > ') FROM pieces WHERE id IN (FROM good)""")
def staged_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Children where an article has them, else the article."""
    rows = cut_lineage(staging.staged_articles(_staged(spark, folder)[0]))
    parts = parse.children(rows)
    paths = parts.select("child_id", F.array_join("structure_path", " > ").alias("path"))
    return parse.passages(rows, parts).join(paths, "child_id", "left").select("article_id", "child_id", "canonical_text", "path")


_CORE = ", ".join(f"'{i}'" for i in CORE_IDS)


@query(f"""{sql_with('relationships')} SELECT doc_id source, other_doc_id target, relationship,
CASE WHEN doc_id IN ({_CORE}) THEN doc_id ELSE other_doc_id END core_document_id,
CASE WHEN doc_id IN ({_CORE}) THEN other_doc_id ELSE doc_id END related_document_id, 'quarantined_outside_core_corpus' disposition
FROM relationships WHERE relationship = 'Sửa đổi, bổ sung' AND (doc_id IN ({_CORE}) OR other_doc_id IN ({_CORE}))""")
def amendment_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return staging.amendment_boundary(relationships(spark, folder), CORE_IDS)


@query(f"""{sql_with('relationships')} SELECT DISTINCT CASE WHEN doc_id IN ({_CORE}) THEN doc_id ELSE other_doc_id END core_document_id,
CASE WHEN doc_id IN ({_CORE}) THEN other_doc_id ELSE doc_id END related_document_id
FROM relationships WHERE relationship = 'Sửa đổi, bổ sung' AND (doc_id IN ({_CORE}) OR other_doc_id IN ({_CORE}))
AND NOT (doc_id IN ({_CORE}) AND other_doc_id IN ({_CORE}))""")
def related_documents(spark: SparkSession, folder: str) -> DataFrame:
    return staging.related_documents(staging.amendment_boundary(relationships(spark, folder), CORE_IDS), CORE_IDS)


@query(f"""{DECISIONS_SQL} SELECT id, CASE WHEN content_state = 'missing_content_row' THEN 'missing source or audit record'
WHEN scope_reason <> 'central_exact' THEN 'not central' WHEN content_state <> 'present' OR visible_characters = 0 THEN 'content quality'
WHEN issuer_signal <> 'central_issuer_signal' THEN 'issuer conflict' WHEN len(flags) > 0 THEN 'unresolved audit flags'
WHEN primary_reason <> 'include_for_employment_review' THEN 'audit disposition' END reason FROM decided""")
def core_record_gate(spark: SparkSession, folder: str) -> DataFrame:
    return curation.core_gate(decided(spark, folder))


_TOPIC_LIST = "list_filter([" + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains({_HEADING}, {chr(39)}{t}{chr(39)})' for t in terms)} THEN '{name}' END" for name, terms in TOPICS.items()) \
    + "], lambda x: x IS NOT NULL)"


def _curated(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: the language as document, the source as label, the first line as heading."""
    docs = table(spark, folder, "documents")
    articles = docs.select(F.col("lang").alias("document_id"), F.col("source").alias("label"), F.col("doc_id").cast("string").alias("article_id"),
                           F.substring_index("text", "\n", 1).alias("heading"))
    parents = docs.select(F.col("lang").alias("id")).distinct().withColumn("reported_status", F.upper("id"))
    return curation.curate(articles, parents, {"en": ("src1", "src2"), "de": ("src3",)}, TOPICS)


_CURATED_SQL = f"""cu AS (SELECT lang document_id, source AS label, CAST(doc_id AS VARCHAR) article_id, {_TOPIC_LIST} topics FROM documents),
cd AS (SELECT *, CASE WHEN len(topics) > 0 THEN 'in_scope_topic' WHEN document_id = 'en' AND label IN ('src1', 'src2') OR document_id = 'de' AND label = 'src3'
THEN 'explicit_dependency' ELSE 'out_of_scope' END index_disposition FROM cu)"""


@query(f"WITH {_CURATED_SQL} SELECT document_id, article_id, label, index_disposition, index_disposition <> 'out_of_scope' retrieval_index_candidate, upper(document_id) reported_status FROM cd")
def index_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    return _curated(spark, folder).select("document_id", "article_id", "label", "index_disposition", "retrieval_index_candidate", "reported_status")


@query(f"WITH {_CURATED_SQL} SELECT DISTINCT document_id, unnest(topics) topic, label FROM cd")
def topic_labels(spark: SparkSession, folder: str) -> DataFrame:
    return curation.topic_labels(_curated(spark, folder))
