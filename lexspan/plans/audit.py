"""Audit queries: inventories, duplicates, decisions, edge checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions import classify
from lexspan.functions.text import norm
from lexspan.operators import audit
from lexspan.operators.skew import attach_group_size
from lexspan.plans.registry import query
from lexspan.session import cut_lineage
from lexspan.plans.tables import content, metadata, relationships, spread, sql_collapse, sql_norm, sql_with, table

_NO_MARKUP = ("regexp_replace({}, '(?is)<!--.*?-->|<head\\b[^>]*>.*?</head\\s*>|<script\\b[^>]*>.*?</script\\s*>"
              "|<style\\b[^>]*>.*?</style\\s*>|<title\\b[^>]*>.*?</title\\s*>', ' ', 'g')")


def sql_entities(expr: str) -> str:
    """Decodes the entities the given tables use."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                         ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expr = f"replace({expr}, '{entity}', '{char}')"
    return expr


def sql_visible(expr: str) -> str:
    stripped = f"regexp_replace({_NO_MARKUP.format(expr)}, '(?s)<[^>]*>', ' ', 'g')"
    return sql_collapse(f"nfc_normalize({sql_entities(stripped)})")


def _scope(expr: str) -> str:
    value = sql_norm(expr)
    return (f"CASE WHEN {value} = 'trung ương' THEN 'central_exact' "
            f"WHEN regexp_matches({value}, '{classify.LOCAL_SCOPE_PREFIXES}') OR {value} IN ('tuyên quang', 'lâm đồng') "
            f"THEN 'exclude_local_scope' WHEN {value} = '' THEN 'quarantine_missing_scope' "
            "ELSE 'quarantine_unrecognized_scope' END")


def _issuer(expr: str) -> str:
    value = sql_norm(expr)
    return (f"CASE WHEN regexp_matches({value}, '{classify.LOCAL_ISSUER_WORDS}') THEN 'local_issuer_signal' "
            f"WHEN {value} = '' OR contains({value}, 'chưa xác định') THEN 'missing_or_unknown_issuer' "
            f"WHEN regexp_matches({value}, '{classify.CENTRAL_ISSUER_WORDS}') THEN 'central_issuer_signal' "
            "ELSE 'unrecognized_issuer' END")


_QUOTE = "CASE WHEN {0} IS NULL THEN 'null' ELSE CAST(to_json({0}) AS VARCHAR) END"
_META_FIELDS = sorted(("title", "so_ky_hieu", "pham_vi", "co_quan_ban_hanh", "ngay_ban_hanh", "ngay_het_hieu_luc",
                       "tinh_trang_hieu_luc", "linh_vuc"))
_META_JSON = "'{' || " + " || ', ' || ".join(f"'\"{c}\": ' || {_QUOTE.format(c)}" for c in _META_FIELDS) + " || '}'"

FACTS_SQL = f"""vis AS (SELECT id, row_index, content_html body, {sql_visible('content_html')} shown FROM content),
facts AS (SELECT id, row_index,
  CASE WHEN {sql_collapse('body')} = '' THEN 'blank_html' WHEN shown = '' THEN 'no_visible_text_heuristic' ELSE 'present' END content_state,
  sha256(body) raw_sha256, CASE WHEN shown <> '' THEN sha256(shown) ELSE '' END text_sha256, length(shown) visible_characters
  FROM vis)"""

MEMBERS_SQL = f"""ident AS (SELECT id, {sql_norm('so_ky_hieu')} a, {sql_norm('co_quan_ban_hanh')} b, {sql_norm('ngay_ban_hanh')} c FROM metadata),
keys AS (
  SELECT 'metadata_id' kind, sha256({_QUOTE.format('id')}) group_id, id FROM metadata
  UNION ALL SELECT 'exact_metadata_except_id', sha256(CAST(to_json({_META_JSON}) AS VARCHAR)), id FROM metadata
  UNION ALL SELECT 'bibliographic_identity', sha256('[' || to_json(a) || ', ' || to_json(b) || ', ' || to_json(c) || ']'), id
            FROM ident WHERE a <> '' AND b <> '' AND c <> ''
  UNION ALL SELECT 'content_id', sha256({_QUOTE.format('id')}), id FROM content
  UNION ALL SELECT 'exact_html', sha256('"' || raw_sha256 || '"'), id FROM facts WHERE content_state = 'present'
  UNION ALL SELECT 'normalized_text_candidate', sha256('"' || text_sha256 || '"'), id FROM facts WHERE content_state = 'present'),
members AS (SELECT * FROM (SELECT kind, group_id, id, count(*) OVER (PARTITION BY kind, group_id) record_count FROM keys)
            WHERE record_count > 1)"""

DECISIONS_SQL = f"""{sql_with('metadata', 'content')}, {FACTS_SQL}, {MEMBERS_SQL},
kinds AS (SELECT id, list_sort(list_distinct(list('duplicate_' || kind))) kinds FROM members GROUP BY id),
lastrow AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_index DESC) = 1),
base AS (SELECT m.row_index, m.id, m.title, m.linh_vuc, m.pham_vi, {_scope('m.pham_vi')} scope_reason, m.co_quan_ban_hanh issuer,
  {_issuer('m.co_quan_ban_hanh')} issuer_signal, coalesce(f.content_state, 'missing_content_row') content_state,
  coalesce(f.raw_sha256, '') raw_sha256, coalesce(f.text_sha256, '') text_sha256,
  coalesce(f.visible_characters, 0) visible_characters,
  CASE WHEN {sql_collapse("coalesce(ngay_het_hieu_luc, '')")} = '' THEN 'unknown_expiry' ELSE 'reported_expiry_unverified' END expiry_state,
  tinh_trang_hieu_luc reported_status, k.kinds
  FROM metadata m LEFT JOIN lastrow f ON m.id = f.id LEFT JOIN kinds k ON m.id = k.id),
flagged AS (SELECT *, list_concat(list_filter([
    CASE WHEN scope_reason = 'central_exact' AND issuer_signal = 'local_issuer_signal' THEN 'central_scope_local_issuer_conflict' END,
    CASE WHEN scope_reason = 'exclude_local_scope' AND issuer_signal = 'central_issuer_signal'
         THEN 'local_scope_central_issuer_suspected_conflict' END,
    CASE WHEN issuer_signal IN ('missing_or_unknown_issuer', 'unrecognized_issuer') THEN issuer_signal END,
    CASE WHEN content_state <> 'present' THEN content_state END], lambda x: x IS NOT NULL), coalesce(kinds, [])) flags FROM base),
decided AS (SELECT *, CASE WHEN scope_reason <> 'central_exact' THEN scope_reason WHEN len(flags) > 0
    THEN 'quarantine_' || flags[1] ELSE 'include_for_employment_review' END primary_reason FROM flagged),
audits AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_index DESC) = 1)"""


def audit_tables(spark: SparkSession, folder: str, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    return metadata(spark, folder, ordered), spread(content(spark, folder, ordered), "id")


def decided(spark: SparkSession, folder: str) -> DataFrame:
    return audit.decisions(*audit_tables(spark, folder, ordered=True))


@query(f"""{sql_with('metadata')} SELECT {_QUOTE.format('pham_vi')} raw_value_json, {sql_norm('pham_vi')} normalized_value,
count(*) count, {_scope('pham_vi')} scope_reason FROM metadata GROUP BY pham_vi""")
def value_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return audit.value_inventory(metadata(spark, folder), "pham_vi")


@query(f"""{sql_with('metadata')} SELECT co_quan_ban_hanh issuer, pham_vi, {_issuer('co_quan_ban_hanh')} signal, count(*) count
FROM metadata GROUP BY co_quan_ban_hanh, pham_vi""")
def issuer_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return audit.issuer_inventory(metadata(spark, folder))


@query(f"""{sql_with('content')}, {FACTS_SQL} SELECT id, content_state, raw_sha256, text_sha256, visible_characters FROM facts""")
def content_state(spark: SparkSession, folder: str) -> DataFrame:
    return audit.content_facts(spread(content(spark, folder), "id")).drop("row_index")


@query(f"""SELECT page_id, {sql_visible('html')} visible, sha256({sql_visible('html')}) text_sha256 FROM pages""")
def html_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    pages = spread(table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return pages.select("page_id", audit.text_fingerprint("html").alias("visible")).withColumn(
        "text_sha256", F.sha2("visible", 256))


@query(f"""{DECISIONS_SQL} SELECT row_index, id, title, pham_vi pham_vi_raw, scope_reason, issuer, issuer_signal, content_state, raw_sha256, text_sha256,
visible_characters, expiry_state, reported_status, primary_reason, array_to_string(flags, '|') flags FROM decided""")
def document_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return decided(spark, folder).select(
        "row_index", "id", "title", "pham_vi_raw", "scope_reason", "issuer", "issuer_signal", "content_state", "raw_sha256", "text_sha256",
        "visible_characters", "expiry_state", "reported_status", "primary_reason", F.array_join("flags", "|").alias("flags"))


@query(f"""{DECISIONS_SQL} SELECT flag, count(*) count FROM (SELECT unnest(flags) flag FROM decided) GROUP BY flag""")
def flag_counts(spark: SparkSession, folder: str) -> DataFrame:
    return audit.flag_counts(decided(spark, folder))


@query(f"""{DECISIONS_SQL} SELECT count(*) AS "rows", count(scope_reason) scope_total, count(primary_reason) primary_total,
count(*) FILTER (scope_reason = 'central_exact') central_rows,
count(primary_reason) FILTER (scope_reason = 'central_exact') central_primary_total,
count(*) FILTER (primary_reason = 'include_for_employment_review') included FROM decided""")
def reconcile_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    return audit.reconcile(decided(spark, folder))


@query(f"""{DECISIONS_SQL}, items AS (
SELECT 'metadata_rows' metric, '' AS value FROM decided
UNION ALL SELECT 'scope_counts', scope_reason FROM decided
UNION ALL SELECT 'primary_reasons', primary_reason FROM decided
UNION ALL SELECT 'central_primary_reasons', primary_reason FROM decided WHERE scope_reason = 'central_exact'
UNION ALL SELECT 'content_states_all', content_state FROM decided
UNION ALL SELECT 'content_states_central', content_state FROM decided WHERE scope_reason = 'central_exact'
UNION ALL SELECT 'blank_expiry_all', '' FROM decided WHERE expiry_state = 'unknown_expiry'
UNION ALL SELECT 'blank_expiry_central', '' FROM decided WHERE expiry_state = 'unknown_expiry' AND scope_reason = 'central_exact'
UNION ALL SELECT 'blank_expiry_by_reported_status', coalesce(reported_status, 'None') FROM decided WHERE expiry_state = 'unknown_expiry'
UNION ALL SELECT 'overlapping_issue_counts', unnest(flags) FROM decided)
SELECT metric, value, count(*) count FROM items GROUP BY ALL
UNION ALL SELECT 'metadata_unique_ids', '', count(DISTINCT id) FROM metadata
UNION ALL SELECT 'content_rows', '', count(*) FROM content
UNION ALL SELECT 'content_unique_ids', '', count(DISTINCT id) FROM content
UNION ALL SELECT 'orphan_content_ids', '', count(DISTINCT id) FROM content WHERE id NOT IN (SELECT id FROM metadata)
UNION ALL SELECT 'scope_raw_value_count', '', count(*) FROM (SELECT DISTINCT pham_vi FROM metadata)
UNION ALL SELECT 'scope_normalized_value_count', '', count(DISTINCT {sql_norm('pham_vi')}) FROM metadata""")
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    meta, body = audit_tables(spark, folder, ordered=True)
    facts = cut_lineage(audit.content_facts(body))
    rows = audit.decide(meta, facts, audit.duplicate_members(cut_lineage(audit.group_keys(meta, facts))))
    return audit.summary(rows).unionByName(audit.corpus_counts(meta, facts))


def _members(spark: SparkSession, folder: str) -> DataFrame:
    meta, body = audit_tables(spark, folder)
    return audit.duplicate_members(cut_lineage(audit.group_keys(meta, audit.content_facts(body))))


_CORPUS_MEMBERS = f"{sql_with('metadata', 'content')}, {FACTS_SQL}, {MEMBERS_SQL}"


@query(f"""{_CORPUS_MEMBERS} SELECT DISTINCT kind, group_id, record_count FROM members""")
def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return audit.duplicate_ledger(_members(spark, folder))


@query(f"""{_CORPUS_MEMBERS} SELECT kind, group_id, id, record_count FROM members""")
def duplicate_members(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder)


@query(f"""{_CORPUS_MEMBERS} SELECT kind, count(DISTINCT group_id) AS "groups", count(*) participating_rows,
count(DISTINCT id) distinct_ids, count(*) - count(DISTINCT group_id) excess_rows_within_groups FROM members GROUP BY kind""")
def dup_summary(spark: SparkSession, folder: str) -> DataFrame:
    return audit.duplicate_summary(_members(spark, folder))


@query("""SELECT * FROM (SELECT doc_id, sha256(text) text_hash, count(*) OVER (PARTITION BY text) copies FROM documents) WHERE copies > 1""")
def exact_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return attach_group_size(docs, ["text_hash"], "copies").where("copies IS NOT NULL")


@query(f"""WITH n AS (SELECT doc_id, sha256({sql_norm('text')}) text_hash FROM documents)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY text_hash) copies FROM n) WHERE copies > 1""")
def normalized_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    docs = docs.select("doc_id", norm("text").alias("__norm")).select("doc_id", F.sha2("__norm", 256).alias("text_hash"))
    return attach_group_size(docs, ["text_hash"], "copies").where("copies IS NOT NULL")


@query(f"""WITH n AS (SELECT p_partkey, {sql_norm('p_name')} a, {sql_norm('p_brand')} b, {sql_norm('p_type')} c FROM part)
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY a, b, c) copies FROM n WHERE a <> '' AND b <> '' AND c <> '') WHERE copies > 1""")
def identity_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "part").select("p_partkey", norm("p_name").alias("a"), norm("p_brand").alias("b"),
                                               norm("p_type").alias("c")).where("a <> '' AND b <> '' AND c <> ''")
    return attach_group_size(keys, ["a", "b", "c"], "copies").where("copies IS NOT NULL")


@query(f"""{sql_with('metadata', 'content')} SELECT id, count(*) count FROM content WHERE id NOT IN (SELECT id FROM metadata) GROUP BY id""")
def orphan_content(spark: SparkSession, folder: str) -> DataFrame:
    return audit.orphan_content(content(spark, folder), metadata(spark, folder))


@query("""SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'missing_label_row') AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def missing_labels(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("missing_label_row")).alias("state"))


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def orphan_vectors(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("vec_id"))
    return table(spark, folder, "embeddings").select("vec_id", "label").join(labels, "vec_id", "left_anti")


EDGES_SQL = f"""{DECISIONS_SQL}, {sql_with('relationships')[5:]},
ends AS (SELECT e.*, coalesce(s.primary_reason, 'missing_metadata') source_state, coalesce(t.primary_reason, 'missing_metadata') target_state,
  coalesce(s.scope_reason = 'central_exact', false) central_source
  FROM relationships e LEFT JOIN audits s ON e.doc_id = s.id LEFT JOIN audits t ON e.other_doc_id = t.id),
audited AS (SELECT *, list_filter([
  CASE WHEN source_state = 'missing_metadata' THEN 'source_missing_metadata' END,
  CASE WHEN target_state = 'missing_metadata' THEN 'target_missing_metadata' END,
  CASE WHEN doc_id = other_doc_id THEN 'self_edge' END,
  CASE WHEN trim(coalesce(relationship, '')) = '' THEN 'missing_relationship_label' END,
  CASE WHEN source_state = 'include_for_employment_review' AND target_state <> 'include_for_employment_review'
       THEN 'included_source_target_unavailable_after_audit' END,
  CASE WHEN central_source AND target_state <> 'include_for_employment_review'
       THEN 'central_source_target_unavailable_after_audit' END], lambda x: x IS NOT NULL) flags FROM ends)"""


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return audit.edge_audit(relationships(spark, folder), decided(spark, folder))


@query(f"""{EDGES_SQL} SELECT doc_id, other_doc_id, relationship, source_state, target_state, array_to_string(flags, '|') flags
FROM audited WHERE len(flags) > 0""")
def edge_audit(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).where(F.size("flags") > 0).select(
        "doc_id", "other_doc_id", "relationship", "source_state", "target_state", F.array_join("flags", "|").alias("flags"))


@query(f"""{EDGES_SQL}, items AS (SELECT 'rows' metric, '' AS value FROM audited
UNION ALL SELECT 'relationship_types', coalesce(relationship, 'None') FROM audited
UNION ALL SELECT 'central_source_edges', '' FROM audited WHERE central_source
UNION ALL SELECT 'included_source_edges', '' FROM audited WHERE source_state = 'include_for_employment_review'
UNION ALL SELECT 'central_source_target_states', target_state FROM audited WHERE central_source
UNION ALL SELECT 'flag', unnest(flags) FROM audited),
twice AS (SELECT count(*) n FROM relationships GROUP BY doc_id, other_doc_id, relationship HAVING count(*) > 1)
SELECT metric, value, count(*) count FROM items GROUP BY ALL
UNION ALL SELECT 'duplicate_groups', '', count(*) FROM twice UNION ALL SELECT 'duplicate_excess_rows', '', coalesce(sum(n - 1), 0) FROM twice""")
def edge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return audit.edge_metrics(_edges(spark, folder)).unionByName(audit.duplicate_edge_counts(relationships(spark, folder)))


@query(f"""{EDGES_SQL}, r AS (SELECT 'missing_source' AS role, doc_id id FROM audited WHERE source_state = 'missing_metadata'
UNION ALL SELECT 'missing_target', other_doc_id FROM audited WHERE target_state = 'missing_metadata'
UNION ALL SELECT 'central_source_missing_target', other_doc_id FROM audited WHERE target_state = 'missing_metadata' AND central_source
UNION ALL SELECT 'included_source_missing_target', other_doc_id FROM audited
  WHERE target_state = 'missing_metadata' AND source_state = 'include_for_employment_review')
SELECT role, count(DISTINCT id) distinct_ids FROM r GROUP BY role""")
def absent_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return audit.absent_endpoints(_edges(spark, folder))


@query(f"""{sql_with('relationships')} SELECT doc_id, other_doc_id, relationship, count(*) count FROM relationships GROUP BY ALL HAVING count(*) > 1""")
def duplicate_edges(spark: SparkSession, folder: str) -> DataFrame:
    return audit.duplicate_edges(relationships(spark, folder))


@query(f"""{sql_with('metadata', 'relationships')} SELECT * FROM (SELECT *, doc_id NOT IN (SELECT id FROM metadata) source_missing,
other_doc_id NOT IN (SELECT id FROM metadata) target_missing FROM relationships) WHERE source_missing OR target_missing""")
def dangling_edges(spark: SparkSession, folder: str) -> DataFrame:
    return audit.dangling_edges(relationships(spark, folder), metadata(spark, folder))
