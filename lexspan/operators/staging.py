"""Seeds, one-hop dependencies, review roles and the review list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from lexspan.functions.classify import EMPLOYMENT_TERMS, WORKSHEET_TERMS, employment_reasons, scope_reason
from lexspan.functions.columns import first_reason
from lexspan.operators.audit import INCLUDE, latest_rows
from lexspan.operators import parse
from lexspan.operators.skew import HOT_ROWS, lookup, top_k
from lexspan.session import cut_lineage

AMENDMENT_RELATIONS = (
    "Sửa đổi, bổ sung", "Văn bản được sửa đổi", "Văn bản bổ sung", "Hợp nhất", "Thay thế", "Bãi bỏ",
    "Văn bản hết hiệu lực", "Văn bản quy định hết hiệu lực", "Văn bản bị hết hiệu lực 1 phần",
    "Văn bản quy định hết hiệu lực 1 phần")


def seeds(metadata: DataFrame, decided: DataFrame, terms: tuple[str, ...] = EMPLOYMENT_TERMS) -> DataFrame:
    """Central documents with an employment term in the title that the audit includes."""
    sector = F.col("nganh") if "nganh" in metadata.columns else F.lit("")
    field = F.col("linh_vuc") if "linh_vuc" in metadata.columns else F.lit("")
    candidates = metadata.where(scope_reason("pham_vi") == "central_exact").where(
        F.size(employment_reasons("title", sector, field, terms)) > 0)
    included = decided.where(F.col("primary_reason") == INCLUDE).select("id")
    return candidates.select("id").join(included, "id", "left_semi").distinct()


def touching_edges(edges: DataFrame, seed_ids: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges with a seed at either end, with a mark per end. Two equality lookups, so an
    OR condition never turns into a nested loop."""
    marks = seed_ids.select("id", F.lit(True).alias("source_seed"), F.lit(True).alias("target_seed"))
    rows = lookup(edges, marks, {"doc_id": "id"}, ["source_seed"], hot_rows)
    rows = lookup(rows, marks, {"other_doc_id": "id"}, ["target_seed"], hot_rows)
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("source_seed", "target_seed")}).where(
        "source_seed OR target_seed")


def one_hop(touching: DataFrame, seed_ids: DataFrame) -> DataFrame:
    """Ids one edge away from a seed in either direction, seeds excluded."""
    ends = touching.select(F.explode(F.array_compact(F.array(
        F.when(F.col("source_seed"), F.col("other_doc_id")), F.when(F.col("target_seed"), F.col("doc_id"))))).alias("id"))
    return ends.distinct().join(seed_ids, "id", "left_anti")


def neighbors(touching: DataFrame) -> DataFrame:
    """Distinct (id, neighbor) rows in both directions."""
    pairs = F.explode(F.array(F.struct(F.col("doc_id").alias("id"), F.col("other_doc_id").alias("neighbor")),
                              F.struct(F.col("other_doc_id").alias("id"), F.col("doc_id").alias("neighbor"))))
    return touching.select(pairs.alias("p")).select("p.id", "p.neighbor").distinct()


def neighbor_sets(pairs: DataFrame) -> DataFrame:
    """Degree per id. The sets themselves are the rows of ``neighbors``."""
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("neighbors"))


def directed_edges(touching: DataFrame) -> DataFrame:
    """One record per edge and seed end: outgoing under the source, incoming under the target."""
    records = F.explode(F.array_compact(F.array(
        F.when(F.col("source_seed"), F.struct(F.col("doc_id").alias("id"), F.lit("outgoing").alias("direction"))),
        F.when(F.col("target_seed"), F.struct(F.col("other_doc_id").alias("id"), F.lit("incoming").alias("direction"))))))
    return touching.select(records.alias("r"), F.col("doc_id").alias("source"), F.col("other_doc_id").alias("target"),
                           "relationship").select("r.id", "source", "target", "relationship", "r.direction")


def review_roles(metadata: DataFrame, decided: DataFrame, seed_ids: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Role and eligibility of every document to review. Ids without metadata dangle; of
    repeated ids the last row counts."""
    review = seed_ids.select("id", F.lit(True).alias("seed")).unionByName(dependencies.select("id", F.lit(False).alias("seed")))
    meta = latest_rows(metadata, "title", "so_ky_hieu", "pham_vi").withColumn("known", F.lit(True))
    audit = latest_rows(decided, "primary_reason", "content_state")
    rows = review.join(meta, "id", "left").join(audit, "id", "left")
    scope = scope_reason("pham_vi")
    role = first_reason((F.col("known").isNull(), "dangling_dependency"), (F.col("seed"), "employment_seed"),
                        (scope == "central_exact", "central_dependency_candidate"), default="excluded_dependency")
    rows = rows.select(
        "id", "title", "so_ky_hieu", F.when(F.col("known"), scope).alias("source_scope_reason"),
        F.col("primary_reason").alias("audit_primary_reason"), "content_state", role.alias("stage_role"),
        F.when(F.col("known"), F.lit("provisional")).otherwise("unresolved_dependency").alias("employment_scope"))
    eligible = (F.col("stage_role").isin("employment_seed", "central_dependency_candidate")
                & (F.col("audit_primary_reason") == INCLUDE) & (F.col("content_state") == "present"))
    return rows.withColumn("searchable_candidate", F.coalesce(eligible, F.lit(False)))


def role_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("stage_role").agg(F.count(F.lit(1)).alias("documents"),
                                           F.count_if("searchable_candidate").alias("eligible"))


def stage_documents(content: DataFrame, roles: DataFrame, patterns: parse.Patterns = parse.Patterns(),
                    max_chars: int = parse.MAX_CHARS) -> tuple[DataFrame, dict[str, int]]:
    """Parsed documents with their status, of all that may be searched, and the counters of
    the step. The counters are observed while the rows are written, without another scan."""
    chosen = content.join(roles.where("searchable_candidate").select("id"), "id", "left_semi")
    rows = parse.with_status(parse.parse_documents(chosen, patterns=patterns, max_chars=max_chars))
    status, seen = F.col("status"), Observation()
    staged = cut_lineage(rows.observe(
        seen, F.count(F.lit(1)).alias("attempted_documents"),
        F.count_if(status == "segmented").alias("documents_with_successful_article_segmentation"),
        F.count_if(status == "zero_article").alias("zero_article_documents"),
        F.count_if(status == "quarantined_layout").alias("quarantined_layout_documents"),
        F.coalesce(F.sum(F.when(status == "segmented", F.col("article_count"))), F.lit(0)).alias("article_versions")))
    return staged, seen.get


def staged_articles(staged: DataFrame, prefix: str = "lexspan") -> DataFrame:
    """Articles of the documents that the ledger does not hold back."""
    return parse.articles(staged.where(F.col("status") == "segmented"), prefix)


# Rows of the review list per bucket.
PRIORITY_SIZES = {"employment_seed": 20, "central_dependency_candidate": 15, "not_included_dependency": 10,
                  "dangling_dependency": 5}


def priority_list(roles: DataFrame, sizes: dict[str, int] | None = None) -> DataFrame:
    """First documents by id per review bucket. The buckets of dependencies may overlap: a
    central one that the audit did not include stands in both."""
    sizes = sizes or PRIORITY_SIZES
    role, scope = F.col("stage_role"), F.col("source_scope_reason")
    dependency = role.isin("central_dependency_candidate", "excluded_dependency")
    buckets = F.array_compact(F.array(
        F.when(role == "employment_seed", F.lit("employment_seed")),
        F.when(role == "central_dependency_candidate", F.lit("central_dependency_candidate")),
        F.when(dependency & (F.col("audit_primary_reason") != INCLUDE), F.lit("not_included_dependency")),
        F.when(role == "dangling_dependency", F.lit("dangling_dependency"))))
    rows = roles.select("id", "title", "so_ky_hieu", scope, F.explode(buckets).alias("bucket"))
    ranked = top_k(rows, ["bucket"], [F.asc("id")], max(sizes.values()), "position")
    limit = first_reason(*[(F.col("bucket") == name, F.lit(size)) for name, size in sizes.items()])
    shown = first_reason((F.col("bucket") != "not_included_dependency", F.col("bucket")),
                         (scope != "central_exact", "excluded_dependency"), default="quarantined_dependency")
    return ranked.where(F.col("position") <= limit).select(
        "bucket", F.col("position").cast("long").alias("position"), "id", "title", "so_ky_hieu",
        shown.alias("stage_role"), F.coalesce(scope, F.lit("missing_metadata")).alias("source_scope_reason"))


def amendment_boundary(edges: DataFrame, core_ids: list[str]) -> DataFrame:
    """Amendment edges that touch a core document; both filters reach the scan."""
    source, target = F.col("doc_id"), F.col("other_doc_id")
    touching = edges.where(F.col("relationship").isin(*AMENDMENT_RELATIONS)).where(
        source.isin(*core_ids) | target.isin(*core_ids))
    from_core = F.coalesce(source.isin(*core_ids), F.lit(False))
    return touching.select(
        source.alias("source"), target.alias("target"), "relationship",
        F.when(from_core, source).otherwise(target).alias("core_document_id"),
        F.when(from_core, target).otherwise(source).alias("related_document_id"),
        F.lit("quarantined_outside_core_corpus").alias("disposition"))


def related_documents(boundary: DataFrame, core_ids: list[str]) -> DataFrame:
    """Distinct outside documents per core document."""
    return boundary.where(~F.col("related_document_id").isin(*core_ids)).select(
        "core_document_id", "related_document_id").distinct()


def review_worksheet(priority: DataFrame, articles: DataFrame) -> DataFrame:
    """Scope-term articles per seed: their number and a preview of the first three."""
    chosen = priority.where(F.col("stage_role") == "employment_seed").select("id")
    matching = articles.where(F.col("canonical_text").rlike(WORKSHEET_TERMS)).join(
        F.broadcast(chosen), F.col("document_id") == F.col("id"), "left_semi")
    counts = matching.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    first = top_k(matching, ["document_id"], [F.asc("source_start"), F.asc("article_id")], 3, "position")
    shown = F.concat(F.coalesce("label", F.lit("unlabeled stored article")), F.lit(" ["), F.col("article_id"),
                     F.lit("] offsets "), F.col("source_start").cast("string"), F.lit(":"), F.col("source_end").cast("string"))
    preview = first.groupBy("document_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", shown.alias("shown")))), lambda s: s["shown"]), " | ").alias("preview"))
    rows = chosen.join(counts.join(preview, "document_id"), F.col("id") == F.col("document_id"), "left")
    more = F.when(F.col("n") > 3, F.concat(F.lit(" | +"), (F.col("n") - 3).cast("string"), F.lit(" additional candidates"))).otherwise("")
    return rows.select(F.col("id").alias("dataset_id"), F.coalesce("n", F.lit(0)).alias("article_candidate_count"),
                       F.coalesce(F.concat("preview", more), F.lit("none derived from stored scope terms")).alias("article_candidates_preview"))
