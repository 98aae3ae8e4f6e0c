"""Corpus audit: inventories, duplicate groups, one decision per metadata row.

Results are tables; nothing is gathered on the driver. A duplicate group's members stay
rows, because one group may hold a large share of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.functions.classify import content_state, expiry_state, issuer_signal, scope_reason
from lexspan.functions.columns import first_reason, flag
from lexspan.functions.ids import json_list, json_string, sha256
from lexspan.functions.text import is_blank, norm, text_fingerprint
from lexspan.operators.skew import HOT_ROWS, attach_group_size, lookup
from lexspan.session import cut_lineage

IDENTITY_FIELDS = ("so_ky_hieu", "co_quan_ban_hanh", "ngay_ban_hanh")
INCLUDE = "include_for_employment_review"


def value_inventory(metadata: DataFrame, column: str) -> DataFrame:
    """Raw values with counts, NULL and blanks kept apart, most frequent first."""
    counts = metadata.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    rows = counts.select(json_string(F.col(column)).alias("raw_value_json"), norm(column).alias("normalized_value"),
                         "count", scope_reason(column).alias("scope_reason"),
                         F.coalesce(F.col(column), F.lit("None")).alias("__text"))
    return rows.orderBy(F.desc("count"), "__text").drop("__text")


def issuer_inventory(metadata: DataFrame) -> DataFrame:
    """Counts per issuer and scope; the signal is computed once per distinct issuer."""
    counts = metadata.groupBy("co_quan_ban_hanh", "pham_vi").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("co_quan_ban_hanh").alias("issuer"), "pham_vi",
                         issuer_signal("co_quan_ban_hanh").alias("signal"), "count")


def content_facts(content: DataFrame) -> DataFrame:
    """One row per content row: id, row_index, state, hashes and visible length."""
    shown = content.select("id", "row_index", F.coalesce("content_html", F.lit("")).alias("body"),
                           text_fingerprint("content_html").alias("visible"))
    return shown.select(
        "id", "row_index", content_state("body", F.col("visible"), F.lit(True)).alias("content_state"),
        sha256("body").alias("raw_sha256"), F.when(F.col("visible") != "", sha256("visible")).otherwise("").alias("text_sha256"),
        F.length("visible").cast("long").alias("visible_characters"))


def latest_content(facts: DataFrame) -> DataFrame:
    """Last row wins for a repeated id; combines map-side."""
    fields = ["content_state", "raw_sha256", "text_sha256", "visible_characters"]
    return facts.groupBy("id").agg(F.max_by(F.struct(*fields), "row_index").alias("last")).select("id", "last.*")


def _metadata_json(metadata: DataFrame) -> Column:
    parts = []
    for name in sorted(c for c in metadata.columns if c not in ("id", "row_index")):
        parts += [F.lit(f'{", " if parts else ""}"{name}": '), json_string(F.col(name).cast("string"))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def group_keys(metadata: DataFrame, facts: DataFrame) -> DataFrame:
    """(kind, group_id, id) for every row that could belong to a duplicate group."""
    identity = metadata.select("id", _metadata_json(metadata).alias("json"), F.array(*[norm(c) for c in IDENTITY_FIELDS]).alias("identity"))
    meta = identity.select("id", F.explode(F.array(
        _key("metadata_id", json_string(F.col("id"))), _key("exact_metadata_except_id", json_string(F.col("json"))),
        _key("bibliographic_identity", F.when(~F.array_contains("identity", ""), json_list("identity"))))).alias("key"))
    present = F.col("content_state") == "present"
    body = facts.select("id", F.explode(F.array(
        _key("content_id", json_string(F.col("id"))),
        _key("exact_html", F.when(present, json_string(F.col("raw_sha256")))),
        _key("normalized_text_candidate", F.when(present, json_string(F.col("text_sha256")))))).alias("key"))
    return meta.unionByName(body).select("key.kind", "key.group_id", "id").where(F.col("group_id").isNotNull())


def _key(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), sha256(value).alias("group_id"))


def duplicate_members(keys: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Member rows of groups with more than one row: kind, group_id, id, record_count."""
    return attach_group_size(keys, ["kind", "group_id"], "record_count", hot_rows).where(F.col("record_count").isNotNull())


def duplicate_ledger(members: DataFrame) -> DataFrame:
    """One row per group. Its members are the rows of ``duplicate_members``, whatever their number."""
    return members.groupBy("kind", "group_id").agg(F.count(F.lit(1)).alias("record_count"))


def duplicate_summary(members: DataFrame) -> DataFrame:
    """Groups, rows, distinct ids and excess rows per kind. Ids are counted through a
    (kind, id) aggregate, so no kind's ids meet in one task."""
    per_id = members.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("rows")).groupBy("kind").agg(
        F.sum("rows").alias("participating_rows"), F.count(F.lit(1)).alias("distinct_ids"))
    groups = members.groupBy("kind", "group_id").agg(F.count(F.lit(1)).alias("n")).groupBy("kind").agg(
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("excess_rows_within_groups"))
    return groups.join(per_id, "kind")


def decide(metadata: DataFrame, facts: DataFrame, members: DataFrame) -> DataFrame:
    """One decision per metadata row. The order of the flags is part of the rule: the
    first one names the quarantine reason."""
    kinds = members.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = metadata.join(latest_content(facts).withColumn("joined", F.lit(True)), "id", "left").join(kinds, "id", "left")
    rows = rows.select(
        "row_index", "id", "title", "so_ky_hieu", F.col("pham_vi").alias("pham_vi_raw"), scope_reason("pham_vi").alias("scope_reason"),
        F.col("co_quan_ban_hanh").alias("issuer"), issuer_signal("co_quan_ban_hanh").alias("issuer_signal"),
        F.coalesce("content_state", F.lit("missing_content_row")).alias("content_state"),
        F.coalesce("raw_sha256", F.lit("")).alias("raw_sha256"), F.coalesce("text_sha256", F.lit("")).alias("text_sha256"),
        F.coalesce("visible_characters", F.lit(0)).cast("long").alias("visible_characters"),
        expiry_state("ngay_het_hieu_luc").alias("expiry_state"), F.col("ngay_het_hieu_luc").alias("reported_expiry"),
        F.col("tinh_trang_hieu_luc").alias("reported_status"), "kinds")
    scope, issuer, state = F.col("scope_reason"), F.col("issuer_signal"), F.col("content_state")
    own = F.array_compact(F.array(
        flag((scope == "central_exact") & (issuer == "local_issuer_signal"), "central_scope_local_issuer_conflict"),
        flag((scope == "exclude_local_scope") & (issuer == "central_issuer_signal"),
             "local_scope_central_issuer_suspected_conflict"),
        flag(issuer.isin("missing_or_unknown_issuer", "unrecognized_issuer"), issuer),
        flag(state != "present", state)))
    duplicates = F.transform(F.coalesce("kinds", F.array().cast("array<string>")),
                             lambda kind: F.concat(F.lit("duplicate_"), kind))
    rows = rows.withColumn("flags", F.concat(own, duplicates))
    primary = first_reason((scope != "central_exact", scope),
                           (F.size("flags") > 0, F.concat(F.lit("quarantine_"), F.get("flags", F.lit(0)))), default=INCLUDE)
    return rows.drop("kinds").select(
        "*", primary.alias("primary_reason"), json_list("flags").alias("all_flags_json"),
        F.lit("unverified").alias("current_validity"), F.lit("not_yet_reviewed").alias("employment_scope"),
        F.lit(False).alias("searchable"))


def decisions(metadata: DataFrame, content: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The whole audit of metadata and content. The facts and keys are small next to the
    texts and are read more than once, so both become tables: each text is parsed once."""
    facts = cut_lineage(content_facts(content))
    return decide(metadata, facts, duplicate_members(cut_lineage(group_keys(metadata, facts)), hot_rows))


def latest_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per id: of repeated ids the last one in input order; combines map-side. Columns
    that nobody reads are not shuffled."""
    return rows.groupBy("id").agg(*[F.max_by(column, "row_index").alias(column) for column in columns])


def corpus_counts(metadata: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows, distinct ids and distinct scope values, as (metric, value, count). Distinct
    values are rows of an aggregate, so no set is built in one task."""
    def total(metric: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("count")).select(F.lit(metric).alias("metric"), F.lit("").alias("value"), "count")

    ids, bodies, scopes = metadata.select("id").distinct(), facts.groupBy("id").agg(F.count(F.lit(1)).alias("n")), metadata.select("pham_vi").distinct()
    parts = [total("metadata_unique_ids", ids), total("content_rows", facts), total("content_unique_ids", bodies),
             total("orphan_content_ids", bodies.join(ids, "id", "left_anti")), total("scope_raw_value_count", scopes),
             total("scope_normalized_value_count", scopes.select(norm("pham_vi").alias("value")).distinct())]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def orphan_content(content: DataFrame, metadata: DataFrame) -> DataFrame:
    return (content.groupBy("id").agg(F.count(F.lit(1)).alias("count"))
            .join(metadata.select("id"), "id", "left_anti"))


def flag_counts(decided: DataFrame) -> DataFrame:
    """Rows per flag. A row with several flags counts under each."""
    sets = decided.groupBy("flags").agg(F.count(F.lit(1)).alias("n"))
    return sets.select("n", F.explode("flags").alias("flag")).groupBy("flag").agg(F.sum("n").alias("count"))


def summary(decided: DataFrame) -> DataFrame:
    """All overlapping and exclusive counts in one pass, as (metric, value, count). Rows
    are first counted per combination of states; only the combinations are unfolded."""
    decided = decided.groupBy("scope_reason", "primary_reason", "content_state", "expiry_state", "reported_status", "flags").agg(
        F.count(F.lit(1)).alias("n"))
    central = F.col("scope_reason") == "central_exact"
    blank = F.col("expiry_state") == "unknown_expiry"

    def item(metric: str, value, condition: Column = F.lit(True)) -> Column:
        text = F.coalesce(value, F.lit("None")) if isinstance(value, Column) else F.lit(value)
        return F.when(condition, F.struct(F.lit(metric).alias("metric"), text.alias("value")))

    items = F.array_compact(F.array(
        item("metadata_rows", ""), item("scope_counts", F.col("scope_reason")),
        item("primary_reasons", F.col("primary_reason")),
        item("central_primary_reasons", F.col("primary_reason"), central),
        item("content_states_all", F.col("content_state")),
        item("content_states_central", F.col("content_state"), central),
        item("blank_expiry_all", "", blank), item("blank_expiry_central", "", blank & central),
        item("blank_expiry_by_reported_status", F.col("reported_status"), blank)))
    flags = F.transform("flags", lambda name: F.struct(F.lit("overlapping_issue_counts").alias("metric"), name.alias("value")))
    return decided.select("n", F.explode(F.concat(items, flags)).alias("item")).groupBy("item.metric", "item.value").agg(
        F.sum("n").alias("count"))


def reconcile(decided: DataFrame) -> DataFrame:
    """One row that shows the exclusive counts add up to the rows they classify."""
    central = F.col("scope_reason") == "central_exact"
    return decided.agg(F.count(F.lit(1)).alias("rows"), F.count("scope_reason").alias("scope_total"),
                       F.count("primary_reason").alias("primary_total"), F.count_if(central).alias("central_rows"),
                       F.count(F.when(central, F.col("primary_reason"))).alias("central_primary_total"),
                       F.count_if(F.col("primary_reason") == INCLUDE).alias("included"))


def edge_audit(edges: DataFrame, decided: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every edge with the state of both ends and its flags (an empty list when clean).

    An endpoint may own a large share of the edges, so both lookups split hot keys off.
    """
    state = cut_lineage(latest_rows(decided, "primary_reason", "scope_reason").select(
        "id", F.col("primary_reason").alias("state"), F.col("scope_reason").alias("scope")))
    ends = lookup(edges, state.select("id", F.col("state").alias("source_state"), F.col("scope").alias("source_scope")),
                  {"doc_id": "id"}, ["source_state", "source_scope"], hot_rows)
    ends = lookup(ends, state.select("id", F.col("state").alias("target_state")), {"other_doc_id": "id"},
                  ["target_state"], hot_rows)
    ends = ends.select(*edges.columns, F.coalesce("source_state", F.lit("missing_metadata")).alias("source_state"),
                       F.coalesce("target_state", F.lit("missing_metadata")).alias("target_state"), "source_scope")
    source, target = F.col("source_state"), F.col("target_state")
    central = F.coalesce(F.col("source_scope") == "central_exact", F.lit(False))
    unavailable = target != INCLUDE
    flags = F.array_compact(F.array(
        flag(source == "missing_metadata", "source_missing_metadata"),
        flag(target == "missing_metadata", "target_missing_metadata"),
        flag(F.col("doc_id") == F.col("other_doc_id"), "self_edge"),
        flag(is_blank("relationship"), "missing_relationship_label"),
        flag((source == INCLUDE) & unavailable, "included_source_target_unavailable_after_audit"),
        flag(central & unavailable, "central_source_target_unavailable_after_audit")))
    return ends.select(*edges.columns, "source_state", "target_state", central.alias("central_source"), flags.alias("flags"))


def edge_metrics(audited: DataFrame) -> DataFrame:
    """All edge counts in one pass, as (metric, value, count), from counts per combination."""
    audited = audited.groupBy("relationship", "central_source", "source_state", "target_state", "flags").agg(
        F.count(F.lit(1)).alias("n"))

    def item(metric: str, value, condition: Column = F.lit(True)) -> Column:
        text = F.coalesce(value, F.lit("None")) if isinstance(value, Column) else F.lit(value)
        return F.when(condition, F.struct(F.lit(metric).alias("metric"), text.alias("value")))

    items = F.array_compact(F.array(
        item("rows", ""), item("relationship_types", F.col("relationship")),
        item("central_source_edges", "", F.col("central_source")),
        item("included_source_edges", "", F.col("source_state") == INCLUDE),
        item("central_source_target_states", F.col("target_state"), F.col("central_source"))))
    flags = F.transform("flags", lambda name: F.struct(F.lit("flag").alias("metric"), name.alias("value")))
    return audited.select("n", F.explode(F.concat(items, flags)).alias("item")).groupBy("item.metric", "item.value").agg(
        F.sum("n").alias("count"))


def absent_endpoints(audited: DataFrame) -> DataFrame:
    """Distinct ids without metadata, per role. Distinct rows first, then counts: no
    distinct set is built in one task."""
    no_source, no_target = (F.col(c) == "missing_metadata" for c in ("source_state", "target_state"))
    roles = F.array_compact(F.array(
        F.when(no_source, F.struct(F.lit("missing_source").alias("role"), F.col("doc_id").alias("id"))),
        F.when(no_target, F.struct(F.lit("missing_target").alias("role"), F.col("other_doc_id").alias("id"))),
        F.when(no_target & F.col("central_source"),
               F.struct(F.lit("central_source_missing_target").alias("role"), F.col("other_doc_id").alias("id"))),
        F.when(no_target & (F.col("source_state") == INCLUDE),
               F.struct(F.lit("included_source_missing_target").alias("role"), F.col("other_doc_id").alias("id")))))
    return audited.select(F.explode(roles).alias("r")).select("r.role", "r.id").distinct().groupBy("role").agg(
        F.count(F.lit(1)).alias("distinct_ids"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("doc_id", "other_doc_id", "relationship").agg(F.count(F.lit(1)).alias("count")).where("count > 1")


def duplicate_edge_counts(edges: DataFrame) -> DataFrame:
    """Groups of equal edges and the rows beyond the first of each, as (metric, value, count)."""
    sums = duplicate_edges(edges).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("excess"))
    return sums.select(F.expr("stack(2, 'duplicate_groups', groups, 'duplicate_excess_rows', excess) AS (metric, count)")).select(
        "metric", F.lit("").alias("value"), "count")


def dangling_edges(edges: DataFrame, metadata: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges with an end that has no metadata, each once."""
    known = metadata.select("id").distinct().withColumn("known", F.lit(True))
    rows = lookup(edges, known.withColumnRenamed("known", "source_known"), {"doc_id": "id"}, ["source_known"], hot_rows)
    rows = lookup(rows, known.withColumnRenamed("known", "target_known"), {"other_doc_id": "id"}, ["target_known"], hot_rows)
    return rows.where("source_known IS NULL OR target_known IS NULL").select(
        *edges.columns, F.col("source_known").isNull().alias("source_missing"),
        F.col("target_known").isNull().alias("target_missing"))
