"""Metric, grid and latency queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.operators import evaluation, fusion, metrics
from lexspan.plans.registry import query
from lexspan.operators.skew import ranked
from lexspan.plans.retrieval import BM25_SQL, DENSE_SQL, HYBRID_SQL, as_branch, dense_hits, hybrid, overlap_score, sparse_hits
from lexspan.plans.tables import queries_from_benchmark, sql_tokens, table
from lexspan.session import cut_lineage

K = 5

# Documents labelled good are relevant to every case; grades add the absence of toxicity.
_RANKS_SQL = f"""{HYBRID_SQL}, ranks AS (
SELECT 'bm25' branch, query_id, doc_id, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM der WHERE rank <= 30
UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fr),
rel AS (SELECT doc_id FROM labels WHERE quality = 1),
cases AS (SELECT b.branch, item_id query_id FROM benchmark, (VALUES ('bm25'), ('dense'), ('rrf')) b(branch)),
got AS (SELECT branch, query_id, count(*) found, min(rank) first FROM ranks JOIN rel USING (doc_id) WHERE rank <= {K} GROUP BY ALL),
m AS (SELECT branch, query_id, coalesce(found, 0) / (SELECT count(*) FROM rel) recall, coalesce(1.0 / first, 0) mrr
      FROM cases LEFT JOIN got USING (branch, query_id))"""


def _branches(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three rankings; the two searches run once and are read from their hit tables."""
    sparse, dense = (cut_lineage(as_branch(hits, name)) for hits, name in (
        (sparse_hits(spark, folder), "bm25"), (dense_hits(spark, folder), "dense")))
    fused = fusion.rrf_fuse(sparse.unionByName(dense), ["bm25", "dense"], decimals=9)
    return {"bm25": sparse, "dense": dense, "rrf": fused.select("query_id", "article_id", F.col("rank").alias("position"))}


def _relevant(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("article_id"))


def _per_case(spark: SparkSession, folder: str) -> DataFrame:
    cases, relevant = queries_from_benchmark(spark, folder), _relevant(spark, folder)
    rows = None
    for name, hits in _branches(spark, folder).items():
        one = metrics.recall_mrr(hits, relevant, cases, K).withColumn("branch", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(f"WITH {_RANKS_SQL} SELECT branch, query_id, round(recall, 9) recall_at_k, round(mrr, 9) mrr_at_k FROM m")
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _per_case(spark, folder).select("branch", "query_id", F.round("recall_at_k", 9).alias("recall_at_k"),
                                           F.round("mrr_at_k", 9).alias("mrr_at_k"))


@query(f"""WITH {_RANKS_SQL} SELECT branch, count(*) cases, count(*) measured_cases, round(avg(recall), 9) mean_recall_at_k,
round(avg(mrr), 9) mean_mrr_at_k FROM m GROUP BY branch""")
def metric_means(spark: SparkSession, folder: str) -> DataFrame:
    rows = _per_case(spark, folder)
    measured = F.col("relevant") > 0
    return rows.groupBy("branch").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(measured).alias("measured_cases"),
        F.round(F.avg(F.when(measured, F.col("recall_at_k"))), 9).alias("mean_recall_at_k"),
        F.round(F.avg(F.when(measured, F.col("mrr_at_k"))), 9).alias("mean_mrr_at_k"))


@query(f"""WITH {HYBRID_SQL}, g AS (SELECT doc_id, 2 * quality + 1 - toxic grade FROM labels),
i AS (SELECT sum((pow(2, grade) - 1) / log2(r + 1)) idcg FROM (SELECT grade, row_number() OVER (ORDER BY grade DESC) r FROM g) WHERE r <= 10),
d AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) dcg FROM fr JOIN g USING (doc_id) WHERE rank <= 10 GROUP BY query_id)
SELECT item_id query_id, round(coalesce(dcg, 0) / idcg, 9) ndcg_at_k FROM benchmark LEFT JOIN d ON query_id = item_id, i""")
def ndcg_at_k(spark: SparkSession, folder: str) -> DataFrame:
    grades = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("article_id"),
                                                   (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade"))
    hits = hybrid(spark, folder).select("query_id", "article_id", F.col("rank").alias("position"))
    return metrics.ndcg_shared(hits, grades, queries_from_benchmark(spark, folder), 10).select(
        "query_id", F.round("ndcg_at_k", 9).alias("ndcg_at_k"))


@query(f"""WITH {HYBRID_SQL}, miss AS (SELECT DISTINCT query_id FROM bmr b WHERE rank <= 3 AND NOT EXISTS
(SELECT 1 FROM fr WHERE fr.query_id = b.query_id AND fr.doc_id = b.doc_id AND fr.rank <= 5))
SELECT count(*) cases, round(avg(CASE WHEN item_id IN (SELECT query_id FROM miss) THEN 0.0 ELSE 1.0 END), 9) sufficient_evidence_recall FROM benchmark""")
def sufficient_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Share of queries whose first five fused documents hold the first three of BM25."""
    wanted = sparse_hits(spark, folder).where("rank <= 3").select("query_id", F.col("doc_id").cast("string").alias("article_id"))
    got = hybrid(spark, folder).where("rank <= 5").select("query_id", "article_id")
    return metrics.sufficient_evidence_recall(got, wanted, queries_from_benchmark(spark, folder)).select(
        "cases", F.round("sufficient_evidence_recall", 9).alias("sufficient_evidence_recall"))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL}, p(k_bm25, k_dense) AS (VALUES (10, 10), (20, 20), (40, 40), (20, 40), (40, 20)),
h AS (SELECT k_bm25, k_dense, query_id, doc_id FROM p, bmr WHERE rank <= k_bm25 UNION SELECT k_bm25, k_dense, query_id, doc_id FROM p, der WHERE rank <= k_dense),
n AS (SELECT k_bm25, k_dense, query_id, count(*) n FROM h GROUP BY ALL)
SELECT item_id query_id, k_bm25, k_dense, k_rerank, k_evidence, greatest(k_bm25, k_dense) requested_unique_articles, coalesce(n, 0) achieved_unique_articles,
least(coalesce(n, 0), k_rerank) actual_rerank_candidates, least(coalesce(n, 0), k_rerank, k_evidence) actual_evidence_articles,
'score_only_unmeasured_latency' measurement_status
FROM benchmark CROSS JOIN p LEFT JOIN n ON n.query_id = item_id AND n.k_bm25 = p.k_bm25 AND n.k_dense = p.k_dense
CROSS JOIN (VALUES (10), (20), (40)) r(k_rerank) CROSS JOIN (VALUES (3), (5), (8)) e(k_evidence)""".replace(
    "SELECT item_id query_id, k_bm25, k_dense, k_rerank", "SELECT item_id query_id, p.k_bm25, p.k_dense, k_rerank").replace(
    "greatest(k_bm25, k_dense)", "greatest(p.k_bm25, p.k_dense)"))
def sweep_grid(spark: SparkSession, folder: str) -> DataFrame:
    hits = as_branch(sparse_hits(spark, folder, 40), "bm25").unionByName(as_branch(dense_hits(spark, folder, 40), "dense"))
    return evaluation.sweep(hits, queries_from_benchmark(spark, folder))


# Cut-offs of the grid, and how many fused candidates a scorer may reorder.
DEPTHS, RERANKED = (1, 3, 5, 10), (5, 10, 20)

_GRID_SQL = f"""{HYBRID_SQL}, sc AS (SELECT fr.query_id, fr.doc_id, fr.rank place, round(len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('d.text')})))
  / greatest(len(list_distinct({sql_tokens('b.text')})), 1), 9) s FROM fr JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE fr.rank <= 20),
cfg AS (SELECT 'bm25' config, query_id, doc_id, rank FROM bmr WHERE rank <= 30 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM der WHERE rank <= 30
  UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM fr
  UNION ALL SELECT 'rerank_' || d, query_id, doc_id, row_number() OVER (PARTITION BY d, query_id ORDER BY s DESC, CAST(doc_id AS VARCHAR)) FROM sc, (VALUES (5), (10), (20)) r(d) WHERE place <= d),
gold AS (SELECT item_id query_id, doc_id FROM benchmark JOIN labels ON quality = 1 AND doc_id % 7 = item_id % 7 WHERE item_id % 5 <> 0),
size AS (SELECT query_id, count(*) n FROM gold GROUP BY query_id),
grid AS (SELECT config, item_id query_id, depth FROM (SELECT DISTINCT config FROM cfg), benchmark, (VALUES (1), (3), (5), (10)) v(depth)),
got AS (SELECT config, query_id, depth, count(gold.doc_id) hits, min(CASE WHEN gold.doc_id IS NOT NULL THEN rank END) first
  FROM grid LEFT JOIN cfg USING (config, query_id) LEFT JOIN gold USING (query_id, doc_id) WHERE rank <= depth GROUP BY ALL),
per AS (SELECT g.config, g.query_id, g.depth, n IS NOT NULL measured, CASE WHEN n IS NOT NULL THEN coalesce(hits, 0) / n END recall,
  CASE WHEN n IS NOT NULL THEN coalesce(1.0 / first, 0) END mrr FROM grid g LEFT JOIN size USING (query_id) LEFT JOIN got USING (config, query_id, depth))"""


@query(f"""WITH {_GRID_SQL} SELECT config, depth, ['first', 'second', 'third'][query_id % 3 + 1] kind, count(*) cases, count(*) FILTER (measured) measured_cases,
round(avg(recall), 9) mean_recall, round(avg(mrr), 9) mean_mrr FROM per GROUP BY ALL""")
def evaluation_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every ranking and rerank depth at every cut-off and kind of case, from one search each:
    the rerank depths are nested in one scored list."""
    branches = {name: cut_lineage(hits) for name, hits in _branches(spark, folder).items()}
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    first = branches["rrf"].where(F.col("position") <= max(RERANKED)).select("query_id", "article_id", F.col("position").alias("place"))
    scored = texts.join(first, "article_id").join(queries_from_benchmark(spark, folder), "query_id").select(
        "query_id", "article_id", "place", overlap_score("query", "text").alias("score"))
    nested = scored.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in RERANKED]))).where("place <= depth")
    reordered = ranked(nested, ["depth", "query_id"], [F.desc("score"), F.asc("article_id")], "position").select(
        F.concat(F.lit("rerank_"), F.col("depth").cast("string")).alias("config"), "query_id", "article_id", "position")
    hits = cut_lineage(reordered)
    for name, rows in branches.items():
        hits = hits.unionByName(rows.select(F.lit(name).alias("config"), "query_id", "article_id", "position"))
    items = queries_from_benchmark(spark, folder).select("query_id")
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id", (F.col("doc_id") % 7).alias("class"))
    relevant = items.where("query_id % 5 <> 0").withColumn("class", F.col("query_id") % 7).join(good, "class").select(
        "query_id", F.col("doc_id").cast("string").alias("article_id"))
    per_case = metrics.metrics_by_depth(hits, relevant, items, list(DEPTHS)).withColumn(
        "kind", F.element_at(F.array(F.lit("first"), F.lit("second"), F.lit("third")), (F.col("query_id") % 3 + 1).cast("int")))
    means = metrics.macro_mean(per_case, F.col("measured"), ["recall", "mrr"], ("config", "depth", "kind"))
    return means.select("config", "depth", "kind", "cases", "measured_cases", F.round("mean_recall", 9).alias("mean_recall"), F.round("mean_mrr", 9).alias("mean_mrr"))


@query("""SELECT event_type, count(value) samples, round(quantile_cont(value, 0.5), 6) p50, quantile_disc(value, 0.95) p95 FROM events GROUP BY event_type""")
def latency_distribution(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_type", "value")
    return metrics.latency_distribution(events, "value", ["event_type"]).withColumn("p50", F.round("p50", 6))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) i, count(*) OVER (PARTITION BY event_type) n FROM events)
SELECT event_type, n samples, round(max(value) FILTER (i = n // 2 + 1), 2) median, round(max(value), 2) AS "max" FROM r GROUP BY event_type, n""")
def report_latency(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_type", "value")
    return metrics.report_distribution(events, "value", ["event_type"])


_FAMILY = "lower(regexp_extract({}, '^\\s*(\\S+)', 1))"


def _family(text: str):
    return F.lower(F.regexp_extract(text, r"^\s*(\S+)", 1))


@query(f"""SELECT conv_id || ':' || turn case_id, {_FAMILY.format('text')} scenario_family_id FROM conversations WHERE role = 'user'
AND {_FAMILY.format('text')} IN (SELECT {_FAMILY.format('text')} FROM benchmark)""")
def split_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """User turns (held out) whose family, the first word, occurs among the benchmark items (development)."""
    dev = table(spark, folder, "benchmark").select(_family("text").alias("scenario_family_id"))
    heldout = table(spark, folder, "conversations").where("role = 'user'").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("case_id"), _family("text").alias("scenario_family_id"))
    return evaluation.leaked_families(heldout, dev).select("case_id", "scenario_family_id")


@query(f"""WITH c AS (SELECT {_FAMILY.format('text')} f, 'dev' split FROM benchmark UNION ALL SELECT {_FAMILY.format('text')}, 'heldout' FROM conversations WHERE role = 'user')
SELECT f scenario_family_id, min(split) first_split, max(split) last_split, count(*) cases FROM c GROUP BY f HAVING min(split) <> max(split)""")
def split_violations(spark: SparkSession, folder: str) -> DataFrame:
    dev = table(spark, folder, "benchmark").select(_family("text").alias("scenario_family_id"), F.lit("dev").alias("split"))
    held = table(spark, folder, "conversations").where("role = 'user'").select(_family("text").alias("scenario_family_id"), F.lit("heldout").alias("split"))
    return evaluation.split_violations(dev.unionByName(held))


_KIND = "CASE WHEN length(text) > 300 THEN 'answerable' WHEN length(text) > 150 THEN 'ambiguous' ELSE 'negative' END"


@query(f"""WITH {HYBRID_SQL}, good AS (SELECT DISTINCT query_id FROM fr JOIN labels USING (doc_id) WHERE quality = 1 AND rank <= 12),
top AS (SELECT DISTINCT query_id FROM fr JOIN labels USING (doc_id) WHERE quality = 1 AND rank <= 3),
r AS (SELECT {_KIND} kind, item_id IN (SELECT query_id FROM good) hit, item_id IN (SELECT query_id FROM top) ev FROM benchmark)
SELECT kind, count(*) cases, count(*) FILTER (kind = 'answerable') answerable, count(*) FILTER (kind = 'answerable' AND hit) answerable_retrieval_hits,
count(*) FILTER (kind = 'answerable' AND ev) answerable_provider_evidence_hits, count(*) FILTER (kind = 'answerable' AND ev) exact_answer_citations,
count(*) FILTER (kind = 'answerable' AND NOT ev) answerable_safe_abstentions, count(*) FILTER (kind = 'ambiguous') ambiguous_cases,
count(*) FILTER (kind = 'negative') negative_cases, count(*) FILTER (kind <> 'answerable') nonanswerable_safe_abstentions,
count(*) citation_contract_passes FROM r GROUP BY kind""")
def behaviour_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Reference-selector run: answer when a good document is among the first three sources."""
    fused = hybrid(spark, folder).where("rank <= 12").join(_relevant(spark, folder), "article_id", "left_semi")
    best = fused.groupBy("query_id").agg(F.min("rank").alias("best"))
    kind = F.when(F.length("text") > 300, "answerable").when(F.length("text") > 150, "ambiguous").otherwise("negative")
    cases = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), kind.alias("kind"))
    rows = cases.join(best, "query_id", "left").select(
        "kind", F.col("best").isNotNull().alias("retrieval_hit"), F.coalesce(F.col("best") <= 3, F.lit(False)).alias("evidence_hit"))
    exact = (F.col("kind") == "answerable") & F.col("evidence_hit")
    rows = rows.withColumns({"exact_answer": exact, "safe_abstention": ~exact, "contract_valid": F.lit(True)})
    return evaluation.behaviour_summary(rows, ["kind"])
