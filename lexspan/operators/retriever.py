"""The two composed searches: corpus search over passages, and eligible hybrid search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lexspan.operators import bm25, dense, fusion, policy
from lexspan.session import cut_lineage

Rerank = Column | Callable[[DataFrame], DataFrame]


def _branches(passages: DataFrame, points: DataFrame, queries: DataFrame, vectors: DataFrame, sparse: int, deep: int,
              decimals: int | None) -> DataFrame:
    ids = ["article_id", "child_id"]
    found = bm25.search(passages, queries, sparse, id_cols=ids, decimals=decimals).withColumn("branch", F.lit("bm25"))
    near = dense.search(points, vectors, deep, id_cols=ids, decimals=decimals).withColumn("branch", F.lit("dense"))
    # Both lists are short (queries x depth) and read three times below.
    return cut_lineage(found.unionByName(near).withColumnRenamed("rank", "position"))


def _with_sources(fused: DataFrame, hits: DataFrame, articles: DataFrame, limit: int | None) -> DataFrame:
    rows = fused if limit is None else fused.where(F.col("rank") <= limit)
    matched = hits.where("child_id IS NOT NULL").groupBy("query_id", "article_id").agg(
        F.array_sort(F.collect_set("child_id")).alias("matched_child_ids"))
    rows = rows.drop("rank").join(matched, ["query_id", "article_id"], "left")
    # Candidates are queries x depth rows, read from tables; when their count shows them
    # small they are broadcast and the article side stays where it is.
    return articles.join(rows, "article_id")


def corpus_search(passages: DataFrame, points: DataFrame, articles: DataFrame, queries: DataFrame, vectors: DataFrame, *,
                  sparse_limit: int = 30, dense_limit: int = 30, evidence_cap: int = 5, decimals: int | None = None) -> dict[str, DataFrame]:
    """BM25 over passages and exact vectors, fused to articles, cut to evidence.

    passages (article_id, child_id, text), points (article_id, child_id, vector), articles
    (article_id, ...), queries (query_id, query), vectors (query_id, query_vector).
    """
    hits = _branches(passages, points, queries, vectors, sparse_limit, dense_limit, decimals)
    fused = cut_lineage(fusion.rrf_fuse(hits, ["bm25", "dense"]))
    candidates = _with_sources(fused, hits, articles, None)
    return {"sparse": hits.where("branch = 'bm25'"), "dense": hits.where("branch = 'dense'"), "fused": fused,
            "evidence": fusion.select_evidence(candidates, evidence_cap)}


def hybrid_search(passages: DataFrame, points: DataFrame, articles: DataFrame, queries: DataFrame, vectors: DataFrame, day: int, *,
                  provision: str | None = None, include_open_ended: bool = False, sparse_limit: int = 20, dense_limit: int = 20,
                  rerank_limit: int = 20, evidence_cap: int = 5, rerank: Rerank | None = None,
                  decimals: int | None = None) -> dict[str, DataFrame]:
    """As above over legally eligible rows only. Corpus statistics of BM25 cover the whole
    corpus; eligibility filters before the lists are cut, so eligible rows fill them."""
    ok = policy.legal_eligibility(F.lit(day), include_open_ended=include_open_ended, provision=provision)
    ids = ["article_id", "child_id"]
    found = bm25.search(passages, queries, sparse_limit, id_cols=ids, decimals=decimals, eligible=ok).withColumn("branch", F.lit("bm25"))
    allowed = policy.legal_filter(F.lit(day), include_open_ended=include_open_ended, provision=provision)
    near = dense.search(points, vectors, dense_limit, id_cols=ids, where=allowed, decimals=decimals).withColumn("branch", F.lit("dense"))
    hits = cut_lineage(found.unionByName(near).withColumnRenamed("rank", "position"))
    fused = cut_lineage(fusion.rrf_fuse(hits, ["bm25", "dense"]))
    candidates = _with_sources(fused, hits, articles, rerank_limit)
    if rerank is not None:
        candidates = fusion.rerank(candidates.join(queries, "query_id"), rerank)
    return {"sparse": hits.where("branch = 'bm25'"), "dense": hits.where("branch = 'dense'"), "fused": fused,
            "evidence": fusion.select_evidence(candidates, evidence_cap)}
