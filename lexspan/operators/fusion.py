"""Grouping of passage hits to articles, rank fusion, reranking and evidence cuts.

Hit lists are already cut to a depth per query and branch, so lists per query are short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

RRF_K = 60


def group_article_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Passage hits (child_id, score, position) to one row per article: best score,
    children by their first score, rank. Missing scores count as 0."""
    scored = hits.withColumn("score", F.coalesce("score", F.lit(0.0)))
    per_child = scored.groupBy(*keys, "article_id", "child_id").agg(
        F.max("score").alias("best"), F.min_by("score", "position").alias("first_score"))
    child = F.when(F.coalesce(F.col("child_id"), F.lit("")) != "",
                   F.struct((-F.col("first_score")).alias("order"), F.col("child_id").alias("child_id")))
    grouped = per_child.groupBy(*keys, "article_id").agg(
        F.max("best").alias("score"),
        F.transform(F.array_sort(F.collect_list(child)), lambda c: c["child_id"]).alias("matched_child_ids"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "article_id")
    return grouped.withColumn("rank", F.row_number().over(order))


def branch_ranks(hits: DataFrame) -> DataFrame:
    """Rank of each article in its branch list (query_id, branch, article_id, position, score).

    A branch with child ids is grouped to articles first. Otherwise positions stand as
    they are: a repeated article is dropped but still uses up its position.
    """
    keys = ["query_id", "branch"]
    per_article = hits.groupBy(*keys, "article_id").agg(
        F.min("position").alias("position"), F.min_by("score", "position").alias("first_score"),
        F.max(F.coalesce("score", F.lit(0.0))).alias("best"), F.max(F.col("child_id").isNotNull()).alias("has_child"))
    grouped = F.max("has_child").over(Window.partitionBy(*keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("best"), "article_id"))
    return per_article.select(*keys, "article_id", F.when(grouped, place).otherwise(F.col("position")).alias("rank"),
                              F.when(grouped, F.col("best")).otherwise(F.col("first_score")).alias("score"))


def rrf_fuse(hits: DataFrame, branches: list[str], rrf_k: int = RRF_K, decimals: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion: query_id, article_id, rrf_score, branches, rank.

    Shares are added in the order the branches are declared, so scores do not depend on
    which task finished first.
    """
    ranks = branch_ranks(hits)
    place = F.array_position(F.array(*[F.lit(b) for b in branches]), F.col("branch"))
    fused = ranks.groupBy("query_id", "article_id").agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), "branch", "rank", "score"))).alias("__shares"))
    fused = fused.select(
        "query_id", "article_id",
        F.aggregate("__shares", F.lit(0.0), lambda acc, s: acc + F.lit(1.0) / (F.lit(rrf_k) + s["rank"])).alias("rrf_score"),
        F.map_from_entries(F.transform("__shares", lambda s: F.struct(
            s["branch"], F.struct(s["rank"].alias("rank"), s["score"].alias("score"))))).alias("branches"))
    if decimals is not None:
        fused = fused.withColumn("rrf_score", F.round("rrf_score", decimals))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "article_id")
    return fused.withColumn("rank", F.row_number().over(order))


def rerank(candidates: DataFrame, score: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Attach ``rerank_score`` and order by it. ``score`` is a Column (a vectorised model
    call or an expression) or a function that adds the column; every row needs a score."""
    scored = candidates.withColumn("rerank_score", score) if isinstance(score, Column) else score(candidates)
    scored = scored.withColumn("rerank_score", F.coalesce(
        F.col("rerank_score"), F.raise_error(F.lit("a candidate has no rerank score")).cast("double")))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "article_id")
    return scored.withColumn("rank", F.row_number().over(order))


def select_evidence(candidates: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` rows per query by rerank score if any row of the query has one, else
    by fused score; missing scores count as 0. ``rerank_rank`` only on reranked rows."""
    rows = candidates if "rerank_score" in candidates.columns else candidates.withColumn(
        "rerank_score", F.lit(None).cast("double"))
    reranked = F.max(F.col("rerank_score").isNotNull()).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("__by", F.when(reranked, F.coalesce("rerank_score", F.lit(0.0)))
                           .otherwise(F.coalesce("rrf_score", F.lit(0.0))))
    order = Window.partitionBy("query_id").orderBy(F.desc("__by"), "article_id")
    rows = rows.withColumn("evidence_rank", F.row_number().over(order)).where(F.col("evidence_rank") <= max(0, cap))
    return rows.withColumn("rerank_rank", F.when(F.col("rerank_score").isNotNull(), F.col("evidence_rank"))).drop("__by")
