"""Ranking metrics as joins and aggregates over hit and relevance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexspan.operators.skew import lookup
from lexspan.session import cut_lineage


def unique_ranks(hits: DataFrame) -> DataFrame:
    """First occurrence of each article per query, re-ranked without gaps."""
    first = hits.groupBy("query_id", "article_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy("query_id").orderBy("position")
    return first.withColumn("rank", F.row_number().over(order))


def recall_mrr(hits: DataFrame, relevant: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """recall@k and MRR@k per case. ``relevant`` holds (query_id, article_id), or only
    article_id when all cases share one set. The recall denominator is the number of
    relevant articles; cases without any get 0.

    Only the k ranked rows per case meet the relevance table, and its size is a count, so
    a case with very many relevant articles never gathers them.
    """
    keys = [c for c in ("query_id", "article_id") if c in relevant.columns]
    pairs = relevant.select(*keys).distinct()
    found = (unique_ranks(hits).where(F.col("rank") <= k).join(pairs, keys)
             .groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first")))
    count = F.count(F.lit(1)).alias("relevant")
    if "query_id" in keys:
        rows = cases.select("query_id").join(pairs.groupBy("query_id").agg(count), "query_id", "left")
    else:
        rows = cases.select("query_id").crossJoin(F.broadcast(pairs.agg(count)))
    return (rows.join(found, "query_id", "left")
            .select("query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"),
                    F.coalesce(F.try_divide("found", "relevant"), F.lit(0.0)).alias("recall_at_k"),
                    F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_at_k")))


def ndcg(hits: DataFrame, grades: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """nDCG@k with gain 2^grade - 1; the ideal order uses every graded article."""
    def gain(grade, rank):
        return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)

    got = (unique_ranks(hits).where(F.col("rank") <= k).join(grades, ["query_id", "article_id"])
           .groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg")))
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "article_id")
    ideal = (grades.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
             .groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("idcg")))
    ratio = F.when(F.col("idcg") != 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg"))
    return (cases.select("query_id").join(ideal, "query_id", "left").join(got, "query_id", "left")
            .select("query_id", F.coalesce(ratio, F.lit(0.0)).alias("ndcg_at_k")))


def ndcg_shared(hits: DataFrame, grades: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """nDCG@k where all cases share one grade table (article_id, grade): the ideal is one
    take-ordered of k rows, not a copy of the grades per case."""
    def gain(grade, rank):
        return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)

    got = (unique_ranks(hits).where(F.col("rank") <= k).join(grades, "article_id")
           .groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg")))
    first = grades.orderBy(F.desc("grade"), "article_id").limit(k)
    ideal = (first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("grade"), "article_id")))
             .agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("idcg")))
    return (cases.select("query_id").crossJoin(F.broadcast(ideal)).join(got, "query_id", "left")
            .select("query_id", F.coalesce(F.when(F.col("idcg") != 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")),
                                           F.lit(0.0)).alias("ndcg_at_k")))


def sufficient_evidence_recall(predicted: DataFrame, reference: DataFrame, cases: DataFrame) -> DataFrame:
    """Share of cases whose predicted set holds the whole reference set; 0 without cases.
    Both tables are (query_id, article_id) rows."""
    missing = reference.join(predicted, ["query_id", "article_id"], "left_anti").select("query_id").distinct()
    covered = cases.join(missing.withColumn("__missing", F.lit(True)), "query_id", "left")
    return covered.agg(F.count(F.lit(1)).alias("cases"), F.coalesce(
        F.avg(F.when(F.col("__missing").isNull(), 1.0).otherwise(0.0)), F.lit(0.0)).alias("sufficient_evidence_recall"))


def macro_mean(per_case: DataFrame, measured, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Means over measured cases only, per key; NULL when there is none."""
    return per_case.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases"), F.count_if(measured).alias("measured_cases"),
                        *[F.avg(F.when(measured, F.col(c))).alias(f"mean_{c}") for c in columns])


# Rows in which a rank may be looked for by sorting; splitters of a round of narrowing.
ORDER_ROWS, SPLITTERS = 1_000_000, 256


def order_statistics(samples: DataFrame, value: str, keys: list[str], ranks: dict[str, Column], limit: int = ORDER_ROWS) -> DataFrame:
    """Exact values at given 1-based ranks per key; ``ranks`` are Columns of ``samples``, the
    number of samples.

    While more than ``limit`` samples lie in the range that holds a rank, a round narrows
    it: quantile sketches, which know no outliers, name splitters, the two around the rank
    (with the sketch's error on each side) are the new range, and an exact count says how
    many samples lie below it and in it. Then the distinct values of the range are ordered.
    No task sorts more than a range, whatever the distribution.
    """
    rows = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    names, same = list(ranks), {key: key for key in keys}
    fields = ["rank", "low", "high", "before", "inside"]

    def of(field: str, name: str) -> str:
        return f"__{field}_{name}"

    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    state = cut_lineage(state.select(*keys, "samples", *[
        column.alias(of(field, name)) for name in names
        for field, column in zip(fields, (ranks[name].cast("long"), F.col("__low"), F.col("__high"), F.lit(0).cast("long"), F.col("samples")), strict=True)]))
    bounds = [of(field, name) for name in names for field in ("low", "high")]

    def within(name: str) -> Column:
        return F.col("__v").between(F.col(of("low", name)), F.col(of("high", name)))

    def widest(rows_: DataFrame) -> int:
        open_ = [F.when(F.col(of("low", n)) < F.col(of("high", n)), F.col(of("inside", n))).otherwise(0) for n in names]
        return rows_.agg(F.max(F.greatest(*open_, F.lit(0)))).first()[0] or 0

    most = widest(state)
    while most > limit:
        grid = [i / SPLITTERS for i in range(SPLITTERS + 1)]
        split = lookup(rows, state.select(*keys, *bounds), same, bounds).groupBy(*keys).agg(*[
            F.percentile_approx(F.when(within(name), F.col("__v")), grid, 10 * SPLITTERS).alias(of("split", name)) for name in names])
        narrowed = state.join(split, keys)
        for name in names:
            at = F.floor((F.col(of("rank", name)) - F.col(of("before", name))) / F.col(of("inside", name)) * SPLITTERS).cast("int")
            narrowed = narrowed.withColumns({of("low", name): F.get(of("split", name), F.greatest(at - 2, F.lit(0))),
                                             of("high", name): F.get(of("split", name), F.least(at + 2, F.lit(SPLITTERS)))})
        narrowed = cut_lineage(narrowed.select(*keys, "samples", *[of("rank", n) for n in names], *bounds))
        counted = lookup(rows, narrowed.select(*keys, *bounds), same, bounds).groupBy(*keys).agg(*[
            column for name in names for column in (F.count_if(F.col("__v") < F.col(of("low", name))).alias(of("before", name)),
                                                    F.count_if(within(name)).alias(of("inside", name)))])
        state = cut_lineage(narrowed.join(counted, keys))
        before, most = most, widest(state)
        if most >= before:  # equal values only, or fewer samples than splitters
            break
    held = lookup(rows, state.select(*keys, *bounds), same, bounds)
    inside = held.select(*keys, "__v", F.explode(F.array_compact(F.array(*[F.when(within(name), F.lit(name)) for name in names]))).alias("name"))
    values = inside.groupBy(*keys, "name", "__v").agg(F.count(F.lit(1)).alias("__m"))
    upto = Window.partitionBy(*keys, "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    targets = state.select(*keys, "samples", F.explode(F.array(*[F.struct(
        F.lit(name).alias("name"), F.col(of("rank", name)).alias("rank"), F.col(of("before", name)).alias("before")) for name in names])).alias("__t")).select(
        *keys, "samples", "__t.*")
    hit = values.withColumn("__to", F.sum("__m").over(upto)).join(targets, [*keys, "name"]).where(F.col("before") + F.col("__to") >= F.col("rank"))
    return hit.groupBy(*keys, "samples").agg(*[F.min(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in names])


def latency_distribution(samples: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Samples, true median and nearest-rank (ceiling) 95th percentile."""
    n = F.col("samples")
    found = order_statistics(samples, value, keys, {
        "__lower": F.floor((n + 1) / 2), "__upper": F.floor(n / 2) + 1, "p95": F.greatest(F.ceil(n * F.lit("0.95").cast("decimal(3,2)")), F.lit(1))})
    return found.select(*keys, "samples", ((F.col("__lower") + F.col("__upper")) / 2).alias("p50"), "p95")


def report_distribution(samples: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """The upper-element median and the maximum some reports print instead."""
    found = order_statistics(samples, value, keys, {"median": F.floor(F.col("samples") / 2) + 1, "max": F.col("samples")})
    return found.select(*keys, "samples", F.round("median", 2).alias("median"), F.round("max", 2).alias("max"))


def metrics_by_depth(hits: DataFrame, relevant: DataFrame, cases: DataFrame, depths: list[int]) -> DataFrame:
    """recall and MRR of every configuration at every depth, from one set of ranks.

    ``hits`` are (config, query_id, article_id, position), ``relevant`` (query_id,
    article_id). A rank joins the relevant rows once and counts for all depths it is within,
    so a further depth or configuration costs no further search, join or scan. One row per
    case, configuration and depth; a case without relevant articles is not measured.
    """
    first = hits.groupBy("config", "query_id", "article_id").agg(F.min("position").alias("position"))
    order = Window.partitionBy("config", "query_id").orderBy("position")
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(depths))
    pairs = relevant.select("query_id", "article_id").distinct()
    found = ranked.join(pairs, ["query_id", "article_id"]).groupBy("config", "query_id").agg(
        F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= d).alias(f"__{d}") for d in depths])
    grid = cases.select("query_id").crossJoin(F.broadcast(hits.select("config").distinct()))
    rows = grid.join(pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")), "query_id", "left").join(found, ["config", "query_id"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.coalesce(f"__{d}", F.lit(0)).alias("hits")) for d in depths])).alias("d")
    rows = rows.select("config", "query_id", F.coalesce("relevant", F.lit(0)).alias("relevant"), "first", each).select(
        "config", "query_id", "relevant", "first", "d.*")
    measured = F.col("relevant") > 0
    return rows.select("config", "query_id", "depth", measured.alias("measured"), F.when(measured, F.col("hits") / F.col("relevant")).alias("recall"),
                       F.when(measured, F.when(F.col("first") <= F.col("depth"), 1 / F.col("first")).otherwise(0.0)).alias("mrr"))
