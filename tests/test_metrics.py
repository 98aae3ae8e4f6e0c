import math
import random

import numpy as np
from pyspark.sql import functions as F

from lexspan.operators import evaluation, metrics


def hits_of(spark, names):
    return spark.createDataFrame([(0, n, i) for i, n in enumerate(names, 1)], "query_id int, article_id string, position int")


def test_recall_mrr_and_ndcg(spark):
    cases = spark.createDataFrame([(0,), (1,)], "query_id int")
    hits = hits_of(spark, ["a", "a", "b"])
    relevant = spark.createDataFrame([(0, "b")], "query_id int, article_id string")
    rows = {r.query_id: r for r in metrics.recall_mrr(hits, relevant, cases, 2).collect()}
    assert (rows[0].recall_at_k, rows[0].mrr_at_k) == (1.0, 0.5) and (rows[1].recall_at_k, rows[1].mrr_at_k) == (0.0, 0.0)
    shared = {r.query_id: r.recall_at_k for r in metrics.recall_mrr(hits, relevant.select("article_id"), cases, 2).collect()}
    assert shared == {0: 1.0, 1: 0.0}
    grades = spark.createDataFrame([(0, "a", 3), (0, "c", 2)], "query_id int, article_id string, grade int")
    ideal = 7 + 3 / math.log2(3)
    for got in (metrics.ndcg(hits, grades, cases, 5), metrics.ndcg_shared(hits, grades.drop("query_id"), cases, 5)):
        assert abs({r.query_id: r.ndcg_at_k for r in got.collect()}[0] - 7 / ideal) < 1e-12


def test_sufficient_evidence(spark):
    cases = spark.createDataFrame([(0,), (1,)], "query_id int")
    pair = "query_id int, article_id string"
    predicted = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a")], pair)
    reference = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (1, "c")], pair)
    assert metrics.sufficient_evidence_recall(predicted, reference, cases).first().sufficient_evidence_recall == 0.5
    assert metrics.sufficient_evidence_recall(predicted, reference, cases.where("false")).first().sufficient_evidence_recall == 0.0


def test_latency_statistics_are_exact(spark):
    rng = random.Random(1)
    groups = {"four": [1., 2., 3., 4.], "one": [5.], "same": [7.] * 50, "many": [rng.expovariate(.01) for _ in range(3001)],
              "ties": [float(rng.randint(0, 5)) for _ in range(400)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(4)
    for r in metrics.latency_distribution(df, "v", ["k"]).collect():
        ordered = sorted(groups[r.k])
        assert r.samples == len(ordered) and r.p50 == float(np.median(ordered))
        assert r.p95 == ordered[max(0, math.ceil(.95 * len(ordered)) - 1)]


def test_sweep_has_45_settings(spark):
    hits = spark.createDataFrame([(0, "bm25", "a", 1), (0, "dense", "a", 1)], "query_id int, branch string, article_id string, position int")
    rows = evaluation.sweep(hits, spark.createDataFrame([(0,)], "query_id int")).collect()
    assert len(rows) == 45 and {r.achieved_unique_articles for r in rows} == {1} and {r.actual_evidence_articles for r in rows} == {1}


def test_macro_mean_skips_unmeasured(spark):
    df = spark.createDataFrame([(1, .5), (0, 0.)], "relevant int, recall double")
    assert metrics.macro_mean(df, F.col("relevant") > 0, ["recall"]).first().mean_recall == .5
    assert metrics.macro_mean(df, F.col("relevant") > 5, ["recall"]).first().mean_recall is None


def test_case_checks(spark):
    schema = "case_id string, scenario_family_id string, kind string, query string, relevant_article_ids array<string>"
    cases = spark.createDataFrame([("1", "f", "answerable", "q", ["a"]), ("2", "g", "negative", "q", ["a"]), ("3", "h", "ambiguous", "q", ["a"]),
                                   ("4", "i", "odd", "q", []), ("5", "", "negative", "q", [])], schema)
    assert {r.case_id: r.reason for r in evaluation.case_errors(cases).collect()} == {
        "2": "targets_do_not_match_kind", "3": "targets_do_not_match_kind", "4": "schema", "5": "schema"}
    dev = cases.where("case_id = '1'")
    assert {r.case_id for r in evaluation.leaked_targets(cases.where("case_id > '1'"), dev).collect()} == {"2", "3"}
    split = spark.createDataFrame([("f", "dev"), ("f", "heldout"), ("g", "dev")], "scenario_family_id string, split string")
    assert [r.scenario_family_id for r in evaluation.split_violations(split).collect()] == ["f"]


def test_order_statistics_with_outliers_and_hot_values(spark):
    rng = np.random.default_rng(2)
    values = {"wide": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 1e-300]]), "flat": np.full(2000, 7.5),
              "steps": np.repeat(rng.normal(size=40), 50), "one": np.array([3.25])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("wide", None), ("none", None)]
    df = spark.createDataFrame(rows, "kind string, value double").repartition(5)
    for limit in (metrics.ORDER_ROWS, 100):  # the second narrows the ranges in rounds
        n = F.col("samples")
        got = {r.kind: r for r in metrics.order_statistics(df, "value", ["kind"], {"low": F.lit(1), "mid": F.floor(n / 2) + 1, "top": n}, limit).collect()}
        assert got.keys() == values.keys()
        for kind, vs in values.items():
            ordered = np.sort(vs)
            assert (got[kind].samples, got[kind].low, got[kind].mid, got[kind].top) == (len(vs), ordered[0], ordered[len(vs) // 2], ordered[-1])


def test_metrics_by_depth(spark):
    hits = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 1, "x", 3), ("a", 1, "z", 4), ("b", 1, "z", 1), ("b", 2, "q", 1)],
                                 "config string, query_id int, article_id string, position int")
    relevant = spark.createDataFrame([(1, "y"), (1, "z"), (1, "z"), (2, "p")], "query_id int, article_id string")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {(r.config, r.query_id, r.depth): (r.measured, r.recall, r.mrr) for r in metrics.metrics_by_depth(hits, relevant, cases, [1, 2, 3]).collect()}
    assert len(got) == 18 and got["a", 1, 1] == (True, 0.0, 0.0) and got["a", 1, 2] == (True, 0.5, 0.5) and got["a", 1, 3] == (True, 1.0, 0.5)
    assert got["b", 1, 1] == (True, 0.5, 1.0) and got["b", 2, 3] == (True, 0.0, 0.0) and got["a", 3, 3] == (False, None, None)
