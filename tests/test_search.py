import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.operators import bm25, dense, fusion, retriever, skew

WORDS = "thử việc hợp đồng lao động nghỉ phép giờ làm the and Straße".split()


def brute_bm25(docs, query, k):
    toks = {d: re.findall(r"[\wÀ-ỹ]+", t.casefold()) for d, t in docs}
    average = sum(map(len, toks.values())) / len(toks)
    df = Counter(t for words in toks.values() for t in set(words))
    scores = {}
    for d, words in toks.items():
        tf = Counter(words)
        scores[d] = sum(math.log(1 + (len(docs) - df[t] + .5) / (df[t] + .5)) * tf[t] * 2.2
                        / (tf[t] + 1.2 * (.25 + .75 * len(words) / max(average, 1)))
                        for t in re.findall(r"[\wÀ-ỹ]+", query.casefold()) if t in tf)
    kept = [(d, round(s, 6)) for d, s in scores.items() if s]
    return sorted(kept, key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    queries = [(0, "thử việc"), (1, "the the lao"), (2, "strasse NGHỈ"), (3, "absent")]
    return docs, queries, spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(queries, "query_id int, query string")


def test_bm25_equals_brute_force(spark, corpus, tmp_path):
    docs, queries, df, qs = corpus
    expected = {q: brute_bm25(docs, text, 7) for q, text in queries}
    bm25.write_index(df, str(tmp_path / "index"), id_cols=["id"])
    for hits in (bm25.search(df, qs, 7, id_cols=["id"], decimals=6),
                 bm25.search_index(spark, str(tmp_path / "index"), qs, 7, id_cols=["id"], decimals=6)):
        got = {}
        for row in sorted(hits.collect(), key=lambda r: r.rank):
            got.setdefault(row.query_id, []).append((row.id, row.score))
        assert got == {q: rows for q, rows in expected.items() if rows}
    single = bm25.search_terms(df, ["the", "the", "lao"], 7, id_cols=["id"], decimals=6).collect()
    assert [(r.id, r.score) for r in single] == expected[1]


def test_bm25_shuffles_no_pairs_and_skips_runs(monkeypatch, spark, corpus):
    docs, queries, df, qs = corpus
    plain = sorted(map(tuple, bm25.search(df, qs, 3, id_cols=["id"], decimals=6).collect()))
    hits = bm25.search(df, qs, 3, id_cols=["id"], decimals=6)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__query" in plan and "hashpartitioning(query_id" not in plan and "HashAggregate" not in plan
    # Small blocks of queries and runs of rows change nothing; null ids and texts are rows as well.
    for name, value in (("QUERY_TERMS", 2), ("BLOCK_ROWS", 2)):
        monkeypatch.setattr(bm25, name, value)
    assert sorted(map(tuple, bm25.search(df, qs, 3, id_cols=["id"], decimals=6).collect())) == plain
    odd = spark.createDataFrame([(None, "x y"), ("b", "x y"), ("a", "x y"), ("a", None), ("c", "")], "id string, text string")
    one = spark.createDataFrame([("q", "x z x"), ("none", "zz"), (None, None)], "query_id string, query string")
    found = [(r.query_id, r.id, r.rank) for r in bm25.search(odd, one, 3, id_cols=["id"]).orderBy("rank").collect()]
    assert found == [("q", None, 1), ("q", "a", 2), ("q", "b", 3)]
    assert bm25.search(odd.where("false"), one, 3, id_cols=["id"]).count() == 0 and bm25.search(odd, one.where("false"), 3, id_cols=["id"]).count() == 0


def test_block_bounds_end_early():
    rng = np.random.default_rng(8)
    rows, terms = 4096, 40
    owners = np.repeat(np.arange(rows), 5)
    numbers = np.concatenate([(row // 128 * 6 + rng.choice(6, 5, replace=False)) % terms for row in range(rows)])
    tfs = np.where(owners < 256, 9, 1)  # the best rows stand together
    ids = pa.RecordBatch.from_arrays([pa.array(range(rows))], ["id"])
    factors = rng.random(terms) + 1
    search = bm25.BlockMax([(np.arange(terms), factors)], 5.0, 4, 1.2, 0.75, 6)
    search.add(ids, np.full(rows, 5), owners, numbers, tfs)
    weight = tfs * 2.2 / (tfs + 1.2)
    scores = np.bincount(owners, factors[numbers] * weight, rows)
    assert [hit[4][0] for hit in search.best[0]] == sorted(range(rows), key=lambda r: (-round(scores[r], 6), r))[:4]
    assert search.scored < rows // bm25.BLOCK_ROWS / 2


def test_eligible_rows_fill_the_list(spark):
    docs = spark.createDataFrame([(i, "x " * (9 - i), i >= 5) for i in range(9)], "id int, text string, ok boolean")
    qs = spark.createDataFrame([(0, "x")], "query_id int, query string")
    assert [r.id for r in bm25.search(docs, qs, 2, id_cols=["id"], eligible=F.col("ok")).collect()][0] >= 5
    assert bm25.search(docs, qs, 2, id_cols=["id"], eligible=F.col("ok")).count() == 2


def test_dense_equals_numpy_in_blocks(spark):
    rng = np.random.default_rng(0)
    points, queries = rng.normal(size=(80, 6)), rng.normal(size=(5, 6))
    points[10] = points[20]
    df = spark.createDataFrame([(i, p.tolist(), i % 2) for i, p in enumerate(points)], "id int, vector array<double>, side int").repartition(4)
    qs = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id int, query_vector array<double>")
    scores = np.round(points @ queries.T, 6)
    for block, where in ((2048, None), (2, None), (2048, F.col("side") == 1)):
        hits = dense.search(df, qs, 9, id_cols=["id"], decimals=6, block=block, where=where, pass_bytes=1 << 20 if block > 2 else 100)
        got = {(r.query_id, r.rank): (r.id, r.score) for r in hits.collect()}
        for q in range(5):
            ids = [i for i in range(80) if where is None or i % 2]
            order = sorted(ids, key=lambda i: (-scores[i, q], i))[:9]
            assert [got[(q, n)] for n in range(1, 10)] == [(i, scores[i, q]) for i in order]
    one = dense.search_vector(df, queries[0].tolist(), 3, id_cols=["id"], decimals=6).collect()
    assert [r.id for r in one] == sorted(range(80), key=lambda i: (-scores[i, 0], i))[:3]


HIT = "query_id int, branch string, article_id string, child_id string, score double, position int"


def test_grouping_fusion_and_evidence(spark):
    hits = spark.createDataFrame([(0, "b", "a", "a1", .2, 1), (0, "b", "b", "b1", .8, 2), (0, "b", "a", "a2", .9, 3), (0, "b", "a", "a1", .95, 4)], HIT)
    rows = fusion.group_article_hits(hits, ["query_id"]).orderBy("rank").collect()
    assert [(r.article_id, r.score, r.matched_child_ids) for r in rows] == [("a", .95, ["a2", "a1"]), ("b", .8, ["b1"])]
    swapped = spark.createDataFrame([(0, "x", "a", None, 2., 1), (0, "x", "b", None, 1., 2), (0, "y", "b", None, 2., 1), (0, "y", "a", None, 1., 2)], HIT)
    fused = fusion.rrf_fuse(swapped, ["x", "y"]).orderBy("rank").collect()
    assert fused[0].rrf_score == fused[1].rrf_score == 1 / 61 + 1 / 62 and [r.article_id for r in fused] == ["a", "b"]
    assert fused[0].branches["y"].rank == 2
    repeated = spark.createDataFrame([(0, "x", "a", None, 3., 1), (0, "x", "a", None, 2., 2), (0, "x", "b", None, 1., 3)], HIT)
    assert {r.article_id: r.rrf_score for r in fusion.rrf_fuse(repeated, ["x"]).collect()} == {"a": 1 / 61, "b": 1 / 63}
    ranked = fusion.rerank(fusion.rrf_fuse(swapped, ["x", "y"]), F.when(F.col("article_id") == "b", 2.0).otherwise(1.0))
    best = fusion.select_evidence(ranked, 1).collect()
    assert [(r.article_id, r.rerank_rank) for r in best] == [("b", 1)]
    assert fusion.select_evidence(ranked, 0).count() == 0
    with pytest.raises(Exception, match="no rerank score"):
        fusion.rerank(ranked.drop("rerank_score"), F.lit(None).cast("double")).collect()


def test_composed_searches(spark):
    rows = [("a", "a1", "thử việc hai tháng", [1.0, 0.0], 10, 20), ("b", "b1", "nghỉ phép năm", [0.0, 1.0], 10, 20), ("c", "c1", "thử việc", [.9, .1], 10, 12)]
    df = spark.createDataFrame(rows, "article_id string, child_id string, text string, vector array<double>, effective_from_day int, effective_to_day int")
    df = df.withColumns({"pham_vi": F.lit("Trung ương"), "reviewed_status": F.lit("reviewed"), "central_eligible": F.lit(True),
                         "reviewed_through_day": F.lit(99), "reviewed_open_ended": F.lit(False)})
    articles = df.select("article_id", F.col("text").alias("canonical_text"))
    qs = spark.createDataFrame([(0, "thử việc", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    out = retriever.corpus_search(df, df, articles, qs.select("query_id", "query"), qs.select("query_id", "query_vector"), evidence_cap=2)
    assert [r.article_id for r in out["evidence"].orderBy("evidence_rank").collect()] == ["a", "c"]
    assert out["evidence"].count() == 2 and out["fused"].count() == 3
    legal = retriever.hybrid_search(df, df, articles, qs.select("query_id", "query"), qs.select("query_id", "query_vector"), 15, evidence_cap=3)
    assert {r.article_id for r in legal["evidence"].collect()} == {"a", "b"}
    assert [r.article_id for r in legal["sparse"].collect()] == ["a"]


@pytest.mark.parametrize("most", [skew.MOST_HOT, 2])
def test_skewed_joins_agree_with_plain_ones(spark, monkeypatch, most):
    monkeypatch.setattr(skew, "MOST_HOT", most)
    rows = [(i, "hot" if i % 3 == 0 else ("ghost" if i % 5 == 0 else (None if i % 7 == 0 else f"k{i % 11}"))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, key string").repartition(4)
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 10 + i) for i in range(11)], "name string, value int")
    expected = {r.id: r.value for r in df.join(dim, df.key == dim.name, "left").collect()}
    counts = Counter(k for _, k in rows)
    for hot in (1, 20, 10**6):
        assert {r.id: r.value for r in skew.lookup(df, dim, {"key": "name"}, ["value"], hot).collect()} == expected
        sizes = {r.id: r.n for r in skew.attach_group_size(df, ["key"], "n", hot).collect()}
        assert sizes == {i: (counts[k] if k is not None and counts[k] > 1 else None) for i, k in rows}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.lookup(df, dim, {"key": "name"}, ["value"], 20)._jdf.queryExecution().toString()
        assert "hashpartitioning(key" in plan and "__spread" in plan.split("hashpartitioning(key", 1)[1].split(")")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
