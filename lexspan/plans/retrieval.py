"""Search, fusion and evidence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.functions.text import tokenize
from lexspan.operators import bm25, dense, fusion, retriever
from lexspan.plans.registry import query
from lexspan.plans.tables import queries_from_benchmark, spread, sql_tokens, table
from lexspan.session import cut_lineage

FLAGSHIP_TERMS = ["the", "and", "tion", "the"]
DEPTH, TOP = 30, 10

# BM25 of every benchmark item over all documents, as common table expressions.
BM25_SQL = f"""tok AS (SELECT doc_id, {sql_tokens('text')} toks FROM documents),
len AS (SELECT doc_id, len(toks) dl FROM tok),
tf AS (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest(toks) term FROM tok) GROUP BY ALL),
stat AS (SELECT count(*) n, greatest(avg(dl), 1) avgdl FROM len),
df AS (SELECT term, count(*) df FROM tf GROUP BY term),
qt AS (SELECT item_id query_id, term, count(*) qtf
       FROM (SELECT item_id, unnest({sql_tokens('text')}) term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
              / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
       FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN len USING (doc_id), stat GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM bm WHERE score <> 0)"""

# Inner products of the benchmark items' vectors (the vectors with their ids) with all vectors.
DENSE_SQL = """qv AS (SELECT item_id query_id, CAST(embedding AS DOUBLE[]) qe FROM benchmark JOIN embeddings ON vec_id = item_id),
de AS (SELECT query_id, vec_id doc_id, round(list_dot_product(qe, CAST(embedding AS DOUBLE[])), 6) score FROM qv, embeddings),
der AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM de)"""

HYBRID_SQL = f"""{BM25_SQL}, {DENSE_SQL},
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) rrf
       FROM (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= {DEPTH}
             UNION ALL SELECT query_id, doc_id, rank FROM der WHERE rank <= {DEPTH}) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, CAST(doc_id AS VARCHAR)) rank FROM fu)"""


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def _query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    return items.join(table(spark, folder, "embeddings"), F.col("vec_id") == F.col("query_id")).select(
        "query_id", F.col("embedding").alias("query_vector"))


def sparse_hits(spark: SparkSession, folder: str, k: int = DEPTH) -> DataFrame:
    return bm25.search(_documents(spark, folder), queries_from_benchmark(spark, folder), k, id_cols=["doc_id"], decimals=6)


def dense_hits(spark: SparkSession, folder: str, k: int = DEPTH) -> DataFrame:
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return dense.search(points, _query_vectors(spark, folder), k, id_cols=["doc_id"], decimals=6)


def as_branch(hits: DataFrame, branch: str) -> DataFrame:
    return hits.select("query_id", F.lit(branch).alias("branch"), F.col("doc_id").cast("string").alias("article_id"),
                       F.lit(None).cast("string").alias("child_id"), "score", F.col("rank").alias("position"))


def hybrid(spark: SparkSession, folder: str) -> DataFrame:
    hits = as_branch(sparse_hits(spark, folder), "bm25").unionByName(as_branch(dense_hits(spark, folder), "dense"))
    return fusion.rrf_fuse(hits, ["bm25", "dense"], decimals=9)


@query(f"""WITH tok AS (SELECT doc_id, {sql_tokens('text')} toks FROM documents),
stat AS (SELECT count(*) n, greatest(avg(len(toks)), 1) avgdl FROM tok),
tf AS (SELECT doc_id, any_value(len(toks)) dl, term, count(*) tf FROM (SELECT doc_id, toks, unnest(toks) term FROM tok)
       GROUP BY doc_id, term),
df AS (SELECT term, count(*) df FROM tf GROUP BY term),
q(term) AS (VALUES {', '.join(f"('{t}')" for t in FLAGSHIP_TERMS)})
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
FROM q JOIN df USING (term) JOIN tf USING (term), stat GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return bm25.search_terms(_documents(spark, folder), FLAGSHIP_TERMS, 20, id_cols=["doc_id"], decimals=6)


@query(f"""WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= {TOP}""")
def bm25_multi_query(spark: SparkSession, folder: str) -> DataFrame:
    return sparse_hits(spark, folder, TOP).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM25_SQL} SELECT term, df, n AS documents, round(avgdl, 6) average_length,
round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf FROM df, stat""")
def bm25_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    frequencies = bm25.term_frequencies(_documents(spark, folder), ["doc_id"])
    stats = bm25.corpus_statistics(_documents(spark, folder).select(F.size(bm25.tokenize("text")).alias("length")))
    return bm25.document_frequency(bm25.postings(frequencies, ["doc_id"])).crossJoin(F.broadcast(stats)).select(
        "term", "df", "documents", F.round("average_length", 6).alias("average_length"),
        F.round(bm25.inverse_frequency(F.col("documents"), F.col("df")), 6).alias("idf"))


@query(f"""WITH {DENSE_SQL} SELECT query_id, doc_id, score, rank FROM der WHERE rank <= {TOP}""")
def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    return dense_hits(spark, folder, TOP).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT label query_id, list(v ORDER BY i) qe FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) v
FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_dot_product(qe, CAST(embedding AS DOUBLE[])), 6) score FROM c, embeddings WHERE label = query_id)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
WHERE query_id = 3 AND rank <= 10""")
def dense_filtered_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Points of one label nearest to that label's mean: the filter comes before the cut."""
    points = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    means = dense.centroids(points, "label").where("query_id = 3")
    return dense.search(points, means, 10, id_cols=["vec_id"], where=F.col("label") == 3, decimals=6).select(
        "query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""WITH c AS (SELECT label query_id, list(v ORDER BY i) qe FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) v
FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT query_id, vec_id, round(list_dot_product(qe, CAST(embedding AS DOUBLE[])), 6) score FROM c, embeddings)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM s)
WHERE rank <= 10""")
def dense_centroid_topk(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    return dense.search(points, dense.centroids(points, "label"), 10, id_cols=["vec_id"], decimals=6).select(
        "query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AS valid,
round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) length FROM embeddings""")
def vector_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", dense.is_valid_vector("embedding", 64).alias("valid"),
                       F.round(F.sqrt(dense.dot("embedding", "embedding")), 6).alias("length"))


@query(f"""WITH {HYBRID_SQL} SELECT query_id, CAST(doc_id AS VARCHAR) article_id, rrf rrf_score, rank FROM fr WHERE rank <= {TOP}""")
def rrf_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid(spark, folder).where(F.col("rank") <= TOP).select(
        "query_id", "article_id", "rrf_score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {BM25_SQL}, {DENSE_SQL},
b0 AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) score
       FROM qt JOIN df USING (term) JOIN tf USING (term), stat GROUP BY ALL),
b0r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM b0 WHERE score <> 0),
u AS (SELECT 'bm25' branch, query_id, doc_id, rank, score FROM bmr WHERE rank <= {DEPTH}
      UNION ALL SELECT 'dense', query_id, doc_id, rank, score FROM der WHERE rank <= {DEPTH}
      UNION ALL SELECT 'flat', query_id, doc_id, rank, score FROM b0r WHERE rank <= {DEPTH})
SELECT query_id, CAST(doc_id AS VARCHAR) article_id, round(sum(1.0 / (60 + rank)), 9) rrf_score,
string_agg(branch || ':' || rank, '|' ORDER BY branch) branches FROM u GROUP BY query_id, doc_id""")
def rrf_three_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of BM25, vectors and BM25 without length normalisation, with branch ranks."""
    flat = bm25.search(_documents(spark, folder), queries_from_benchmark(spark, folder), DEPTH, id_cols=["doc_id"], b=0.0, decimals=6)
    hits = as_branch(sparse_hits(spark, folder), "bm25").unionByName(as_branch(dense_hits(spark, folder), "dense")).unionByName(
        as_branch(flat, "flat"))
    fused = fusion.rrf_fuse(hits, ["bm25", "dense", "flat"], decimals=9)
    shown = F.transform(F.array_sort(F.map_entries("branches")), lambda e: F.concat_ws(":", e["key"], e["value"]["rank"].cast("string")))
    return fused.select("query_id", "article_id", "rrf_score", F.array_join(shown, "|").alias("branches"))


def overlap_score(query_col: str, text_col: str):
    """Stand-in for a cross-encoder: share of the query's distinct tokens in the text."""
    wanted = F.array_distinct(tokenize(query_col))
    return F.round(F.size(F.array_intersect(wanted, tokenize(text_col))) / F.greatest(F.size(wanted), F.lit(1)), 9)


@query(f"""WITH {HYBRID_SQL}, c AS (SELECT fr.query_id, CAST(fr.doc_id AS VARCHAR) article_id, fr.rrf rrf_score,
list_distinct({sql_tokens('b.text')}) qt, list_distinct({sql_tokens('d.text')}) dt
FROM fr JOIN benchmark b ON b.item_id = fr.query_id JOIN documents d ON d.doc_id = fr.doc_id WHERE rank <= 20),
r AS (SELECT query_id, article_id, rrf_score, round(len(list_intersect(qt, dt)) / greatest(len(qt), 1), 9) rerank_score FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, article_id) rerank_rank FROM r)
SELECT query_id, article_id, rrf_score, rerank_score, rerank_rank FROM e WHERE rerank_rank <= 5""")
def rerank_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """First 20 fused documents, reranked by a scorer, first 5 as evidence."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("article_id"), "text")
    few = cut_lineage(hybrid(spark, folder).where(F.col("rank") <= 20).select("query_id", "article_id", "rrf_score"))
    rows = texts.join(few, "article_id").join(queries_from_benchmark(spark, folder), "query_id")
    ranked = fusion.rerank(rows, overlap_score("query", "text")).select("query_id", "article_id", "rrf_score", "rerank_score")
    return fusion.select_evidence(ranked, 5).select("query_id", "article_id", "rrf_score", "rerank_score",
                                                    F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query(f"""WITH {BM25_SQL}, g AS (SELECT query_id, source article_id, max(score) score,
string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY score DESC, CAST(doc_id AS VARCHAR)) children
FROM (SELECT * FROM bmr JOIN documents USING (doc_id) WHERE rank <= {DEPTH}) GROUP BY ALL)
SELECT query_id, article_id, score, children, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, article_id) rank FROM g""")
def grouped_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Document hits grouped to their source, as passages are grouped to articles."""
    sources = table(spark, folder, "documents").select("doc_id", F.col("source").alias("article_id"))
    hits = sources.join(cut_lineage(sparse_hits(spark, folder)), "doc_id").select(
        "query_id", "article_id", F.col("doc_id").cast("string").alias("child_id"), "score", F.col("rank").alias("position"))
    return fusion.group_article_hits(hits, ["query_id"]).select(
        "query_id", "article_id", "score", F.array_join("matched_child_ids", "|").alias("children"), F.col("rank").cast("long").alias("rank"))


# Two documents make an article; every seventeenth article is not in the catalogue.
COMPOSED_DAY = 729_390

_LEGAL_SQL = """{id} % 5 <> 0 AND {id} % 7 <> 0 AND {id} % 11 <> 0 AND 729000 + {id} % 300 <= 729390 AND 729600 + {id} % 300 >= 729390
AND NOT ({id} % 13 = 0 AND {id} % 3 <> 0) AND ({id} % 3 = 0 OR 729200 + {id} % 300 + {id} % 200 > 729390)"""


def _composed_sql(where: str, depth: int) -> str:
    return f"""{BM25_SQL}, {DENSE_SQL},
articles AS (SELECT 'a' || doc_id // 2 article_id, text canonical_text FROM documents WHERE doc_id % 2 = 0 AND doc_id // 2 % 17 <> 3),
listed AS (SELECT 'bm25' branch, query_id, doc_id, score FROM bm WHERE score <> 0 UNION ALL SELECT 'dense', query_id, doc_id, score FROM de),
hits AS (SELECT branch, query_id, 'a' || doc_id // 2 article_id, CAST(doc_id AS VARCHAR) child_id, score,
  row_number() OVER (PARTITION BY branch, query_id ORDER BY score DESC, 'a' || doc_id // 2, CAST(doc_id AS VARCHAR)) position FROM listed WHERE {where} QUALIFY position <= {depth}),
grouped AS (SELECT branch, query_id, article_id, max(score) best FROM hits GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY branch, query_id ORDER BY best DESC, article_id) rank FROM grouped),
fused AS (SELECT query_id, article_id, sum(1.0 / (60 + rank) ORDER BY branch) rrf_score FROM places GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, article_id) place FROM fused),
children AS (SELECT query_id, article_id, array_to_string(list_sort(list_distinct(list(child_id))), '|') children FROM hits GROUP BY ALL)"""


def _with_law(rows: DataFrame, number: str) -> DataFrame:
    """Article and child ids, and legal fields that follow from a number, so that each rule decides somewhere."""
    n = F.col(number)
    start = F.lit(729_000) + n % 300
    return rows.withColumns({
        "article_id": F.concat(F.lit("a"), F.floor(n / 2).cast("string")), "child_id": n.cast("string"),
        "pham_vi": F.when(n % 5 != 0, "Trung ương").otherwise("Tỉnh"), "reviewed_status": F.when(n % 7 != 0, "reviewed").otherwise("draft"),
        "central_eligible": n % 11 != 0, "effective_from_day": start, "reviewed_through_day": start + 600,
        "effective_to_day": F.when(n % 3 != 0, start + 200 + n % 200), "reviewed_open_ended": (n % 3 == 0) | (n % 13 == 0)})


def _composed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    passages = _with_law(_documents(spark, folder), "doc_id")
    points = _with_law(table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector")), "vec_id")
    articles = table(spark, folder, "documents").where("doc_id % 2 = 0 AND doc_id div 2 % 17 <> 3").select(
        F.concat(F.lit("a"), F.floor(F.col("doc_id") / 2).cast("string")).alias("article_id"), F.col("text").alias("canonical_text"))
    return passages, points, articles, queries_from_benchmark(spark, folder), _query_vectors(spark, folder)


@query(f"""WITH {_composed_sql('true', 30)}, kept AS (SELECT * FROM ranked JOIN articles USING (article_id)),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, article_id) evidence_rank FROM kept)
SELECT query_id, article_id, round(rrf_score, 9) rrf_score, children, evidence_rank FROM e JOIN children USING (query_id, article_id) WHERE evidence_rank <= 5""")
def corpus_search(spark: SparkSession, folder: str) -> DataFrame:
    """Passages and vectors fused to articles of the catalogue, five as evidence."""
    found = retriever.corpus_search(*_composed(spark, folder), decimals=6)["evidence"]
    return found.select("query_id", "article_id", F.round("rrf_score", 9).alias("rrf_score"), F.array_join("matched_child_ids", "|").alias("children"),
                        F.col("evidence_rank").cast("long").alias("evidence_rank"))


@query(f"""WITH {_composed_sql(_LEGAL_SQL.format(id='doc_id'), 20)},
c AS (SELECT r.query_id, r.article_id, rrf_score, list_distinct({sql_tokens('b.text')}) qt, list_distinct({sql_tokens('a.canonical_text')}) dt
  FROM ranked r JOIN articles a USING (article_id) JOIN benchmark b ON b.item_id = r.query_id WHERE place <= 20),
s AS (SELECT query_id, article_id, rrf_score, round(len(list_intersect(qt, dt)) / greatest(len(qt), 1), 9) rerank_score FROM c),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, article_id) rerank_rank FROM s)
SELECT query_id, article_id, round(rrf_score, 9) rrf_score, rerank_score, rerank_rank, children FROM e JOIN children USING (query_id, article_id) WHERE rerank_rank <= 5""")
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same over what is in force on a day, open ends included, with a scorer."""
    found = retriever.hybrid_search(*_composed(spark, folder), COMPOSED_DAY, include_open_ended=True, decimals=6,
                                    rerank=overlap_score("query", "canonical_text"))["evidence"]
    return found.select("query_id", "article_id", F.round("rrf_score", 9).alias("rrf_score"), "rerank_score",
                        F.col("rerank_rank").cast("long").alias("rerank_rank"), F.array_join("matched_child_ids", "|").alias("children"))
