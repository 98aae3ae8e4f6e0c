"""BM25 over a table of documents, for one query or for a table of queries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexspan.functions.pieces import pieces
from lexspan.functions.text import tokenize
from lexspan.operators.skew import top_k
from lexspan.session import cut_lineage

K1, B = 1.2, 0.75


def term_frequencies(docs: DataFrame, id_cols: list[str], text: str = "text") -> DataFrame:
    """One row per document: its length and its (term, tf) pairs, computed inside the row.

    Sorting the tokens puts equal terms side by side, so frequencies are run lengths and
    no token leaves its document row.
    """
    n = F.size("__sorted")
    tokens = docs.select(*id_cols, F.sort_array(tokenize(text)).alias("__sorted"))
    starts = F.filter(F.transform("__sorted", lambda term, i: F.struct(term.alias("term"), i.alias("at"))),
                      lambda run: (run["at"] == 0) | (run["term"] != F.get(F.col("__sorted"), run["at"] - 1)))
    runs = tokens.select(*id_cols, n.cast("long").alias("length"), starts.alias("__runs"))
    tf = F.transform("__runs", lambda run, i: F.struct(
        run["term"].alias("term"),
        (F.coalesce(F.get(F.col("__runs"), i + 1)["at"], F.col("length").cast("int")) - run["at"]).cast("long").alias("tf")))
    return runs.select(*id_cols, "length", tf.alias("terms"))


def postings(frequencies: DataFrame, id_cols: list[str]) -> DataFrame:
    """One row per (document, term). The outer form keeps the optimizer from testing the
    pair list in a filter further down, which would compute it once more per token."""
    return frequencies.select(*id_cols, "length", F.explode_outer("terms").alias("p")).select(
        *id_cols, "length", "p.term", "p.tf").where(F.col("term").isNotNull())


def corpus_statistics(frequencies: DataFrame) -> DataFrame:
    """Document count (empty documents included) and mean length, one row."""
    return frequencies.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average_length"))


def document_frequency(posting_rows: DataFrame) -> DataFrame:
    """Documents per term. A posting row is distinct per (document, term)."""
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def inverse_frequency(documents, df) -> Column:
    return F.log(1 + (documents - df + 0.5) / (df + 0.5))


def term_weight(tf, length, average, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(average, F.lit(1.0))))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query") -> DataFrame:
    """Query terms with multiplicity: a repeated term counts as often as it occurs."""
    return (queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(text)).alias("term"))
            .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("repeats")))


# Stands for "every document" among the terms; no token is empty.
EVERY_DOCUMENT = ""

# Distinct terms of a block of queries; rows whose bounds are kept together; Arrow bytes of a task's rows scored at a time.
QUERY_TERMS, BLOCK_ROWS, GROUP_BYTES = 100_000, 128, 8 << 20


def search(docs: DataFrame, queries: DataFrame, k: int, *, id_cols: list[str], text: str = "text",
           query_id: str = "query_id", query: str = "query", k1: float = K1, b: float = B,
           decimals: int | None = None, eligible: Column | None = None) -> DataFrame:
    """Top ``k`` documents per query: query_id, id columns, score, rank. ``eligible`` keeps
    documents out of the ranking but not out of the corpus statistics.

    Every text is tokenised once per block of queries. What a document has of the block's
    terms stays in its row, so scores are complete in the task that holds the row: nothing
    is shuffled by query and document, and each task returns k rows per query. Queries come
    through the driver in blocks of at most ``QUERY_TERMS`` distinct terms.
    """
    kept = docs.withColumn("__ranked", F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)))
    found = None
    for block in _query_blocks(queries, query_id, query):
        hits = _search_block(kept, block, k, id_cols, text, k1, b, decimals, queries.schema[query_id].dataType)
        if hits is not None:
            found = hits if found is None else found.unionAll(hits)
    if found is None:
        kinds = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in id_cols]
        return queries.select(F.col(query_id).alias("query_id"), *kinds, F.lit(0.0).alias("score"), F.lit(1).alias("rank")).where("false")
    return found


def _query_blocks(queries: DataFrame, query_id: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    block, vocabulary = {}, set()
    for row in queries.select(F.col(query_id).alias("name"), tokenize(text).alias("tokens")).toLocalIterator():
        terms = Counter(row["tokens"])
        if block and len(vocabulary) + len(terms) > QUERY_TERMS:
            yield list(block.items())
            block, vocabulary = {}, set()
        block.setdefault(row["name"], Counter()).update(terms)
        vocabulary.update(terms)
    if vocabulary:
        yield list(block.items())


def _restricted(docs: DataFrame, vocabulary: list[str], id_cols: list[str], text: str) -> DataFrame:
    """Of every document its length and what it has of the vocabulary, as numbers of terms and their frequencies."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = term_frequencies(docs, [*id_cols, "__ranked"], text).select(*id_cols, "__ranked", "length", F.col("terms.term").alias("words"), F.col("terms.tf").alias("tfs"))
    schema = T.StructType([*rows.schema.fields[:-2], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(held.value, pa.string())
        for *others, words, tfs in (piece for batch in batches for piece in pieces(tuple(batch.columns))):
            number = pc.index_in(words.flatten(), value_set=known)
            has = pc.is_valid(number)
            before = np.concatenate([[0], np.cumsum(has.to_numpy(zero_copy_only=False))]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy())])
            offsets = pa.array(before[ends], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, values.filter(has)) for values in (number, tfs.flatten())]
            yield pa.RecordBatch.from_arrays([*others, *lists], schema.names)

    return rows.mapInArrow(run, schema)


class BlockMax:
    """The best documents of a task for the queries of a block, by bounds of runs of rows.

    A run's highest weight of each term bounds the score of all its rows. Per query the runs
    are scored from the highest bound on, until the k-th score is above those that are left.
    """

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]], average: float, k: int, k1: float, b: float, decimals: int | None):
        self.queries, self.average, self.k, self.k1, self.b, self.decimals = queries, max(average, 1.0), k, k1, b, decimals
        self.slack = 10.0 ** -decimals if decimals is not None else 1e-9
        self.best: list[list[tuple]] = [[] for _ in queries]
        self.scored = 0  # runs that were not skipped

    def add(self, ids: pa.RecordBatch, lengths: np.ndarray, owners: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        weights = tfs * (self.k1 + 1) / (tfs + self.k1 * (1 - self.b + self.b * lengths[owners] / self.average))
        order = np.argsort(terms, kind="stable")
        terms, owners, weights = terms[order], owners[order], weights[order]
        runs = owners // BLOCK_ROWS
        heads = np.flatnonzero(np.concatenate([[True], (terms[1:] != terms[:-1]) | (runs[1:] != runs[:-1])])) if len(terms) else terms
        most = np.maximum.reduceat(weights, heads) if len(terms) else weights
        head_term, head_run = terms[heads], runs[heads]
        n_runs = len(lengths) // BLOCK_ROWS + 1
        for number, (wanted, factors) in enumerate(self.queries):
            spans = [(slice(*np.searchsorted(terms, (t, t + 1))), slice(*np.searchsorted(head_term, (t, t + 1))), f) for t, f in zip(wanted, factors, strict=True)]
            bounds = np.zeros(n_runs)
            for _, h, f in spans:
                bounds[head_run[h]] += f * most[h]
            by_bound = np.argsort(-bounds, kind="stable")
            by_bound = by_bound[bounds[by_bound] > 0]
            done, step = 0, 4
            while done < len(by_bound):
                take = by_bound[done:done + step]
                take = take[bounds[take] >= self._floor(number) - self.slack]
                if not len(take):
                    break
                inside = np.zeros(n_runs, dtype=bool)
                inside[take] = True
                scores = np.zeros(len(lengths))
                for s, _, f in spans:
                    here = inside[runs[s]]
                    scores[owners[s][here]] += f * weights[s][here]
                self.scored += len(take)
                self._keep(number, scores, ids)
                done, step = done + step, step * 4

    def _floor(self, number: int) -> float:
        best = self.best[number]
        return best[self.k - 1][1] if len(best) >= self.k else 0.0

    def _keep(self, number: int, scores: np.ndarray, ids: pa.RecordBatch) -> None:
        shown = scores if self.decimals is None else np.round(scores, self.decimals)
        rows = np.flatnonzero((shown > 0) & (shown >= self._floor(number)))
        if len(rows) > self.k:  # equal scores stay until the ids decide
            rows = rows[shown[rows] >= np.partition(shown[rows], len(rows) - self.k)[len(rows) - self.k]]
        keys = zip(*(column.to_pylist() for column in ids.take(pa.array(rows)).columns), strict=True)
        new = [(float(-shown[r]), float(shown[r]), tuple((v is not None, v) for v in key), float(scores[r]), key) for r, key in zip(rows, keys, strict=True)]
        self.best[number] = sorted(self.best[number] + new, key=lambda hit: hit[::2][:2])[:self.k]


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], k: int, id_cols: list[str], text: str, k1: float, b: float,
                  decimals: int | None, query_type: T.DataType) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = sorted({term for _, terms in block for term in terms})
    table = cut_lineage(_restricted(docs, vocabulary, id_cols, text))
    total = table.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average")).first()
    if not total["documents"]:
        return None
    held_by = np.zeros(len(vocabulary))
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
        held_by[row["term"]] = row["n"]
    idf = np.log(1 + (total["documents"] - held_by + 0.5) / (held_by + 0.5))
    number = {term: n for n, term in enumerate(vocabulary)}
    weighed = []
    for _, terms in block:
        own = np.array([number[t] for t in terms], dtype=np.int64)
        weighed.append((own, np.array(list(terms.values()), dtype=float) * idf[own]))
    held = spark.sparkContext.broadcast((weighed, total["average"], k, k1, b, decimals))
    schema = T.StructType([T.StructField("__query", T.IntegerType()), *[docs.schema[c] for c in id_cols], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search_ = BlockMax(*held.value)
        names = None
        for whole in batches:
            for columns in pieces(tuple(whole.columns), GROUP_BYTES):
                batch = pa.RecordBatch.from_arrays(list(columns), schema=whole.schema)
                names = names or [batch.schema.field(c).type for c in id_cols]
                owners = np.repeat(np.arange(batch.num_rows), batch.column("terms").value_lengths().to_numpy())
                search_.add(batch.select(id_cols), batch.column("length").to_numpy(), owners, batch.column("terms").flatten().to_numpy(),
                            batch.column("tfs").flatten().to_numpy())
        hits = [(n, *hit[4], hit[3]) for n, best in enumerate(search_.best) for hit in best]
        if hits:
            columns = list(zip(*hits, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *names, pa.float64()], strict=True)], schema.names)

    hits = table.where("__ranked").select(*id_cols, "length", "terms", "tfs").mapInArrow(run, schema)
    if decimals is not None:
        hits = hits.withColumn("score", F.round("score", decimals))
    names = spark.createDataFrame([(n, name) for n, (name, _) in enumerate(block)], T.StructType([T.StructField("__query", T.IntegerType()), T.StructField("query_id", query_type)]))
    best = top_k(hits.where("score <> 0"), ["__query"], [F.desc("score"), *[F.asc(c) for c in id_cols]], k)
    return best.join(names, "__query").select("query_id", *id_cols, "score", "rank")


def postings_with_total(frequencies: DataFrame, id_cols: list[str]) -> DataFrame:
    """Posting rows plus one row per document under the empty term, so that corpus size
    and mean length come out of the same pass as document frequencies."""
    every = F.array(F.struct(F.lit(EVERY_DOCUMENT).alias("term"), F.lit(1).cast("long").alias("tf")))
    return frequencies.select(*id_cols, "length", F.explode_outer(F.concat(F.col("terms"), every)).alias("p")).select(
        *id_cols, "length", "p.term", "p.tf")


def _search_postings(posting_rows: DataFrame, queries: DataFrame, k: int, id_cols: list[str], query_id: str, query: str,
                     k1: float, b: float, decimals: int | None) -> DataFrame:
    """Two passes over the postings of the query vocabulary: statistics, then scores. The
    vocabulary filters before anything is shuffled."""
    terms = cut_lineage(query_terms(queries, query_id, query))
    every = terms.sparkSession.createDataFrame([(EVERY_DOCUMENT,)], "term string")
    vocabulary = terms.select("term").distinct().unionByName(every)
    statistics = cut_lineage(posting_rows.join(vocabulary, "term", "left_semi").groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("length").alias("total_length")))
    corpus = statistics.where(F.col("term") == EVERY_DOCUMENT).select(
        F.col("df").alias("documents"), (F.col("total_length") / F.col("df")).alias("average_length"))
    weights = terms.join(statistics, "term").crossJoin(corpus).select(
        "query_id", "term", "average_length",
        (F.col("repeats") * inverse_frequency(F.col("documents"), F.col("df"))).alias("idf"))
    weight = F.col("idf") * term_weight(F.col("tf"), F.col("length"), F.col("average_length"), k1, b)
    scored = (posting_rows.join(weights, "term").groupBy("query_id", *id_cols)
              .agg(F.sum(weight).alias("score")).where(F.col("score") != 0))
    if decimals is not None:
        scored = scored.withColumn("score", F.round("score", decimals))
    return top_k(scored, ["query_id"], [F.desc("score"), *[F.asc(c) for c in id_cols]], k)


def write_index(docs: DataFrame, path: str, *, id_cols: list[str], text: str = "text") -> None:
    """Postings as a table ordered by term and document, so that a query reads only the
    row groups of its terms. Ranges include the ids: a very common term spans many files."""
    rows = postings_with_total(term_frequencies(docs, id_cols, text), id_cols)
    rows.repartitionByRange("term", *id_cols).sortWithinPartitions("term", *id_cols).write.mode("errorifexists").parquet(path)


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int, *, id_cols: list[str],
                 query_id: str = "query_id", query: str = "query", k1: float = K1, b: float = B,
                 decimals: int | None = None) -> DataFrame:
    return _search_postings(spark.read.parquet(path), queries, k, id_cols, query_id, query, k1, b, decimals)


def search_terms(docs: DataFrame, terms: list[str], k: int, *, id_cols: list[str], text: str = "text",
                 k1: float = K1, b: float = B, decimals: int | None = None) -> DataFrame:
    """Top ``k`` documents for one short query given as its term list.

    Frequencies are counted per row and the statistics are one small aggregate, so the
    plan is two scans and a take-ordered: no shuffle carries documents.
    """
    distinct = list(dict.fromkeys(terms))
    tokens = docs.select(*id_cols, tokenize(text).alias("__tokens"))
    counts = tokens.select(*id_cols, F.size("__tokens").cast("long").alias("length"), *[
        _occurrences(F.col("__tokens"), term).alias(f"__tf{i}") for i, term in enumerate(distinct)])
    stats = counts.agg(F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average_length"),
                       *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(distinct))])
    parts = [terms.count(term) * inverse_frequency(F.col("documents"), F.col(f"__df{i}"))
             * term_weight(F.col(f"__tf{i}"), F.col("length"), F.col("average_length"), k1, b)
             for i, term in enumerate(distinct)]
    # No filter on the frequencies: it would move below them and tokenise every text again.
    scored = counts.crossJoin(F.broadcast(stats))
    score = sum(parts[1:], parts[0])
    scored = scored.select(*id_cols, (F.round(score, decimals) if decimals is not None else score).alias("score"))
    return scored.where("score <> 0").orderBy(F.desc("score"), *id_cols).limit(k)


def _occurrences(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda token: token == F.lit(term))).cast("long")
