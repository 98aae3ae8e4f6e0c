"""Ranked lexical search by presence masks (operator 11).

Two passes for each block of items. The first reads every whole text once, keeps of each
document the terms that occur in the block's items, and writes them as arrays in the row;
statistics over all documents follow from that table. The second scores documents in
groups of some thousands:

* a term is a bitmap over the documents of the group, and its best contribution to any of
  them is known exactly;
* an item's bitmaps, transposed, give every document its mask of matched terms; documents
  with equal masks are one set, whose score is at most the sum of its terms' best
  contributions;
* sets are evaluated by descending bound until the item's k-th best score so far is above
  all bounds that are left. Scores of a task go on from group to group, so later groups end
  sooner, and a task returns k rows per item at most.

Items stream through the driver in blocks of at most ``BLOCK_TERMS`` distinct terms (a
longer item is a block of its own), so neither the driver nor a task ever holds them all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexspan.llm.common import cut_lineage

BLOCK_TERMS = 100_000
BITMAP_BYTES, GROUP_ROWS, GROUP_POSTINGS = 1 << 24, 1 << 13, 1 << 20  # of a group of documents
LONG_TEXT = 1 << 22

# Separators become spaces, capital ASCII letters small ones; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
HITS = "item int, doc_id long, score long"


def count_terms(text: bytes) -> Counter:
    """Occurrences of each term of a whole text, long ones a stretch at a time."""
    folded = text.translate(_FOLD)
    if len(folded) <= LONG_TEXT:
        return Counter(folded.split())
    found, at = Counter(), 0
    while at < len(folded):
        end = folded.find(b" ", at + LONG_TEXT)
        end = len(folded) if end < 0 else end
        found.update(folded[at:end].split())
        at = end
    return found


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, Counter]]]:
    block, vocabulary = [], set()
    for row in items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).toLocalIterator():
        terms = count_terms(row["text"].encode())
        if block and len(vocabulary) + len(terms) > BLOCK_TERMS:
            yield block
            block, vocabulary = [], set()
        block.append((row["item_id"], terms))
        vocabulary.update(terms)
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Of every document its number of terms, and the vocabulary's terms with their occurrences."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                totals, terms, counts = [], [], []
                for text in batch.column("text").to_pylist():
                    found = count_terms(text)
                    own = sorted((number, n) for term, n in found.items() if (number := held.value.get(term)) is not None)
                    totals.append(found.total())
                    terms.append([number for number, _ in own])
                    counts.append([n for _, n in own])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                                  pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    return texts.mapInArrow(run, POSTINGS)


def _muldiv(a: np.ndarray, b: int, c: int) -> np.ndarray:
    """a * b div c without overflow."""
    if not len(a) or int(a.max()) * b < 1 << 63:
        return a * b // c
    return np.array([int(x) * b // c for x in a.tolist()], dtype=np.int64)


class Searcher:
    """The best documents of a task for every item of a block."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, top: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.top = items, weights, n_docs, n_terms, top
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in items]
        self.rows = int(np.clip(BITMAP_BYTES * 8 // max(1, len(weights)), 256, GROUP_ROWS))

    def groups(self, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """First and end row of runs of documents; one document at least."""
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            fits = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + GROUP_POSTINGS, side="right"))
            end = min(max(fits, at + 1), at + self.rows)
            yield at, end
            at = end

    def group(self, ids: np.ndarray, known: np.ndarray, totals: np.ndarray, owners: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Search documents; ``owners``, ``terms`` and ``counts`` are their postings."""
        m = 25 + _muldiv(75 * totals, self.n_docs, self.n_terms)
        gain = self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m[owners]))
        order = np.argsort(terms, kind="stable")
        terms, owners, gain = terms[order], owners[order], gain[order]
        first = np.searchsorted(terms, np.arange(len(self.weights) + 1))
        present = np.flatnonzero(np.diff(first))
        bitmaps = np.zeros((len(present), len(ids) // 8 + 1), dtype=np.uint8)
        place = np.full(len(self.weights), -1)
        place[present] = np.arange(len(present))
        # A document has a term once, so adding its bit sets it.
        np.add.at(bitmaps, (place[terms], owners >> 3), np.uint8(128) >> (owners & 7).astype(np.uint8))
        most = np.zeros(len(self.weights), dtype=np.int64)
        most[present] = np.maximum.reduceat(gain, first[present]) if len(present) else 0
        for number, (wanted, repeats) in enumerate(self.items):
            here = place[wanted] >= 0
            wanted, repeats = wanted[here], repeats[here]
            if len(wanted):
                masks, bounds = self._masks(bitmaps[place[wanted]], most[wanted] * repeats, len(ids))
                self._search(number, ids, known, owners, gain, first, wanted, repeats, masks, bounds)

    @staticmethod
    def _masks(bitmaps: np.ndarray, most: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each document's mask as a number, and each mask's highest possible score (0: no term)."""
        masks, bounds = np.zeros(rows, dtype=np.int64), np.zeros(1, dtype=np.int64)
        for at in range(0, len(bitmaps), 32):
            part = np.unpackbits(bitmaps[at:at + 32], axis=1, count=rows)
            words = np.zeros(rows, dtype=np.int64)
            for k, row in enumerate(np.packbits(part, axis=0, bitorder="little")):
                words |= row.astype(np.int64) << (8 * k)
            distinct, masks = np.unique(masks << 32 | words, return_inverse=True)
            matched = (distinct[:, None] >> np.arange(len(part))) & 1
            bounds = bounds[distinct >> 32] + matched @ most[at:at + 32]
        return masks, bounds

    def _search(self, number, ids, known, owners, gain, first, wanted, repeats, masks, bounds) -> None:
        by_mask = np.argsort(masks, kind="stable")
        starts = np.searchsorted(masks[by_mask], np.arange(len(bounds) + 1))
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        scores, done, step = None, 0, 1
        while done < len(order):
            best = self.best[number]
            floor = int(best[0][self.top - 1]) if len(best[0]) >= self.top else 0
            take = order[done:done + step]
            take = take[bounds[take] >= floor]
            if not len(take):
                return
            if scores is None:  # this item's postings, by document
                spans = [slice(first[t], first[t + 1]) for t in wanted]
                rows = np.concatenate([owners[s] for s in spans])
                values = np.concatenate([gain[s] * r for s, r in zip(spans, repeats, strict=True)])
                sort = np.argsort(rows, kind="stable")
                values = np.concatenate([[0], np.cumsum(values[sort])])
                edges = np.searchsorted(rows[sort], np.arange(len(ids) + 1))
                scores = values[edges[1:]] - values[edges[:-1]]
            rows = np.concatenate([by_mask[starts[g]:starts[g + 1]] for g in take])
            rows = rows[scores[rows] >= max(floor, 1)]
            self._keep(number, scores[rows], known[rows], ids[rows])
            done, step = done + step, min(step * 2, 1024)

    def _keep(self, number: int, scores: np.ndarray, known: np.ndarray, ids: np.ndarray) -> None:
        joined = [np.concatenate(pair) for pair in zip(self.best[number], (scores, known, ids), strict=True)]
        order = np.lexsort((joined[2], ~joined[1].astype(bool), -joined[0]))[:self.top]
        self.best[number] = tuple(column[order] for column in joined)


def _search_block(docs: DataFrame, block: list[tuple[object, Counter]], top: int, id_col: str, text_col: str) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    for _, terms in block:
        for term in terms:
            vocabulary.setdefault(term, len(vocabulary))
    if not vocabulary:
        return None
    table = cut_lineage(postings(docs, vocabulary, id_col, text_col))
    total = table.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    held_by = np.zeros(len(vocabulary), dtype=np.int64)
    for row in table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toLocalIterator():
        held_by[row["term"]] = row["n"]
    weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * df + 1))) for df in held_by.tolist()], dtype=np.int64)
    items = [(np.array([vocabulary[t] for t in terms], dtype=np.int64), np.array(list(terms.values()), dtype=np.int64)) for _, terms in block]
    held = spark.sparkContext.broadcast((items, weights, total["docs"], total["terms"], top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*held.value)
        for batch in batches:
            for at, end in searcher.groups(batch.column("terms").value_lengths().to_numpy()):
                part = batch.slice(at, end - at)
                ids, terms, counts = part.column("doc_id"), part.column("terms"), part.column("counts")
                owners = np.repeat(np.arange(part.num_rows), terms.value_lengths().to_numpy())
                searcher.group(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), part.column("n").to_numpy(),
                               owners, terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64))
        found = [(number, score, known, doc) for number, best in enumerate(searcher.best) for score, known, doc in zip(*best, strict=True)]
        if found:
            item, score, known, doc = (np.array(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=known == 0), pa.array(score, pa.int64())],
                                             ["item", "doc_id", "score"])

    best_first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = table.mapInArrow(run, HITS).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(number, name) for number, (name, _) in enumerate(block)], "item int, item_id long")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text") -> DataFrame:
    """The ``top`` documents of every item: item_id, rank, doc_id, score.

    A null or empty text has no terms: such a document is never found and does not count in
    the statistics, such an item has no rows. Every row is a document or an item of its own:
    repeated rows tie, equal scores are ordered by id, null ids last. Other columns are not
    read. Without documents or items the result is empty.
    """
    found = None
    for block in _blocks(items, item_col, item_text_col):
        hits = _search_block(docs, block, top, id_col, text_col)
        if hits is not None:
            found = hits if found is None else found.unionAll(hits)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
tf AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, total GROUP BY term),
s AS (
    SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM q JOIN tf USING (term) JOIN w USING (term), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""
