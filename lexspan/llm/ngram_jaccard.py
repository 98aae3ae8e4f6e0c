"""N-gram Jaccard join (operator 1): which documents share three quarters of their shingles.

The documents are the rows and the shingles the columns of a sparse incidence matrix.
Documents with one and the same set are one row (a class). Blocks of columns are
multiplied, and overlap counts are accumulated only where a size-derived bound leaves
something to find:

1. *Columns.* Tasks send each shingle, cut to 32 bits within its block of columns, and the
   class that has it. A shingle that several classes of a task share is sent once as a
   marker, so a frequent one costs a row per task and not one per document. The block
   returns the entries of shingles that two classes or more have. A shingle that only one
   class has adds to no overlap. Cut hashes may take two shingles for one, which only
   returns more entries than needed.
2. *Rows.* Two sets link only if they share a shingle among the first n - ceil(3n/4) + 1 of
   each, in any order common to all. Unshared shingles come first, frequent ones last, so
   most documents have no shared shingle there and are done.
3. *Stars.* In every column the entries are compared with one pivot. Copies by the
   thousand become one component by as many comparisons.
4. *Product.* Columns that still hold several components are multiplied block by block.
   Sets that link share ceil(3(n+m)/7) shingles, and the first column they share has all
   of them at or behind its places in both lists: pairs in different components whose places
   leave less are discarded, and so are pairs whose parities differ too often: every class
   has SKETCH_BITS bits, each the parity of the number of its shingles that fall there, and
   a shingle of only one of two sets turns one bit, so sets differ in as many shingles as
   bits at least. For the others the overlap is accumulated over the whole sets of 64-bit
   hashes.

Nothing is capped: the order of shingles and the pivots decide only how much work it takes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexspan.llm import bytespans as B
from lexspan.llm.common import cut_lineage, shuffle_partitions
from lexspan.llm.components import components

SHINGLE_WORDS, PERCENT = 5, 75
# Postings a task holds before it sends them; documents at most, so that two bytes name one.
FLUSH_POSTINGS, FLUSH_DOCS = 1_500_000, 60_000
# A column with as many entries goes to the end of the order; at most so many do, the most
# frequent ones, which bounds what tasks are sent.
FREQUENT, MOST_FREQUENT = 64, 1_000_000
# Bits of the parities of a class, a multiple of 64.
SKETCH_BITS = 1024
# Rounds with further pivots before the product.
MORE_STARS = 1

SETS = "doc_id long, tie long, n_shingles long, class long, class_check long, merged long"


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes, their text numbers, class of each text)."""
    for first, end, data, offsets in B.slices(column):
        starts, ends, texts = B.word_spans(data, offsets)
        n = end - first
        if not len(starts):
            yield first, end, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((n, 2), np.uint64)
            continue
        words = B.span_hashes(B.LOWER[data], starts, ends)
        hashes, owners = B.sorted_distinct(*B.shingle_hashes(words, texts, size))
        bounds = np.searchsorted(owners, np.arange(n + 1))
        sums = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
        np.cumsum(hashes, out=sums[0, 1:])
        np.cumsum(B.mix(hashes + np.uint64(99)), out=sums[1, 1:])
        classes = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
        yield first, end, hashes, owners, B.mix(classes + np.diff(bounds).astype(np.uint64)).T


def _columns(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Column number: block above, 32 bits of the hash below."""
    return ((hashes >> np.uint64(32)) % np.uint64(blocks) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and a hash of their text, which tells apart the texts of one id."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, blocks: int, size: int = SHINGLE_WORDS) -> DataFrame:
    """Per document: size of its set, its class (the set's digest in two parts) and how
    many of its shingles share a column with another one of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, merged = [], [], []
            for first, end, hashes, owners, keys in _sets(batch.column("text"), size):
                n = end - first
                counts.append(np.bincount(owners, minlength=n))
                columns = B.sorted_distinct(_columns(hashes, blocks), owners)[1]
                merged.append(counts[-1] - np.bincount(columns, minlength=n))
                classes.append(keys)
            if counts:
                keys = np.concatenate(classes).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("tie"), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(keys[:, 0].copy()),
                     pa.array(keys[:, 1].copy()), pa.array(np.concatenate(merged).astype(np.int64))],
                    ["doc_id", "tie", "n_shingles", "class", "class_check", "merged"])

    return _rows(docs, id_col, text_col).mapInArrow(run, SETS)


POSTINGS = "g int, block int, kind int, columns binary, rows binary, classes binary"
SINGLE, MARKER, SHARED = 0, 1, 2


def _send(columns: np.ndarray, classes: np.ndarray, blocks: int, flush: int) -> Iterator[tuple]:
    """Rows for the postings of one flush."""
    columns, classes = B.sorted_distinct(classes, columns)[::-1]
    new = np.ones(len(columns), dtype=bool)
    new[1:] = columns[1:] != columns[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(columns)))
    single = np.repeat(counts == 1, counts)
    if not single.all():
        table, index = np.unique(classes[~single], return_inverse=True)
        # Already known to be shared: no block has to see them, so any task takes them.
        yield blocks + flush % blocks, -1, SHARED, columns[~single].tobytes(), index.astype(np.uint16).tobytes(), table.tobytes()
    for kind, cols, owners in ((SINGLE, columns[single], classes[single]), (MARKER, columns[starts[counts > 1]], None)):
        block_of = (cols >> np.uint64(32)).astype(np.int64)
        bounds = np.searchsorted(block_of, np.arange(blocks + 1))
        for block in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[block], bounds[block + 1])
            cut = (cols[part] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes()
            if owners is None:
                yield block, block, kind, cut, None, None
            else:
                table, index = np.unique(owners[part], return_inverse=True)
                yield block, block, kind, cut, index.astype(np.uint16).tobytes(), table.tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      ["g", "block", "kind", "columns", "rows", "classes"])


def _post(blocks: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        flush = TaskContext.get().partitionId()
        held, docs = [], 0
        for batch in batches:
            for first, end, hashes, owners, keys in _sets(batch.column("text"), size):
                held.append((_columns(hashes, blocks), keys[owners, 0]))
                docs += end - first
                if docs >= FLUSH_DOCS // 2 or sum(len(h[0]) for h in held) >= FLUSH_POSTINGS:
                    yield from _flush(held, blocks, flush)
                    held, docs, flush = [], 0, flush + 7919
        if held:
            yield from _flush(held, blocks, flush)

    return run


def _flush(held: list, blocks: int, flush: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in _send(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), blocks, flush):
        rows.append(row)
        size += len(row[3])
        if size > 1 << 22:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _shared_entries(group: pa.Table) -> pa.Table:
    """Entries of one block's columns that two classes or more have."""
    singles, single_classes, markers, found, found_classes = [], [], [], [], []
    block = 0
    for k in range(group.num_rows):
        kind, cut = group["kind"][k].as_py(), group["columns"][k].as_py()
        if kind == MARKER:
            markers.append(np.frombuffer(cut, np.uint32))
            block = group["block"][k].as_py()
            continue
        classes = np.frombuffer(group["classes"][k].as_py(), np.uint64)[np.frombuffer(group["rows"][k].as_py(), np.uint16)]
        if kind == SHARED:
            found.append(np.frombuffer(cut, np.uint64))
            found_classes.append(classes)
        else:
            block = group["block"][k].as_py()
            singles.append(np.frombuffer(cut, np.uint32))
            single_classes.append(classes)
    if singles:
        classes, columns = B.sorted_distinct(np.concatenate(single_classes), np.concatenate(singles))
        shared = np.zeros(len(columns), dtype=bool)
        shared[1:] = columns[1:] == columns[:-1]
        shared[:-1] |= shared[1:].copy()
        if markers:
            shared |= np.isin(columns, np.concatenate(markers))
        found.append(columns[shared].astype(np.uint64) | np.uint64(block << 32))
        found_classes.append(classes[shared])
    empty = [np.zeros(0, np.uint64)]
    return pa.table({"column": np.concatenate(found or empty).view(np.int64), "class": np.concatenate(found_classes or empty).view(np.int64)})


def _prefixes(frequent):
    """Entries among the first n - ceil(3n/4) + 1 shingles of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        for batch in batches:
            columns, classes, sizes, spare, places, lengths = [], [], [], [], [], []
            for klass, n, merged, entries in zip(*(batch.column(k) for k in ("class", "n_shingles", "merged", "entries")), strict=True):
                n, merged = n.as_py(), merged.as_py()
                own = np.sort(entries.values.to_numpy())
                late = np.isin(own, last, assume_unique=True)
                own = np.concatenate([own[~late], own[late]])
                reach = n - (-(-n * PERCENT // 100)) + 1 + merged
                length = len(own)
                own = own[:max(0, reach - (n - merged - length))]
                columns.append(own)
                classes.append(np.full(len(own), klass.as_py()))
                sizes.append(np.full(len(own), n))
                spare.append(np.full(len(own), merged))
                places.append(np.arange(len(own)))
                lengths.append(np.full(len(own), length))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (columns, classes, sizes, spare, places, lengths)],
                                                 ["column", "class", "n", "merged", "place", "listed"])

    return run


def _least_share(small: str, large: str):
    return F.col(small) * 100 >= F.col(large) * PERCENT


def _within_bounds(n, m, listed, other_listed, place, other_place, merged):
    """Whether two sets that share the entries at these places of their lists of shared
    shingles can still link: what precedes in both lists, the entry and what follows in both."""
    reach = F.least(place, other_place) + 1 + F.least(F.col(listed) - F.col(place), F.col(other_listed) - F.col(other_place)) - 1 + F.col(merged)
    needed = F.ceil((F.col(n) + F.col(m)) * PERCENT / (100 + PERCENT))
    return _least_share(n, m) & _least_share(m, n) & (reach >= needed)


def _apart(prefixes: DataFrame, known: DataFrame) -> DataFrame:
    """Entries, with their component, of the columns that hold several components."""
    placed = prefixes.join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    apart = placed.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("column")
    return cut_lineage(placed.join(apart, "column", "left_semi"))


def _as_links(known: DataFrame) -> DataFrame:
    """Components as the links (a, b) of each node to the least one."""
    return known.where("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def parities(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities of a set, as longs."""
    bits = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _product(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a column, as far as bounds let them link."""
    salts, longs = 8, range(SKETCH_BITS // 64)
    rows = rows.join(sets.select("class", "parities"), "class")
    bits = lambda side: [F.col("parities")[k].alias(f"{side}{k}") for k in longs]
    left = rows.select("column", F.pmod("class", F.lit(salts)).alias("salt"), F.col("class").alias("a"), F.col("n").alias("na"),
                       F.col("merged").alias("ma"), F.col("component").alias("ca"), F.col("place").alias("pa"), F.col("listed").alias("la"), *bits("sa"))
    right = rows.select("column", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])).alias("salt"), F.col("class").alias("b"),
                        F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("place").alias("pb"), F.col("listed").alias("lb"), *bits("sb"))
    # The first column that two sets share has all they share at or behind it in both lists.
    needed = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))
    follows = F.least(F.col("la") - F.col("pa"), F.col("lb") - F.col("pb")) + F.col("ma")
    # Sets that link differ in (100 - PERCENT) / (100 + PERCENT) of their shingles at most.
    apart = reduce(add, [F.bit_count(F.col(f"sa{k}").bitwiseXOR(F.col(f"sb{k}"))) for k in longs])
    return (left.join(right, ["column", "salt"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _least_share("na", "nb")
                                                       & _least_share("nb", "na") & (follows >= needed)
                                                       & (apart * (100 + PERCENT) <= (F.col("na") + F.col("nb")) * (100 - PERCENT)))
            .select("a", "b").distinct())


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets are alike enough."""
    left = sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    return (pairs.join(left, "a").join(right, "b")
            .where(both * 100 >= (F.size("ha") + F.size("hb") - both) * PERCENT).select("a", "b"))


def _whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column("class").to_numpy()
            for first, _, hashes, owners, keys in _sets(batch.column("text"), size):
                bounds = np.searchsorted(owners, np.arange(len(keys) + 1))
                hit = np.flatnonzero(keys[:, 0].view(np.int64) == want[first:first + len(keys)])
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[hit, 0].view(np.int64)),
                         pa.array([hashes[bounds[k]:bounds[k + 1]].view(np.int64) for k in hit], pa.list_(pa.int64())),
                         pa.array([parities(hashes[bounds[k]:bounds[k + 1]]) for k in hit], pa.list_(pa.int64()))], ["class", "hashes", "parities"])

    rows = _rows(docs, id_col, text_col)
    same = rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["tie"] == wanted["tie"])
    return (rows.join(wanted, same).select("class", "text").mapInArrow(run, "class long, hashes array<long>, parities array<long>")
            .groupBy("class").agg(F.first("hashes").alias("hashes"), F.first("parities").alias("parities")))


def _in_order():
    """What orders rows: ids that are not null come first."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id"), F.col("tie"))


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents with the class of their set, pairs (a, b) of classes). The pairs connect
    exactly the classes that all links together would connect."""
    spark = docs.sparkSession
    blocks = 4 * shuffle_partitions(spark)
    sets = cut_lineage(shingle_sets(docs, id_col, text_col, blocks, size))
    reps = (sets.where("n_shingles > 0").groupBy("class").agg(
        F.min(_in_order()).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("merged").alias("merged"))
        .select("class", "first.doc_id", "first.tie", "n_shingles", "merged"))
    entries = (docs.select(F.col(text_col).alias("text")).mapInArrow(_post(blocks, size), POSTINGS)
               .groupBy("g").applyInArrow(_shared_entries, "column long, class long"))
    listed = entries.groupBy("class").agg(F.collect_set("column").alias("entries"))
    shared = F.size("entries")
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * PERCENT / 100) + 1 + F.col("merged")
    alive = cut_lineage(listed.join(reps, "class").where(F.col("n_shingles") - F.col("merged") - shared < first))
    counts = alive.select(F.explode("entries").alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= FREQUENT)
    counts = cut_lineage(counts)
    # The least df that leaves no more than MOST_FREQUENT columns, from counts by power of two.
    steps = counts.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("power")).collect()
    least, total = FREQUENT, 0
    for row in steps:
        total += row["n"]
        if total > MOST_FREQUENT:
            least = 1 << (row["power"] + 1)
            break
    late = np.sort(np.array([r["column"] for r in counts.where(F.col("df") >= least).select("column").collect()], dtype=np.int64))
    prefixes = cut_lineage(alive.mapInArrow(_prefixes(spark.sparkContext.broadcast(late)), "column long, class long, n long, merged long, place long, listed long"))
    whole = cut_lineage(_whole_sets(docs, alive.select("doc_id", "tie", "class"), id_col, text_col, size))
    # Stars: every entry of a column against one of its classes.
    pivots = prefixes.groupBy("column").agg(F.min(F.struct("class", "n")).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    stars = (prefixes.join(pivots, "column").select(F.col("p.class").alias("a"), F.col("class").alias("b"), F.col("p.n").alias("x"), "n")
             .where((F.col("a") != F.col("b")) & _least_share("x", "n") & _least_share("n", "x")).select("a", "b").distinct())
    known = components(_linked(stars, whole))
    open_rows = _apart(prefixes, known)
    # A few more pivots, others for each of four sets of columns, for what is still apart.
    for turn in range(MORE_STARS):
        lot = F.xxhash64("class", F.pmod("column", F.lit(4)), F.lit(turn))
        pivots = open_rows.groupBy("column").agg(F.min_by(F.struct("class", "n", "component", "place", "listed"), lot).alias("p"))
        stars = (open_rows.join(pivots, "column")
                 .where((F.col("p.component") != F.col("component")) & _within_bounds("p.n", "n", "p.listed", "listed", "p.place", "place", "merged"))
                 .select(F.greatest("p.class", "class").alias("a"), F.least("p.class", "class").alias("b")).distinct())
        known = components(_as_links(known).unionByName(_linked(stars, whole)))
        open_rows = _apart(prefixes, known)
    # Product of what is still apart, column by column.
    return sets, _as_links(known).unionByName(_linked(_product(open_rows, whole), whole))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    A null or empty text, or one without words, has an empty set and is linked with
    nothing. Rows with a null id take part; a component's id is its smallest id that is not
    null. Repeated rows have the same set and so the same component. An empty table gives
    no rows. Other columns are not read.
    """
    sets, by_class = _labelled(docs, id_col, text_col, size)
    least = by_class.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = by_class.join(least, "component").select("class", "component_id")
    named = sets.join(labels, "class", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows with the class of their set, classes with their component and least id)."""
    sets, links = classes_and_links(docs, id_col, text_col, size)
    found = components(links)
    by_class = (sets.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
                .join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")))
    return sets, cut_lineage(by_class)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each component with all its columns: the one of the least id, null ids
    last, then the least hash of its text. Of rows that repeat both, one stays. Rows whose
    text is null, empty or without words all stay. An empty table gives no rows."""
    sets, by_class = _labelled(docs, id_col, text_col, size)
    rows = sets.where("n_shingles > 0").join(by_class.select("class", "component"), "class").groupBy("component", "doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min_by("n", _in_order()).alias("__n"), F.min(_in_order()).alias("f"))
    first = cut_lineage(first.select(F.col("f.doc_id").alias("__id"), F.col("f.tie").alias("__tie"), "__n"))
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    found = (docs.where(words).select(whole, F.col(id_col).cast("long").alias("__own"), F.xxhash64(text_col).alias("__hash"))
             .join(first, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__tie"))))
    repeated = found.where("__n > 1").groupBy("__id", "__tie").agg(F.any_value("__row").alias("__row"))
    return docs.where(~words).unionByName(found.where("__n = 1").select("__row.*")).unionByName(repeated.select("__row.*"))
